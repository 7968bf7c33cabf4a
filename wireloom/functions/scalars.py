"""Scalar helpers shared by the operators; all built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

MICROS = 1_000_000


def timestamp_of(text: Column) -> Column:
    """ISO text with or without fraction and offset; null when it is not a timestamp."""
    return F.try_to_timestamp(text)


def timestamp_or_epoch(text: Column) -> Column:
    """Epoch seconds (possibly fractional) or ISO text."""
    seconds = text.try_cast("double")
    return F.coalesce(
        F.timestamp_micros(F.round(seconds * MICROS).try_cast("bigint")),
        F.try_to_timestamp(text),
    )


def text_or(value: Column, default: str = "") -> Column:
    return F.coalesce(F.nullif(value, F.lit("")), F.lit(default))


def long_or_zero(value: Column) -> Column:
    return F.coalesce(value.try_cast("bigint"), F.lit(0).cast("bigint"))


def port_or_zero(value: Column) -> Column:
    return F.coalesce(value.try_cast("int"), F.lit(0))


def ratio(numerator: Column, denominator: Column, otherwise: float = 0.0) -> Column:
    """``numerator / denominator`` where the denominator is positive."""
    return F.when(denominator > 0, numerator / denominator).otherwise(F.lit(otherwise))


def ipv4_number(ip: Column) -> Column:
    """Dotted IPv4 as an integer; null for anything else, so that range tests on
    IPv6 or broken addresses are never true. ``ip`` is evaluated once."""
    start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).alias("seen"))

    def step(acc: Column, octet: Column) -> Column:
        number = F.when(octet.rlike(r"^\d{1,3}$"), octet.try_cast("bigint"))
        return F.struct(
            (acc["n"] * 256 + F.when(number <= 255, number)).alias("n"), (acc["seen"] + 1).alias("seen")
        )

    return F.aggregate(
        F.slice(F.split(ip, r"\."), 1, 5), start, step, lambda acc: F.when(acc["seen"] == 4, acc["n"])
    )


def hash_bucket(value: Column, buckets: int = 10_000) -> Column:
    """Stable bucket of a categorical value, from the leading digits of its MD5, so
    that other engines give the same; empty values share bucket 0."""
    text = value.cast("string")
    number = F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")
    return F.when(F.coalesce(text, F.lit("")) == "", F.lit(0).cast("bigint")).otherwise(F.pmod(number, F.lit(buckets)))
