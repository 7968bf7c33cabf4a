"""Exact pseudo-random subsets per class without ranking a class in one task.

Rows are ordered by a seeded hash of their id. The hash's leading digits cut
each class into buckets of near-equal size; a table of bucket counts (at most
``16 ** digits`` rows per class) tells which bucket the wanted number of rows
ends in, so only that one bucket is ranked row by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

DIGITS = 4
MAX_CLASSES = 1000
ORDER, BUCKET = "_order", "_bucket"


def seeded_order(id_column: str, seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.col(id_column).cast("string"), F.lit(str(seed))))


def _with_order(df: DataFrame, id_column: str, seed: int, digits: int) -> DataFrame:
    return df.withColumn(ORDER, seeded_order(id_column, seed)).withColumn(
        BUCKET, F.substring(ORDER, 1, digits)
    )


def _bucket_counts(ordered: DataFrame, label: str) -> DataFrame:
    counts = ordered.groupBy(label, BUCKET).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(label).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))


def class_counts(df: DataFrame, label: str) -> dict:
    """Rows per class. A label has few values by nature; one that has more than
    ``MAX_CLASSES`` is refused before its values reach the driver."""
    counts = df.groupBy(label).count()
    if counts.agg(F.count(F.lit(1)).alias("n")).first()["n"] > MAX_CLASSES:
        raise ValueError(f"{label} has more than {MAX_CLASSES} values: it is no class label")
    return {r[0]: r[1] for r in counts.collect()}


def take_per_class(
    df: DataFrame, label: str, id_column: str, quotas: dict, seed: int = 42, digits: int = DIGITS
) -> tuple[DataFrame, DataFrame]:
    """Split into (the first ``quotas[class]`` rows of each class in hash order, the rest)."""
    ordered = _with_order(df, id_column, seed, digits)
    quota = F.coalesce(*[F.when(F.col(label) == F.lit(k), F.lit(v)) for k, v in quotas.items()], F.lit(0))
    edge = (
        _bucket_counts(ordered, label)
        .withColumn("_quota", quota)
        .filter((F.col("_before") < F.col("_quota")) & (F.col("_before") + F.col("_n") >= F.col("_quota")))
        .select(label, F.col(BUCKET).alias("b"), (F.col("_quota") - F.col("_before")).alias("left"))
        .collect()
    )  # at most one row per class

    def per_class(values: dict, default) -> Column:
        cases = [F.when(F.col(label) == F.lit(k), F.lit(v)) for k, v in values.items()]
        return F.coalesce(*cases, F.lit(default))

    border = per_class({r[0]: r["b"] for r in edge}, "")
    left = per_class({r[0]: r["left"] for r in edge}, 0)
    inside, on_edge, outside = F.col(BUCKET) < border, F.col(BUCKET) == border, F.col(BUCKET) > border
    rank = F.row_number().over(Window.partitionBy(label, BUCKET).orderBy(ORDER, id_column))
    ranked = ordered.filter(on_edge).withColumn("_rank", rank).withColumn("_left", left)
    helpers = [ORDER, BUCKET, "_rank", "_left"]
    taken = ordered.filter(inside).drop(ORDER, BUCKET).unionByName(
        ranked.filter("_rank <= _left").drop(*helpers)
    )
    rest = ordered.filter(outside).drop(ORDER, BUCKET).unionByName(
        ranked.filter("_rank > _left").drop(*helpers)
    )
    return taken, rest


def class_rank(df: DataFrame, label: str, id_column: str, seed: int = 42, digits: int = DIGITS) -> DataFrame:
    """Add ``class_rank``: 1, 2, ... within each class in hash order."""
    ordered = _with_order(df, id_column, seed, digits)
    before = _bucket_counts(ordered, label).select(label, BUCKET, "_before")
    rank = F.row_number().over(Window.partitionBy(label, BUCKET).orderBy(ORDER, id_column))
    return (
        ordered.withColumn("_rank", rank)
        .join(before, [label, BUCKET])
        .withColumn("class_rank", F.col("_before") + F.col("_rank"))
        .drop(ORDER, BUCKET, "_rank", "_before")
    )
