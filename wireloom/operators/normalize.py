"""From parsed sensor lines to flat, typed events: one filter and one projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from wireloom.functions.scalars import (
    long_or_zero,
    port_or_zero,
    text_or,
    timestamp_of,
    timestamp_or_epoch,
)
from wireloom.sources.events import CORRUPT

EVENT_TYPES = ["flow", "http", "dns", "tls", "fileinfo", "ssh"]


def is_malformed() -> Column:
    return F.col(CORRUPT).isNotNull()


def is_flagged() -> Column:
    return F.col("alert").isNotNull()


def is_known() -> Column:
    return F.coalesce(F.col("event_type").isin(EVENT_TYPES), F.lit(False))


def drop_malformed(raw: DataFrame) -> DataFrame:
    return raw.filter(~is_malformed())


def drop_flagged(raw: DataFrame) -> DataFrame:
    """Events a signature has already matched are someone else's business."""
    return raw.filter(~is_flagged())


def line_metrics() -> list[Column]:
    """Lines by fate, as aggregates: for a pass of their own, or observed on the way."""
    usable = ~is_malformed() & ~is_flagged()
    return [
        F.count(F.lit(1)).alias("total_entries"),
        F.count_if(is_malformed()).alias("malformed"),
        F.count_if(~is_malformed() & is_flagged()).alias("flagged"),
        F.count_if(usable & ~is_known()).alias("ignored"),
        F.count_if(usable & is_known()).alias("processed_events"),
    ]


def line_counts(raw: DataFrame) -> DataFrame:
    """One row: lines by fate."""
    return raw.agg(*line_metrics())


def dns_answers() -> Column:
    """Names first, then addresses."""
    empty = F.array().cast("array<string>")
    return F.concat(F.coalesce("dns.grouped.CNAME", empty), F.coalesce("dns.grouped.A", empty))


FATE = "fate"


def fate() -> Column:
    """What becomes of a line."""
    return (
        F.when(is_malformed(), "malformed").when(is_flagged(), "flagged").when(is_known(), "processed").otherwise("ignored")
    )


def fated_events(raw: DataFrame) -> DataFrame:
    """Every line with its ``fate`` and, where it is processed, its event. Written once,
    the table gives both the events and the counters, so that lines are parsed once."""
    return _flattened(raw, fate().alias(FATE))


def processed_events(fated: DataFrame) -> DataFrame:
    return fated.filter(F.col(FATE) == "processed").drop(FATE)


def fate_counts(fated: DataFrame) -> DataFrame:
    """One row: lines by fate, as ``line_counts`` has them, from one narrow column."""
    kinds = {"malformed": "malformed", "flagged": "flagged", "ignored": "ignored", "processed_events": "processed"}
    return fated.agg(
        F.count(F.lit(1)).alias("total_entries"), *[F.count_if(F.col(FATE) == kind).alias(name) for name, kind in kinds.items()]
    )


def normalize_events(raw: DataFrame) -> DataFrame:
    """Keep the six event types and flatten them; fields of other types are null.

    ``seq`` orders events of equal time: an existing ``seq`` column is kept,
    otherwise it is a hash of the whole line.
    """
    return _flattened(drop_malformed(raw).filter(is_known()))


def _flattened(raw: DataFrame, *more: Column) -> DataFrame:

    def only(event_type: str, value: Column) -> Column:
        return F.when(F.col("event_type") == event_type, value)

    def text(event_type: str, field: str) -> Column:
        return only(event_type, text_or(F.col(f"{event_type}.{field}")))

    def number(event_type: str, field: str) -> Column:
        return only(event_type, long_or_zero(F.col(f"{event_type}.{field}")))

    stamp = timestamp_of(F.col("timestamp"))
    seq = F.col("seq") if "seq" in raw.columns else F.xxhash64(*[c for c in raw.columns if c != CORRUPT])
    fwd_pkts, bwd_pkts = number("flow", "pkts_toserver"), number("flow", "pkts_toclient")
    fwd_bytes, bwd_bytes = number("flow", "bytes_toserver"), number("flow", "bytes_toclient")
    return raw.select(
        *more,
        "event_type",
        F.coalesce("flow_id", F.lit("None")).alias("flow_id"),
        "src_ip",
        port_or_zero(F.col("src_port")).alias("src_port"),
        F.col("dest_ip").alias("dst_ip"),
        port_or_zero(F.col("dest_port")).alias("dst_port"),
        "proto",
        "app_proto",
        stamp.alias("event_ts"),
        seq.alias("seq"),
        only("flow", F.coalesce(timestamp_or_epoch(F.col("flow.start")), stamp)).alias("start_ts"),
        only("flow", F.coalesce(timestamp_or_epoch(F.col("flow.end")), stamp)).alias("end_ts"),
        fwd_pkts.alias("fwd_pkts"),
        bwd_pkts.alias("bwd_pkts"),
        fwd_bytes.alias("fwd_bytes"),
        bwd_bytes.alias("bwd_bytes"),
        (fwd_pkts + bwd_pkts).alias("pkts"),
        (fwd_bytes + bwd_bytes).alias("bytes"),
        text("flow", "state").alias("state"),
        text("http", "http_method").alias("http_method"),
        text("http", "hostname").alias("http_host"),
        text("http", "url").alias("http_uri"),
        text("http", "http_user_agent").alias("http_user_agent"),
        text("http", "status").alias("http_status"),
        text("http", "protocol").alias("http_version"),
        number("http", "request_body_len").alias("http_request_length"),
        number("http", "length").alias("http_response_length"),
        text("dns", "rrname").alias("dns_query"),
        text("dns", "ttl").alias("dns_ttl"),
        text("dns", "rrtype").alias("dns_rrtype"),
        only("dns", dns_answers()).alias("dns_answers"),
        text("tls", "version").alias("tls_version"),
        text("tls", "subject").alias("tls_subject"),
        text("tls", "issuerdn").alias("tls_issuer"),
        text("tls", "sni").alias("tls_sni"),
        text("tls", "notbefore").alias("tls_not_before"),
        text("tls", "notafter").alias("tls_not_after"),
        number("fileinfo", "size").alias("file_size"),
        text("ssh", "client.software_version").alias("ssh_client"),
        text("ssh", "client.proto_version").alias("ssh_client_proto"),
        text("ssh", "server.software_version").alias("ssh_server"),
    )
