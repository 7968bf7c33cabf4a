"""Feature vectors of sessions: nine flow features and the application-layer flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from wireloom.functions.scalars import MICROS, ratio, timestamp_or_epoch
from wireloom.operators.sessions import APP_TYPES, SESSION_KEY

BASE_FEATURES = [
    "dest_port", "duration", "total_fwd_packets", "total_bwd_packets", "total_fwd_bytes",
    "total_bwd_bytes", "flow_bytes_per_sec", "flow_packets_per_sec", "down_up_ratio",
]
INTEGER_FEATURES = [
    "dest_port", "total_fwd_packets", "total_bwd_packets", "total_fwd_bytes", "total_bwd_bytes",
]
# --- fixed values: names a feature may have in the input, in order of preference ---
CANDIDATES = {
    "dest_port": ["dport", "dst_port", "dest_port"],
    "duration": ["dur", "duration", "flow.duration"],
    "total_fwd_packets": ["spkts", "pkts_toserver", "flow.pkts_toserver", "total_fwd_packets"],
    "total_bwd_packets": ["dpkts", "pkts_toclient", "flow.pkts_toclient", "total_bwd_packets"],
    "total_fwd_bytes": ["sbytes", "bytes_toserver", "flow.bytes_toserver", "total_fwd_bytes"],
    "total_bwd_bytes": ["dbytes", "bytes_toclient", "flow.bytes_toclient", "total_bwd_bytes"],
    "start": ["starttime", "start_ts"],
    "end": ["endtime", "end_ts"],
}
AUTH_CODES = ["401", "403", "407"]
# --- end of fixed values ---


def _has_path(schema: T.StructType, path: str) -> bool:
    node: T.DataType = schema
    for part in path.split("."):
        if not isinstance(node, T.StructType) or part not in node.fieldNames():
            return False
        node = node[part].dataType
    return True


def resolve_fields(df: DataFrame) -> dict[str, list[str]]:
    """Which candidate columns exist, decided once from the schema. A nested
    ``flow`` field, where there is one, goes before the flat names."""
    found = {
        feature: [p for p in paths if _has_path(df.schema, p)] for feature, paths in CANDIDATES.items()
    }
    return {f: sorted(paths, key=lambda p: "." not in p) for f, paths in found.items()}


def _number(paths: list[str], kind: str) -> Column:
    return F.coalesce(*[F.col(p).try_cast(kind) for p in paths], F.lit(0).cast(kind))


def _instant(df: DataFrame, path: str) -> Column:
    node: T.DataType = df.schema
    for part in path.split("."):
        node = node[part].dataType
    if isinstance(node, (T.TimestampType, T.TimestampNTZType)):
        return F.col(path).cast("timestamp")
    return timestamp_or_epoch(F.col(path).cast("string"))


def _span(df: DataFrame, start: list[str], end: list[str]) -> Column:
    if not start or not end:
        return F.lit(None).cast("double")
    return (
        F.unix_micros(_instant(df, end[0])) - F.unix_micros(_instant(df, start[0]))
    ) / float(MICROS)


def flow_features(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The nine flow features of any frame whose columns can be resolved.

    ``keep`` names columns carried along (by default the session key, where
    present). ``duration_known`` is 0 where neither a duration nor timestamps exist.
    """
    fields = resolve_fields(df)
    if keep is None:
        keep = [c for c in SESSION_KEY if c in df.columns]
    given = _number(fields["duration"], "double")
    nested = [
        [p] if _has_path(df.schema, p) else [] for p in ("flow.start", "flow.end")
    ]
    span = F.coalesce(_span(df, fields["start"], fields["end"]), _span(df, *nested))
    base = df.select(
        *keep,
        _number(fields["dest_port"], "bigint").alias("dest_port"),
        F.when(given > 0, given).otherwise(F.coalesce(span, F.lit(0.0))).alias("duration"),
        *[_number(fields[f], "bigint").alias(f) for f in INTEGER_FEATURES[1:]],
        ((given > 0) | span.isNotNull()).cast("int").alias("duration_known"),
    )
    floor = F.greatest("duration", F.lit(0.001))
    return base.withColumns(
        {
            "flow_bytes_per_sec": (F.col("total_fwd_bytes") + F.col("total_bwd_bytes")) / floor,
            "flow_packets_per_sec": (F.col("total_fwd_packets") + F.col("total_bwd_packets")) / floor,
            "down_up_ratio": ratio(F.col("total_bwd_bytes"), F.col("total_fwd_bytes")),
        }
    ).select(*keep, *BASE_FEATURES, "duration_known")


def app_feature_columns() -> dict[str, Column]:
    def flag(condition: Column) -> Column:
        return F.coalesce(condition, F.lit(False)).cast("int")

    codes = F.col("http_status_codes")
    counts = {t: F.col(f"{t}_event_count") for t in APP_TYPES}
    layers = sum(flag(c > 0) for c in counts.values())
    return {
        "http_event_count": counts["http"],
        "has_http": flag(counts["http"] > 0),
        "has_http_get": flag(F.array_contains("http_methods", "GET")),
        "has_http_post": flag(F.array_contains("http_methods", "POST")),
        "http_method_count": F.size("http_methods"),
        "has_http_error": flag(F.exists(codes, lambda c: c.startswith("4") | c.startswith("5"))),
        "has_http_auth_error": flag(F.arrays_overlap(codes, F.array(*[F.lit(c) for c in AUTH_CODES]))),
        "dns_event_count": counts["dns"],
        "has_dns": flag(counts["dns"] > 0),
        "dns_query_count": F.size("dns_queries"),
        "dns_answer_count": F.size("dns_answers"),
        "has_dns_failure": flag((counts["dns"] > 0) & (F.size("dns_answers") == 0)),
        "tls_event_count": counts["tls"],
        "has_tls": flag(counts["tls"] > 0),
        "tls_sni_count": F.size("tls_sni"),
        "ssh_event_count": counts["ssh"],
        "has_ssh": flag(counts["ssh"] > 0),
        "is_rejected": flag(F.col("state") == "rejected"),
        "is_established": flag(F.col("state") == "established"),
        "is_closed": flag(F.col("state").isin("closed", "fin")),
        "is_reset": flag(F.col("state") == "rst"),
        "app_layer_count": layers,
        "has_mixed_protocols": flag(layers > 1),
    }


def app_features(sessions: DataFrame) -> DataFrame:
    return sessions.select(*SESSION_KEY, *[c.alias(n) for n, c in app_feature_columns().items()])


def session_features(sessions: DataFrame, keep: list[str] = SESSION_KEY) -> DataFrame:
    """Flow and application features side by side, the nine flow features first."""
    extra = app_feature_columns()
    wide = sessions.select("*", *[c.alias(f"_f_{n}") for n, c in extra.items()])
    out = flow_features(wide, [*keep, *[f"_f_{n}" for n in extra]])
    return out.select(
        *keep, *BASE_FEATURES, "duration_known", *[F.col(f"_f_{n}").alias(n) for n in extra]
    )


def align_features(df: DataFrame, required: list[str] = BASE_FEATURES) -> DataFrame:
    """Required columns first and in order, absent or null ones as 0, then the rest."""
    first = [
        F.coalesce(F.col(c), F.lit(0)).alias(c) if c in df.columns else F.lit(0).alias(c) for c in required
    ]
    return df.select(*first, *[c for c in df.columns if c not in required])
