"""Behaviour of source addresses over a sliding window.

Each closed session becomes one point on its source's time line, and every
window quantity becomes a stream of changes (+ when something enters the
window, - when it leaves) whose running sum is the quantity. All of them are
merged into one stream per source and summed in one pass of
``running.running_totals``, which cuts hot sources into pieces of time. The window
at a session holds what was seen at times ``t`` with ``now - window < t <= now``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from wireloom.functions.scalars import MICROS, ratio
from wireloom.operators.running import (
    CHUNK,
    TARGET_ROWS,
    activity_epochs,
    chunk_start,
    presence_changes,
    running_totals,
)
from wireloom.operators.sessions import SESSION_KEY, TERMINAL_STATES
from wireloom.sources.staging import materialize

ERROR_CODES = ["401", "403", "407"]
FAILED_STATES = ["rejected", "failed"]
WINDOW_SECONDS = 300
CHUNK_SECONDS = 60

APP_COUNTERS = [
    "http_requests", "http_errors", "dns_queries", "dns_failures",
    "tls_handshakes", "tls_failures", "ssh_attempts", "auth_failures",
]
SLIDING = {
    "ips_in_window": "d_ips",
    "ports_in_window": "d_ports",
    "bytes_in_window": "d_bytes",
    "packets_in_window": "d_packets",
    "max_auth_failures": "d_auth",
}
LIFETIME = {
    "total_flows": "l_flows",
    "rejected_flows": "l_rejected",
    "reset_flows": "l_reset",
    "unique_dst_ips": "l_ips",
    "unique_dst_ports": "l_ports",
    **{f"total_{c}": c for c in APP_COUNTERS},
}
SCORES = [
    "port_scan_score", "host_scan_score", "scan_score",
    "brute_force_score", "volume_anomaly_score", "overall_anomaly_score",
]
FEATURES = [
    "flow_rate", "complete_flow_ratio", "unique_dst_ips", "unique_dst_ports",
    "dst_ips_per_second", "dst_ports_per_second", "bytes_sent_per_second",
    "packets_sent_per_second", "http_error_ratio", "dns_failure_ratio",
    "tls_failure_ratio", "auth_failures_per_second", "rejected_ratio", "reset_ratio",
    "port_scan_score", "host_scan_score", "brute_force_score",
    "volume_anomaly_score", "overall_anomaly_score",
]


def app_counters(sessions: DataFrame) -> DataFrame:
    """Add the per-session application counters."""
    codes, failed = F.col("http_status_codes"), F.col("state").isin(FAILED_STATES)

    def both(count: str, condition: Column) -> Column:
        return ((F.col(count) > 0) & condition).cast("bigint")

    errors = F.size(F.filter(codes, lambda c: c.startswith("4") | c.startswith("5")))
    denied = F.size(F.filter(codes, lambda c: c.isin(ERROR_CODES)))
    return sessions.withColumns(
        {
            "http_requests": F.col("http_event_count"),
            "http_errors": errors.cast("bigint"),
            "dns_queries": F.col("dns_event_count"),
            "dns_failures": both("dns_event_count", F.size("dns_answers") == 0),
            "tls_handshakes": F.col("tls_event_count"),
            "tls_failures": both("tls_event_count", failed),
            "ssh_attempts": F.col("ssh_event_count"),
            "auth_failures": denied.cast("bigint") + both("ssh_event_count", failed),
        }
    )


def observed_sessions(sessions: DataFrame, include_timeout: bool = False) -> DataFrame:
    """The sessions that count towards behaviour: those closed by a terminal state,
    optionally also the timed-out ones."""
    reasons = ["terminal", "timeout"] if include_timeout else ["terminal"]
    kept = sessions.filter(
        F.col("close_reason").isin(reasons) & (F.coalesce("src_ip", F.lit("")) != "")
    )
    return app_counters(kept).select(
        *SESSION_KEY,
        "src_ip",
        "dst_ip",
        F.coalesce(F.col("dst_port").try_cast("int"), F.lit(0)).alias("dst_port"),
        "proto",
        "app_proto",
        "state",
        F.unix_micros("close_ts").alias("us"),
        "total_fwd_bytes",
        "total_bwd_bytes",
        "total_fwd_packets",
        "total_bwd_packets",
        *APP_COUNTERS,
    )


def _auth_changes(
    points: DataFrame, window_us: int, chunk_us: int, target_rows: int
) -> DataFrame:
    """Changes of the largest number of authentication failures any one service has
    in the window.

    The count of a service rises and falls by steps; a step from 3 to 5 enters
    levels 4 and 5. Some service holds level n exactly when the largest count is
    at least n, so the largest count is the number of levels held.
    """
    service = F.when(F.coalesce("app_proto", F.lit("")) != "", F.col("app_proto")).otherwise(
        F.concat_ws("-", "proto", "dst_port")
    )
    failures = points.filter("auth_failures > 0").groupBy("src_ip", service.alias("service"), "us").agg(
        F.sum("auth_failures").alias("n")
    )
    left = failures.select("src_ip", "service", (F.col("us") + window_us).alias("us"), (-F.col("n")).alias("n"))
    steps = failures.union(left).groupBy("src_ip", "service", "us").agg(F.sum("n").alias("n")).filter("n <> 0")
    counts = running_totals(
        steps, ["src_ip", "service"], "us", {"now": "n"}, chunk_us, target_rows=target_rows
    )
    was = F.col("now") - F.col("n")
    levels = (
        counts.select(
            "src_ip",
            "us",
            F.explode(F.sequence(F.least("now", was) + 1, F.greatest("now", was))).alias("level"),
            F.signum("n").cast("bigint").alias("holders"),
        )
        .groupBy("src_ip", "level", "us")
        .agg(F.sum("holders").alias("holders"))
        .filter("holders <> 0")
    )
    levels = materialize(levels, "levels")
    held = running_totals(
        levels, ["src_ip", "level"], "us", {"now": "holders"}, chunk_us, target_rows=target_rows
    )
    change = (F.col("now") > 0).cast("bigint") - ((F.col("now") - F.col("holders")) > 0).cast("bigint")
    return (
        held.select("src_ip", "us", change.alias("d_auth"))
        .filter("d_auth <> 0")
        .groupBy("src_ip", "us")
        .agg(F.sum("d_auth").alias("d_auth"))
    )


def _first_in_epoch(points: DataFrame, epochs: DataFrame, value: str, chunk_us: int, out: str) -> DataFrame:
    """+1 at the first time a source meets a value within one of its epochs."""
    cells = (
        points.withColumn(CHUNK, chunk_start(F.col("us"), chunk_us))
        .groupBy("src_ip", value, CHUNK)
        .agg(F.min("us").alias("us"))
    )
    return (
        cells.join(epochs, ["src_ip", CHUNK])
        .groupBy("src_ip", "epoch", value)
        .agg(F.min("us").alias("us"))
        .groupBy("src_ip", "us")
        .agg(F.count(F.lit(1)).alias(out))
    )


def behavior_timeline(
    sessions: DataFrame,
    window_seconds: float = WINDOW_SECONDS,
    include_timeout: bool = False,
    chunk_seconds: float = CHUNK_SECONDS,
    lifetime: bool = True,
    target_rows: int = TARGET_ROWS,
) -> DataFrame:
    """One row per observed session: the state of its source's window at that moment
    and, with ``lifetime``, the totals since the source last came back from a
    silence longer than the window."""
    window_us = int(window_seconds * MICROS)
    chunk_us = min(int(chunk_seconds * MICROS), window_us)
    points = materialize(observed_sessions(sessions, include_timeout), "points")

    flows = points.select(
        *SESSION_KEY,
        "src_ip",
        "us",
        F.col("total_fwd_bytes").alias("d_bytes"),
        F.col("total_fwd_packets").alias("d_packets"),
        F.lit(1).cast("bigint").alias("l_flows"),
        (F.col("state") == "rejected").cast("bigint").alias("l_rejected"),
        (F.col("state") == "rst").cast("bigint").alias("l_reset"),
        *APP_COUNTERS,
    )
    expiry = points.groupBy("src_ip", (F.col("us") + window_us).alias("us")).agg(
        (-F.sum("total_fwd_bytes")).alias("d_bytes"), (-F.sum("total_fwd_packets")).alias("d_packets")
    )
    with_ip = points.filter("coalesce(dst_ip, '') <> ''")
    with_port = points.filter("dst_port > 0")
    ips = presence_changes(with_ip, ["src_ip"], "dst_ip", "us", window_us, chunk_us)
    ports = presence_changes(with_port, ["src_ip"], "dst_port", "us", window_us, chunk_us)
    streams = [
        flows,
        expiry,
        ips.withColumnRenamed("change", "d_ips"),
        ports.withColumnRenamed("change", "d_ports"),
        _auth_changes(points, window_us, chunk_us, target_rows),
    ]
    epochs = None
    if lifetime:
        epochs = activity_epochs(points, ["src_ip"], "us", window_us, chunk_us)
        streams += [
            _first_in_epoch(with_ip, epochs, "dst_ip", chunk_us, "l_ips"),
            _first_in_epoch(with_port, epochs, "dst_port", chunk_us, "l_ports"),
        ]
    merged = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), streams)
    changes = materialize(merged, "changes")
    totals = running_totals(
        changes,
        ["src_ip"],
        "us",
        SLIDING,
        chunk_us,
        epochs,
        LIFETIME if lifetime else None,
        target_rows,
    )
    extra = ["epoch", "epoch_start", *LIFETIME] if lifetime else []
    return totals.filter("flow_id is not null").select(
        *SESSION_KEY, "src_ip", F.col("us").alias("close_us"), *SLIDING, *extra
    )


def behavior_scores(timeline: DataFrame, window_seconds: float = WINDOW_SECONDS) -> DataFrame:
    """Add scan, brute-force, volume and overall scores, each between 0 and 1."""

    def capped(value: Column, above: float, full: float) -> Column:
        return F.when(value > above, F.least(F.lit(1.0), value / F.lit(full))).otherwise(F.lit(0.0))

    ips, ports = F.col("ips_in_window"), F.col("ports_in_window")
    byte_rate = F.col("bytes_in_window") / F.lit(float(window_seconds))
    packet_rate = F.col("packets_in_window") / F.lit(float(window_seconds))
    return (
        timeline.withColumns(
            {
                "port_scan_score": capped(ratio(ports, ips), 10, 50.0),
                "host_scan_score": capped(ratio(ips, ports), 5, 20.0),
                "brute_force_score": capped(F.col("max_auth_failures"), 3, 20.0),
                "volume_anomaly_score": F.greatest(
                    capped(byte_rate, 1_000_000, 10_000_000.0), capped(packet_rate, 1000, 10_000.0)
                ),
            }
        )
        .withColumn("scan_score", F.greatest("port_scan_score", "host_scan_score"))
        .withColumn(
            "overall_anomaly_score",
            F.greatest("scan_score", "brute_force_score", "volume_anomaly_score"),
        )
    )


def behavior_features(scored: DataFrame, window_seconds: float = WINDOW_SECONDS) -> DataFrame:
    """The 19-field behaviour vector at each session (needs a lifetime timeline)."""
    age = F.least(
        (F.col("close_us") - F.col("epoch_start")) / float(MICROS), F.lit(float(window_seconds))
    )
    seconds = F.when(age <= 0, F.lit(0.001)).otherwise(age)

    def share(part: str, whole: str) -> Column:
        return F.col(part) / F.greatest(F.col(whole), F.lit(1))

    vector = {
        "flow_rate": F.col("total_flows") / seconds,
        "complete_flow_ratio": share("total_flows", "total_flows"),
        "dst_ips_per_second": F.col("ips_in_window") / seconds,
        "dst_ports_per_second": F.col("ports_in_window") / seconds,
        "bytes_sent_per_second": F.col("bytes_in_window") / seconds,
        "packets_sent_per_second": F.col("packets_in_window") / seconds,
        "http_error_ratio": share("total_http_errors", "total_http_requests"),
        "dns_failure_ratio": share("total_dns_failures", "total_dns_queries"),
        "tls_failure_ratio": share("total_tls_failures", "total_tls_handshakes"),
        "auth_failures_per_second": F.col("total_auth_failures") / seconds,
        "rejected_ratio": share("rejected_flows", "total_flows"),
        "reset_ratio": share("reset_flows", "total_flows"),
    }
    return scored.withColumns(vector).select(*SESSION_KEY, "src_ip", "close_us", *FEATURES)


def suspicious(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    return scored.filter(F.col("overall_anomaly_score") > threshold)


def latest_scores(scored: DataFrame) -> DataFrame:
    """The scores of each source at its last session."""
    last = F.max(
        F.struct("close_us", *SESSION_KEY, *[F.col(c) for c in SCORES])
    ).alias("last")
    return scored.groupBy("src_ip").agg(last).select(
        "src_ip", F.col("last.close_us").alias("last_seen_us"), *[f"last.{c}" for c in SCORES]
    )


def top_anomalous_ips(latest: DataFrame, limit: int = 10) -> DataFrame:
    return (
        latest.orderBy(F.desc("overall_anomaly_score"), "src_ip")
        .limit(limit)
        .select("src_ip", "overall_anomaly_score")
    )


def scan_activity(latest: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Sources with a scan score above the threshold; a port scan takes precedence."""
    port, host = F.col("port_scan_score"), F.col("host_scan_score")
    kind = F.when(port > threshold, "port_scan").when(host > threshold, "host_scan")
    return (
        latest.withColumn("scan_type", kind)
        .filter("scan_type is not null")
        .select(
            "src_ip",
            F.when(F.col("scan_type") == "port_scan", port).otherwise(host).alias("scan_score"),
            "scan_type",
        )
        .orderBy(F.desc("scan_score"), "src_ip")
    )


def brute_force_activity(latest: DataFrame, threshold: float = 0.7) -> DataFrame:
    return (
        latest.filter(F.col("brute_force_score") > threshold)
        .select("src_ip", "brute_force_score")
        .orderBy(F.desc("brute_force_score"), "src_ip")
    )


def ip_behavior(scored: DataFrame, ip: str) -> DataFrame:
    return scored.filter(F.col("src_ip") == ip)


def analyzer_stats(latest: DataFrame, threshold: float = 0.5) -> DataFrame:
    return latest.agg(
        F.count(F.lit(1)).alias("tracked_ips"),
        F.count_if(F.col("overall_anomaly_score") > threshold).alias("anomalous_ips"),
    )


def ip_totals(sessions: DataFrame, include_timeout: bool = False) -> DataFrame:
    """Totals per source over the whole input."""
    port = F.when(F.col("dst_port") > 0, F.col("dst_port"))
    return observed_sessions(sessions, include_timeout).groupBy("src_ip").agg(
        F.count(F.lit(1)).alias("total_flows"),
        F.count_if(F.col("state").isin(TERMINAL_STATES)).alias("completed_flows"),
        F.sum("total_fwd_bytes").alias("bytes_sent"),
        F.sum("total_bwd_bytes").alias("bytes_received"),
        F.sum("total_fwd_packets").alias("packets_sent"),
        F.sum("total_bwd_packets").alias("packets_received"),
        F.count_distinct(F.nullif(F.col("dst_ip"), F.lit(""))).alias("unique_dst_ips"),
        F.count_distinct(port).alias("unique_dst_ports"),
        *[F.sum(c).alias(c) for c in APP_COUNTERS],
    )


def ip_histogram_rows(sessions: DataFrame, include_timeout: bool = False) -> DataFrame:
    """``(src_ip, kind, value, n)`` for protocol, application protocol and state."""
    kinds = {"protocol": "proto", "app_protocol": "app_proto", "state": "state"}
    values = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("value")) for k, c in kinds.items()])
    return (
        observed_sessions(sessions, include_timeout)
        .select("src_ip", F.explode(values).alias("v"))
        .filter("coalesce(v.value, '') <> ''")
        .groupBy("src_ip", F.col("v.kind").alias("kind"), F.col("v.value").alias("value"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def ip_histograms(sessions: DataFrame, include_timeout: bool = False) -> DataFrame:
    """One map per source and kind; its entries are the distinct values."""

    def as_map(kind: str, name: str) -> Column:
        entry = F.when(F.col("kind") == kind, F.struct("value", "n"))
        return F.map_from_entries(F.array_sort(F.collect_list(entry))).alias(name)

    return ip_histogram_rows(sessions, include_timeout).groupBy("src_ip").agg(
        as_map("protocol", "protocols"),
        as_map("app_protocol", "app_protocols"),
        as_map("state", "connection_states"),
    )


def escalate(
    results: DataFrame, features: DataFrame, below: float = 0.8, above: float = 0.7, report: float = 0.5
) -> DataFrame:
    """Attach the behaviour vector of suspicious sources to detection results and
    raise results that scoring alone left low."""
    vectors = suspicious(features, report).select(
        *SESSION_KEY, F.struct(*FEATURES).alias("behavior")
    )
    joined = results.join(vectors, SESSION_KEY, "left")
    raised = (F.col("combined_score") < below) & (F.col("behavior.overall_anomaly_score") > above)
    raised = F.coalesce(raised, F.lit(False))
    return joined.withColumn(
        "alert_reason",
        F.when(raised & ~F.col("is_anomalous"), "behavior").when(
            F.col("is_anomalous") | raised, "score"
        ),
    ).withColumns(
        {
            "escalated": raised,
            "combined_score": F.when(raised, F.lit(below)).otherwise(F.col("combined_score")),
            "is_anomalous": F.col("is_anomalous") | raised,
        }
    )
