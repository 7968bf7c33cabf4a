"""Sessions: events of one flow id up to a terminal flow state or a silence.

Everything is one lazy plan over the events. Rows are shuffled once, by
``(flow_id, time piece)`` so that a flow id holding a large share of all events
is spread over many tasks (see ``running``); the state that crosses borders
travels as one summary row per piece. Several branches read the events, so give
it a stored table rather than unparsed lines. Values are deduplicated before they are collected, so a
session row holds its distinct values and never the raw events.
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, Window, functions as F

from wireloom.functions.scalars import MICROS, ratio
from wireloom.operators.running import CHUNK, PIECE, TARGET_ROWS, cut_pieces

TERMINAL_STATES = ["closed", "established", "fin", "rst"]
APP_TYPES = ["http", "dns", "tls", "ssh"]

# session list column -> event column
LISTS = {
    "http_methods": "http_method",
    "http_status_codes": "http_status",
    "http_hosts": "http_host",
    "http_uris": "http_uri",
    "http_user_agents": "http_user_agent",
    "dns_queries": "dns_query",
    "dns_rrtypes": "dns_rrtype",
    "dns_answers": "dns_answers",
    "tls_sni": "tls_sni",
    "tls_versions": "tls_version",
    "tls_subjects": "tls_subject",
    "tls_issuers": "tls_issuer",
    "ssh_client_versions": "ssh_client",
    "ssh_server_versions": "ssh_server",
}
# session counter -> event type
COUNTS = {
    "flow_event_count": "flow",
    "http_event_count": "http",
    "dns_event_count": "dns",
    "tls_event_count": "tls",
    "ssh_event_count": "ssh",
    "file_event_count": "fileinfo",
}
SESSION_KEY = ["flow_id", "session_no"]


def number_sessions(
    events: DataFrame,
    gap_seconds: float = 120,
    terminal_states: list[str] = TERMINAL_STATES,
    chunk_seconds: float = 60,
    target_rows: int = TARGET_ROWS,
) -> DataFrame:
    """Add ``session_no`` (0, 1, ... per flow id), ``us`` and ``terminal`` to each event.

    A session ends with a flow event in a terminal state, or before an event that
    comes more than ``gap_seconds`` after the previous one.
    """
    gap_us = int(gap_seconds * MICROS)
    width = min(int(chunk_seconds * MICROS), gap_us)
    terminal = (F.col("event_type") == "flow") & F.col("state").isin(terminal_states)
    rows = events.withColumns(
        {
            "us": F.unix_micros("event_ts"),
            "terminal": F.coalesce(terminal, F.lit(False)),
        }
    )
    rows = cut_pieces(rows, ["flow_id"], "us", width, target_rows)
    cell = ["flow_id", PIECE]
    inside = Window.partitionBy(*cell).orderBy("us", "seq")
    closes = F.col("terminal").cast("bigint")
    local = F.coalesce(
        F.sum(closes).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )

    summary = rows.groupBy(*cell).agg(
        F.min("us").alias("_first"),
        F.sum(closes).alias("_closed"),
        F.max(F.struct("us", "seq", "terminal")).alias("_tail"),
    )
    chunks = Window.partitionBy("flow_id").orderBy(PIECE)
    tail = F.lag("_tail").over(chunks)
    timed_out = ((F.col("_first") - tail["us"]) > gap_us) & ~tail["terminal"]
    carry = (
        summary.withColumn("_timeout", F.coalesce(timed_out.cast("bigint"), F.lit(0)))
        .withColumn(
            "_base",
            F.sum("_timeout").over(chunks)
            + F.coalesce(
                F.sum("_closed").over(chunks.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
            ),
        )
        .select(*cell, "_base")
    )
    return (
        rows.withColumn("_local", local)
        .join(carry, cell)
        .withColumn("session_no", F.col("_base") + F.col("_local"))
        .drop("_base", "_local", CHUNK, PIECE)
    )


def _values() -> Column:
    """The event's list values as ``(kind, pos, value)``; kind -1 stands for the event itself."""
    kinds = {column: kind for kind, column in enumerate(LISTS.values())}
    many = kinds.pop("dns_answers")

    def item(kind: int, pos: str, value: str) -> str:
        return f"named_struct('kind', {kind}, 'pos', {pos}, 'value', cast({value} as string))"

    scalars = ", ".join(item(kind, "0", column) for column, kind in kinds.items())
    answers = f"transform(coalesce(dns_answers, array()), (x, i) -> {item(many, 'i', 'x')})"
    return F.expr(
        f"""concat(array({item(-1, '0', 'null')}),
            filter(concat(array({scalars}), {answers}), x -> coalesce(x.value, '') <> ''))"""
    )


def sessionize(
    events: DataFrame,
    gap_seconds: float = 120,
    terminal_states: list[str] = TERMINAL_STATES,
    chunk_seconds: float = 60,
    log_end: datetime.datetime | None = None,
    target_rows: int = TARGET_ROWS,
) -> DataFrame:
    """One row per session.

    ``close_reason`` is ``terminal``, ``timeout`` (silent for longer than the gap
    before ``log_end``, by default the last event time) or ``flush`` (still open
    at the end of the log). Identity comes from the first event, state and
    counters from the last flow event, lists keep first-seen order.
    """
    numbered = number_sessions(
        events, gap_seconds, terminal_states, chunk_seconds, target_rows
    )
    # each event once (kind -1) and once per value it contributes; rows of values hold no event, which keeps their sort narrow
    apps = ", ".join(f"'{t}'" for t in APP_TYPES)
    event = "event_type, src_ip, src_port, dst_ip, dst_port, proto, event_ts, terminal, state, fwd_pkts, bwd_pkts, fwd_bytes, bwd_bytes, app_proto, start_ts, end_ts"
    narrow = numbered.withColumn("item", F.explode(_values())).selectExpr(
        *SESSION_KEY,
        "item.kind as kind",
        "item.value as value",
        "us",
        "seq",
        "item.pos as pos",
        f"if(item.kind = -1, struct({event}), null) as event",
    )
    whole, flow = "event is not null", "event.event_type = 'flow'"

    def ordered(when: str, *fields: str) -> Column:
        listed = ", ".join(["us", "seq", *[f"event.{f} as {f}" for f in fields]])
        return F.expr(f"if({when}, struct({listed}), null)")

    head = ", ".join(f"event.{c} as {c}" for c in ("src_ip", "src_port", "dst_ip", "dst_port", "proto"))
    lows = {
        "seen": F.expr("if(kind >= 0, struct(us, seq, pos), null)"),
        "head": F.expr(f"if({whole}, struct(us, seq, {head}, event.event_type <> 'flow' as app, event.event_ts as event_ts), null)"),
        "first_app": ordered(f"event.event_type in ({apps})", "event_type"),
        "flow_start": F.expr(f"if({flow}, coalesce(event.start_ts, event.event_ts), null)"),
    }
    highs = {
        "tail": ordered(whole, "terminal"),
        "flow": ordered(flow, "state", "fwd_pkts", "bwd_pkts", "fwd_bytes", "bwd_bytes"),
        "flow_app": ordered(f"{flow} and coalesce(event.app_proto, '') <> ''", "app_proto"),
        "flow_end": F.expr(f"if({flow}, coalesce(event.end_ts, event.event_ts), null)"),
    }
    per_value = narrow.groupBy(*SESSION_KEY, "kind", "value").agg(
        *[F.min(x).alias(c) for c, x in lows.items()],
        *[F.max(x).alias(c) for c, x in highs.items()],
        *[F.count(F.expr(f"if(event.event_type = '{t}', 1, null)")).alias(c) for c, t in COUNTS.items()],
    )
    merged = per_value.groupBy(*SESSION_KEY).agg(
        *[F.max(c).alias(c) for c in ("head", "tail", "flow", "flow_app", "first_app", "flow_start", "flow_end")],
        *[F.sum(c).alias(c) for c in COUNTS],
        *[
            F.expr(f"array_sort(collect_list(if(kind = {i}, struct(seen, value), null)))").alias(n)
            for i, n in enumerate(LISTS)
        ],
    )
    gap_us = int(gap_seconds * MICROS)
    if log_end is None:
        end_us = events.agg(F.max(F.unix_micros("event_ts")).alias("end_us")).scalar()
    else:
        end_us = F.unix_micros(F.lit(log_end))
    merged = merged.withColumn("_end_us", end_us)
    reason = (
        F.when(F.col("tail.terminal"), "terminal")
        .when(F.col("_end_us") - F.col("tail.us") > gap_us, "timeout")
        .otherwise("flush")
    )
    close_us = (
        F.when(F.col("close_reason") == "terminal", F.col("tail.us"))
        .when(F.col("close_reason") == "timeout", F.col("tail.us") + gap_us)
        .otherwise(F.col("_end_us"))
    )

    def counter(name: str) -> Column:
        return F.coalesce(F.col(f"flow.{name}"), F.lit(0)).cast("bigint")

    return merged.withColumn("close_reason", reason).select(
        *SESSION_KEY,
        *[F.col(f"head.{c}").alias(c) for c in ("src_ip", "src_port", "dst_ip", "dst_port", "proto")],
        F.coalesce("flow_app.app_proto", "first_app.event_type", F.lit("")).alias("app_proto"),
        F.least("flow_start", F.when(F.col("head.app"), F.col("head.event_ts"))).alias("start_ts"),
        F.col("flow_end").alias("end_ts"),
        F.coalesce("flow.state", F.lit("")).alias("state"),
        counter("fwd_pkts").alias("total_fwd_packets"),
        counter("bwd_pkts").alias("total_bwd_packets"),
        counter("fwd_bytes").alias("total_fwd_bytes"),
        counter("bwd_bytes").alias("total_bwd_bytes"),
        *[F.col(f"{n}.value").alias(n) for n in LISTS],
        *COUNTS,
        (F.col("flow_event_count") < sum(F.col(c) for c in COUNTS)).alias("has_app_data"),
        F.timestamp_micros("tail.us").alias("last_event_ts"),
        "close_reason",
        F.timestamp_micros(close_us).alias("close_ts"),
    )


def session_metrics(sessions: DataFrame, min_duration: float = 0.001) -> DataFrame:
    """Add ``duration`` (seconds), byte and packet rates and the down/up byte ratio."""
    span = (F.unix_micros("end_ts") - F.unix_micros("start_ts")) / float(MICROS)
    floor = F.greatest("duration", F.lit(min_duration))
    return sessions.withColumn("duration", F.coalesce(span, F.lit(0.0))).withColumns(
        {
            "flow_bytes_per_sec": (F.col("total_fwd_bytes") + F.col("total_bwd_bytes")) / floor,
            "flow_packets_per_sec": (F.col("total_fwd_packets") + F.col("total_bwd_packets")) / floor,
            "down_up_ratio": ratio(F.col("total_bwd_bytes"), F.col("total_fwd_bytes")),
        }
    )


def app_summary(sessions: DataFrame) -> DataFrame:
    """Per session: application-layer counts and flags."""
    codes = F.col("http_status_codes")
    kinds = sum((F.col(f"{t}_event_count") > 0).cast("int") for t in APP_TYPES)
    return sessions.select(
        *SESSION_KEY,
        "http_event_count",
        F.size("http_methods").alias("unique_http_methods"),
        F.exists(codes, lambda c: c.startswith("4") | c.startswith("5")).alias("has_http_error"),
        F.arrays_overlap(codes, F.array(F.lit("401"), F.lit("407"))).alias("has_http_auth"),
        "dns_event_count",
        F.size("dns_queries").alias("unique_dns_queries"),
        F.size("dns_answers").alias("dns_answer_count"),
        "tls_event_count",
        F.size("tls_sni").alias("tls_sni_count"),
        "ssh_event_count",
        "file_event_count",
        (kinds > 1).alias("has_mixed_app_data"),
    )


def session_stats(sessions: DataFrame) -> DataFrame:
    """One row: sessions by fate and events by type."""
    return sessions.agg(
        F.count(F.lit(1)).alias("total_sessions"),
        F.count_if(F.col("close_reason") == "flush").alias("active_sessions"),
        F.count_if(F.col("close_reason") != "flush").alias("closed_sessions"),
        F.count_if(F.col("close_reason") == "timeout").alias("expired_sessions"),
        *[
            F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(f"{t if t != 'fileinfo' else 'file'}_events")
            for c, t in COUNTS.items()
        ],
    )


def sessions_by_flow(sessions: DataFrame, flow_id: str) -> DataFrame:
    return sessions.filter(F.col("flow_id") == flow_id)


def sessions_by_ip(sessions: DataFrame, ip: str) -> DataFrame:
    return sessions.filter(F.col("src_ip") == ip)


def sessions_by_dest_port(sessions: DataFrame, port: int) -> DataFrame:
    return sessions.filter(F.col("dst_port") == port)


def session_records(sessions: DataFrame) -> DataFrame:
    """Each session as one JSON record."""
    return sessions.select(*SESSION_KEY, F.to_json(F.struct("*")).alias("record"))
