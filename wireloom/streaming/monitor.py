"""Continuous monitoring: rotated event files in, results, alerts and status out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from wireloom.functions.scalars import MICROS
from wireloom.operators import alerts, behavior, normalize, scoring
from wireloom.operators.running import activity_epochs
from wireloom.operators.sessions import session_metrics
from wireloom.operators.whitelist import TrustedServices, apply_whitelist
from wireloom.operators.zero_byte import BURST_KEY, zero_byte_bursts, zero_byte_sessions
from wireloom.plans.batch import Detector, score_sessions, session_counters, status_report
from wireloom.sources.events import stream_events, tail_events
from wireloom.sources.sinks import write_alerts, write_results
from wireloom.sources.staging import materialize
from wireloom.streaming.bursts import stream_bursts
from wireloom.streaming.sessions import closed_schema, stream_sessions


def live_events(
    spark: SparkSession, path: str, trusted: TrustedServices = TrustedServices(), max_files: int | None = None, growing: bool = False
) -> DataFrame:
    """``growing``: the files are appended to and rotated; without it they are complete when they appear."""
    raw = tail_events(spark, path) if growing else stream_events(spark, path, max_files)
    return apply_whitelist(normalize.normalize_events(normalize.drop_flagged(raw)), trusted)


def start_sessions(
    spark: SparkSession, events_path: str, out: str, trigger: dict | None = None, growing: bool = False, **options
) -> StreamingQuery:
    """Write closed sessions to ``{out}/sessions``, partitioned by hour of closing."""
    closed = session_metrics(stream_sessions(live_events(spark, events_path, growing=growing), **options))
    writer = (
        closed.withColumn("hour", F.date_format("close_ts", "yyyy-MM-dd-HH"))
        .writeStream.format("parquet")
        .outputMode("append")
        .partitionBy("hour")
        .option("checkpointLocation", f"{out}/checkpoints/sessions")
    )
    return writer.trigger(**(trigger or {"processingTime": "10 seconds"})).start(f"{out}/sessions")


def start_bursts(
    spark: SparkSession, out: str, trigger: dict | None = None, min_count: int = 3, max_rate: float = 1.0
) -> StreamingQuery:
    """Write burst alerts to ``{out}/bursts`` from the session table."""
    sessions = session_stream(spark, out)
    return (
        stream_bursts(sessions, min_count, max_rate)
        .writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", f"{out}/checkpoints/bursts")
        .trigger(**(trigger or {"processingTime": "10 seconds"}))
        .start(f"{out}/bursts")
    )


def session_stream(spark: SparkSession, out: str) -> DataFrame:
    """The session table as a stream, whether or not anything has been written yet."""
    known = session_metrics(spark.createDataFrame([], closed_schema(spark))).schema.add("hour", "string")
    return spark.readStream.schema(known).parquet(f"{out}/sessions")


def _observed(sessions: DataFrame) -> DataFrame:
    """The sessions that count towards behaviour."""
    return sessions.filter("close_reason = 'terminal' and coalesce(src_ip, '') <> ''")


def since_silence(
    spark: SparkSession,
    out: str,
    name: str,
    batch_id: int,
    batch: DataFrame,
    only: Callable[[DataFrame], DataFrame],
    keys: list[str],
    silence_seconds: float,
) -> DataFrame:
    """Those sessions of the table that ``only`` keeps and that have the keys of
    the batch, from each key's last silence of more than ``silence_seconds`` on:
    all that totals which restart with such a silence depend on.

    One row per key and batch tells when its activity began and was last seen. A
    batch reads those of its keys, a source that has been active for days costs
    its own sessions, and the hour partitions prune the rest.
    """
    silence_us = int(silence_seconds * MICROS)
    us = F.unix_micros("close_ts")
    now = only(batch).groupBy(*keys).agg(F.min(us).alias("first"))
    same = lambda a, b: [a[k].eqNullSafe(b[f"_{k}"]) for k in keys]
    named = {k: f"_{k}" for k in keys}
    folder = f"{out}/activity-{name}"
    known = spark.createDataFrame([], now.withColumns({"began": F.lit(0).cast("bigint"), "seen": F.lit(0).cast("bigint")}).drop("first").schema)
    if batch_id > 0:
        known = spark.read.schema(known.schema.add("batch", "long")).parquet(folder).filter(F.col("batch") < batch_id)
    last = known.groupBy(*keys).agg(F.max_by(F.struct("began", "seen"), "seen").alias("k")).withColumnsRenamed(named)
    began = F.when(F.col("first") - F.col("k.seen") <= silence_us, F.col("k.began"))
    starts = now.join(last, same(now, last), "left").select(*keys, F.least("first", F.coalesce(began, "first")).alias("start"))
    starts = materialize(starts.withColumnsRenamed(named), f"starts-{name}")
    low = starts.agg(F.timestamp_micros(F.min("start")).alias("t")).first()["t"]
    table = spark.read.schema(session_stream(spark, out).schema).parquet(f"{out}/sessions")
    table = table.filter(F.col("hour") >= F.date_format(F.lit(low), "yyyy-MM-dd-HH")) if low else table.limit(0)
    table = only(table)
    here = table.join(starts, [*same(table, starts), F.unix_micros(table["close_ts"]) >= starts["start"]]).drop("hour", "start", *named.values())
    context = materialize(here, f"context-{name}")
    points = context.withColumn("us", us)
    epochs = activity_epochs(points, keys, "us", silence_us, min(silence_us, 60 * MICROS))
    latest = epochs.groupBy(*keys).agg(F.max_by("epoch_start", "epoch").alias("began"))
    seen = points.groupBy(*keys).agg(F.max("us").alias("seen")).withColumnsRenamed(named)
    rows = latest.join(seen, same(latest, seen)).select(*keys, "began", "seen")
    rows.write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")
    return context


def score_batch(
    batch: DataFrame,
    context: DataFrame,
    detector: Detector,
    window_seconds: float = behavior.WINDOW_SECONDS,
    bursts: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(results, latest behaviour scores) of one micro-batch of closed sessions, as
    the batch analysis has them. ``context`` holds the sessions of their sources
    since their last silence, ``bursts`` the alerts among them."""
    results = scoring.result_rows(score_sessions(batch, detector), bursts)
    timeline = behavior.behavior_timeline(context, window_seconds)
    sources = behavior.behavior_scores(timeline, window_seconds)
    vectors = behavior.behavior_features(sources, window_seconds)
    return behavior.escalate(results, vectors), behavior.latest_scores(sources)


def start_scoring(
    spark: SparkSession,
    out: str,
    detector: Detector,
    on_alerts: Callable[[DataFrame, int], None] | None = None,
    on_status: Callable[[DataFrame, int], None] | None = None,
    trigger: dict | None = None,
    burst_count: int = 3,
    burst_rate: float = 1.0,
    idle_seconds: float = 600,
    on_counters: Callable[[DataFrame, int], None] | None = None,
) -> StreamingQuery:
    """Score new sessions of the session table; write results and alert texts and
    hand alerts, the suspicious-source status and the counters to the callbacks.

    ``on_counters`` gets one row: ``batches`` so far, and the ``session_counters`` of
    the batch and, named ``total_...``, of the whole run, restarts included. Each batch leaves
    one row in ``{out}/counters``, which a repeated batch replaces, so nothing counts twice."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        columns = materialize(batch.drop("hour"), "batch")
        context = since_silence(spark, out, "sources", batch_id, columns, _observed, ["src_ip"], behavior.WINDOW_SECONDS)
        of_keys = since_silence(spark, out, "bursts", batch_id, columns, zero_byte_sessions, BURST_KEY, idle_seconds)
        bursts = zero_byte_bursts(of_keys, burst_count, burst_rate, idle_seconds)
        results, latest = score_batch(columns, context, detector, bursts=bursts)
        folder = f"{out}/scored/batch={batch_id}"  # a repeated batch replaces its own output
        results.write.mode("overwrite").parquet(folder)
        done = spark.read.parquet(folder)
        write_results(done, f"{out}/results/batch={batch_id}", mode="overwrite")
        texts = alerts.render_alerts(done)
        write_alerts(texts, f"{out}/alerts/batch={batch_id}", mode="overwrite")
        session_counters(done).coalesce(1).write.mode("overwrite").parquet(f"{out}/counters/batch={batch_id}")
        if on_counters:
            on_counters(run_counters(spark, out, batch_id), batch_id)
        if on_alerts:
            on_alerts(texts, batch_id)
        if on_status:
            on_status(status_report(latest), batch_id)

    sessions = session_stream(spark, out)
    return (
        sessions.writeStream.foreachBatch(handle)
        .option("checkpointLocation", f"{out}/checkpoints/scoring")
        .trigger(**(trigger or {"processingTime": "10 seconds"}))
        .start()
    )


def run_counters(spark: SparkSession, out: str, batch_id: int) -> DataFrame:
    """The counters of a batch and of all batches up to it, in one row; one row a batch is read."""
    rows = spark.read.parquet(f"{out}/counters").filter(F.col("batch") <= batch_id)
    names = [c for c in rows.columns if c != "batch"]
    return rows.agg(
        F.count(F.lit(1)).alias("batches"),
        *[F.max(F.when(F.col("batch") == batch_id, F.col(c))).alias(c) for c in names],
        *[F.sum(c).alias(f"total_{c}") for c in names],
    )
