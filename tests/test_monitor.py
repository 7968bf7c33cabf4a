"""The monitor's results, batch by batch, are those of the batch analysis."""

import random

from pyspark.sql import Row, functions as F

from tests.helpers import events, sessions
from wireloom.operators import behavior, scoring
from wireloom.operators.sessions import session_metrics
from wireloom.operators.zero_byte import zero_byte_bursts
from wireloom.plans.batch import Detector, score_sessions
from wireloom.streaming import monitor
from wireloom.streaming.sessions import EVENT_COLUMNS, SessionProcessor, closed_schema, stream_sessions


def table(spark):
    """Three sources over 25 minutes, one with a silence of six, one sending nothing."""
    rng, rows = random.Random(12), []
    for t in range(0, 1500, 10):
        for s in range(3):
            if s == 1 and 500 < t < 900:
                continue
            rows.append(dict(us=t * 1_000_000 + s, src_ip=f"10.0.0.{s}", dst_ip=f"10.1.0.{rng.randrange(9)}", dst_port=rng.randrange(1, 60), total_fwd_bytes=0 if s == 2 else rng.randrange(1, 900), total_fwd_packets=2, close_reason=rng.choice(["terminal", "terminal", "timeout"])))
    for r in rows:
        if r["src_ip"].endswith("2"):
            r.update(dst_ip="10.1.0.1", dst_port=80)
    known = spark.createDataFrame([], closed_schema(spark))
    return session_metrics(known.unionByName(sessions(spark, rows), allowMissingColumns=True)).withColumn(
        "hour", F.date_format("close_ts", "yyyy-MM-dd-HH")
    )


def rows_of(results):
    b = F.col("behavior")
    return sorted(
        tuple(r)
        for r in results.select(
            "flow_id", "combined_score", "is_anomalous", "zero_byte_pattern", "zero_byte_count", "alert_reason", b["flow_rate"], b["unique_dst_ips"], b["unique_dst_ports"]
        ).collect()
    )


def test_batches_of_a_stream_score_as_the_whole(spark, tmp_path):
    out, rows = str(tmp_path), table(spark).cache()
    for low, high in ((0, 140), (140, 150), (150, 300), (300, 10_000)):
        part = rows.filter(F.col("flow_id").cast("int").between(low, high - 1)).coalesce(1)
        part.write.mode("append").partitionBy("hour").parquet(f"{out}/sessions")
        monitor.start_scoring(spark, out, Detector(), trigger={"availableNow": True}, burst_rate=0.05).awaitTermination()
    got = spark.read.parquet(f"{out}/scored")
    whole = rows.drop("hour")
    scored = scoring.result_rows(score_sessions(whole, Detector()), zero_byte_bursts(whole, 3, 0.05))
    vectors = behavior.behavior_features(behavior.behavior_scores(behavior.behavior_timeline(whole)))
    want = rows_of(behavior.escalate(scored, vectors))
    assert any(r[3] for r in want)
    assert rows_of(got) == want


def test_scoring_may_start_before_the_first_session(spark, tmp_path):
    (tmp_path / "sessions").mkdir()
    run = monitor.start_scoring(spark, str(tmp_path), Detector(), trigger={"availableNow": True})
    run.awaitTermination()
    assert run.exception() is None


def test_counters_of_a_run(spark, tmp_path):
    out, rows, seen = str(tmp_path), table(spark).cache(), []
    for low, high in ((0, 140), (140, 10_000)):
        part = rows.filter(F.col("flow_id").cast("int").between(low, high - 1)).coalesce(1)
        part.write.mode("append").partitionBy("hour").parquet(f"{out}/sessions")
        run = monitor.start_scoring(spark, out, Detector(), trigger={"availableNow": True}, burst_rate=0.05, on_counters=lambda c, b: seen.append((b, c.first())))
        run.awaitTermination()
    done = spark.read.parquet(f"{out}/scored")
    last = seen[-1][1]
    assert [b for b, _ in seen] == [0, 1] and last.batches == 2 and seen[0][1].finalized_sessions == 140
    assert last.total_finalized_sessions == rows.count() == seen[0][1].finalized_sessions + last.finalized_sessions
    assert last.total_anomalies_detected == done.filter("is_anomalous").count() > 0
    assert last.total_burst_alerts == done.filter("zero_byte_pattern").count() > 0
    # a batch that is repeated replaces its row
    assert monitor.run_counters(spark, out, 0).first().total_finalized_sessions == 140


class Handle:
    """State and timers of one key, kept in lists."""

    def __init__(self):
        self.state, self.timers, self.calls = None, set(), []

    def getValueState(self, name, schema):
        return self

    def get(self):
        self.calls.append("get")
        return self.state

    def update(self, state):
        self.calls.append("update")
        self.state = state

    def clear(self):
        self.state = None

    def registerTimer(self, at):
        self.calls.append("register")
        self.timers.add(at)

    def deleteTimer(self, at):
        self.calls.append("delete")
        self.timers.remove(at)


def test_a_key_costs_four_calls_and_one_timer():
    """Rows of a key are handled without a data frame, and its timer follows from its state: nothing is listed."""
    columns = [c for c in EVENT_COLUMNS if c not in ("start_ts", "end_ts", "event_ts")] + ["us", "start_us", "end_us"]
    event = lambda **given: Row(*columns)(*[{**dict.fromkeys(columns), "event_type": "flow", **given}[c] for c in columns])
    handle, work = Handle(), SessionProcessor(120_000_000, ["closed"], 86_400_000_000)
    work.init(handle)
    run = lambda *rows: [(r.session_no, r.close_reason, r.flow_event_count) for r in work.handleInputRows(("f",), iter(rows), None)]
    assert run(event(us=5_000_000, seq=2), event(us=1_000_000, seq=1)) == []
    assert handle.timers == {125_001} and handle.calls == ["get", "update", "register"]
    handle.calls.clear()
    assert run(event(us=130_000_000, seq=3), event(us=131_000_000, seq=4, state="closed")) == [(0, "timeout", 2), (1, "terminal", 2)]
    assert handle.calls == ["get", "update", "delete", "register"] and handle.timers == {86_531_001}
    assert run(event(us=140_000_000, seq=5)) == [] and handle.timers == {260_001}
    assert [(r.session_no, r.close_reason) for r in work.handleExpiredTimer(("f",), None, None)] == [(2, "timeout")]
    assert handle.timers == {260_001, 86_540_001}  # Spark drops the expired one itself
    assert list(work.handleExpiredTimer(("f",), None, None)) == [] and handle.state is None


def test_a_port_stays_where_another_event_has_none(spark, tmp_path):
    """Data frames made decimals of ports next to a missing one, and the state stored them as null."""
    rows = [dict(us=1_000_000, flow_id=f, dst_port=p, event_type="flow", state="closed") for f, p in (("a", 443), ("b", None), ("c", 80))]
    last = dict(us=9_000_000, flow_id="a", dst_port=None, event_type="http")
    table = events(spark, [*rows, last]).coalesce(1)
    table.write.parquet(str(tmp_path / "in"))
    closed = stream_sessions(spark.readStream.schema(table.schema).parquet(str(tmp_path / "in")))
    writer = closed.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state"))
    writer.trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    assert {(r.flow_id, r.dst_port) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {("a", 443), ("b", None), ("c", 80)}
