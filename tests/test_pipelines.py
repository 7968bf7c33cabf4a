"""Training, artifacts, sinks, alerts and the streaming twin, end to end."""

import random

import pytest
from pyspark.sql import functions as F

from tests.compare import compare, connect
from tests.helpers import sessions
from wireloom.operators import alerts, models
from wireloom.operators.features import BASE_FEATURES
from wireloom.operators.zero_byte import zero_byte_bursts
from wireloom.plans import batch, registry, training
from wireloom.plans.fixtures import training_flows
from wireloom.sources import artifacts, sinks
from wireloom.streaming import monitor
from wireloom.streaming.bursts import stream_bursts

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def trained(spark):
    raw = training_flows(spark, SF_DIR).drop("record_id")
    # make the attacks separable, so that a model has something to find
    raw = raw.withColumn("Flow Bytes/s", F.when(F.col("` Label`") == "ATTACK", F.col("`Flow Bytes/s`") + 1e6).otherwise(F.col("`Flow Bytes/s`")))
    return training.train(raw, trees=4, rounds=2, forest_depth=4)


def test_training_balances_and_learns(trained):
    assert trained.balanced_labels.first().warning is None
    for report in training.evaluate(trained).values():
        rows = {r["class"]: r for r in report.collect()}
        assert rows["accuracy"].f1 > 0.9 and rows["0"].support + rows["1"].support == rows["macro avg"].support


def test_artifacts_round_trip_and_the_booster_is_optional(spark, trained, tmp_path):
    training.save(spark, str(tmp_path), trained.detector)
    loaded = training.load(spark, str(tmp_path))
    assert loaded.scaler == trained.detector.scaler and loaded.baseline == trained.detector.baseline
    rows = trained.test.select(*BASE_FEATURES)
    a = models.score_models(rows, trained.detector.models, trained.detector.scaler).select("ml").collect()
    assert a == models.score_models(rows, loaded.models, loaded.scaler).select("ml").collect()
    two = {k: m for k, m in loaded.models.items() if k != "gbt"}
    r = models.score_models(rows, two, loaded.scaler).first().ml
    assert r.score == pytest.approx(0.4 * r.dt_confidence + 0.6 * r.rf_confidence) and "gbt_prediction" not in r
    text = artifacts.baseline_as_json(spark.read.json(f"{tmp_path}/baseline")).first()[0]
    (tmp_path / "one.json").write_text(text)
    assert artifacts.read_baseline_json(spark, str(tmp_path / "one.json")).keys() == loaded.baseline.keys()
    importance = models.feature_importances(loaded.models["dt"], list(loaded.scaler)).collect()
    assert importance[0].feature == "flow_bytes_per_sec"


def test_macro_f1_of_the_grid(spark):
    counts = [(6, 100, 0.1, 0, 0, 0, 6), (6, 100, 0.1, 0, 0, 1, 2), (6, 100, 0.1, 0, 1, 1, 1), (6, 100, 0.1, 0, 1, 0, 1), (6, 100, 0.1, 1, 0, 0, 5)]
    df = spark.createDataFrame(counts, "depth int, rounds int, step double, fold int, label int, prediction int, n bigint")
    f0, f1 = 2 * 6 / (8 + 7), 2 * 1 / (2 + 3)
    assert models.grid_scores(df).first().macro_f1 == pytest.approx(((f0 + f1) / 2 + 1.0) / 2)


@pytest.fixture(scope="module")
def log(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("log") / "lines")
    registry.event_lines(spark, SF_DIR).coalesce(1).write.text(path)
    return path


def test_log_analysis_writes_results_and_alerts(spark, trained, log, tmp_path):
    run = batch.analyze_log(spark, log, trained.detector, burst_rate=0.02)
    results = run.results
    closed = run.sessions.filter("close_reason <> 'flush'").count()
    assert batch.run_summary(run.lines, results).first().finalized_sessions == closed
    sinks.write_results(results, str(tmp_path / "results"))
    back = spark.read.option("header", True).csv(str(tmp_path / "results"))
    assert back.columns == sinks.RESULT_FIELDS and back.count() == closed
    texts = alerts.render_alerts(results)
    sinks.write_alerts(texts, str(tmp_path / "alerts"))
    written = "\n".join(r.value for r in spark.read.text(str(tmp_path / "alerts")).collect())
    assert written.count(alerts.TITLE) == texts.count() > 0
    one = texts.filter(~F.col("zero_byte_pattern")).first().message
    for part in ("Endpoints", "Volume", "Decision Tree:", "Boosted trees:", "It may mean", "written for: "):
        assert part in one


def test_stream_of_sessions_equals_batch(spark):
    name = "stream_sessions"
    ok, note = compare(spark, connect("0.001"), name, registry.QUERIES[name], registry.SQL[name], "0.001")
    assert ok, note


def test_stream_of_bursts_equals_batch(spark, tmp_path):
    rng, t, rows = random.Random(4), 0, []
    for i in range(60):
        t += rng.choice([0, 1000, 300_000, 2_000_000]) if i != 40 else 700_000_000
        rows.append(dict(us=t, src_ip=f"s{i % 3 // 2}"))
    df = sessions(spark, rows)
    for low, high in ((0, 30), (30, 60)):
        df.filter(F.col("flow_id").cast("int").between(low, high - 1)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run = (stream_bursts(stream).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state"))
           .trigger(availableNow=True).start(str(tmp_path / "out")))
    run.awaitTermination()
    want = sorted(tuple(r) for r in zero_byte_bursts(df).collect())
    assert want and sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == want


def test_monitor_end_to_end(spark, trained, log, tmp_path):
    out, seen = str(tmp_path), {}
    once = {"availableNow": True}
    monitor.start_sessions(spark, log, out, once).awaitTermination()
    found = spark.read.parquet(f"{out}/sessions")
    assert found.count() > 0 and set(r[0] for r in found.select("close_reason").distinct().collect()) <= {"terminal", "timeout"}
    monitor.start_scoring(
        spark, out, trained.detector, lambda df, i: seen.update(alerts=df.count()),
        lambda df, i: seen.update(status=df.columns), once,
    ).awaitTermination()
    results = spark.read.option("header", True).csv(f"{out}/results")
    assert results.count() == found.count() and seen["status"] == ["src_ip", "overall_anomaly_score"]
    assert seen["alerts"] == results.filter("is_anomalous = 1").count()
    monitor.start_bursts(spark, out, once, max_rate=0.02).awaitTermination()
    assert spark.read.parquet(f"{out}/bursts").columns[:2] == ["flow_id", "session_no"]
