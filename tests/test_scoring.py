import inspect
import random
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from wireloom.operators import features, prep, scoring
from wireloom.operators.features import BASE_FEATURES
from wireloom.operators.quantiles import SLACKS, exact_percentiles
from wireloom.operators.ranking import class_rank, take_per_class

UNIT = dict(mean=0.0, std=1.0, min=-9.0, max=9.0, q1=-1.0, median=0.0, q3=1.0, iqr=2.0)
FLAT = {**UNIT, "iqr": 0.0}


def stat(spark, values, baseline, scaler=None, **extra):
    row = {**dict.fromkeys(BASE_FEATURES, 0.0), **values, **extra}
    df = spark.createDataFrame([tuple(row.values())], ", ".join(f"{c} double" for c in row))
    return scoring.score_statistical(df, baseline, scaler).first().stat


def test_z_of_exactly_four_is_no_outlier_but_is_reported(spark):
    s = stat(spark, {"duration": 4.0}, dict.fromkeys(BASE_FEATURES, FLAT))
    assert s.score == 0 and not s.is_anomalous
    assert [(d.feature, d.z_score, d.is_outlier) for d in s.details] == [("duration", 4.0, False)]


def test_weights_order_and_verdict(spark):
    values = {"flow_bytes_per_sec": 10.0, "dest_port": 5.0, "duration": -4.5}
    s = stat(spark, values, dict.fromkeys(BASE_FEATURES, UNIT))
    assert s.score == pytest.approx((10 * 0.8 + 5 * 1.2 + 4.5) / 9) and s.is_anomalous
    assert [d.feature for d in s.details] == ["flow_bytes_per_sec", "dest_port", "duration"]


def test_zero_deviation_outside_the_quartiles_counts_as_one(spark):
    odd = {**UNIT, "std": 0.0, "q1": 5.0, "q3": 6.0, "iqr": 1.0}
    s = stat(spark, {}, {**dict.fromkeys(BASE_FEATURES, UNIT), "duration": odd})
    assert s.score == pytest.approx(1 / 9) and s.details[0].is_outlier and s.details[0].z_score == 0


def test_integer_features_are_rounded_half_even_after_scaling(spark):
    scaler = {c: (0.0, 2.0) for c in BASE_FEATURES}
    base = dict.fromkeys(BASE_FEATURES, {**UNIT, "q1": -0.1, "q3": 0.1, "iqr": 0.2})
    s = stat(spark, {"dest_port": 9.0, "duration": 9.0, "down_up_ratio": 9.0}, base, scaler, duration_known=1.0)
    assert {d.feature: d.value for d in s.details} == {"dest_port": 4.0, "duration": 4.5, "down_up_ratio": 4.0}
    s = stat(spark, {"total_fwd_bytes": 2.0, "down_up_ratio": 9.0, "duration": 9.0}, base, scaler, duration_known=0.0)
    assert {d.feature: d.value for d in s.details} == {"total_fwd_bytes": 1.0, "down_up_ratio": 4.5, "duration": 4.0}


def test_neutral_results(spark):
    df = spark.createDataFrame([(1.0,)], "dest_port double")
    out = scoring.combine(scoring.ensemble(scoring.score_statistical(df, {}))).first()
    assert (out.combined_score, out.is_anomalous, out.stat.details) == (0.0, False, [])
    assert not scoring.has_coverage(df, BASE_FEATURES)


def test_fields_are_resolved_by_preference(spark):
    df = spark.createDataFrame([("x", 5, (7, "9"))], "spkts string, total_bwd_packets int, flow struct<bytes_toserver:int,bytes_toclient:string>")
    r = features.flow_features(df).first()
    assert (r.total_fwd_packets, r.total_bwd_packets, r.total_fwd_bytes, r.total_bwd_bytes) == (0, 5, 7, 9)
    assert r.duration == 0 and r.duration_known == 0 and r.flow_bytes_per_sec == 16 / 0.001
    df = spark.createDataFrame([("2024-01-01T00:00:00Z", "1704067202.5", 0.0)], "starttime string, endtime string, dur double")
    assert features.flow_features(df).first().duration == 2.5


def test_percentiles_are_exact_whatever_the_brackets(spark):
    """Good brackets, too narrow ones that are taken wider, and everything in one."""
    rng = random.Random(3)
    a = [53.0 if rng.random() < 0.4 else rng.lognormvariate(0, 3) for _ in range(5000)]
    b = [None if rng.random() < 0.1 else float(rng.randrange(40)) for _ in range(5000)]
    df = spark.createDataFrame(list(zip(a, b)), "`a b` double, b double")
    probs = [0.0, 0.25, 0.5, 0.75, 1.0]
    for slacks in (SLACKS, (0.0009, 1.0), (1.0,)):
        got = exact_percentiles(df, ["a b", "b"], probs, slacks)
        assert got["a b"] == pytest.approx(list(np.quantile(a, probs)), rel=1e-12)
        assert got["b"] == pytest.approx(list(np.quantile([x for x in b if x is not None], probs)), rel=1e-12)
    few = df.selectExpr("b", "cast(null as double) none").filter("b < 2").limit(7)
    values = sorted(r.b for r in few.collect())
    assert exact_percentiles(few, ["b", "none"], [0.9, 0.1]) == {
        "b": pytest.approx(list(np.quantile(values, [0.9, 0.1]))), "none": [None, None]}
    odd = spark.range(9).selectExpr("double('NaN') nan", "if(id < 6, id, double('NaN')) mixed")
    got = exact_percentiles(odd, ["nan", "mixed"], [0.5, 1.0])
    assert got["mixed"][0] == 4.0 and all(np.isnan(x) for x in [*got["nan"], got["mixed"][1]])


@pytest.mark.parametrize("digits", [1, 4])
def test_class_quotas_are_exact_and_repeatable(spark, digits):
    df = spark.range(1000).withColumn("c", (F.col("id") % 7 == 0).cast("int"))
    taken, rest = take_per_class(df, "c", "id", {0: 100, 1: 143}, digits=digits)
    ids = {r.id for r in taken.collect()}
    assert len(ids) == 243 and sum(i % 7 == 0 for i in ids) == 143
    assert {r.id for r in rest.collect()} == set(range(1000)) - ids
    again, _ = take_per_class(df.repartition(5), "c", "id", {0: 100, 1: 143})
    assert {r.id for r in again.collect()} == ids
    ranks = {(r.c, r.class_rank) for r in class_rank(df, "c", "id", digits=digits).collect()}
    assert ranks == {(0, i + 1) for i in range(857)} | {(1, i + 1) for i in range(143)}


def test_balance_and_split(spark):
    df = spark.range(900).withColumn("Label", (F.col("id") % 9 == 0).cast("int"))
    with pytest.raises(ValueError):
        prep.balance_classes(df, "id", "target")
    balanced = prep.balance_classes(df, "id")
    assert tuple(prep.label_report(balanced).first()) == (100, 100, 1.0, None)
    assert prep.label_report(df).first().warning == "imbalance"
    flipped = df.withColumn("Label", 1 - F.col("Label"))
    assert prep.label_report(flipped, balanced=False).first().warning == "labels may be reversed"
    train, test = prep.stratified_split(balanced, "id")
    assert train.count() == 150 and test.filter("Label = 1").count() == 25


def test_cleaning(spark):
    rows = [(1.0, 1, "BENIGN"), (float("inf"), 2, "x"), (None, 3, "benign"), (3.0, None, "x"), (1.0, 1, "BENIGN"), (2.0, 9, None)]
    raw = spark.createDataFrame(rows, "` a` double, `b ` int, ` Label` string")
    got = sorted(tuple(r) for r in prep.clean_training(raw).collect())
    assert got == [(1.0, 1.0, 0), (1.5, 2.0, 1), (1.5, 3.0, 0), (3.0, 2.0, 1)]
    lower = prep.binary_label(spark.createDataFrame([("benign",), ("DDoS",)], "label string"))
    assert [r.Label for r in lower.collect()] == [0, 1]
    with pytest.raises(ValueError):
        prep.binary_label(spark.range(1))


def test_cleaning_works_every_source_row_out_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(x):
        seen.add(1)
        return None if x % 10 == 0 else float(x % 4)

    raw = spark.range(50).select(F.udf(count, "double")("id").alias(" a"), F.col("id").alias("b"), F.lit("x").alias("Label"))
    assert prep.clean_training(raw).count() == 50
    assert seen.value == 50


def test_models_are_trained_side_by_side(spark, monkeypatch):
    from wireloom.operators import models
    from wireloom.plans import training

    meet = threading.Barrier(3, timeout=60)

    def stub(name):
        def fit(vectors, **options):
            meet.wait()  # fails if one waits for the end of another
            return name, vectors.count(), options

        return fit

    names = {"dt": "train_decision_tree", "rf": "train_random_forest", "gbt": "train_boosted_trees"}
    for name, function in names.items():
        monkeypatch.setattr(models, function, stub(name))
    raw = spark.range(40).selectExpr("double(id) ` Destination Port`", "double(id * 2) `Flow Duration`", "if(id % 2 = 0, 'BENIGN', 'x') Label")
    got = training.train(raw, trees=7, rounds=9, forest_depth=3).detector.models
    assert got == {"dt": ("dt", 30, {}), "rf": ("rf", 30, {"trees": 7, "depth": 3}), "gbt": ("gbt", 30, {"rounds": 9})}


def test_scaler_uses_the_population_deviation(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (3.0, 5.0), (4.0, 5.0)], "x double, c double")
    scaler = prep.fit_scaler(df, ["x", "c"])
    assert scaler["x"] == pytest.approx((2.5, 1.118033988)) and scaler["c"] == (5.0, 1.0)
    base = prep.build_baseline(df, ["x"])["x"]
    assert base["std"] == pytest.approx(1.290994448) and (base["q1"], base["median"], base["q3"]) == (1.75, 2.5, 3.25)


def test_grid_search_covers_the_whole_grid(spark, monkeypatch):
    from wireloom.operators import models
    from wireloom.plans import registry

    asked = {}

    def search(train, id_column, label, **cut):
        asked.update(inspect.signature(tuned).bind(train, id_column, label, **cut).arguments)
        return models.Tuned(None, {}, spark.createDataFrame([(6, 100, 0.1, 0.5)], "depth int, rounds int, step double, macro_f1 double"), None)

    tuned = models.tune_boosted_trees
    monkeypatch.setattr(models, "tune_boosted_trees", search)
    assert len(registry.QUERIES["grid_search"](spark, "/root/testdata/sf0.001").collect()) == 1
    assert set(asked) == {"train", "id_column", "label"}  # nothing smaller than the defaults
    default = {k: p.default for k, p in inspect.signature(tuned).parameters.items()}
    assert (default["depths"], default["rounds"], default["steps"], default["folds"]) == ((6, 9, 12), (100, 150), (0.05, 0.1, 0.2), 3)
