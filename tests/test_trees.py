import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from wireloom.operators import boosting, models, trees

COLUMNS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def rows(spark):
    x = spark.range(600).selectExpr(
        "id", "cast(id % 37 as double) as a", "cast(xxhash64(id) % 1000 as double) as b", "cast(id % 5 as double) as c"
    )
    noise = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(10)) == 0
    return x.withColumn("Label", (((F.col("a") > 17) & (F.col("b") > 0)) != noise).cast("int")).cache()


@pytest.fixture(scope="module")
def vectors(rows):
    return models.assemble(rows, COLUMNS)


@pytest.fixture(scope="module")
def fitted(vectors):
    return {
        "dt": models.train_decision_tree(vectors, depth=4),
        "rf": models.train_random_forest(vectors, trees=5, depth=6),
        "gbt": models.train_boosted_trees(vectors, rounds=6, depth=3),
    }


@pytest.mark.parametrize("name", ["dt", "rf", "gbt"])
def test_expressions_score_as_the_model_does(vectors, fitted, name):
    scored = trees.predict(fitted[name].transform(vectors), trees.compiled(fitted[name]), [F.col(c) for c in COLUMNS], "m")
    for r in scored.withColumn("p", vector_to_array("probability")[1]).collect():
        assert r.m_confidence == pytest.approx(r.p, abs=1e-12) and r.m_prediction == int(r.prediction)


def test_values_at_thresholds_go_the_same_way(spark, fitted):
    nodes = trees.export(fitted["dt"])
    edges = [(r.threshold,) * 3 for r in nodes.filter("feature >= 0").collect()]
    df = spark.createDataFrame(edges, "a double, b double, c double")
    a = trees.predict(df, trees.compiled(fitted["dt"]), [F.col(c) for c in COLUMNS], "m")
    b = fitted["dt"].transform(models.assemble(df, COLUMNS)).withColumn("p", vector_to_array("probability")[1])
    assert [r.m_confidence for r in a.collect()] == [r.p for r in b.collect()]


@pytest.mark.parametrize("name", ["dt", "rf", "gbt"])
def test_importances_equal_the_models(fitted, name):
    found = {r.feature: r.importance for r in models.feature_importances(fitted[name], COLUMNS).collect()}
    assert list(found.values()) == pytest.approx([dict(zip(COLUMNS, fitted[name].featureImportances.toArray()))[c] for c in found])


def test_the_first_rounds_are_the_smaller_booster(vectors, fitted):
    small = models.train_boosted_trees(vectors, rounds=3, depth=3)
    whole = trees.compiled(fitted["gbt"])
    values = trees.tree_values(whole, vector_to_array(models.VECTOR))
    got = small.transform(vectors).select((trees.margin(whole, values, 3) - vector_to_array("rawPrediction")[1]).alias("d")).agg(F.max(F.abs("d"))).first()[0]
    assert got < 1e-12


def test_the_grid_by_prefixes_scores_as_single_fits(rows, vectors):
    tuned = models.tune_boosted_trees(vectors, "id", depths=(2,), rounds=(1, 3), steps=(0.1, 0.3), folds=3, parallelism=2)
    folded = models.stratified_folds(vectors, "id")
    found = {(r.rounds, r.step): r.macro_f1 for r in tuned.scores.collect()}
    assert set(found) == {(1, 0.1), (1, 0.3), (3, 0.1), (3, 0.3)}
    counts = tuned.counts.groupBy("depth", "rounds", "step").agg(F.sum("n").alias("n"))
    assert {r.n for r in counts.collect()} == {600}
    from pyspark.ml.classification import GBTClassifier

    means = []
    for fold in range(3):
        single = GBTClassifier(labelCol="Label", featuresCol=models.VECTOR, seed=models.SEED, maxDepth=2, stepSize=0.3, maxIter=1)
        scored = single.fit(folded.filter(F.col("fold") != fold)).transform(folded.filter(F.col("fold") == fold))
        means.append(models.classification_report(scored).filter("class = 'macro avg'").first().f1)
    assert found[1, 0.3] == pytest.approx(sum(means) / 3)
    best = max(found.values())
    assert found[tuned.best["rounds"], tuned.best["step"]] == best and tuned.bestModel.getNumTrees == tuned.best["rounds"]


@pytest.mark.parametrize("depth, rounds", [(1, 3), (3, 8), (6, 4)])
def test_boosters_of_one_task_are_mllibs(rows, depth, rounds):
    """Few and many values, a constant, two features that always tie, and rows that are alike."""
    more = rows.withColumns({"d": F.col("c") * 2, "e": F.lit(7.0), "f": F.log(F.col("id") + 2)})
    columns = [*COLUMNS, "d", "e", "f"]
    vectors = models.assemble(more.unionByName(more.filter("id < 50")), columns).withColumn("fold", F.lit(0))
    booster = GBTClassifier(labelCol="Label", featuresCol=models.VECTOR, seed=models.SEED, maxDepth=depth, stepSize=0.2, maxIter=rounds)
    theirs, ours = booster.fit(vectors), boosting.fit(boosting.pack(vectors, "Label", models.VECTOR, "fold"), booster, len(columns))
    assert (ours.getNumTrees, ours.getMaxIter(), ours.numFeatures) == (rounds, rounds, len(columns))
    assert list(ours.treeWeights) == list(theirs.treeWeights)
    assert [t.numNodes for t in ours.trees] == [t.numNodes for t in theirs.trees]
    a = theirs.transform(vectors).select("id", vector_to_array("rawPrediction")[1].alias("a"))
    b = ours.transform(vectors).select("id", vector_to_array("rawPrediction")[1].alias("b"))
    assert a.join(b, "id").agg(F.max(F.abs(F.col("a") - F.col("b")))).first()[0] < 1e-12
    assert list(ours.featureImportances.toArray()) == pytest.approx(list(theirs.featureImportances.toArray()))


def test_the_grid_takes_no_job_for_each_tree(spark, vectors):
    sc = spark.sparkContext
    sc.setJobGroup("grid", "grid")
    try:
        tuned = models.tune_boosted_trees(vectors, "id", depths=(2,), rounds=(10, 20), steps=(0.1,))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert len(sc.statusTracker().getJobIdsForGroup("grid")) < 80  # 4 boosters of 20 trees of 2 levels
    assert tuned.scores.count() == 2 and tuned.bestModel.getNumTrees == tuned.best["rounds"]


def test_the_grid_is_the_same_where_rows_exceed_a_task(vectors, monkeypatch):
    grid = {"depths": (2, 3), "rounds": (2, 4), "steps": (0.2,), "folds": 2}
    own = models.tune_boosted_trees(vectors, "id", **grid)
    monkeypatch.setattr(boosting, "MAX_CELLS", 1)
    other = models.tune_boosted_trees(vectors, "id", **grid)
    assert sorted(own.counts.collect()) == sorted(other.counts.collect()) and own.best == other.best
    means = {tuple(r)[:3]: r.macro_f1 for r in other.scores.collect()}
    assert {tuple(r)[:3]: r.macro_f1 for r in own.scores.collect()} == pytest.approx(means)


def test_boosters_refuse_what_mllib_refuses(rows):
    odd = models.assemble(rows.withColumn("c", F.expr("if(id = 3, double('Infinity'), c)")), COLUMNS)
    with pytest.raises(Exception, match="finite"):
        models.tune_boosted_trees(odd, "id", depths=(2,), rounds=(1,), steps=(0.1,))
    with pytest.raises(Exception, match="0 or 1"):
        models.tune_boosted_trees(models.assemble(rows.withColumn("Label", F.lit(2)), COLUMNS), "id", depths=(2,), rounds=(1,), steps=(0.1,))


def test_sessions_that_observe_can_score(spark, rows, fitted):
    """Model objects can't be sent to tasks once a session has observed anything; expressions can."""
    ready = {k: trees.compiled(m) for k, m in fitted.items()}
    observed = rows.observe("seen", F.count(F.lit(1)).alias("n"))
    scored = models.score_models(observed, ready, columns=COLUMNS)
    plain = models.score_models(rows, fitted, columns=COLUMNS)
    a = {r.id: r.ml.score for r in scored.collect()}
    assert a == pytest.approx({r.id: r.ml.score for r in plain.collect()})


def test_a_tree_without_splits(spark):
    one = spark.createDataFrame([(0, 1.0, 0, -1, 0.0, -1, -1, 0.75, 0.0, 10.0)], trees.NODES)
    r = trees.predict(spark.range(1), trees.compile_nodes(one, False), [F.col("id")], "m").first()
    assert (r.m_confidence, r.m_prediction) == (0.75, 1)
