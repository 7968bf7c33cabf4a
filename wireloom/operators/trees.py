"""Fitted tree ensembles as tables of nodes, and as expressions.

A model of MLlib becomes a table with a row for each node, and from that an
expression that walks all trees with Spark's own functions: rows are scored
without model objects in the tasks, in any plan, also of a stream. The walk
knows every tree's value, so sums over the first trees of a booster (a booster
with fewer rounds) and importances come from the same table.

A model is as large as its trees; it is on the driver while it is trained, and
the expression holds it as constants.
"""

from __future__ import annotations

import json
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from wireloom.sources.staging import staging_path

NODES = "tree int, weight double, node int, feature int, threshold double, left int, right int, value double, gain double, rows double"


def export(model) -> DataFrame:
    """``NODES`` of a fitted decision tree, forest or booster, from its saved form. ``value``
    is the share of class 1 among a leaf's rows; for a booster it is the prediction. Leaves
    have feature -1."""
    spark = SparkSession.builder.getOrCreate()  # threads have no active session
    path = staging_path(spark, "model")
    model.write().save(path)
    saved = spark.read.parquet(f"{path}/data")
    single = "nodeData" not in saved.columns
    n = (lambda c: F.col(c)) if single else (lambda c: F.col(f"nodeData.{c}"))
    stats = n("impurityStats")
    # a booster's trees predict residuals; their statistics are count, sum and sum of squares
    booster = is_booster(model)
    total = stats[0] if booster else F.aggregate(stats, F.lit(0.0), lambda a, b: a + b)
    share = F.when(total > 0, F.coalesce(F.get(stats, F.lit(1)), F.lit(0.0)) / total).otherwise(F.lit(0.0))
    inner = n("leftChild") >= 0
    nodes = saved.select(
        (F.lit(0) if single else F.col("treeID")).alias("tree"),
        n("id").alias("node"),
        F.when(inner, n("split.featureIndex")).otherwise(-1).alias("feature"),
        F.when(inner, n("split.leftCategoriesOrThreshold")[0]).otherwise(0.0).alias("threshold"),
        F.when(inner, n("leftChild")).otherwise(-1).alias("left"),
        F.when(inner, n("rightChild")).otherwise(-1).alias("right"),
        (n("prediction") if booster else share).alias("value"),
        F.when(inner, n("gain")).otherwise(0.0).alias("gain"),
        total.alias("rows"),
    )
    weights = [1.0] if single else list(model.treeWeights)
    listed = spark.createDataFrame(list(enumerate(map(float, weights))), "tree int, weight double")
    return nodes.join(F.broadcast(listed), "tree").select(*[c.split()[0] for c in NODES.split(", ")])


def is_booster(model) -> bool:
    return type(model).__name__.startswith("GBT")


_COMPILED: dict[str, Ensemble] = {}


def compiled(model) -> Ensemble:
    """The expression's constants of a fitted model, made once for each model."""
    if isinstance(model, Ensemble):
        return model
    if model.uid not in _COMPILED:
        _COMPILED[model.uid] = compile_nodes(export(model), is_booster(model))
    return _COMPILED[model.uid]


class Ensemble(NamedTuple):
    """Trees as constants: parts of every node, trees one after the other."""

    booster: bool
    roots: list[int]
    weights: list[float]
    depth: int
    nodes: str  # JSON: lists of feature, threshold, left, right, value


def compile_nodes(nodes: DataFrame, booster: bool) -> Ensemble:
    rows = sorted((r.tree, r.node, r.weight, r.feature, r.threshold, r.left, r.right, r.value) for r in nodes.collect())
    place = {(r[0], r[1]): k for k, r in enumerate(rows)}
    roots = [place[t, n] for t, n in place if n == 0]
    children = [[place[t, x] if x >= 0 else -1 for x in (left, right)] for t, _, _, _, _, left, right, _ in rows]
    deep = 0
    for r in roots:
        level = [r]
        for d in range(len(rows)):
            level = [c for k in level for c in children[k] if c >= 0]
            if not level:
                break
            deep = max(deep, d + 1)
    parts = [[r[3] for r in rows], [r[4] for r in rows], [c[0] for c in children], [c[1] for c in children], [r[7] for r in rows]]
    return Ensemble(booster, roots, [rows[r][2] for r in roots], deep, json.dumps(parts))


def _constant(values: list, kind: str) -> Column:
    # one string, folded to an array once for a plan, not an expression for each value
    return F.split(F.lit(",".join(map(repr, values))), ",").cast(f"array<{kind}>")


def tree_values(ensemble: Ensemble, features: Column) -> Column:
    """The value of every tree for an array of features; splits send values up to the
    threshold to the left, all others (also NaN) to the right."""
    feature, threshold, left, right, value = (_constant(p, k) for p, k in zip(json.loads(ensemble.nodes), ("int", "double", "int", "int", "double")))

    def step(node: Column, _: Column) -> Column:
        at = F.get(feature, node)
        below = F.get(features, at) <= F.get(threshold, node)
        return F.when(at < 0, node).when(below, F.get(left, node)).otherwise(F.get(right, node))

    steps = F.sequence(F.lit(1), F.lit(max(1, ensemble.depth)))
    return F.transform(_constant(ensemble.roots, "int"), lambda r: F.aggregate(steps, r, step, lambda n: F.get(value, n)))


def margin(ensemble: Ensemble, values: Column, rounds: int | None = None) -> Column:
    """A booster's weighted sum over its first ``rounds`` trees (all, if none is given)."""
    weighed = F.zip_with(values, _constant(ensemble.weights, "double"), lambda v, w: v * w)
    return F.aggregate(weighed if rounds is None else F.slice(weighed, 1, rounds), F.lit(0.0), lambda a, b: a + b)


def confidence(ensemble: Ensemble, values: Column) -> Column:
    """Probability of class 1: mean share of the trees, or the logistic of a booster's margin."""
    if ensemble.booster:
        return 1 / (1 + F.exp(-2 * margin(ensemble, values)))
    return F.aggregate(values, F.lit(0.0), lambda a, b: a + b) / len(ensemble.roots)


def predict(df: DataFrame, ensemble: Ensemble, columns: list[Column], name: str) -> DataFrame:
    """Add ``{name}_prediction`` and ``{name}_confidence`` from the features ``columns``."""
    values = tree_values(ensemble, F.array(*[c.cast("double") for c in columns]))
    scored = df.withColumn(f"{name}_confidence", confidence(ensemble, values))
    return scored.withColumn(f"{name}_prediction", (F.col(f"{name}_confidence") > 0.5).cast("int"))


def importances(nodes: DataFrame, columns: list[str], by_tree: bool = True) -> DataFrame:
    """``feature, importance``, strongest first: the gain of a feature's splits, weighed by
    rows, as a share of all; ``by_tree`` gives every tree the same say (boosters don't)."""
    gains = nodes.filter("feature >= 0").groupBy("tree", "feature").agg(F.sum(F.col("gain") * F.col("rows")).alias("g"))
    whole = F.sum("g").over(Window.partitionBy("tree")) if by_tree else F.lit(1.0)
    shares = gains.withColumn("whole", whole).filter("whole > 0").groupBy("feature").agg(F.sum(F.col("g") / F.col("whole")).alias("s"))
    found = {r.feature: r.s for r in shares.collect()}  # one number for each feature
    total = sum(found.values()) or 1.0
    rows = [(c, found.get(k, 0.0) / total) for k, c in enumerate(columns)]
    return nodes.sparkSession.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")
