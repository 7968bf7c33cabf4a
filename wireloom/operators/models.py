"""Tree ensembles and their evaluation, on MLlib."""

from __future__ import annotations

from multiprocessing.pool import ThreadPool
from typing import NamedTuple

from pyspark import inheritable_thread_target
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassificationModel,
    GBTClassifier,
    RandomForestClassifier,
)
from pyspark.ml.feature import IndexToString, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from wireloom.operators import boosting, trees
from wireloom.operators.features import BASE_FEATURES
from wireloom.operators.ranking import class_counts, class_rank
from wireloom.operators.scoring import ensemble, has_coverage
from wireloom.sources.staging import materialize

SEED = 42
WEIGHT = "_weight"
VECTOR = "_features"


def assemble(df: DataFrame, columns: list[str], output: str = VECTOR) -> DataFrame:
    return VectorAssembler(inputCols=columns, outputCol=output).transform(df)


def balanced_weights(df: DataFrame, label: str = "Label") -> DataFrame:
    """Each class weighs the same in total: ``n / (classes * n_class)``."""
    counts = class_counts(df, label)
    total = sum(counts.values())
    cases = [
        F.when(F.col(label) == F.lit(k), F.lit(total / (len(counts) * n))) for k, n in counts.items()
    ]
    return df.withColumn(WEIGHT, F.coalesce(*cases))


def positive_weights(df: DataFrame, label: str = "Label", weight: float = 5.0) -> DataFrame:
    return df.withColumn(WEIGHT, F.when(F.col(label) == 1, F.lit(weight)).otherwise(F.lit(1.0)))


def encode_labels(df: DataFrame, source: str, target: str = "label_index"):
    """(encoded frame, decoder): indices follow the alphabetic order of labels."""
    model = StringIndexer(inputCol=source, outputCol=target, stringOrderType="alphabetAsc").fit(df)
    return model.transform(df), IndexToString(inputCol=target, outputCol=f"{source}_decoded", labels=model.labels)


def train_decision_tree(train: DataFrame, label: str = "Label", depth: int = 10):
    return DecisionTreeClassifier(
        labelCol=label, featuresCol=VECTOR, weightCol=WEIGHT, maxDepth=depth, seed=SEED
    ).fit(balanced_weights(train, label))


def train_random_forest(
    train: DataFrame, label: str = "Label", trees: int = 100, depth: int = 15, min_leaf: int = 4
):
    return RandomForestClassifier(
        labelCol=label,
        featuresCol=VECTOR,
        weightCol=WEIGHT,
        numTrees=trees,
        maxDepth=depth,
        minInstancesPerNode=min_leaf,
        featureSubsetStrategy="sqrt",
        seed=SEED,
    ).fit(balanced_weights(train, label))


def train_boosted_trees(
    train: DataFrame, label: str = "Label", rounds: int = 50, positive_weight: float = 5.0, depth: int = 5
):
    return GBTClassifier(
        labelCol=label, featuresCol=VECTOR, weightCol=WEIGHT, maxIter=rounds, maxDepth=depth, seed=SEED
    ).fit(positive_weights(train, label, positive_weight))


def stratified_folds(df: DataFrame, id_column: str, label: str = "Label", folds: int = 3) -> DataFrame:
    """Add ``fold``; every class is spread evenly over the folds."""
    ranked = class_rank(df, label, id_column, SEED)
    return ranked.withColumn("fold", F.pmod("class_rank", F.lit(folds)).cast("int")).drop("class_rank")


class Tuned(NamedTuple):
    bestModel: GBTClassificationModel
    best: dict[str, float]
    scores: DataFrame  # depth, rounds, step, macro_f1
    counts: DataFrame  # depth, rounds, step, fold, label, prediction, n


def tune_boosted_trees(
    train: DataFrame,
    id_column: str,
    label: str = "Label",
    depths=(6, 9, 12),
    rounds=(100, 150),
    steps=(0.05, 0.1, 0.2),
    folds: int = 3,
    parallelism: int = 8,
) -> Tuned:
    """Grid search by stratified cross-validation on macro F1. A booster's first
    rounds are the booster with fewer rounds, so depth, step and fold are fitted once, for
    the greatest number of rounds, and the held-out rows are scored for every number. Of equal
    means the first combination wins; it is fitted on all rows. Each booster is trained by one
    task (``boosting``), or by MLlib, ``parallelism`` at a time, where the rows exceed a task."""
    folded = materialize(stratified_folds(train, id_column, label, folds).select(label, VECTOR, "fold").hint("rebalance"), "folds")
    jobs = [(d, float(s), f) for d in sorted(depths, reverse=True) for s in steps for f in range(folds)]  # the longest first

    def booster(depth: int, step: float, n: int) -> GBTClassifier:
        return GBTClassifier(labelCol=label, featuresCol=VECTOR, seed=SEED, maxDepth=depth, stepSize=step, maxIter=n, checkpointInterval=-1)

    def held_out(job: tuple[int, float, int]) -> list[tuple]:
        depth, step, fold = job
        fitted = trees.compiled(booster(depth, step, max(rounds)).fit(folded.filter(F.col("fold") != fold)))
        values = trees.tree_values(fitted, vector_to_array(VECTOR))
        rows = folded.filter(F.col("fold") == fold).select(F.col(label).cast("int").alias("label"), values.alias("values"))
        says = [F.struct(F.lit(n).alias("rounds"), (trees.margin(fitted, F.col("values"), n) > 0).cast("int").alias("prediction")) for n in rounds]
        counts = rows.select("label", F.inline(F.array(*says))).groupBy("label", "rounds", "prediction").count().collect()
        return [(*job, r.rounds, r.label, r.prediction, r["count"]) for r in counts]  # 4 rows a number of rounds

    size = folded.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(vector_to_array(VECTOR))).alias("features")).first()
    small = size.n * (size.features or 0) <= boosting.MAX_CELLS
    if small:
        blocks = boosting.pack(folded, label, VECTOR, "fold")
        whole = [boosting.Job(d, s, tuple(rounds), f) for d, s, f in jobs]
        found = [(*jobs[r.job], r.rounds, r.label, r.prediction, r.n) for r in boosting.held_out_counts(blocks, whole).collect()]
    else:
        with ThreadPool(parallelism) as pool:
            found = [row for rows in pool.map(inheritable_thread_target(held_out), jobs) for row in rows]
    spark = train.sparkSession
    counts = spark.createDataFrame(found, "depth int, step double, fold int, rounds int, label int, prediction int, n bigint").select(
        "depth", "rounds", "step", "fold", "label", "prediction", "n"
    )
    scores = grid_scores(counts)
    means = {(r.depth, r.rounds, r.step): r.macro_f1 for r in scores.collect()}
    best = max(((d, n, float(s)) for d in depths for n in rounds for s in steps), key=lambda c: means[c])
    chosen = booster(best[0], best[2], best[1])
    model = boosting.fit(blocks, chosen, size.features) if small else chosen.fit(folded)
    return Tuned(model, dict(zip(("depth", "rounds", "step"), best)), scores, counts)


def grid_scores(counts: DataFrame) -> DataFrame:
    """Macro F1 of each fold's confusion counts, its mean over the folds by combination. A
    class that is neither there nor predicted in a fold doesn't count."""
    grid = ["depth", "rounds", "step"]
    sides = F.array(
        F.struct(F.col("label").alias("c"), F.col("n").alias("size"), F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0).alias("hit")),
        F.struct(F.col("prediction").alias("c"), F.col("n").alias("size"), F.lit(0).cast("bigint").alias("hit")),
    )
    classes = counts.select(*grid, "fold", F.inline(sides)).groupBy(*grid, "fold", "c").agg(F.sum("size").alias("size"), F.sum("hit").alias("hit"))
    by_fold = classes.groupBy(*grid, "fold").agg(F.avg(2 * F.col("hit") / F.col("size")).alias("f1"))
    return by_fold.groupBy(*grid).agg(F.avg("f1").alias("macro_f1"))


def confusion_counts(df: DataFrame, label: str = "Label", prediction: str = "prediction") -> DataFrame:
    return df.groupBy(
        F.col(label).cast("int").alias("label"), F.col(prediction).cast("int").alias("prediction")
    ).agg(F.count(F.lit(1)).alias("n"))


def confusion_matrix(df: DataFrame, label: str = "Label", prediction: str = "prediction") -> DataFrame:
    """One row per true class, one column per predicted class."""
    matrix = confusion_counts(df, label, prediction).groupBy("label").pivot("prediction", [0, 1]).sum("n")
    return matrix.select(
        "label",
        F.coalesce("0", F.lit(0)).alias("predicted_0"),
        F.coalesce("1", F.lit(0)).alias("predicted_1"),
    )


def classification_report(
    df: DataFrame, label: str = "Label", prediction: str = "prediction"
) -> DataFrame:
    """Precision, recall, F1 and support per class, their macro and weighted
    averages, and accuracy. Works on the confusion counts, four rows for two classes."""
    counts = confusion_counts(df, label, prediction)
    sides = F.array(
        F.struct(F.col("label").alias("c"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("predicted"),
                 F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0).alias("hit")),
        F.struct(F.col("prediction").alias("c"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("predicted"),
                 F.lit(0).cast("bigint").alias("hit")),
    )

    def safe(a: str, b: str) -> Column:
        return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))

    per_class = (
        counts.select(F.inline(sides))
        .groupBy("c")
        .agg(*[F.sum(x).alias(x) for x in ("support", "predicted", "hit")])
        .withColumns({"precision": safe("hit", "predicted"), "recall": safe("hit", "support")})
        .withColumn(
            "f1",
            F.when(
                F.col("precision") + F.col("recall") > 0,
                2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall")),
            ).otherwise(F.lit(0.0)),
        )
    )
    metrics = ["precision", "recall", "f1"]
    total = F.sum("support")
    summary = per_class.agg(
        *[F.avg(m).alias(f"macro_{m}") for m in metrics],
        *[(F.sum(F.col(m) * F.col("support")) / total).alias(f"weighted_{m}") for m in metrics],
        (F.sum("hit") / total).alias("accuracy"),
        total.alias("support"),
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(f"{kind} avg").alias("class"),
                *[F.col(f"{kind}_{m}").alias(m) for m in metrics],
                F.col("support"),
            )
            for kind in ("macro", "weighted")
        ],
        F.struct(F.lit("accuracy").alias("class"), *[F.col("accuracy").alias(m) for m in metrics], F.col("support")),
    )
    return per_class.select(F.col("c").cast("string").alias("class"), *metrics, "support").unionByName(
        summary.select(F.inline(rows))
    )


def feature_importances(model, columns: list[str] = BASE_FEATURES) -> DataFrame:
    """``(feature, importance)``, strongest first."""
    return trees.importances(trees.export(model), columns, by_tree=not trees.is_booster(model))


def predict(df: DataFrame, model, name: str) -> DataFrame:
    """Add ``{name}_prediction`` and ``{name}_confidence`` (probability of attack)."""
    scored = model.transform(df)
    confidence = F.get(vector_to_array("probability"), F.lit(1))
    return (
        scored.withColumn(f"{name}_confidence", F.coalesce(confidence, F.lit(0.0)))
        .withColumn(f"{name}_prediction", F.col("prediction").cast("int"))
        .drop("rawPrediction", "probability", "prediction")
    )


def score_models(
    df: DataFrame,
    models: dict,
    scaler: dict[str, tuple[float, float]] | None = None,
    columns: list[str] = BASE_FEATURES,
) -> DataFrame:
    """Add ``ml`` from the models named dt, rf and optionally gbt. Absent features
    count as 0; with fewer than 70 % of them present, or no models, the result is
    neutral. Models are MLlib's, or ``trees.Ensemble``, which are walked by expressions."""
    if not {"dt", "rf"} <= set(models) or not has_coverage(df, columns):
        return ensemble(df)
    scaled = []
    for c in columns:
        value = F.col(c).cast("double") if c in df.columns else F.lit(0.0)
        if scaler and c in scaler:
            value = (value - F.lit(scaler[c][0])) / F.lit(scaler[c][1])
        scaled.append(value.alias(f"_s_{c}"))
    out = df.select("*", *scaled)
    if not all(isinstance(m, trees.Ensemble) for m in models.values()):
        out = assemble(out, [f"_s_{c}" for c in columns])
    for name in ("dt", "rf", "gbt"):
        if name in models and isinstance(models[name], trees.Ensemble):
            out = trees.predict(out, models[name], [F.col(f"_s_{c}") for c in columns], name)
        elif name in models:
            out = predict(out, models[name], name)
    return ensemble(out.drop(VECTOR, *[f"_s_{c}" for c in columns]))
