"""Training: cleaned, balanced, split and scaled records; three models; a baseline."""

from __future__ import annotations

from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession, functions as F

from wireloom.operators import models as ml
from wireloom.operators import prep
from wireloom.operators.features import BASE_FEATURES
from wireloom.plans.batch import Detector
from wireloom.sources import artifacts
from wireloom.sources.staging import materialize

ROW_ID = "record_id"


@dataclass
class Training:
    detector: Detector
    train: DataFrame
    test: DataFrame
    original_labels: DataFrame
    balanced_labels: DataFrame


def with_row_id(df: DataFrame) -> DataFrame:
    """Distinct rows identify themselves by a hash of their content."""
    return df.withColumn(ROW_ID, F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])), 256))


def prepare(raw: DataFrame, duration_scale: float = 1.0, seed: int = 42) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(all cleaned rows, training rows, test rows), features unscaled."""
    cleaned = with_row_id(prep.clean_training(raw))
    rows = materialize(prep.select_features(cleaned, [ROW_ID, "Label"], duration_scale), "cleaned")
    balanced = prep.balance_classes(rows, ROW_ID, seed=seed)
    train, test = prep.stratified_split(balanced, ROW_ID, seed=seed)
    return rows, train, test


def train(
    raw: DataFrame,
    trees: int = 100,
    rounds: int = 50,
    forest_depth: int = 15,
    duration_scale: float = 1.0,
    tune: dict | None = None,
) -> Training:
    """``tune`` gives the grid for the boosted trees (see
    ``models.tune_boosted_trees``); without it they are fitted once."""
    rows, train_rows, test_rows = prepare(raw, duration_scale)
    columns = [c for c in BASE_FEATURES if c in rows.columns]
    scaler = prep.fit_scaler(train_rows, columns)
    train_scaled = materialize(prep.scale(train_rows, scaler), "train")
    test_scaled = materialize(prep.scale(test_rows, scaler), "test")
    vectors = ml.assemble(train_scaled, columns)
    fits = {
        "dt": lambda: ml.train_decision_tree(vectors),
        "rf": lambda: ml.train_random_forest(vectors, trees=trees, depth=forest_depth),
    }
    if tune is None:
        fits["gbt"] = lambda: ml.train_boosted_trees(vectors, rounds=rounds)
    else:
        fits["gbt"] = lambda: ml.tune_boosted_trees(vectors, ROW_ID, **tune).bestModel
    with ThreadPool(len(fits)) as pool:  # a booster is many short jobs, a forest few long ones
        in_session = inheritable_thread_target(raw.sparkSession)
        fitted = dict(zip(fits, pool.map(in_session(lambda name: fits[name]()), fits, chunksize=1)))
    baseline = prep.build_baseline(train_scaled.filter("Label = 0"), columns)
    return Training(
        Detector(fitted, scaler, baseline),
        train_scaled,
        test_scaled,
        prep.label_report(rows, balanced=False),
        prep.label_report(train_scaled, balanced=True),
    )


def evaluate(training: Training) -> dict[str, DataFrame]:
    """A classification report per model on the held-out rows."""
    columns = [c for c in BASE_FEATURES if c in training.test.columns]
    vectors = ml.assemble(training.test, columns)
    return {
        name: ml.classification_report(model.transform(vectors))
        for name, model in training.detector.models.items()
    }


def save(spark: SparkSession, path: str, detector: Detector) -> None:
    artifacts.save_models(path, detector.models)
    artifacts.save_scaler(spark, path, detector.scaler)
    artifacts.save_baseline(spark, path, detector.baseline)


def load(spark: SparkSession, path: str) -> Detector:
    return Detector(
        artifacts.load_models(spark, path),
        artifacts.load_scaler(spark, path),
        artifacts.load_baseline(spark, path),
    )
