"""Saved training results: models, scaler, baseline and feature list in one folder."""

from __future__ import annotations

import json

from pyspark.ml.classification import (
    DecisionTreeClassificationModel,
    GBTClassificationModel,
    RandomForestClassificationModel,
)
from pyspark.sql import DataFrame, SparkSession, functions as F

from wireloom.operators.scoring import baseline_table

LOADERS = {
    "dt": DecisionTreeClassificationModel,
    "rf": RandomForestClassificationModel,
    "gbt": GBTClassificationModel,
}
STATS = ["mean", "std", "min", "max", "q1", "median", "q3", "iqr"]


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def save_models(path: str, models: dict) -> None:
    for name, model in models.items():
        model.write().overwrite().save(f"{path}/{name}")


def load_models(spark: SparkSession, path: str) -> dict:
    """The models that are there; the boosted one may be missing."""
    return {n: cls.load(f"{path}/{n}") for n, cls in LOADERS.items() if _exists(spark, f"{path}/{n}")}


def save_scaler(spark: SparkSession, path: str, scaler: dict[str, tuple[float, float]]) -> None:
    rows = [(i, c, float(m), float(s)) for i, (c, (m, s)) in enumerate(scaler.items())]
    spark.createDataFrame(rows, "position int, feature string, mean double, std double").coalesce(
        1
    ).write.mode("overwrite").parquet(f"{path}/scaler")


def load_scaler(spark: SparkSession, path: str) -> dict[str, tuple[float, float]]:
    rows = spark.read.parquet(f"{path}/scaler").orderBy("position").collect()  # one row per feature
    return {r["feature"]: (r["mean"], r["std"]) for r in rows}


def save_baseline(spark: SparkSession, path: str, baseline: dict[str, dict[str, float]]) -> None:
    baseline_table(spark, baseline).coalesce(1).write.mode("overwrite").json(f"{path}/baseline")


def load_baseline(spark: SparkSession, path: str) -> dict[str, dict[str, float]]:
    schema = "feature string, " + ", ".join(f"`{s}` double" for s in STATS)
    rows = spark.read.schema(schema).json(f"{path}/baseline").collect()  # one row per feature
    return {r["feature"]: {s: r[s] for s in STATS} for r in rows}


def read_baseline_json(spark: SparkSession, path: str) -> dict[str, dict[str, float]]:
    """A baseline kept as one JSON object ``{feature: {statistic: value}}``."""
    text = spark.read.option("wholetext", True).text(path).first()[0]
    return json.loads(text)


def baseline_as_json(table: DataFrame) -> DataFrame:
    """The long table as one JSON object."""
    entry = F.struct("feature", F.struct(*STATS).alias("stats"))
    return table.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(entry)))).alias("baseline"))
