"""From raw documents to token ids: the five stages of a training-data pipeline.

Every stage works on all that its predecessor kept, is written as Parquet and
read again. All but the last return the columns of documents; the last adds the
token ids and the decoded text's agreement.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from wireloom.llm import minhash, mixing, pieces, pii, quality
from wireloom.sources.staging import materialize

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.drop_near_duplicates(docs)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document that the mix takes twice is there twice."""
    return mixing.take(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # decoding needs no Python workers, so it follows in the tasks that put the ids together
    decoded = pieces.decode(pieces.encode(docs, pieces.load(), ids="token_ids"), ids="token_ids", to="decoded")
    return decoded.withColumn("round_trip", F.col("decoded").eqNullSafe(F.col("text"))).drop("decoded")


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", keep_good),
    ("minhash near-dedup", drop_near_duplicates),
    ("pii", redact),
    ("mixing", mix_sources),
    ("sentencepiece", encode),
]

#: Label model, signatures and trees are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"corpus-{name.replace(' ', '-')}")
    return docs
