"""Preparation of labelled flow records for training."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F, types as T

from wireloom.operators.quantiles import exact_percentiles
from wireloom.operators.ranking import class_counts, take_per_class
from wireloom.sources.staging import materialize

# --- fixed values: training column -> feature; labels of benign traffic ---
FEATURE_COLUMNS = {
    "Destination Port": "dest_port",
    "Flow Duration": "duration",
    "Total Fwd Packets": "total_fwd_packets",
    "Total Backward Packets": "total_bwd_packets",
    "Total Length of Fwd Packets": "total_fwd_bytes",
    "Total Length of Bwd Packets": "total_bwd_bytes",
    "Flow Bytes/s": "flow_bytes_per_sec",
    "Flow Packets/s": "flow_packets_per_sec",
    "Down/Up Ratio": "down_up_ratio",
}
BENIGN = ["BENIGN", "benign"]
# --- end of fixed values ---


def _quoted(name: str):
    return F.col(f"`{name}`")


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def trim_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip() for c in df.columns])


def infinite_to_null(df: DataFrame) -> DataFrame:
    """Infinities and NaN become null in floating-point columns."""
    out = []
    for field in df.schema.fields:
        c = _quoted(field.name)
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            bad = (F.abs(c) == float("inf")) | F.isnan(c)
            c = F.when(~bad, c)
        out.append(c.alias(field.name))
    return df.select(*out)


def missing_counts(df: DataFrame) -> DataFrame:
    """``(column, missing)`` for every column, from one pass."""
    counted = df.agg(*[F.count_if(_quoted(c).isNull()).alias(c) for c in df.columns])
    pairs = F.array(
        *[F.struct(F.lit(c).alias("column"), _quoted(c).alias("missing")) for c in df.columns]
    )
    return counted.select(F.inline(pairs))


def impute_median(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Fill gaps of numeric columns with the column's exact median."""
    columns = columns or numeric_columns(df)
    gaps = df.agg(*[F.count_if(_quoted(c).isNull()).alias(str(i)) for i, c in enumerate(columns)]).first()
    gappy = [c for c, n in zip(columns, gaps) if n]
    if not gappy:
        return df
    medians = exact_percentiles(df, gappy, [0.5])
    filled = {c: m[0] for c, m in medians.items() if m[0] is not None}
    return df.select(
        *[
            F.coalesce(_quoted(c), F.lit(filled[c])).alias(c) if c in filled else _quoted(c).alias(c)
            for c in df.columns
        ]
    )


def drop_missing(df: DataFrame) -> DataFrame:
    return df.dropna()


def duplicate_count(df: DataFrame) -> DataFrame:
    """One row: rows, distinct rows and surplus duplicates."""
    return (
        df.groupBy(*[_quoted(c) for c in df.columns])
        .count()
        .agg(
            F.coalesce(F.sum("count"), F.lit(0)).alias("total_rows"),
            F.count(F.lit(1)).alias("distinct_rows"),
            F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("duplicates"),
        )
    )


def drop_duplicate_rows(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def binary_label(df: DataFrame, source: str = "Label", target: str = "Label") -> DataFrame:
    """0 for benign, 1 for anything else; a lower-case ``label`` column stands in
    where the named one is missing."""
    if source not in df.columns:
        if source.lower() not in df.columns:
            raise ValueError(f"no label column {source!r}")
        source = source.lower()
    label = F.when(_quoted(source).isin(BENIGN), 0).otherwise(1)
    return df.withColumn(target, label)


def select_features(
    df: DataFrame, keep: list[str] | None = None, duration_scale: float = 1.0
) -> DataFrame:
    """The mapped feature columns that are present, renamed. ``duration_scale``
    converts the file's duration unit, e.g. 1e-6 from microseconds to seconds."""
    out = []
    for source, name in FEATURE_COLUMNS.items():
        if source in df.columns:
            value = _quoted(source).cast("double")
            out.append((value * duration_scale if name == "duration" else value).alias(name))
    return df.select(*(keep or []), *out)


def label_report(df: DataFrame, label: str = "Label", balanced: bool = True) -> DataFrame:
    """One row: class counts, their ratio and the warning it deserves."""
    counts = df.agg(
        F.count_if(F.col(label) == 0).alias("benign"), F.count_if(F.col(label) == 1).alias("attack")
    )
    ratio = F.when((F.col("benign") > 0) & (F.col("attack") > 0), F.col("benign") / F.col("attack"))
    if balanced:
        warning = F.when((ratio > 1.2) | (ratio < 0.8), "imbalance")
    else:
        warning = F.when(ratio < 1, "labels may be reversed")
    return counts.select("benign", "attack", ratio.alias("ratio"), warning.alias("warning"))


def balance_classes(
    df: DataFrame, id_column: str, label: str = "Label", benign_value=0, seed: int = 42
) -> DataFrame:
    """Exactly as many benign as attack rows: all of the smaller class and a
    seeded random choice of the larger one."""
    if label not in df.columns:
        raise ValueError(f"target column {label!r} not found")
    side = "_attack"
    marked = df.withColumn(side, (F.col(label) != F.lit(benign_value)).cast("int"))
    counts = class_counts(marked, side)
    size = min(counts.get(0, 0), counts.get(1, 0))
    taken, _ = take_per_class(marked, side, id_column, {0: size, 1: size}, seed)
    return taken.drop(side)


def shuffle_rows(df: DataFrame, id_column: str, seed: int = 42) -> DataFrame:
    """Rows in seeded random order (a range-partitioned sort)."""
    from wireloom.operators.ranking import seeded_order

    return df.orderBy(seeded_order(id_column, seed), id_column)


def stratified_split(
    df: DataFrame, id_column: str, label: str = "Label", train_share: float = 0.75, seed: int = 42
) -> tuple[DataFrame, DataFrame]:
    """(train, test) with ``ceil(train_share * n)`` training rows of every class."""
    quotas = {k: math.ceil(train_share * n) for k, n in class_counts(df, label).items()}
    return take_per_class(df, label, id_column, quotas, seed)


def fit_scaler(df: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and population standard deviation per column (1 where it is 0)."""
    row = df.agg(
        *[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns]
    ).first()
    return {c: (row[f"m_{c}"], row[f"s_{c}"] or 1.0) for c in columns}


def scale(df: DataFrame, scaler: dict[str, tuple[float, float]], prefix: str = "") -> DataFrame:
    return df.withColumns(
        {f"{prefix}{c}": (F.col(c) - F.lit(m)) / F.lit(s) for c, (m, s) in scaler.items()}
    )


def build_baseline(df: DataFrame, columns: list[str]) -> dict[str, dict[str, float]]:
    """Statistics of (scaled, benign) rows per feature; sample standard deviation."""
    row = df.agg(
        *[f(c).alias(f"{n}_{c}") for c in columns for n, f in
          (("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max))]
    ).first()
    quartiles = exact_percentiles(df, columns, [0.25, 0.5, 0.75])
    out = {}
    for c in columns:
        q1, median, q3 = quartiles[c]
        stats = {n: row[f"{n}_{c}"] for n in ("mean", "std", "min", "max")}
        out[c] = {**stats, "q1": q1, "median": median, "q3": q3, "iqr": q3 - q1}
    return out


def clean_training(raw: DataFrame) -> DataFrame:
    """Headers, infinities, medians, remaining gaps, duplicates, binary label. The finite rows
    are written once: counting gaps, medians and filtering would each work them out again."""
    df = materialize(infinite_to_null(trim_headers(raw)), "finite")
    return binary_label(drop_duplicate_rows(drop_missing(impute_median(df))))
