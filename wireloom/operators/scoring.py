"""Scoring of feature rows against the benign baseline, and result assembly."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from wireloom.operators.features import BASE_FEATURES, INTEGER_FEATURES
from wireloom.operators.sessions import SESSION_KEY

# --- fixed values: weights and thresholds of the rules ---
FEATURE_WEIGHT = {"flow_bytes_per_sec": 0.8, "dest_port": 1.2}
Z_SCORED = 4.0
Z_REPORTED = 3.0
IQR_REACH = 1.5
SCORE_LIMIT = 0.7
MIN_EXTREME = 2
ENSEMBLE_3 = {"dt": 0.2, "rf": 0.3, "gbt": 0.5}
ENSEMBLE_2 = {"dt": 0.4, "rf": 0.6}
MIN_COVERAGE = 0.7
# --- end of fixed values ---

DETAIL = "struct<feature:string,value:double,z_score:double,is_outlier:boolean,baseline_mean:double,baseline_std:double>"
NEUTRAL_STAT = f"named_struct('score', 0.0D, 'is_anomalous', false, 'details', cast(array() as array<{DETAIL}>))"


def base_features(df: DataFrame) -> DataFrame:
    """The session key and the flow features that are present."""
    return df.select(
        *[c for c in SESSION_KEY if c in df.columns], *[c for c in BASE_FEATURES if c in df.columns]
    )


def has_coverage(df: DataFrame, required: list[str], share: float = MIN_COVERAGE) -> bool:
    return len([c for c in required if c in df.columns]) >= share * len(required)


def scaled_value(
    feature: str, scaler: dict[str, tuple[float, float]], has_duration_flag: bool, round_integers: bool = True
) -> str:
    """SQL for the scaled feature, rounded half-even where the raw value is an integer."""
    if feature not in scaler:
        return f"cast({feature} as double)"
    mean, std = scaler[feature]
    scaled = f"(cast({feature} as double) - {_literal(mean)}) / {_literal(std)}"
    whole = "true" if feature in INTEGER_FEATURES else None
    if feature == "down_up_ratio":  # an integer 0 where nothing was sent
        whole = "total_fwd_bytes <= 0"
    elif feature == "duration" and has_duration_flag:
        whole = "duration_known = 0"
    if not round_integers or whole is None:
        return scaled
    return f"if({whole}, bround({scaled}, 0), {scaled})"


def _literal(value: float) -> str:
    return f"double('{float(value)!r}')"


def score_statistical(
    df: DataFrame,
    baseline: dict[str, dict[str, float]],
    scaler: dict[str, tuple[float, float]] | None = None,
    round_integers: bool = True,
) -> DataFrame:
    """Add ``stat``: score, verdict and the deviating features, strongest first.

    The baseline has one entry per feature and is folded into the plan.
    """
    present = [c for c in BASE_FEATURES if c in df.columns]
    if not baseline or not present:
        return df.withColumn("stat", F.expr(NEUTRAL_STAT))
    flag = "duration_known" in df.columns
    checked = [c for c in present if c in baseline]
    values, tests, parts, extremes, details = [], [], [], [], []
    for i, c in enumerate(checked):
        stats, v, z, o = baseline[c], f"_v_{c}", f"_z_{c}", f"_o_{c}"
        mean, std, iqr = stats["mean"], stats["std"] or 0.0, stats["iqr"]
        values.append(f"{scaled_value(c, scaler or {}, flag, round_integers)} as {v}")
        tests.append(f"({v} - {_literal(mean)}) / {_literal(std)} as {z}" if std > 0 else f"0.0D as {z}")
        low, high = _literal(stats["q1"] - IQR_REACH * iqr), _literal(stats["q3"] + IQR_REACH * iqr)
        tests.append(f"({v} < {low} or {v} > {high}) as {o}" if iqr > 0 else f"false as {o}")
        weight = FEATURE_WEIGHT.get(c, 1.0)
        parts.append(
            f"if(abs({z}) > {Z_SCORED} or {o}, if(abs({z}) > 0, abs({z}), 1.0D) * {_literal(weight)}, 0.0D)"
        )
        extremes.append(f"int(abs({z}) > {Z_SCORED})")
        details.append(
            f"if(abs({z}) > {Z_REPORTED} or {o}, struct(-abs({z}) as rank, {i} as i, cast(struct('{c}', {v}, {z}, {o}, "
            f"{_literal(mean)}, {_literal(std)}) as {DETAIL}) as d), null)"
        )
    score = f"({' + '.join(parts)}) / {_literal(len(present))}"
    ordered = f"transform(array_sort(array_compact(array({', '.join(details)}))), x -> x.d)"
    helpers = [f"_{k}_{c}" for k in "vzo" for c in checked]
    scored = (
        df.selectExpr("*", *values)
        .selectExpr("*", *tests)
        .selectExpr("*", f"{score} as _score")
        .selectExpr(
            "*",
            f"struct(_score as score, _score > {SCORE_LIMIT} or {' + '.join(extremes)} >= {MIN_EXTREME} "
            f"as is_anomalous, {ordered} as details) as stat",
        )
    )
    return scored.drop("_score", *helpers)


def ensemble(df: DataFrame) -> DataFrame:
    """Add ``ml`` from the per-model columns ``{m}_prediction`` and ``{m}_confidence``
    of models dt, rf and, where present, gbt."""
    if "dt_prediction" not in df.columns or "rf_prediction" not in df.columns:
        return df.withColumn("ml", F.expr("named_struct('score', 0.0D, 'is_anomalous', false)"))
    weights = ENSEMBLE_3 if "gbt_prediction" in df.columns else ENSEMBLE_2
    votes = sum(F.col(f"{m}_prediction").cast("int") for m in weights)
    terms = [F.col(f"{m}_confidence") * w for m, w in weights.items()]
    own = [f"{m}_{x}" for m in weights for x in ("prediction", "confidence")]
    ml = F.struct(
        reduce(lambda a, b: a + b, terms).alias("score"),
        (votes >= (2 if len(weights) == 3 else 1)).alias("is_anomalous"),
        *[F.col(c) for c in own],
    )
    return df.withColumn("ml", ml).drop(*own)


def combine(df: DataFrame) -> DataFrame:
    """Add the combined score and verdict from ``ml`` and ``stat``."""
    return df.withColumns(
        {
            "combined_score": F.greatest("ml.score", "stat.score"),
            "is_anomalous": F.col("ml.is_anomalous") | F.col("stat.is_anomalous"),
        }
    )


def result_rows(scored: DataFrame, bursts: DataFrame | None = None) -> DataFrame:
    """One result per session: identity, totals, scores and the full session.

    ``scored`` has the session as a struct ``session`` next to ``ml``, ``stat``,
    ``combined_score`` and ``is_anomalous``. A session at which a burst of empty
    flows was reported gets the fixed burst result instead.
    """
    if bursts is None:
        joined = scored.withColumns(
            {"zero_byte_count": F.lit(None).cast("bigint"), "zero_byte_rate": F.lit(None).cast("double")}
        )
    else:
        joined = scored.join(
            bursts.select(*SESSION_KEY, "zero_byte_count", "zero_byte_rate"), SESSION_KEY, "left"
        )
    session = F.col("session")
    burst = F.col("zero_byte_count").isNotNull()

    def fixed(name: str, value: Column, source: Column | None = None) -> Column:
        return F.when(burst, value).otherwise(F.col(name) if source is None else source).alias(name)

    ml_type, stat_type = joined.schema["ml"].dataType, joined.schema["stat"].dataType

    def burst_struct(kind) -> Column:
        known = {"score": F.lit(0.8), "is_anomalous": F.lit(True)}
        return F.struct(
            *[known.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in kind.fields]
        )

    total_bytes = session["total_fwd_bytes"] + session["total_bwd_bytes"]
    total_packets = session["total_fwd_packets"] + session["total_bwd_packets"]
    zero = F.lit(0).cast("bigint")
    identity = ["src_ip", "src_port", "dst_ip", "dst_port", "proto", "app_proto"]
    return joined.select(
        *SESSION_KEY,
        session["close_ts"].alias("timestamp"),
        *[session[c].alias(c) for c in identity],
        fixed("duration", F.lit(0.0), session["duration"]),
        fixed("total_bytes", zero, total_bytes),
        fixed("total_packets", zero, total_packets),
        fixed("ml", burst_struct(ml_type)),
        fixed("stat", burst_struct(stat_type)),
        fixed("combined_score", F.lit(0.8)),
        fixed("is_anomalous", F.lit(True)),
        burst.alias("zero_byte_pattern"),
        "zero_byte_count",
        "zero_byte_rate",
        "session",
    )


def detection_stats(results: DataFrame, min_duration: float = 0.0) -> DataFrame:
    """One row of counters over the results, as they are before behaviour raises
    rows: those that behaviour alone made anomalous don't count."""
    burst = F.col("zero_byte_pattern")
    anomalous = F.col("is_anomalous")
    if "alert_reason" in results.columns:
        anomalous = anomalous & (F.coalesce("alert_reason", F.lit("")) != "behavior")
    session = F.col("session")
    empty = (session["total_fwd_bytes"] + session["total_bwd_bytes"]) == 0
    short = (session["duration"] < min_duration) & F.lit(min_duration > 0) & ~burst
    return results.agg(
        F.count(F.lit(1)).alias("processed_sessions"),
        F.count_if(empty).alias("zero_byte_sessions"),
        F.count_if(short).alias("short_duration_sessions"),
        F.count_if(~burst).alias("analyzed_sessions"),
        F.count_if(~burst & anomalous).alias("anomalous_sessions"),
        F.count_if(anomalous).alias("alerts_generated"),
    )


def baseline_table(spark: SparkSession, baseline: dict[str, dict[str, float]]) -> DataFrame:
    """The baseline as a long table, one row per feature."""
    stats = ["mean", "std", "min", "max", "q1", "median", "q3", "iqr"]
    rows = [(f, *[float(s[n]) if s[n] is not None else None for n in stats]) for f, s in baseline.items()]
    return spark.createDataFrame(rows, "feature string, " + ", ".join(f"`{n}` double" for n in stats))
