"""Analysis of an event log: one lazy plan from lines to results, cut only where
several branches read the same table."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from wireloom.operators import behavior, models, normalize, scoring, trees, zero_byte
from wireloom.operators.features import session_features
from wireloom.operators.sessions import SESSION_KEY, session_metrics, sessionize
from wireloom.operators.whitelist import TrustedServices, apply_whitelist
from wireloom.sources.events import read_events
from wireloom.sources.staging import materialize


@dataclass
class Detector:
    """Trained state. Every part may be missing; its result is then neutral."""

    models: dict = field(default_factory=dict)
    scaler: dict[str, tuple[float, float]] = field(default_factory=dict)
    baseline: dict[str, dict[str, float]] = field(default_factory=dict)

    def as_expressions(self) -> Detector:
        """The same detector without model objects in its plans, for sessions that observe metrics."""
        return Detector({name: trees.compiled(m) for name, m in self.models.items()}, self.scaler, self.baseline)


@dataclass
class Analysis:
    lines: DataFrame
    sessions: DataFrame
    behavior: DataFrame
    results: DataFrame


def score_features(features: DataFrame, detector: Detector) -> DataFrame:
    """Add model and statistical results and the combined verdict."""
    scored = models.score_models(features, detector.models, detector.scaler)
    return scoring.combine(scoring.score_statistical(scored, detector.baseline, detector.scaler))


def score_sessions(sessions: DataFrame, detector: Detector) -> DataFrame:
    """Score each session within its own row; the session travels along as a struct."""
    whole = sessions.withColumn("session", F.struct(*sessions.columns))
    return score_features(session_features(whole, [*SESSION_KEY, "session"]), detector)


def detect(
    sessions: DataFrame,
    detector: Detector,
    burst_count: int = 3,
    burst_rate: float = 1.0,
) -> DataFrame:
    """Results of the given (closed) sessions, bursts of empty flows included."""
    bursts = zero_byte.zero_byte_bursts(sessions, burst_count, burst_rate)
    return scoring.result_rows(score_sessions(sessions, detector), bursts)


def analyze_events(
    events: DataFrame,
    detector: Detector,
    trusted: TrustedServices = TrustedServices(),
    gap_seconds: float = 120,
    include_timeout: bool = False,
    burst_rate: float = 1.0,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sessions, behaviour vectors, results) of normalised events. Sessions still
    open at the end of the log are in the session table but not scored."""
    kept = apply_whitelist(events, trusted)
    sessions = materialize(session_metrics(sessionize(kept, gap_seconds)), "sessions")
    closed = sessions.filter(F.col("close_reason") != "flush")
    timeline = behavior.behavior_timeline(closed, include_timeout=include_timeout)
    vectors = behavior.behavior_features(behavior.behavior_scores(timeline))
    results = behavior.escalate(
        detect(closed, detector, burst_rate=burst_rate), vectors
    )
    return sessions, vectors, results


def analyze_log(spark: SparkSession, path: str, detector: Detector, **options) -> Analysis:
    raw = read_events(spark, path)
    # parsed once: the written table gives the events and, from one narrow column, the counters
    fated = materialize(normalize.fated_events(raw), "lines")
    sessions, vectors, results = analyze_events(normalize.processed_events(fated), detector, **options)
    return Analysis(normalize.fate_counts(fated), sessions, vectors, results)


def run_summary(lines: DataFrame, results: DataFrame) -> DataFrame:
    """One row: lines, flagged lines, processed events, finished sessions, anomalies."""
    finished = results.agg(F.count(F.lit(1)).alias("n"))
    anomalies = results.agg(F.count_if("is_anomalous").alias("n"))
    return lines.select(
        "total_entries",
        "flagged",
        "processed_events",
        finished.scalar().alias("finalized_sessions"),
        anomalies.scalar().alias("anomalies_detected"),
    )


def session_counters(results: DataFrame) -> DataFrame:
    """One row: finished and scored sessions, anomalies, and alerts that behaviour or a burst raised."""
    return results.agg(
        F.count(F.lit(1)).alias("finalized_sessions"),
        F.count_if("is_anomalous").alias("anomalies_detected"),
        F.count_if("zero_byte_pattern").alias("burst_alerts"),
        F.count_if(F.col("alert_reason") == "behavior").alias("behavior_alerts"),
    )


def status_report(latest: DataFrame, threshold: float = 0.7, limit: int = 5) -> DataFrame:
    """The most suspicious sources above the threshold."""
    return behavior.top_anomalous_ips(latest, limit).filter(
        F.col("overall_anomaly_score") > threshold
    )


def flagship(events: DataFrame, limit: int = 10) -> DataFrame:
    """Events to the most suspicious source addresses."""
    sessions = session_metrics(sessionize(apply_whitelist(events)))
    scored = behavior.behavior_scores(behavior.behavior_timeline(sessions, lifetime=False))
    return behavior.top_anomalous_ips(behavior.latest_scores(scored), limit)
