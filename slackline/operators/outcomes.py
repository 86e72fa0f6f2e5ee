"""Outcomes of finished projects: an append-only store, its latest state, and a calibration report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slackline.functions.order_stats import index_percentiles

SAFE_ID = r"^[A-Za-z0-9_.\-]+$"
TTL_DAYS = 5 * 365


def register(outcomes: DataFrame, path: str) -> None:
    """Append valid outcomes (a safe project_id and class, a finish) to the store."""
    valid = outcomes.where(F.col("project_id").cast("string").rlike(SAFE_ID) & F.col("reference_class").rlike(SAFE_ID) & F.col("actual_finish").isNotNull())
    valid.write.mode("append").partitionBy("reference_class").parquet(path)


def latest(outcomes: DataFrame, now: str, ttl_days: int = TTL_DAYS) -> DataFrame:
    """The last outcome of each class and project that isn't older than the time to live."""
    live = outcomes.where(F.col("submitted_at") >= F.to_timestamp_ntz(F.lit(now)) - F.make_dt_interval(F.lit(ttl_days)))
    row = F.struct(*[c for c in outcomes.columns if c not in ("reference_class", "project_id")])
    newest = live.groupBy("reference_class", "project_id").agg(F.max_by(row, F.struct("submitted_at", "actual_finish")).alias("r"))
    return newest.select("reference_class", "project_id", "r.*")


def calibration(outcomes: DataFrame) -> DataFrame:
    """By class: how many times the predicted P80 overrun the actual one was, and what that advises.

    Only predictions later than the baseline count; an early finish is an overrun of 0.
    """
    span = lambda a, b: F.timestamp_diff("SECOND", F.col(b), F.col(a)) / 86400.0
    r = outcomes.where("p80_finish > baseline_finish and actual_finish is not null").withColumn("ratio", F.greatest(F.lit(0.0), span("actual_finish", "baseline_finish")) / span("p80_finish", "baseline_finish"))
    s = index_percentiles(r, "reference_class", "ratio", {"p50": 0.5, "p80": 0.8, "p95": 0.95}).withColumn("p95", F.when(F.col("n") >= 5, F.col("p95")))
    return s.withColumn("advice", F.when(F.col("mean") > 1.3, "tighten").when(F.col("mean") < 0.7, "relax").otherwise("keep"))


def listed(outcomes: DataFrame, reference_class: str | None = None, most: int = 10_000) -> DataFrame:
    """Outcomes of one class (of all, if none is named), by class and project, at most so many: a listing's limit. A class whose name isn't safe has none."""
    if reference_class is not None:
        outcomes = outcomes.where(F.lit(reference_class).rlike(SAFE_ID) & (F.col("reference_class") == reference_class))
    return outcomes.orderBy("reference_class", "project_id", "submitted_at").limit(most)
