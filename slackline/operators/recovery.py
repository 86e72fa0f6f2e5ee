"""Recovery: what can be crashed or compressed, and how much of it meets a target."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Largest share that can be crashed, by supplier and then by the first pattern in a name (fixed values).
SUPPLIERS = {"external_equipment": 0.03, "external_material": 0.05, "external_service": 0.10}
NAMES = (
    (r"permit|approval|regulat|review|sign", 0.08, "governance"),
    (r"procure|purchase|delivery|ship|vendor", 0.12, "procurement"),
    (r"design|engineer|ifc|draw|model", 0.18, "engineering"),
    (r"fabricat|shop|weld|machine|prefab", 0.22, "fabrication"),
    (r"install|erect|construct|civil|mech|elect|pipe", 0.28, "construction"),
    (r"test|commission|start.?up|turnover", 0.20, "commissioning"),
)
DEFAULT_SHARE = 0.25


def crash_profile(name: Column, supplier: Column) -> tuple[Column, Column]:
    """(largest share, kind)."""
    s = F.lower(F.trim(F.coalesce(supplier, F.lit(""))))
    share, kind = F.when(F.lit(False), 0.0), F.when(F.lit(False), "")
    for k, v in SUPPLIERS.items():
        share, kind = share.when(s == k, v), kind.when(s == k, k)
    for pattern, v, k in NAMES:
        hit = F.coalesce(name, F.lit("")).rlike(f"(?i){pattern}")
        share, kind = share.when(hit, v), kind.when(hit, k)
    return share.otherwise(DEFAULT_SHARE), kind.otherwise("generic")


def crash_candidates(acts: DataFrame, cpm: DataFrame, hours_per_day: float = 8.0, places: int = 2) -> DataFrame:
    """Unfinished activities with enough hours to crash, on the critical path or near it, with a score.

    acts needs name and supplier_type besides the schedule's columns. Values are rounded to places (half
    to even), leverage to 4 at least, before anything is packaged.
    """
    share, kind = crash_profile(F.col("name"), F.col("supplier_type"))
    rows = acts.where("actual_finish is null and duration > 0").join(cpm.select("project_id", "id", "tf", "critical"), ["project_id", "id"])
    rows = rows.withColumn("remaining", F.col("duration") * (1 - F.col("pct") / 100)).withColumn("kind", kind).withColumn("crash", F.col("remaining") * share).withColumn("float_days", F.col("tf") / hours_per_day)
    rows = rows.where("remaining >= 16 and crash >= 8 and (critical or float_days <= 10)")
    leverage = F.when(F.col("critical"), 1.0).otherwise(F.greatest(F.lit(0.2), F.least(F.lit(0.75), 1 - F.col("float_days") / 12)))
    rows = rows.withColumn("leverage", leverage).withColumn("score", F.col("remaining") * F.col("leverage") * (0.55 + 0.45 * F.col("importance")))
    return rows.select("project_id", "id", "kind", F.bround("remaining", places).alias("remaining_hrs"), F.bround("crash", places).alias("max_crash_hrs"), F.bround("leverage", max(4, places)).alias("leverage"), F.col("critical").alias("on_critical"), F.bround("float_days", places).alias("float_days"), F.bround("score", places).alias("score"))


def packaged(candidates: DataFrame, target_hours: float, most: int = 18) -> DataFrame:
    """Best candidates first until their hours meet the target: a running sum says what each still takes."""
    w = Window.partitionBy("project_id").orderBy(F.desc("score"), "id")
    rows = candidates.withColumn("rank", F.row_number().over(w)).withColumn("before", F.coalesce(F.sum("max_crash_hrs").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    rows = rows.where((F.col("before") < target_hours) & (F.col("rank") <= most))
    return rows.select("project_id", "id", "rank", F.least("max_crash_hrs", F.lit(target_hours) - F.col("before")).alias("crash_hrs"), (F.col("before") + F.col("max_crash_hrs") >= target_hours).alias("meets_target"))


def lag_candidates(links: DataFrame, cpm: DataFrame, hours_per_day: float = 8.0, least_days: float = 2.0, off_chain_days: float = 5.0, factor: float = 0.5) -> DataFrame:
    """Links whose positive lag is worth compressing: from least_days on between critical activities, else from off_chain_days on."""
    c = cpm.where("critical").select("project_id", "id")
    rows = links.where("lag > 0").withColumn("lag_days", F.col("lag") / hours_per_day)
    rows = rows.join(c.select("project_id", F.col("id").alias("source"), F.lit(True).alias("cs")), ["project_id", "source"], "left").join(c.select("project_id", F.col("id").alias("target"), F.lit(True).alias("ct")), ["project_id", "target"], "left")
    chain = F.col("cs").isNotNull() & F.col("ct").isNotNull()
    rows = rows.withColumn("on_chain", chain).where((F.col("lag_days") >= least_days) & (F.col("on_chain") | (F.col("lag_days") >= off_chain_days)))
    return rows.select("project_id", "source", "target", "rel", "lag_days", "on_chain", (F.col("lag_days") * factor).alias("saved_days"))
