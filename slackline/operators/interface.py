"""Interfaces between groups: cross-boundary links, hotspots, matrix and samples, for any lens."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class HotspotWeights:
    incoming: float = 0.35
    distinct_pred: float = 0.20
    outgoing: float = 0.25
    distinct_succ: float = 0.10
    risk: float = 0.10


def cross_links(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Links with both ends' groups and the successor's float and risk, one row for each lens.

    nodes: lens, id, group, total_float, risk. links: source, target. Both may have a project_id, by which ids are then told
    apart. A blank group is '(unassigned)'; links with an unknown end are dropped.
    """
    key = ["project_id"] if "project_id" in nodes.columns and "project_id" in links.columns else []
    named = F.coalesce(F.nullif(F.trim("group"), F.lit("")), F.lit("(unassigned)"))
    n = nodes.withColumn("group", named)
    pred = n.select(*key, F.col("lens"), F.col("id").alias("source"), F.col("group").alias("pred_group"))
    succ = n.select(*key, F.col("lens"), F.col("id").alias("target"), F.col("group").alias("succ_group"), "total_float", "risk")
    rows = links.select(*key, "source", "target").join(pred, [*key, "source"]).join(succ, [*key, "target", "lens"])
    return rows.withColumn("is_cross", F.col("pred_group") != F.col("succ_group"))


def scaled(x: Column, by: list[str]) -> Column:
    """Min-max over the rows of a lens; a constant column is 0, and so is a missing value's share."""
    w = Window.partitionBy(*by)
    lo, hi = F.min(x).over(w), F.max(x).over(w)
    return F.coalesce(F.when(hi > lo, (x - lo) / (hi - lo)), F.lit(0.0))


def hotspots(cross: DataFrame, weights: HotspotWeights = HotspotWeights()) -> DataFrame:
    """A row for each lens and group with cross-group traffic: both sides' aggregates and the score."""
    ends = F.array(F.struct(F.lit(True).alias("into"), F.col("succ_group").alias("group"), F.col("pred_group").alias("other")), F.struct(F.lit(False).alias("into"), F.col("pred_group").alias("group"), F.col("succ_group").alias("other")))
    # one row for each pair of groups first, so that the joined links are read once and distinct partners are rows
    pairs = cross.where("is_cross").select("lens", "total_float", "risk", F.explode(ends).alias("e")).groupBy("lens", "e.group", "e.into", "e.other")
    pairs = pairs.agg(F.count("*").alias("n"), F.min("total_float").alias("least"), F.sum("total_float").alias("sf"), F.count("total_float").alias("nf"), F.max("risk").alias("most"), F.sum("risk").alias("sr"), F.count("risk").alias("nr"))
    i, o = F.col("into"), ~F.col("into")
    of = lambda side, c: F.when(side, F.col(c))
    mean = lambda side, total, n: F.sum(of(side, total)) / F.nullif(F.sum(of(side, n)), F.lit(0))
    both = pairs.groupBy("lens", "group").agg(
        F.coalesce(F.sum(of(i, "n")), F.lit(0)).alias("incoming"), F.count_if(i).alias("distinct_pred"), F.min(of(i, "least")).alias("min_float"), mean(i, "sf", "nf").alias("avg_float"), F.max(of(i, "most")).alias("max_risk"), mean(i, "sr", "nr").alias("avg_risk"),
        F.coalesce(F.sum(of(o, "n")), F.lit(0)).alias("outgoing"), F.count_if(o).alias("distinct_succ"), F.max(of(o, "most")).alias("max_down_risk"), mean(o, "sr", "nr").alias("avg_down_risk"),
    )
    w, by = weights, ["lens"]
    score = 100 * (w.incoming * scaled(F.col("incoming"), by) + w.distinct_pred * scaled(F.col("distinct_pred"), by) + w.outgoing * scaled(F.col("outgoing"), by) + w.distinct_succ * scaled(F.col("distinct_succ"), by) + w.risk * scaled(F.greatest("max_risk", "max_down_risk"), by))
    return both.withColumn("score", score)


def top_hotspots(cross: DataFrame, k: int) -> DataFrame:
    return hotspots(cross).orderBy(F.desc("score"), "lens", "group").limit(k)


def matrix(cross: DataFrame) -> DataFrame:
    return cross.where("is_cross").groupBy("lens", "pred_group", "succ_group").agg(F.count("*").alias("links"), F.min("total_float").alias("min_float"), F.max("risk").alias("max_risk"))


def summary(cross: DataFrame) -> DataFrame:
    x = F.col("is_cross")
    return cross.groupBy("lens").agg(F.count("*").alias("links"), F.count_if(x).alias("cross_links"), F.avg(x.cast("double")).alias("cross_ratio"), F.countDistinct(F.when(x, F.col("succ_group"))).alias("groups_in"), F.countDistinct(F.when(x, F.col("pred_group"))).alias("groups_out"))


def samples(cross: DataFrame, n: int = 3) -> DataFrame:
    """Each group's n riskiest receiving activities (ties: least float, then id), each once."""
    one = cross.where("is_cross").groupBy("lens", F.col("succ_group").alias("group"), F.col("target").alias("id")).agg(F.max("risk").alias("risk"), F.min("total_float").alias("total_float"))
    w = Window.partitionBy("lens", "group").orderBy(F.desc_nulls_last("risk"), F.asc_nulls_last("total_float"), "id")
    return one.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
