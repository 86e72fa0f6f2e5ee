"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import dropped, persisted


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every end of an edge; component is the smallest node reachable.

    Null ends and loops are ignored; repeated edges and either direction are allowed; no edges give
    no rows. Each round is written to the shared folder; only a count and a checksum reach the driver.
    Every step is a grouped minimum (combined before the shuffle) and an inner join that adaptive
    execution can split, so a hub with any number of neighbours stays spread out.
    """
    hi, lo = F.greatest(a, b), F.least(a, b)
    now = persisted(edges.where(F.col(a) != F.col(b)).select(hi.cast("long").alias("u"), lo.cast("long").alias("v")).distinct(), "stars")
    mark = _mark(now)
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        large = persisted(large, "stars")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        new = persisted(small.select("e.*").where("u != v").distinct(), "stars")
        dropped(now, large)
        now, before, mark = new, mark, _mark(new)
        if mark == before:
            break
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _mark(t: DataFrame) -> tuple:
    return tuple(t.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
