"""Independent near-critical paths: families of alike paths, quotas of branches, then a filter by shared links."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slackline.plans.grouped import whole_projects

#: Depths of signatures, quotas and caps of the selection (fixed values).
BRANCH_DEPTH, MIDPOINT_DEPTH, MOST, LEAST_BRANCH, MOST_BRANCH, MULTIPLIER, CANDIDATES = 4, 3, 200, 3, 30, 20, 20_000
#: Overlap and new links asked for (fixed values): as a rule, where families are large, and where they are small.
USUAL, LARGE, SMALL = (0.92, 5), (0.90, 10), (0.94, 5)


def families(paths: DataFrame, most: int | None = MOST) -> DataFrame:
    """(project_id, path, duration, branch, midpoint, deviation, family, place, overlap_threshold, min_new_links): preselected paths.

    Candidates are a project's longest paths, up to a cap that is far above `most`. A family is the paths of one branch (first
    activities) that leave the longest path by the same link and come back to it at the same activity; its longest path stands for
    its `family` members. Branches, those with the longest path first, get equal quotas (half as much again to choose from), within
    which each midpoint comes once before any comes twice. How much paths may share depends on the sizes of the families. Ties go to
    the smaller path as text; a path without links has no deviation (UNSPEC), one that never leaves the longest is ON_REF. Rows with a
    null path or duration are left out. No rows give no rows. With most = None every path is a candidate and every family is given.
    """
    long = Window.partitionBy("project_id").orderBy(F.desc("duration"), "path")
    s = paths.where("path is not null and duration is not null").select("project_id", "path", "duration")
    s = s.withColumn("_k", F.row_number().over(long)).withColumn("_ref", F.split(F.first("path").over(long), ">"))
    if most is not None:
        s = s.where(F.col("_k") <= min(CANDIDATES, max(most * MULTIPLIER, most * 3)))
    s = s.withColumn("_n", F.split("path", ">"))
    size, mid = F.size("_n"), F.floor(F.size("_n") / 2).cast("int")
    branch = F.array_join(F.slice("_n", 1, BRANCH_DEPTH), ">")
    midpoint = F.when(size < 5, "short").otherwise(F.array_join(F.slice("_n", F.greatest(F.lit(0), mid - MIDPOINT_DEPTH // 2) + 1, F.lit(MIDPOINT_DEPTH)), ">"))
    leaves = "filter(sequence(1, size(_n) - 1), j -> array_position(_ref, _n[j - 1]) between 1 and size(_ref) - 1 and _ref[int(array_position(_ref, _n[j - 1]))] != _n[j])"
    s = s.withColumn("_j", F.expr(f"CASE WHEN size(_n) < 2 OR size(_ref) < 2 THEN NULL ELSE get({leaves}, 0) END"))
    back = F.expr("get(filter(slice(_n, _j + 1, size(_n)), v -> array_position(_ref, v) > array_position(_ref, _n[_j - 1])), 0)")
    left = F.concat_ws(">", F.expr("_n[_j - 1]"), F.expr("_n[_j]"), F.coalesce(back, F.lit("none")))
    s = s.withColumn("deviation", F.when((size < 2) | (F.size("_ref") < 2), "UNSPEC").when(F.col("_j").isNull(), "ON_REF").otherwise(left))
    s = s.withColumn("branch", branch).withColumn("midpoint", midpoint).drop("_n", "_ref", "_j", "_k")

    own = Window.partitionBy("project_id", "branch", "deviation")
    s = s.withColumn("family", F.count("*").over(own)).withColumn("_n", F.count("*").over(Window.partitionBy("project_id")))
    s = s.withColumn("_r", F.row_number().over(own.orderBy(F.desc("duration"), "path"))).where("_r = 1")
    all_ = Window.partitionBy("project_id")
    s = s.withColumn("_f", F.count("*").over(all_)).withColumn("_largest", F.max("family").over(all_))
    large = (F.col("_largest") >= 200) | (F.col("_largest") / F.col("_n") >= 0.25) | (F.col("_f") / F.col("_n") <= 0.40)
    small = ~large & (F.col("_largest") <= 10) & (F.col("_f") / F.col("_n") >= 0.85)
    chosen = lambda i: F.when(large, LARGE[i]).when(small, SMALL[i]).otherwise(USUAL[i])
    s = s.withColumn("overlap_threshold", chosen(0)).withColumn("min_new_links", chosen(1))
    columns = ["project_id", "path", "duration", "branch", "midpoint", "deviation", "family", F.row_number().over(long).alias("place"), "overlap_threshold", "min_new_links"]
    if most is None:
        return s.select(*columns)

    of = Window.partitionBy("project_id", "branch")
    first = F.first(F.struct((-F.col("duration")).alias("d"), "path")).over(of.orderBy(F.desc("duration"), "path"))
    s = s.withColumn("_lead", first).withColumn("_members", F.count("*").over(of))
    s = s.withColumn("_b", F.dense_rank().over(all_.orderBy("_lead"))).withColumn("_branches", F.max("_b").over(all_))
    least = F.when(F.col("_branches") * LEAST_BRANCH > most, 1).otherwise(LEAST_BRANCH)
    quota = F.floor(F.lit(most) / F.col("_branches")) + F.when(F.col("_b") <= F.lit(most) % F.col("_branches"), 1).otherwise(0)
    quota = F.greatest(least, F.least(F.when(large, 20).otherwise(MOST_BRANCH), quota))
    s = s.withColumn("_q", F.least(F.col("_members"), F.floor((quota * 3 + 1) / 2)))
    s = s.withColumn("_again", F.row_number().over(Window.partitionBy("project_id", "branch", "midpoint").orderBy(F.desc("duration"), "path")) > 1)
    s = s.withColumn("_i", F.row_number().over(of.orderBy("_again", F.desc("duration"), "path"))).where("_i <= _q")
    s = s.withColumn("_at", F.row_number().over(all_.orderBy("_b", "_i"))).where(F.col("_at") <= F.least(F.col("_f"), F.lit(max(most * 3, most + 10))))
    return s.select(*columns)


def independent(pre: DataFrame, most: int = MOST) -> DataFrame:
    """(project_id, path, duration, place, filled): at most `most` of each project's preselected paths (see families), longest first, such
    that each shares less than overlap_threshold of the links of the shorter one with any taken before it and brings
    min_new_links links that none has. If fewer qualify, the longest of the others fill the places (filled), and paths of one activity with them.

    A project has at most three times `most` preselected paths, so a task holds one project's links as a matrix at a time.
    """
    cols = ["project_id", "place", "path", "duration", "overlap_threshold", "min_new_links"]
    rows = pre.select(*cols).repartition("project_id").sortWithinPartitions("project_id", "place")
    schema = "project_id long, path string, duration double, place int, filled boolean"

    def run(batches):
        for t in whole_projects(batches):
            d = t.to_pandas()
            taken, filled = np.zeros(len(d), bool), np.zeros(len(d), bool)
            at = np.r_[0, np.flatnonzero(np.diff(d.project_id)) + 1, len(d)]
            for s, e in zip(at[:-1].tolist(), at[1:].tolist()):
                own = _spread([p.split(">") for p in d.path[s:e]], d.overlap_threshold[s], d.min_new_links[s], most)
                rest = np.flatnonzero(~own)[: max(0, min(most, e - s) - int(own.sum()))]
                taken[s:e] = own
                filled[s + rest] = True
            out = d[taken | filled].assign(filled=filled[taken | filled])
            yield pa.RecordBatch.from_pandas(out[["project_id", "path", "duration", "place", "filled"]].astype({"place": "int32"}), preserve_index=False)

    return rows.mapInArrow(run, schema)


def _spread(paths: list[list[str]], overlap: float, new_links: int, most: int) -> np.ndarray:
    """Which paths are taken, in order."""
    number: dict[tuple[str, str], int] = {}
    links = [[number.setdefault(x, len(number)) for x in zip(p, p[1:])] for p in paths]
    m = np.zeros((len(paths), len(number)), np.float32)
    for i, own in enumerate(links):
        m[i, own] = 1
    size = m.sum(1)
    taken, covered = np.zeros(len(paths), bool), np.zeros(len(number), bool)
    for i in np.flatnonzero(size > 0).tolist():
        if taken.sum() >= most:
            break
        if taken.any():
            shared = (m[taken] @ m[i]) / np.minimum(size[taken], size[i])
            if (shared.astype(float) >= overlap - 1e-6).any() or (~covered[links[i]]).sum() < new_links:
                continue
        taken[i] = True
        covered[links[i]] = True
    return taken
