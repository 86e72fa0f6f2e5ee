"""Path corpora: signatures, overlaps, outliers and recurring parts, and what a slip does."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slackline.plans.grouped import graph_apply

from .cpm import acyclic, by_level, passes, weights


def signatures(paths: DataFrame, depth: int = 2) -> DataFrame:
    """Branch (first nodes), midpoint (nodes about the middle) and number of hops of each path."""
    p = F.split("path", ">")
    n = F.size(p)
    mid = F.greatest(F.lit(1), F.floor(n / 2) - int(depth / 2) + 1).cast("int")
    return paths.select("project_id", "path", "duration", F.array_join(F.slice(p, 1, depth), ">").alias("branch"), F.array_join(F.slice(p, mid, F.lit(depth)), ">").alias("midpoint"), (n - 1).alias("hops"))


def outliers(paths: DataFrame) -> DataFrame:
    """Paths beyond the upper fence of their project, or of at least 80 % of its longest."""
    s = paths.groupBy("project_id").agg(F.percentile("duration", 0.25).alias("q1"), F.percentile("duration", 0.75).alias("q3"), F.max("duration").alias("longest"))
    rows = paths.join(s, "project_id").withColumn("beyond_fence", F.col("duration") > F.col("q3") + 1.5 * (F.col("q3") - F.col("q1")))
    return rows.withColumn("near_longest", F.col("duration") >= 0.8 * F.col("longest")).where("beyond_fence or near_longest").select("project_id", "path", "duration", "beyond_fence", "near_longest")


def recurring(paths: DataFrame, shortest: int = 3, longest: int = 4, support: int = 2, top: int | None = None) -> DataFrame:
    """Parts of paths, without each path's own ends, that several paths of a project share.

    Support counts paths, not occurrences (an activity occurs once in a path).
    """
    inner = F.slice(F.split("path", ">"), 2, F.greatest(F.lit(0), F.size(F.split("path", ">")) - 2))
    rows = paths.select("project_id", inner.alias("nodes")).where(F.size("nodes") >= shortest)
    cuts = F.flatten(F.array(*[F.expr(f"CASE WHEN size(nodes) >= {k} THEN transform(sequence(1, size(nodes) - {k} + 1), i -> array_join(slice(nodes, i, {k}), '>')) ELSE array() END") for k in range(shortest, longest + 1)]))
    g = rows.select("project_id", F.explode(cuts).alias("part")).groupBy("project_id", "part").agg(F.count("*").alias("support"))
    g = g.where(F.col("support") >= support)
    return g.orderBy(F.desc("support"), F.desc(F.length("part")), "project_id", "part").limit(top) if top else g


def overlaps(paths: DataFrame, most: int = 64) -> DataFrame:
    """Jaccard overlap of the links of each pair of a project's longest paths (most of them)."""
    edges = F.expr("transform(sequence(1, greatest(1, size(n) - 1)), i -> concat(get(n, i - 1), '>', coalesce(get(n, i), '')))")
    rows = paths.withColumn("n", F.split("path", ">")).withColumn("edges", edges)
    rows = rows.withColumn("k", F.row_number().over(Window.partitionBy("project_id").orderBy(F.desc("duration"), "path"))).where(F.col("k") <= most).select("project_id", "k", "edges")
    other = rows.select("project_id", F.col("k").alias("k2"), F.col("edges").alias("e2"))
    pairs = rows.join(other, "project_id").where("k < k2")
    return pairs.select("project_id", "k", "k2", (F.size(F.array_intersect("edges", "e2")) / F.size(F.array_union("edges", "e2"))).alias("jaccard"))


def driving_chains(acts: DataFrame, links: DataFrame, tolerance: float = 1e-6, most: int = 80, shown: int = 15, novelty: float = 0.25) -> DataFrame:
    """(project_id, chain, hours, selected): chains of driving predecessors back from the activity that ends last.

    A predecessor drives if it comes within the tolerance of fixing the early start. The most driving ones are
    followed first, up to most chains of a project; of those, from the longest on, a chain is selected if its
    activities overlap with every selected one's by 1 - novelty at most (shown of them).
    """

    def kernel(a, e):
        a, e, _ = passes(a, e)
        d, es = a.duration.fillna(0).to_numpy(float), a.es.to_numpy()
        src, dst = e.src.to_numpy(int), e.dst.to_numpy(int)
        value = es[src] + e.w.to_numpy()
        top = np.full(len(a), -np.inf)
        np.maximum.at(top, dst, value)
        delta = top[dst] - value
        use = np.flatnonzero(delta <= tolerance)
        use = use[np.lexsort((src[use], delta[use], dst[use]))]
        back: dict[int, list[int]] = {}
        for k in use.tolist():
            if int(src[k]) not in back.setdefault(int(dst[k]), []):
                back[int(dst[k])].append(int(src[k]))
        p = a.p.to_numpy()
        order = np.lexsort((a.seq.to_numpy(), -a.ef.to_numpy(), p))
        ends = order[np.unique(p[order], return_index=True)[1]]
        ids, projects = a.id.to_numpy(object), a.project_id.to_numpy()
        rows = []
        for end in ends.tolist():
            chains, stack = [], [(end,)]
            while stack and len(chains) < most:
                c = stack.pop()
                before = back.get(c[-1])
                if before:
                    stack += [(*c, x) for x in reversed(before) if x not in c]
                else:
                    chains.append(c[::-1])
            hours = [float(sum(d[list(c)])) for c in chains]
            picked: list[set] = []
            chosen = set()
            for i in sorted(range(len(chains)), key=lambda i: -hours[i]):
                s = set(chains[i])
                if len(picked) < shown and all(len(s & t) / len(s | t) <= 1 - novelty for t in picked):
                    picked.append(s)
                    chosen.add(i)
            rows += [(projects[end], ">".join(ids[list(c)]), hours[i], i in chosen) for i, c in enumerate(chains)]
        return pd.DataFrame(rows, columns=["project_id", "chain", "hours", "selected"])

    return graph_apply(acts, links, kernel, "project_id long, chain string, hours double, selected boolean", ["seq", "duration"])


def diverse(paths: DataFrame, most: int = 20, per_branch: int = 5, depth: int = 2) -> DataFrame:
    """At most `most` paths of each project: the longest of each branch, different midpoints first.

    Within a branch the longest path of each midpoint comes before second ones; branches take turns by their
    own order, so a project's quota is spread over them. Ranks are windows over a project's paths.
    """
    s = signatures(paths, depth)
    long = lambda *by: Window.partitionBy("project_id", *by).orderBy(F.desc("duration"), "path")
    s = s.withColumn("again", F.row_number().over(long("branch", "midpoint")))
    turn = Window.partitionBy("project_id", "branch").orderBy("again", F.desc("duration"), "path")
    s = s.withColumn("turn", F.row_number().over(turn)).where(F.col("turn") <= per_branch)
    order = Window.partitionBy("project_id").orderBy("turn", F.desc("duration"), "path")
    return s.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).select("project_id", "path", "duration", "branch", "midpoint", "place")


def cascade(acts: DataFrame, links: DataFrame, hours: float, first: int = 1) -> DataFrame:
    """How much later each activity starts if activity number `first` of its project slips, and whether its float absorbs that."""

    def kernel(a, e):
        a, e, level = passes(a, e)
        d = np.nan_to_num(a.duration.to_numpy(float))
        src, dst, w = e.src.to_numpy(int), e.dst.to_numpy(int), weights(e, d)
        es = np.where(a.seq.to_numpy() == first, a.es.to_numpy() + hours, 0.0)
        for g in by_level(level, dst):
            np.maximum.at(es, dst[g], es[src[g]] + w[g])
        slip = np.maximum(es - a.es.to_numpy(), 0)
        return a.assign(slip=slip, absorbed=slip <= a.tf.to_numpy() + 1e-9)

    return graph_apply(acts, links, kernel, "project_id long, id string, slip double, absorbed boolean", ["seq", "duration"])


def frontier_decay(acts: DataFrame, links: DataFrame, rate: float = 0.85) -> DataFrame:
    """rate to the power of the hops from the nearest activity of the frontier; activities out of its reach are left out.

    acts needs a boolean column frontier.
    """

    def kernel(a, e):
        e, level = acyclic(len(a), e)
        hops = np.where(a.frontier.to_numpy(bool), 0.0, np.inf)
        src, dst = e.src.to_numpy(int), e.dst.to_numpy(int)
        for g in by_level(level, dst):
            np.minimum.at(hops, dst[g], hops[src[g]] + 1)
        a = a.assign(hops=hops, decay=rate**hops)
        return a[np.isfinite(hops)]

    return graph_apply(acts, links, kernel, "project_id long, id string, hops int, decay double", ["seq", "frontier"])
