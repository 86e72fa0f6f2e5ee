"""Schedule health, repeating patterns, structure of the network, and a two-column PCA."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slackline.plans.grouped import graph_apply


def health(acts: DataFrame, links: DataFrame, cpm: DataFrame, path: DataFrame) -> DataFrame:
    """The eight checks that a plan alone allows, their measures and the share passed, for each project."""
    n = acts.groupBy("project_id").agg(F.count("*").alias("n"), F.count_if(F.col("duration") > 44).alias("high_duration"), F.count_if(F.trim(F.coalesce("resources", F.lit(""))) == "").alias("resource_gaps"))
    t = F.upper("rel")
    rel = links.dropDuplicates(["project_id", "source", "target"]).groupBy("project_id").agg(F.count("*").alias("n_links"), F.count_if(F.abs("lag") > 1e-9).alias("n_lags"), F.count_if(F.col("lag") < -1e-9).alias("n_leads"), *[F.count_if(t == k).alias(f"n_{k.lower()}") for k in ("SS", "FF", "SF")])
    heads = acts.join(links.select("project_id", F.col("target").alias("id")), ["project_id", "id"], "left_anti").groupBy("project_id").agg((F.count("*") - 1).alias("no_pred"))
    tails = acts.join(links.select("project_id", F.col("source").alias("id")), ["project_id", "id"], "left_anti").groupBy("project_id").agg((F.count("*") - 1).alias("no_succ"))
    floats = cpm.groupBy("project_id").agg(F.count_if(F.col("tf") > 44).alias("high_float"))
    cp = path.groupBy("project_id").agg(F.count("*").alias("cp_length"))
    rows = n
    for other in (rel, heads, tails, floats, cp):
        rows = rows.join(other, "project_id", "left")
    rows = rows.fillna(0)
    few = F.floor(F.col("n") * 0.05)
    density = F.bround(F.col("n_links") / F.col("n"), 2)
    checks = [density.between(1.5, 2.5), F.col("no_pred") <= F.greatest(F.lit(1), few), F.col("no_succ") <= F.greatest(F.lit(1), few), F.col("n_leads") == 0, F.col("high_float") <= few, F.col("high_duration") <= few, F.col("resource_gaps") <= few, F.col("cp_length") > 0]
    passed = sum((c.cast("int") for c in checks), F.lit(0))
    return rows.select("project_id", "n", "n_links", "n_lags", "n_leads", "n_ss", "n_ff", "n_sf", "no_pred", "no_succ", "high_float", "high_duration", "resource_gaps", "cp_length", passed.alias("passed"), (passed / 8.0).alias("score"))


def patterns(acts: DataFrame, top: int = 10) -> DataFrame:
    """The most frequent combinations of task type, resources and duration (to a tenth) that occur twice or more."""
    key = ["task_type", "resources", F.round(F.col("duration") * 10).cast("long").alias("tenths")]
    g = acts.groupBy(*key).agg(F.count("*").alias("n"), F.avg("duration").alias("average_duration"), F.var_samp("duration").alias("duration_variance"))
    return g.where("n > 1").orderBy(F.desc("n"), "task_type", "resources", "tenths").limit(top)


def work_packages(acts: DataFrame) -> DataFrame:
    """Tasks, hours, first start and last finish of each project's clusters (here its task types)."""
    return acts.groupBy("project_id", "task_type").agg(F.count("*").alias("tasks"), F.sum("duration").alias("hours"), F.min("start").alias("first_start"), F.max("finish").alias("last_finish"))


def pca2(acts: DataFrame, a: str = "importance", b: str = "risk") -> DataFrame:
    """Both principal components of two columns, within each project, from the covariance in closed form.

    The larger eigenvalue comes first; its axis has a positive first coordinate (or second, if that is 0).
    """
    s = acts.groupBy("project_id").agg(F.avg(a).alias("ma"), F.avg(b).alias("mb"), F.covar_samp(a, a).alias("va"), F.covar_samp(b, b).alias("vb"), F.covar_samp(a, b).alias("c"))
    half, gap = (F.col("va") + F.col("vb")) / 2, F.sqrt(F.pow((F.col("va") - F.col("vb")) / 2, 2) + F.col("c") * F.col("c"))
    s = s.withColumn("l1", half + gap).withColumn("l2", half - gap)
    x = F.when(F.abs("c") > 1e-15, F.col("c")).when(F.col("va") >= F.col("vb"), 1.0).otherwise(0.0)
    y = F.when(F.abs("c") > 1e-15, F.col("l1") - F.col("va")).when(F.col("va") >= F.col("vb"), 0.0).otherwise(1.0)
    sign = F.when((x < 0) | ((x == 0) & (y < 0)), -1.0).otherwise(1.0)
    n = F.sqrt(x * x + y * y)
    s = s.withColumn("x", sign * x / n).withColumn("y", sign * y / n)
    rows = acts.join(s, "project_id")
    u, v = F.col(a) - F.col("ma"), F.col(b) - F.col("mb")
    ok = F.col("l1") > 1e-15
    return rows.select("project_id", "id", F.when(ok, u * F.col("x") + v * F.col("y")).otherwise(0.0).alias("pca1"), F.when(ok, v * F.col("x") - u * F.col("y")).otherwise(0.0).alias("pca2"))


def scaled(rows: DataFrame, column: str, by: str) -> DataFrame:
    """Median, MAD score (with mean and deviation where the MAD is 0) of a column within a group."""
    w = Window.partitionBy(by)
    x = rows.withColumn("median", F.median(column).over(w))
    x = x.withColumn("mad", F.median(F.abs(F.col(column) - F.col("median"))).over(w)).withColumn("mean", F.avg(column).over(w)).withColumn("sd", F.stddev_pop(column).over(w))
    z = F.when(F.col("mad") > 0, (F.col(column) - F.col("median")) / (1.4826 * F.col("mad"))).when(F.col("sd") > 1e-12, (F.col(column) - F.col("mean")) / F.col("sd")).otherwise(0.0)
    return x.withColumn("z", z)


#: Sources whose ways are followed at once.
BLOCK = 256


def closeness(n: int, src: np.ndarray, dst: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Closeness by the ways that lead to a node, scaled by the share of its network's `size` that has one.

    Breadth first from BLOCK sources at once; a step's frontier is a list of (source, node), so the work is the number of
    pairs with a way times their links, and memory BLOCK rows of n.
    """
    order = np.argsort(src, kind="stable")
    to, first = dst[order], np.searchsorted(src[order], np.arange(n + 1))
    total, seen = np.zeros(n), np.zeros(n)
    stamp = np.zeros(BLOCK * n, np.int32)
    for lo in range(0, n, BLOCK):
        m = min(BLOCK, n - lo)
        new = np.ones(m * n, bool)
        who, at, step = np.arange(m), np.arange(lo, lo + m), 0
        new[who * n + at] = False
        while len(at):
            step += 1
            k = first[at + 1] - first[at]
            who = np.repeat(who, k)
            at = to[np.repeat(first[at] - (np.cumsum(k) - k), k) + np.arange(int(k.sum()))]
            flat = who * n + at
            fresh = np.flatnonzero(new[flat])
            flat = flat[fresh]
            stamp[flat] = np.arange(len(flat), dtype=np.int32)  # of equal pairs the last one stays
            once = fresh[stamp[flat] == np.arange(len(flat))]
            who, at = who[once], at[once]
            new[who * n + at] = False
            hits = np.bincount(at, minlength=n)
            total += step * hits
            seen += hits
    return np.where(total > 0, seen / np.maximum(total, 1) * seen / np.maximum(size - 1, 1), 0.0)


def clustering(n: int, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """Share of a node's pairs of neighbours (either direction) that are neighbours. Each triangle is found once, at its corner of least
    degree, so a hub costs no square of its degree."""
    pair = np.unique(np.minimum(src, dst).astype(np.int64) * n + np.maximum(src, dst))
    a, b = pair // n, pair % n
    degree = np.bincount(a, minlength=n) + np.bincount(b, minlength=n)
    flip = degree[a] > degree[b]
    a, b = np.where(flip, b, a), np.where(flip, a, b)
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    first = np.searchsorted(a, np.arange(n + 1))
    later = first[a + 1] - 1 - np.arange(len(a))  # neighbours of the same corner behind this one
    x = np.repeat(np.arange(len(a)), later)
    y = x + 1 + np.arange(int(later.sum())) - np.repeat(np.cumsum(later) - later, later)
    key = np.minimum(b[x], b[y]) * np.int64(n) + np.maximum(b[x], b[y])
    at = np.minimum(np.searchsorted(pair, key), max(len(pair) - 1, 0))
    hit = pair[at] == key if len(pair) else np.zeros(0, bool)
    x, y = x[hit], y[hit]
    triangles = np.bincount(a[x], minlength=n) + np.bincount(b[x], minlength=n) + np.bincount(b[y], minlength=n)
    return np.where(degree > 1, 2 * triangles / np.maximum(degree * (degree - 1), 1), 0.0)


def centralities(acts: DataFrame, links: DataFrame, damping: float = 0.9, rounds: int = 100) -> DataFrame:
    """PageRank, closeness, degree centrality and clustering of every activity within its project.

    PageRank weighs links by their duration (1 if there is none) and hands the rank of ends without links
    to all; it stops at a change of 1e-6 times the project's size. Closeness counts ways that lead to the
    activity, scaled by the share of activities that have one. Parallel links are one.
    """

    def kernel(a, e):
        e = e.drop_duplicates(["src", "dst"], keep="last")
        p, n = a.p.to_numpy(), len(a)
        size = np.bincount(p)[p].astype(float)
        src, dst = e.src.to_numpy(int), e.dst.to_numpy(int)
        weight = e.duration.fillna(1.0).to_numpy(float)
        out = np.bincount(src, weight, n)
        rank = 1 / size
        for _ in range(rounds):
            loose = np.bincount(p, np.where(out == 0, rank, 0.0))[p]
            new = damping * (np.bincount(dst, rank[src] * weight / out[src], n) + loose / size) + (1 - damping) / size
            moved = np.bincount(p, np.abs(new - rank))
            rank = new
            if (moved < 1e-6 * np.bincount(p)).all():
                break
        close, tri = closeness(n, src, dst, size), clustering(n, src, dst)
        degree = (np.bincount(src, minlength=n) + np.bincount(dst, minlength=n)) / np.maximum(size - 1, 1)
        return a.assign(pagerank=rank, closeness=close, degree=np.where(size > 1, degree, 1.0), clustering=tri)

    return graph_apply(acts, links, kernel, "project_id long, id string, pagerank double, closeness double, degree double, clustering double", ["seq"], ["duration"])
