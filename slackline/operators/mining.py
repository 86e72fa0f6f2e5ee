"""Recurring parts of paths between activities that stand out, and their score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .health import scaled


def node_scores(acts: DataFrame, links: DataFrame, metrics: tuple[str, ...] = ("risk", "importance")) -> DataFrame:
    """(project_id, id, z_in, z_out, z_<metric>...): MAD scores, within the project, of degrees (parallel links count once) and of the metrics, over
    all activities that have both predecessors and successors, or neither (starts and ends of the network are left out)."""
    once = links.dropDuplicates(["project_id", "source", "target"]).select("project_id", F.explode(F.array(F.struct(F.col("source").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("target").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e"))
    degree = once.groupBy("project_id", F.col("e.id").alias("id")).agg(F.sum("e.i").cast("double").alias("in"), F.sum("e.o").cast("double").alias("out"))
    rows = acts.join(degree, ["project_id", "id"], "left").fillna(0.0, ["in", "out"]).where("(in > 0) = (out > 0)")
    out = rows.select("project_id", "id", "in", "out", *metrics)
    for m in ("in", "out", *metrics):
        out = scaled(out, m, "project_id").withColumnRenamed("z", f"z_{m}").drop("median", "mad", "mean", "sd")
    return out.select("project_id", "id", *[f"z_{m}" for m in ("in", "out", *metrics)])


def bounded(z: Column) -> Column:
    """0 to 1: a score from 0 to 3, clamped, over 3."""
    return F.greatest(F.lit(0.0), F.least(F.lit(3.0), z)) / 3


def recurring_parts(paths: DataFrame, scores: DataFrame, metrics: tuple[str, ...] = ("risk", "importance"), threshold: float = 2.0, shortest: int = 3, longest: int = 100, parts: int = 3) -> DataFrame:
    """(project_id, part, length, support, supp, junc, sal, maxpen, score): parts of paths, from one anchor to a later one, of `shortest` to
    `longest` activities; paths lose their own ends first.

    An anchor is an activity one of whose scores reaches the threshold. support counts paths. supp is its share of the project's paths, junc
    the strength of the ends (degree in at the first, out at the last), sal the mean strength of the activities' salience (the sum of the
    metrics' scores over `parts`, the number of metrics that salience has in full), maxpen the share of the
    commonest neighbour, left or right; score is supp + junc + sal - maxpen. Paths are shuffled once, to their project's scores; anchor pairs
    are made within a path, bounded by `longest`; nothing is capped. Paths without two anchors give nothing.
    """
    z = ["in", "out", *metrics]
    sal = sum((F.col(f"z_{m}") for m in metrics), F.lit(0.0)) / parts
    node = F.struct("id", (F.greatest(*[F.col(f"z_{m}") for m in z]) >= threshold).alias("anchor"), bounded(F.col("z_in")).alias("ji"), bounded(F.col("z_out")).alias("jo"), bounded(sal).alias("sal"))
    known = scores.select("project_id", node.alias("n")).groupBy("project_id").agg(F.collect_list("n").alias("known"))
    known = known.where(F.size(F.filter("known", lambda n: n.anchor)) >= 2)  # others have no pair
    rows = paths.select("project_id", "path").join(known, "project_id").withColumn("corpus", F.count("*").over(Window.partitionBy("project_id")))
    rows = rows.withColumn("nodes", F.slice(F.split("path", ">"), 2, F.greatest(F.lit(0), F.size(F.split("path", ">")) - 2))).where(F.size("nodes") >= shortest)
    # what is known of each activity in order (null: nothing), and the places of anchors: pairs are made within the path's row
    place = "aggregate(known, cast(null AS {0}), (a, n) -> CASE WHEN n.id = x THEN n ELSE a END)".format(known.schema["known"].dataType.elementType.simpleString())
    rows = rows.withColumn("at", F.expr(f"transform(nodes, x -> {place})"))
    rows = rows.withColumn("anchors", F.expr("filter(sequence(0, size(at) - 1), i -> coalesce(at[i].anchor, false))")).where(F.size("anchors") >= 2)
    rows = rows.withColumn("pair", F.expr(f"explode(flatten(transform(anchors, i -> transform(filter(anchors, j -> j - i + 1 BETWEEN {shortest} AND {longest}), j -> struct(i, j)))))"))
    n = F.col("pair.j") - F.col("pair.i") + 1
    inner = F.aggregate(F.slice("at", F.col("pair.i") + 1, n), F.lit(0.0), lambda a, x: a + F.coalesce(x["sal"], F.lit(0.0)))
    pairs = rows.select("project_id", "corpus", "nodes", F.col("pair.i").alias("i"), F.col("pair.j").alias("j"), F.get("at", F.col("pair.i"))["ji"].alias("ji"), F.get("at", F.col("pair.j"))["jo"].alias("jo"), inner.alias("inner"))
    n = F.col("j") - F.col("i") + 1
    part = F.array_join(F.slice("nodes", F.col("i") + 1, n), ">")
    pairs = pairs.select("project_id", "corpus", part.alias("part"), n.alias("length"), "ji", "jo", (F.col("inner") / n).alias("sal"), F.get("nodes", F.col("i") - 1).alias("left"), F.get("nodes", F.col("j") + 1).alias("right"))
    # of pairs with the same neighbours one row; then the commonest neighbour on either side
    keys = ["project_id", "part"]
    g = pairs.groupBy(*keys, "left", "right").agg(F.count("*").alias("k"), F.min("length").cast("int").alias("length"), F.min("ji").alias("ji"), F.min("jo").alias("jo"), F.max("sal").alias("sal"), F.max("corpus").alias("corpus"))
    of = lambda side: F.when(F.col(side).isNotNull(), F.sum("k").over(Window.partitionBy(*keys, side)))
    g = g.withColumn("_l", of("left")).withColumn("_r", of("right"))
    g = g.groupBy(*keys).agg(F.min("length").alias("length"), F.sum("k").alias("support"), F.min("ji").alias("ji"), F.min("jo").alias("jo"), F.max("sal").alias("sal"), F.max("corpus").alias("corpus"), F.max(F.greatest("_l", "_r")).alias("k"))
    g = g.withColumn("supp", F.col("support") / F.col("corpus")).withColumn("junc", (F.col("ji") + F.col("jo")) / 2).withColumn("maxpen", F.coalesce("k", F.lit(0)) / F.col("support"))
    return g.select("project_id", "part", "length", "support", "supp", "junc", "sal", "maxpen", (F.col("supp") + F.col("junc") + F.col("sal") - F.col("maxpen")).alias("score"))


def top_parts(found: DataFrame, top: int = 10) -> DataFrame:
    """Each project's best parts: by score, then support, then length (ties: text); a top-k report."""
    w = Window.partitionBy("project_id").orderBy(F.desc(F.round("score", 9)), F.desc("support"), F.desc("length"), "part")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
