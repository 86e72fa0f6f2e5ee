"""Objectives, gradients, their alignment and the Pareto front, keyed by project."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def criticality() -> Column:
    """2 on the critical path, falling to 1 with float as large as the makespan."""
    return 2 - F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("tf") / F.greatest("makespan", F.lit(1e-9))))


def objectives(rows: DataFrame, rate: float = 85.0, capacity: float = 10.0) -> DataFrame:
    """Schedule, cost, risk, resources and quality of each project's dates (activities joined with their CPM).

    Resources: the squared excess over capacity, integrated over at most 500 bins of the makespan.
    """
    crash = F.col("crash_fraction")
    out = rows.groupBy("project_id").agg(
        F.max("makespan").alias("schedule"),
        F.sum(F.lit(rate) * F.col("resource_count") * F.col("duration")).alias("cost"),
        F.sum(F.col("risk") * 10 * criticality() * F.col("duration")).alias("risk"),
        F.sum(crash * crash * F.col("quality_sensitivity") * F.col("duration")).alias("quality"),
    )
    n = F.least(F.ceil("makespan"), F.lit(500)).cast("int")
    used = rows.where("ef > es and resource_count > 0 and makespan > 0").withColumn("n", n).withColumn("width", F.col("makespan") / n)
    first = F.greatest(F.lit(0), F.least(F.floor(F.col("es") / F.col("width")), F.col("n") - 1)).cast("int")
    last = F.greatest(first + 1, F.least(F.ceil(F.col("ef") / F.col("width")), F.col("n")).cast("int"))
    # +count where an activity begins and -count behind its end: the running sum is the profile
    steps = used.select("project_id", "width", F.explode(F.array(F.struct(first.alias("bin"), F.col("resource_count").alias("step")), F.struct(last.alias("bin"), (-F.col("resource_count")).alias("step")))).alias("e"))
    steps = steps.groupBy("project_id", F.col("e.bin").alias("bin")).agg(F.sum("e.step").alias("step"), F.max("width").alias("width"))
    w = Window.partitionBy("project_id").orderBy("bin")
    level = steps.withColumn("level", F.sum("step").over(w)).withColumn("bins", F.lead("bin").over(w) - F.col("bin"))
    over = F.greatest(F.col("level") - capacity, F.lit(0.0))
    load = level.where("bins is not null").groupBy("project_id").agg(F.sum(over * over * F.col("bins") * F.col("width")).alias("resources"))
    return out.join(load, "project_id", "left").withColumn("resources", F.coalesce("resources", F.lit(0.0)))


def gradients(rows: DataFrame, rate: float = 85.0) -> DataFrame:
    """What an hour more of each activity adds to schedule, cost, risk and quality."""
    return rows.select("project_id", "id", F.col("critical").cast("double").alias("d_schedule"), (F.lit(rate) * F.col("resource_count")).alias("d_cost"), (F.col("risk") * 10 * criticality()).alias("d_risk"), F.when(F.col("duration") > 0, -2 * F.col("crash_fraction") * F.col("quality_sensitivity")).otherwise(0.0).alias("d_quality"))


def alignment(g: DataFrame) -> DataFrame:
    """Cosine between two disciplines' gradients of a project (0 if either vanishes)."""
    names = ("schedule", "cost", "risk", "quality")
    sums = [F.sum(F.col(f"d_{a}") * F.col(f"d_{b}")).alias(f"{a}_{b}") for i, a in enumerate(names) for b in names[i:]]
    s = g.groupBy("project_id").agg(*sums)
    cos = lambda a, b: F.when((F.col(f"{a}_{a}") > 0) & (F.col(f"{b}_{b}") > 0), F.col(f"{a}_{b}") / F.sqrt(F.col(f"{a}_{a}") * F.col(f"{b}_{b}"))).otherwise(0.0)
    return s.select("project_id", *[cos(a, b).alias(f"{a}_{b}") for i, a in enumerate(names) for b in names[i + 1 :]])


def ranking(g: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Interventions: the weighted absolute sensitivity, its rank, share of the largest, and priority."""
    total = sum(weights.values())
    s = sum((F.abs(F.col(f"d_{k}")) * (v / total) for k, v in weights.items()), F.lit(0.0))
    by = Window.partitionBy("project_id")
    rows = g.withColumn("sensitivity", s).withColumn("score", F.when(F.max("sensitivity").over(by) > 0, F.col("sensitivity") / F.max("sensitivity").over(by)).otherwise(0.0))
    rank = F.row_number().over(by.orderBy(F.desc("sensitivity"), "id"))
    priority = F.when(F.col("score") >= 0.7, "high").when(F.col("score") >= 0.3, "medium").otherwise("low")
    return rows.select("project_id", "id", rank.alias("rank"), "sensitivity", "score", priority.alias("priority"))


def pareto_front(points: DataFrame, group: str, minimised: list[str]) -> DataFrame:
    """Points that no other of their group equals or betters everywhere and betters somewhere.

    groups are small (the weight vectors of one project), so the comparison stays within a group's array.
    """
    one = F.struct(*minimised)
    gathered = points.withColumn("others", F.collect_list(one).over(Window.partitionBy(group)))

    def beats(o):
        no_worse, better = F.lit(True), F.lit(False)
        for c in minimised:
            no_worse, better = no_worse & (o[c] <= F.col(c)), better | (o[c] < F.col(c))
        return no_worse & better

    return gathered.where(~F.exists("others", beats)).drop("others")


def weight_vectors(disciplines: list[str], n: int = 30) -> list[dict[str, float]]:
    """Points of the simplex: a line between two disciplines, else a grid, thinned out evenly to n."""
    k = len(disciplines)
    if k == 1:
        return [{disciplines[0]: 1.0}]
    if k == 2:
        return [{disciplines[0]: a, disciplines[1]: 1 - a} for a in (0.05 + 0.9 * i / (n - 1) for i in range(n))]
    steps = max(3, round(n ** (1 / (k - 1))))
    grid: list[list[float]] = [[]]
    for _ in range(k - 1):
        grid = [g + [(1 - sum(g)) * i / steps] for g in grid for i in range(steps + 1) if not ((1 - sum(g)) * i / steps < 0.01 and 1 - sum(g) > 0.1)]
    grid = [g + [1 - sum(g)] for g in grid]
    if len(grid) > n:
        grid = [grid[i * len(grid) // n] for i in range(n)]
    return [dict(zip(disciplines, (round(x, 6) for x in g))) for g in grid]
