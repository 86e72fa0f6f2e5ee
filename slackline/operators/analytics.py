"""Portfolio analytics: overruns, resource needs, histograms, significance, risk indices, compound risk, complexity, cost types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slackline.functions.units import clamp

#: Weights of the parts of a risk index (fixed values): computed risk, overrun probability, outlier, correlation.
RISK_WEIGHTS = (0.40, 0.30, 0.15, 0.15)
#: Spreads in days up to which a forecast counts as of high, medium and low confidence (fixed values).
SPREADS = ((14, "high"), (45, "medium"), (90, "low"))
#: Complexity factors of sectors, first name found counts (fixed values).
SECTORS = (
    ("nuclear", 1.4), ("olympic", 1.3), ("petrochemical", 1.25), ("chemical", 1.2), ("lng", 1.25), ("refinery", 1.2), ("offshore", 1.25), ("semiconductor", 1.2),
    ("defense", 1.15), ("aerospace", 1.15), ("rail", 1.1), ("airport", 1.1), ("tunnel", 1.1), ("hospital", 1.1), ("datacenter", 1.05), ("port", 1.05),
    ("mining", 1.0), ("bridge", 1.0), ("water", 1.0), ("power", 0.95), ("solar", 0.9), ("wind", 0.9), ("road", 0.9), ("building", 0.85),
)
#: Words that tell the type of a cost (fixed values); the type with most of them counts, of equals the first.
COST_WORDS = (
    ("DIRECT_LABOR", ("engineer", "worker", "labor", "manpower", "staff", "crew", "personnel", "technician", "operator", "supervisor", "foreman")),
    ("DIRECT_MATERIAL", ("material", "steel", "concrete", "pipe", "cement", "supply", "purchase", "procurement", "commodity", "consumable", "aggregate")),
    ("EQUIPMENT", ("equipment", "crane", "excavator", "machinery", "vehicle", "tool", "rental", "lease", "mobilization", "demobilization")),
    ("SUBCONTRACTS", ("subcontract", "contractor", "vendor", "supplier", "consultant", "specialist", "outsource", "third-party", "service provider")),
    ("INDIRECT", ("overhead", "management", "admin", "supervision", "office", "insurance", "permit", "facility", "utilities", "safety")),
)


def overrun_multiplier(raw: Column, semantics: str = "fractional_overrun", impact: float = 1.0, least: float = 0.5, most: float = 3.0) -> Column:
    """Duration multiplier of an overrun given as a fraction, a percentage or a probability, within bounds; null, negative and
    non-finite overruns are 0."""
    x = F.when(raw.isNotNull() & ~F.isnan(raw) & (raw > 0) & (raw < float("inf")), raw).otherwise(0.0)
    m = {"percent": 1 + x / 100, "probability": 1 + F.least(F.lit(1.0), x) * impact, "fractional_overrun": 1 + x}[semantics]
    return clamp(m, least, most)


def resource_need(start: Column, finish: Column, hours: Column, hours_per_day: float = 8.0, days_per_week: int = 5) -> Column:
    """Resources that do the hours within the window's working days (both ends included); 0 without one."""
    days = F.datediff(finish, start)
    each = F.when(days >= 0, F.filter(F.transform(F.sequence(F.lit(0), F.greatest(days, F.lit(0))), lambda i: (F.weekday(start) + i) % 7), lambda d: d < days_per_week))
    n = F.coalesce(F.size(each), F.lit(0))
    return F.when(n > 0, F.ceil(hours / (n * hours_per_day))).otherwise(0).cast("int")


def histogram(rows: DataFrame, by: str, value: str, width: float) -> DataFrame:
    """(by, bin, n, smoothed): counts of bins from a group's first to its last, empty ones included, and their moving mean of three."""
    g = rows.where(F.col(value).isNotNull()).groupBy(by, F.floor(F.col(value) / width).alias("bin")).agg(F.count("*").alias("n"))
    ends = g.groupBy(by).agg(F.explode(F.sequence(F.min("bin"), F.max("bin"))).alias("bin"))
    g = ends.join(g, [by, "bin"], "left").fillna(0, ["n"])
    w = Window.partitionBy(by).orderBy("bin").rowsBetween(-1, 1)
    return g.withColumn("smoothed", F.avg("n").over(w))


def peaks(bins: DataFrame, by: str, least_prominence: float = 0.1, least_count: int = 1) -> DataFrame:
    """(by, bin, n, smoothed, prominence, width): local maxima of a histogram that stand out.

    Prominence is the height above the higher of the two valleys, a valley reaching to the next higher bin or the end;
    width counts the bins around that are above half of it. Bins meet the other bins of their own group: a fixed and small number.
    """
    w = Window.partitionBy(by).orderBy("bin")
    top = bins.withColumn("_l", F.lag("smoothed").over(w)).withColumn("_r", F.lead("smoothed").over(w)).where("smoothed > _l and smoothed > _r").drop("_l", "_r")
    other = bins.select(F.col(by).alias("_by"), F.col("bin").alias("_b"), F.col("smoothed").alias("_s"))
    pairs = top.join(other, F.col(by) == F.col("_by"))
    key = [by, "bin", "n", "smoothed"]
    left, right, higher = F.col("_b") < F.col("bin"), F.col("_b") > F.col("bin"), F.col("_s") > F.col("smoothed")
    lim = pairs.groupBy(*key).agg(F.max(F.when(left & higher, F.col("_b"))).alias("_lo"), F.min(F.when(right & higher, F.col("_b"))).alias("_hi"))
    pairs = lim.join(other, F.col(by) == F.col("_by")).where("(_lo is null or _b >= _lo) and (_hi is null or _b <= _hi)")
    base = pairs.groupBy(*key).agg(F.greatest(F.min(F.when(F.col("_b") <= F.col("bin"), F.col("_s"))), F.min(F.when(F.col("_b") >= F.col("bin"), F.col("_s")))).alias("_base"))
    base = base.withColumn("prominence", (F.col("smoothed") - F.col("_base")) / F.col("smoothed")).withColumn("_half", (F.col("smoothed") + F.col("_base")) / 2)
    low = F.col("_s") <= F.col("_half")
    span = base.join(other, F.col(by) == F.col("_by")).groupBy(*key, "prominence").agg(F.max(F.when(left & low, F.col("_b"))).alias("_lo"), F.min(F.when(right & low, F.col("_b"))).alias("_hi"), F.min("_b").alias("_first"), F.max("_b").alias("_last"))
    width = F.coalesce(F.col("_hi"), F.col("_last") + 1) - F.coalesce(F.col("_lo"), F.col("_first") - 1) - 1
    return span.where((F.col("prominence") >= least_prominence) | (F.col("n") >= least_count)).select(*key, "prominence", width.alias("width"))


def significance(paths: DataFrame, critical: DataFrame) -> DataFrame:
    """(project_id, path, significance) of paths (project_id, path, duration, length): 0.4 of the duration's and 0.3 of the length's
    share of the project's largest, 0.3 of the share of critical activities (project_id, id). A largest duration of 0 gives 0."""
    nodes = critical.groupBy("project_id").agg(F.collect_set("id").alias("_c"))  # a project's own ids, as its kernel holds them
    w = Window.partitionBy("project_id")
    n = F.size(F.array_intersect(F.split("path", ">"), F.coalesce("_c", F.array().cast("array<string>"))))
    rows = paths.withColumn("_d", F.max("duration").over(w)).withColumn("_n", F.max("length").over(w)).join(nodes, "project_id", "left")
    s = 0.4 * F.col("duration") / F.col("_d") + 0.3 * n / F.col("length") + 0.3 * F.col("length") / F.col("_n")
    return rows.select("project_id", "path", F.when(F.col("_d") > 0, s).otherwise(0.0).alias("significance"))


def risk_index(risk: Column, overrun: Column, outlier: Column, correlation: Column) -> Column:
    """Weighted risk between 0 and 1; outlier is a flag; nulls count as 0."""
    unit = lambda c: clamp(F.coalesce(c, F.lit(0.0)), 0.0, 1.0)
    parts = (unit(risk), unit(overrun), F.when(outlier, 1.0).otherwise(0.0), unit(F.abs(correlation)))
    return clamp(sum((w * p for w, p in zip(RISK_WEIGHTS, parts)), F.lit(0.0)) / sum(RISK_WEIGHTS), 0.0, 1.0)


def confidence(days: Column) -> Column:
    """high, medium, low or critical by the spread of a forecast in days."""
    out = F.lit("critical")
    for limit, name in reversed(SPREADS):
        out = F.when(days <= limit, name).otherwise(out)
    return out


def elapsed_percent(pct: Column, actual_start: Column, actual_finish: Column, hours: Column, status: str) -> Column:
    """Progress (0 to 1) as reported; where it is 0 and work has begun but not ended, 5/7 of the elapsed hours by the duration, up to 0.99."""
    passed = F.greatest(F.lit(0.0), F.timestamp_diff("SECOND", actual_start, F.to_timestamp_ntz(F.lit(status))) / 3600.0)
    guess = F.least(F.lit(0.99), passed * (5 / 7) / F.nullif(hours, F.lit(0.0)))
    return F.when(pct > 0, pct).when(actual_start.isNotNull() & actual_finish.isNull() & (hours > 0), guess).otherwise(0.0)


def compound_risk(signals: DataFrame) -> DataFrame:
    """(region, types, signals, max_severity, amplification) of regions where signals (region, type, severity) of two types or more
    meet: 1 + log2(types) / 4, a little more if they are severe, up to 1.5. A null region is global, a null type unknown."""
    g = signals.groupBy(F.coalesce("region", F.lit("global")).alias("region")).agg(F.countDistinct(F.coalesce("type", F.lit("unknown"))).alias("types"), F.count("*").alias("signals"), F.greatest(F.lit(0.0), F.max("severity")).alias("max_severity"))
    boost = F.when(F.col("max_severity") > 0.7, 0.08).when(F.col("max_severity") > 0.4, 0.04).otherwise(0.0)
    return g.where("types >= 2").withColumn("amplification", F.least(F.lit(1.5), 1 + 0.25 * F.log2("types") + boost))


def sector_factor(sector: Column) -> Column:
    s, out = F.lower(F.coalesce(sector, F.lit(""))), F.lit(1.0)
    for name, factor in reversed(SECTORS):
        out = F.when(s.contains(name), factor).otherwise(out)
    return out


def complexity(activities: Column, days: Column, capex: Column, sector: Column) -> Column:
    """0 to 100 by size, duration, cost and sector; halves are rounded up."""
    part = lambda x, full: F.least(F.lit(25.0), x / full * 25)
    raw = part(activities, 500) + part(days, 1500) + part(capex, 5e9) + F.when(activities > 1000, 10).when(activities > 500, 5).otherwise(0)
    return F.least(F.lit(100), F.floor(raw * sector_factor(sector) + 0.5)).cast("int")


def cost_type(name: Column) -> Column:
    """The type whose words occur most in a name, of equals the first; DIRECT_LABOR without any."""
    text = F.lower(F.coalesce(name, F.lit("")))
    scores = [sum((text.contains(w).cast("int") for w in words), F.lit(0)) for _, words in COST_WORDS]
    top, out = F.greatest(*scores), F.lit("DIRECT_LABOR")
    for (label, _), score in reversed(list(zip(COST_WORDS, scores))):
        out = F.when((score == top) & (top > 0), label).otherwise(out)
    return out


def best_windows(rows: DataFrame, value: str, least: float, shortest: int = 3, longest: int = 100) -> DataFrame:
    """(project_id, first, length, mean): of each project's runs of neighbouring activities (by seq) whose mean value is at least
    `least`, a longest one, of those the one of the largest mean, of those the first. No run of `shortest` or more: no row.

    Means come from running sums; each activity meets as many lengths as a run may have, so the work grows with activities times
    `longest`, in windows by project.
    """
    w = Window.partitionBy("project_id").orderBy("seq")
    r = rows.select("project_id", "seq", F.col(value).alias("_v")).withColumn("_k", F.row_number().over(w)).withColumn("_sum", F.sum("_v").over(w))
    before = r.select(F.col("project_id").alias("_p"), F.col("_k").alias("_b"), F.col("_sum").alias("_s"))
    n = F.least(F.lit(longest), F.col("_k"))
    r = r.withColumn("_len", F.explode(F.when(n >= shortest, F.sequence(F.lit(shortest), n)).otherwise(F.array().cast("array<int>"))))
    r = r.join(before, (F.col("project_id") == F.col("_p")) & (F.col("_k") - F.col("_len") == F.col("_b")), "left")
    r = r.withColumn("mean", (F.col("_sum") - F.coalesce("_s", F.lit(0.0))) / F.col("_len")).withColumn("first", F.col("_k") - F.col("_len") + 1).where(F.col("mean") >= least)
    best = F.max_by(F.struct("first", F.col("_len").alias("length"), "mean"), F.struct("_len", F.round("mean", 9), -F.col("first")))
    return r.groupBy("project_id").agg(best.alias("b")).select("project_id", "b.first", "b.length", "b.mean")


def tuned_selection(shape: DataFrame) -> DataFrame:
    """(project_id, max_paths, overlap_threshold, min_unique_edges, candidate_cap, midpoint_depth) by a network's shape
    (project_id, nodes, links, median_edges); thresholds are fixed values."""
    n, k, edges = F.col("nodes"), F.col("links"), F.col("median_edges")
    paths = F.when(n < 600, 80).when(n < 1500, 120).when(n < 4000, 180).when(n < 12000, 220).otherwise(260)
    density = k / F.greatest(n, F.lit(1))
    paths = F.when(density > 3.5, F.least(F.lit(320), paths + 40)).when(density > 2.5, F.least(F.lit(300), paths + 20)).otherwise(paths)
    overlap = F.when(edges < 80, 0.90).when(edges < 200, 0.92).when(edges < 450, 0.94).otherwise(0.95)
    unique = F.when(edges < 60, 4).when(edges < 120, 5).when(edges < 250, 8).when(edges < 500, 12).otherwise(15)
    cap = F.when((n > 12000) | (k > 35000), 12_000).when(n > 8000, 15_000).otherwise(20_000)
    return shape.select("project_id", paths.alias("max_paths"), overlap.alias("overlap_threshold"), unique.alias("min_unique_edges"), cap.alias("candidate_cap"), F.when(edges < 80, 2).otherwise(3).alias("midpoint_depth"))


def thousandths(x: Column) -> Column:
    return F.floor(x * 1000 + 0.5) / 1000


def sentiment_divergence(signals: DataFrame, by: str) -> DataFrame:
    """(by, signals, overreacting, underreacting, average) of signals whose divergence is beyond 0.05 either way; the average to thousandths."""
    d = F.col("divergence")
    g = signals.where(F.abs(d) > 0.05).groupBy(by)
    return g.agg(F.count("*").alias("signals"), F.count_if(d > 0).alias("overreacting"), F.count_if(d < 0).alias("underreacting"), thousandths(F.avg(d)).alias("average"))


def weather_confidence(signals: DataFrame, by: str) -> DataFrame:
    """(by, forecasts, confidence, max_severity, h24, h48) of weather signals that carry a confidence; averages and severities to thousandths."""
    g = signals.where("type = 'weather' and confidence is not null").groupBy(by)
    h = F.coalesce("horizon", F.lit("unknown"))
    return g.agg(F.count("*").alias("forecasts"), thousandths(F.avg("confidence")).alias("confidence"), F.max(thousandths(F.coalesce("severity", F.lit(0.0)))).alias("max_severity"), F.count_if(h == "24h").alias("h24"), F.count_if(h == "48h").alias("h48"))


def merged_risks(existing: DataFrame, generated: DataFrame, order: str = "ord") -> DataFrame:
    """Rows of both registers (name, type, ...), one for each name and type in any case: existing ones first, then by order. Missing names and types are empty."""
    rows = existing.withColumn("_p", F.lit(0)).unionByName(generated.withColumn("_p", F.lit(1)))
    key = [F.lower(F.coalesce(c, F.lit(""))) for c in ("name", "type")]
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(*key).orderBy("_p", order))).where("_k = 1").drop("_k", "_p")


def pattern_modes(acts: DataFrame, value: str) -> DataFrame:
    """(task_type, tenths, n, modes): of activities alike in type and duration (to a tenth) their number, if above one, and the commonest values,
    all of equals, sorted. Values are counted first, so a frequent pattern is no hot group."""
    key = ["task_type", F.round(F.col("duration") * 10).cast("long").alias("tenths")]
    g = acts.groupBy(*key, F.col(value).alias("v")).agg(F.count("*").alias("k"))
    top = g.groupBy("task_type", "tenths").agg(F.sum("k").alias("n"), F.max(F.when(F.col("v").isNotNull(), F.col("k"))).alias("top")).where("n > 1")
    both = g.join(top, ["task_type", "tenths"]).groupBy("task_type", "tenths", "n")
    return both.agg(F.concat_ws(",", F.array_sort(F.collect_list(F.when(F.col("k") == F.col("top"), F.col("v"))))).alias("modes"))
