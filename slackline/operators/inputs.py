"""Input rows: defaults, aliases, validation, grouping fields, units, and canonical output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Relations that a link may have (fixed values).
RELATIONS = ("FS", "SS", "FF", "SF")
#: Milliseconds of a unit of wall-clock time by spelling (fixed values): days have 24 hours, months 30 days, years 365.
HOUR = 3_600_000.0
WALL = (
    (("h", "hr", "hrs", "hour", "hours"), HOUR),
    (("s", "sec", "secs", "second", "seconds"), 1000.0),
    (("m", "min", "mins", "minute", "minutes"), HOUR / 60),
    (("d", "day", "days"), 24 * HOUR),
    (("w", "wk", "wks", "week", "weeks"), 7 * 24 * HOUR),
    (("mo", "mon", "mons", "month", "months"), 30 * 24 * HOUR),
    (("y", "yr", "yrs", "year", "years"), 365 * 24 * HOUR),
)


def wall_clock_ms(duration: Column, unit: Column) -> Column:
    """Milliseconds of wall-clock time; null, negative and non-finite durations are 0, unknown units hours."""
    u = F.lower(F.trim(F.coalesce(unit, F.lit("h"))))
    size = F.lit(HOUR)
    for names, ms in WALL:
        size = F.when(u.isin(*names), F.lit(ms)).otherwise(size)
    ok = duration.isNotNull() & ~F.isnan(duration) & (duration >= 0) & (duration < float("inf"))
    return F.when(ok, duration * size).otherwise(0.0)


def first_filled(*columns: Column, default: Column | None = None) -> Column:
    """The first of the columns, as text, that isn't null or blank; else the default."""
    return F.coalesce(*[F.nullif(F.trim(c.cast("string")), F.lit("")) for c in columns], *([default] if default is not None else []))


def first_number(*columns: Column, default: float | None = None) -> Column:
    """The first of the columns that is a finite number (texts are read as numbers); else the default."""
    nums = [c.try_cast("double") for c in columns]
    return F.coalesce(*[F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c) for c in nums], F.lit(default).cast("double"))


def first_rows(rows: DataFrame, columns: list[str], n: int, order: str = "seq") -> DataFrame:
    """Each project's first n rows in input order, with some columns only (a report of the size asked for)."""
    w = Window.partitionBy("project_id").orderBy(order)
    return rows.select("project_id", order, *[c for c in columns if c not in ("project_id", order)]).withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= n).drop("_k").select(*columns)


def grouping_field(rows: DataFrame, candidates: list[str]) -> DataFrame:
    """(project_id, field, populated, n, advice): for each project the first candidate filled on any row; one aggregate.

    advice is 'none' where no candidate is filled (field is then the first one), 'partial' where some rows lack it.
    """
    filled = [F.count(F.nullif(F.trim(F.col(c).cast("string")), F.lit(""))).alias(f"_{i}") for i, c in enumerate(candidates)]
    g = rows.groupBy("project_id").agg(F.count("*").alias("n"), *filled)
    field, populated = F.lit(candidates[0]), F.lit(0)
    for i, c in reversed(list(enumerate(candidates))):
        field, populated = F.when(F.col(f"_{i}") > 0, c).otherwise(field), F.when(F.col(f"_{i}") > 0, F.col(f"_{i}")).otherwise(populated)
    advice = F.when(F.col("populated") == 0, "none").when(F.col("populated") < F.col("n"), "partial")
    return g.select("project_id", field.alias("field"), populated.cast("long").alias("populated"), "n").withColumn("advice", advice)


def dominant_units(rows: DataFrame, unit: str, duration: str, order: str = "seq", default: str = "Hours") -> DataFrame:
    """(project_id, unit, mixed): the most frequent unit, case ignored, of activities with a positive duration; ties go to
    the one that comes first, and it is written as it was first. A missing unit votes for the default; projects
    without votes have the default."""
    own = first_filled(F.col(unit), default=F.lit(default))
    votes = F.coalesce(F.col(duration), F.lit(1.0)) > 0
    g = rows.groupBy("project_id", F.lower(own).alias("_u")).agg(F.count_if(votes).alias("_n"), F.min_by(own, F.when(votes, F.col(order))).alias("_first"), F.min(F.when(votes, F.col(order))).alias("_at"))
    out = g.groupBy("project_id").agg(F.max_by("_first", F.struct("_n", -F.col("_at"))).alias("unit"), F.count_if(F.col("_n") > 0).alias("_kinds"))
    return out.select("project_id", F.when(F.col("_kinds") > 0, F.col("unit")).otherwise(default).alias("unit"), (F.col("_kinds") > 1).alias("mixed"))


def violations(acts: DataFrame, links: DataFrame) -> DataFrame:
    """(project_id, code, n): what is wrong with the rows of a request, counted; sound projects have no rows.

    missing_id, duplicate_id, bad_duration (negative or not finite), unknown_relation, dangling_link (an end that no
    activity has), self_link. One pass over each table, and one shuffle by project and id for both ends of all links.
    """
    ids = acts.groupBy("project_id", "id").agg(F.count("*").alias("_n"))
    d = F.col("duration")
    own = acts.groupBy("project_id").agg(F.count_if(F.trim(F.coalesce("id", F.lit(""))) == "").alias("missing_id"), F.count_if(F.isnan(d) | (d < 0) | (d == float("inf"))).alias("bad_duration"))
    twice = ids.where("id is not null and _n > 1").groupBy("project_id").agg(F.count("*").alias("duplicate_id"))
    rel = links.groupBy("project_id").agg(F.count_if(~F.upper(F.coalesce("rel", F.lit("FS"))).isin(*RELATIONS)).alias("unknown_relation"), F.count_if(F.col("source") == F.col("target")).alias("self_link"))
    ends = links.select("project_id", F.explode(F.array("source", "target")).alias("id")).groupBy("project_id", "id").agg(F.count("*").alias("_k"))
    known = ids.select(F.col("project_id").alias("_p"), F.col("id").alias("_id"))
    loose = ends.join(known, (F.col("project_id") == F.col("_p")) & (F.col("id") == F.col("_id")), "left_anti").groupBy("project_id").agg(F.sum("_k").alias("dangling_link"))
    out = None
    for t in (own, twice, rel, loose):
        codes = [c for c in t.columns if c != "project_id"]
        long = t.select("project_id", F.explode(F.array(*[F.struct(F.lit(c).alias("code"), F.col(c).cast("long").alias("n")) for c in codes])).alias("e")).select("project_id", "e.*")
        out = long if out is None else out.unionByName(long)
    return out.where("n > 0")


def json_ready(rows: DataFrame) -> DataFrame:
    """Doubles that JSON can't say (NaN, infinities) as null; other columns as they are."""
    return rows.select(*[F.when(~F.isnan(c) & (F.abs(c) < float("inf")), F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in rows.dtypes])


def cache_keys(rows: DataFrame, columns: list[str], order: str = "seq") -> DataFrame:
    """(project_id, key): SHA-256 of a project's rows in canonical form (columns by name, input order), so equal
    requests have equal keys. A project's rows meet in one group, as for its network."""
    line = F.concat_ws(";", *[F.concat(F.lit(c + "="), F.coalesce(F.col(c).cast("string"), F.lit("null"))) for c in sorted(columns)])
    lines = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("l")))), lambda s: s["l"])
    return rows.groupBy("project_id").agg(F.sha2(F.concat_ws("\n", lines), 256).alias("key"))


def merged_registry(*tables: DataFrame, key: str = "name") -> DataFrame:
    """Rows of all tables, of each key that of the last table that has it; the tables are small and alike."""
    out = None
    for i, t in enumerate(tables):
        t = t.withColumn("_p", F.lit(i))
        out = t if out is None else out.unionByName(t)
    return out.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("_p")))).where("_k = 1").drop("_k", "_p")
