"""Schedules derived from the star schema: orders are projects, their lines activities.

Nothing here is joined that a window over the project's own lines can say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

STATUS_DATE = "1998-06-30 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_place(rows: DataFrame) -> DataFrame:
    """rows of a table with row: the place in its file; in a table of many files, the file (in order of names) and the place there."""
    at = F.col("_metadata.row_index")
    return rows.select("*", (at if len(rows.inputFiles()) < 2 else F.struct("_metadata.file_path", at)).alias("row"))


def activities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each line: project_id, seq (input order), id, durations, dates, progress, risk, cost and row (place in the table)."""
    line = with_place(table(spark, sf_dir, "lineitem"))
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate")
    a = line.withColumn("seq", F.row_number().over(order))
    done = F.col("l_linestatus") == "F"
    pct = F.when(done, 100.0).otherwise((F.col("l_partkey") % 100).cast("double"))
    finish = F.col("l_shipdate") + F.make_dt_interval(F.ceil(F.col("l_quantity") / 8).cast("int"))
    return a.select(
        F.col("l_orderkey").alias("project_id"),
        "seq",
        F.concat_ws("-", F.col("l_orderkey"), F.col("seq")).alias("id"),
        F.col("l_quantity").alias("duration"),
        F.col("l_shipdate").alias("start"),
        finish.alias("finish"),
        pct.alias("pct"),
        F.when(pct > 0, F.col("l_shipdate")).alias("actual_start"),
        F.when(done, finish).alias("actual_finish"),
        F.when((F.col("l_partkey") % 7 == 0) & (pct > 0), F.col("l_extendedprice") * pct / 100).alias("actual_cost"),
        (F.col("l_extendedprice") / F.col("l_quantity") / 8).alias("cost_rate"),
        ((F.col("l_partkey") % 97) / F.lit(97.0)).alias("risk"),
        ((F.col("l_suppkey") % 13) / F.lit(13.0)).alias("importance"),
        (1 + F.col("l_linenumber") % 3).cast("double").alias("resource_count"),
        F.col("l_returnflag").alias("task_type"),
        F.when(F.col("l_suppkey") % 10 == 0, "").otherwise(F.concat(F.lit("S"), F.col("l_suppkey") % 5)).alias("resources"),
        F.round(F.col("l_tax") * 100).alias("tax"),
        F.col("l_partkey").alias("part"),
        F.col("l_suppkey").alias("supplier"),
        "row",
    )


#: The same view for DuckDB, as a common table expression.
ACT_SQL = """act AS (
SELECT l_orderkey AS project_id, seq, l_orderkey || '-' || seq AS id, l_quantity AS duration, l_shipdate AS start,
 l_shipdate + to_days(ceil(l_quantity / 8)::INTEGER) AS finish, pct, CASE WHEN pct > 0 THEN l_shipdate END AS actual_start,
 CASE WHEN l_linestatus = 'F' THEN l_shipdate + to_days(ceil(l_quantity / 8)::INTEGER) END AS actual_finish,
 CASE WHEN l_partkey % 7 = 0 AND pct > 0 THEN l_extendedprice * pct / 100 END AS actual_cost, l_extendedprice / l_quantity / 8 AS cost_rate,
 (l_partkey % 97) / 97.0::DOUBLE AS risk, (l_suppkey % 13) / 13.0::DOUBLE AS importance, (1 + l_linenumber % 3)::DOUBLE AS resource_count,
 l_returnflag AS task_type, CASE WHEN l_suppkey % 10 = 0 THEN '' ELSE 'S' || (l_suppkey % 5) END AS resources, round(l_tax * 100) AS tax, l_partkey AS part, l_suppkey AS supplier
FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) AS seq,
 CASE WHEN l_linestatus = 'F' THEN 100.0::DOUBLE ELSE (l_partkey % 100)::DOUBLE END AS pct FROM lineitem))"""

LNK_SQL = """lnk AS (
SELECT a.project_id, a.id AS source, b.id AS target, a.seq AS src, b.seq AS dst, (b.seq - a.seq)::INTEGER AS ord,
 CASE a.seq % 4 WHEN 0 THEN 'FS' WHEN 1 THEN 'SS' WHEN 2 THEN 'FF' ELSE 'SF' END AS rel, a.tax - 4 AS lag, a.duration AS dp, b.duration AS ds,
 CASE a.seq % 4 WHEN 0 THEN a.duration + a.tax - 4 WHEN 1 THEN a.tax - 4 WHEN 2 THEN a.duration + a.tax - 4 - b.duration ELSE a.tax - 4 - b.duration END AS w
FROM act a JOIN act b ON a.project_id = b.project_id AND b.seq IN (a.seq + 1, a.seq + 2))"""


def links(acts: DataFrame) -> DataFrame:
    """Each activity to the next two: the relation turns with seq, the lag is the tax less four hours."""
    w = Window.partitionBy("project_id").orderBy("seq")
    rel = F.element_at(F.array(*map(F.lit, ("FS", "SS", "FF", "SF"))), F.col("seq") % 4 + 1)
    both = F.array(*[F.struct(F.lead("id", k).over(w).alias("target"), F.lit(k).alias("ord")) for k in (1, 2)])
    rows = acts.select("project_id", F.col("id").alias("source"), rel.alias("rel"), (F.col("tax") - 4).alias("lag"), both.alias("both"))
    rows = rows.select("project_id", "source", "rel", "lag", F.explode("both").alias("l"))
    return rows.select("project_id", "source", F.col("l.target").alias("target"), "rel", "lag", F.col("l.ord").alias("ord")).where("target IS NOT NULL")
