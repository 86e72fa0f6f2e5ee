"""Deep networks derived from the star schema: a thousand orders are one project of some thousand activities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .star import table

ORDERS, WIDTH, JUMPS = 1000, 8, (0, 1, 3)


def activities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(project_id, seq, id, duration, lag): lines of ORDERS neighbouring order keys, so projects stay of one size
    however large the table is; WIDTH lines are a layer."""
    order = Window.partitionBy("project_id").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate")
    line = table(spark, sf_dir, "lineitem").withColumn("project_id", F.floor(F.col("l_orderkey") / ORDERS))
    line = line.withColumn("seq", F.row_number().over(order))
    return line.select("project_id", "seq", F.concat_ws("-", F.lit("d"), "project_id", "seq").alias("id"), F.col("l_quantity").alias("duration"), (F.round(F.col("l_tax") * 100) - 4).alias("lag"))


def links(acts: DataFrame) -> DataFrame:
    """From every activity to three of the next layer, one of each relation FS, SS and FF."""
    layer, place = F.floor((F.col("seq") - 1) / WIDTH), (F.col("seq") - 1) % WIDTH
    last = F.max("seq").over(Window.partitionBy("project_id"))
    jump = F.explode(F.array(*[F.struct(F.lit(j).alias("jump"), F.lit(r).alias("rel")) for j, r in zip(JUMPS, ("FS", "SS", "FF"))]))
    rows = acts.withColumn("last", last).withColumn("j", jump).withColumn("to", (layer + 1) * WIDTH + (place + F.col("j.jump")) % WIDTH + 1).where("to <= last")
    return rows.select("project_id", F.col("id").alias("source"), F.concat_ws("-", F.lit("d"), "project_id", F.col("to").cast("long")).alias("target"), F.col("j.rel").alias("rel"), "lag", F.col("j.jump").alias("ord"))


SQL = f"""dact AS (SELECT l_orderkey // {ORDERS} AS project_id, row_number() OVER (PARTITION BY l_orderkey // {ORDERS} ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) AS seq, l_quantity AS duration, round(l_tax * 100) - 4 AS lag FROM lineitem),
dlnk AS (SELECT a.project_id, (a.seq - 1) // {WIDTH} AS layer, a.seq AS src, b.seq AS dst, a.lag, b.duration AS ds, CASE j WHEN 0 THEN a.duration + a.lag WHEN 1 THEN a.lag ELSE a.duration + a.lag - b.duration END AS w
 FROM dact a, (VALUES (0), (1), (3)) v(j) JOIN dact b ON b.project_id = a.project_id AND b.seq = ((a.seq - 1) // {WIDTH} + 1) * {WIDTH} + (a.seq - 1 + j) % {WIDTH} + 1)"""
