"""Requests as JSON lines: nodes and links of one project each, and results the same way."""

from __future__ import annotations

from dataclasses import fields, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NODE = "struct<id:string,duration:double,start:timestamp_ntz,risk:double>"
LINK = "struct<source:string,target:string,rel:string,lag:double>"
SCHEMA = f"project_id long, nodes array<{NODE}>, links array<{LINK}>, _broken string"


def read(spark: SparkSession, path: str) -> DataFrame:
    """(project_id, nodes, links, broken): a row for each line of the files; broken holds a line that is no such JSON (else null)."""
    rows = spark.read.schema(SCHEMA).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_broken").json(path)
    return rows.withColumnRenamed("_broken", "broken")


def nodes(requests: DataFrame) -> DataFrame:
    """(project_id, seq, id, duration, start, risk) of sound requests, with defaults: no duration is 1, no risk 0; seq is the input order."""
    rows = requests.where("broken is null").select("project_id", F.posexplode("nodes").alias("seq", "n"))
    return rows.select("project_id", (F.col("seq") + 1).alias("seq"), "n.id", F.coalesce("n.duration", F.lit(1.0)).alias("duration"), "n.start", F.coalesce("n.risk", F.lit(0.0)).alias("risk"))


def links(requests: DataFrame) -> DataFrame:
    """(project_id, source, target, rel, lag, ord) of sound requests; no relation is FS, no lag 0."""
    rows = requests.where("broken is null").select("project_id", F.posexplode("links").alias("ord", "l"))
    return rows.select("project_id", "l.source", "l.target", F.coalesce("l.rel", F.lit("FS")).alias("rel"), F.coalesce("l.lag", F.lit(0.0)).alias("lag"), "ord")


def packed(acts: DataFrame, links_: DataFrame) -> DataFrame:
    """Requests (project_id, nodes, links) of tables, a project's rows in input order in one line."""
    n = acts.groupBy("project_id").agg(F.array_sort(F.collect_list(F.struct("seq", F.struct("id", "duration", "start", "risk").alias("n")))).alias("n"))
    k = links_.groupBy("project_id").agg(F.collect_list(F.struct("source", "target", "rel", "lag")).alias("links"))
    return n.join(k, "project_id", "left").select("project_id", F.transform("n", lambda x: x["n"]).alias("nodes"), "links")


def overridden(config, raw: dict, bounds: dict[str, tuple[float, float]]):
    """A dataclass instance with values of a request put in; ValueError names the field that isn't one, has another type (a bool is no number,
    a float no int) or lies outside its bounds."""
    kinds = {f.name: type(getattr(config, f.name)) for f in fields(config)}
    out = {}
    for name, value in raw.items():
        if name not in kinds:
            raise ValueError(f"{name}: no such option")
        kind = kinds[name]
        if kind is float and isinstance(value, int) and not isinstance(value, bool):
            value = float(value)
        if type(value) is not kind or value != value:
            raise ValueError(f"{name}: {kind.__name__} wanted")
        low, high = bounds.get(name, (None, None))
        if low is not None and not low <= value <= high:
            raise ValueError(f"{name}: between {low} and {high}")
        out[name] = value
    return replace(config, **out)
