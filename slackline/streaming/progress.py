"""Progress as a stream: windowed sums with late data, and the last value of each project."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def events(spark: SparkSession, path: str) -> DataFrame:
    """A file stream of progress events with their time as a timestamp."""
    return spark.readStream.schema(EVENTS).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def windowed(stream: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Count and sum of each type in each window; windows end when the watermark passes them, and
    their state goes. An event is counted once: its id is remembered until the watermark passes it."""
    once = stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    g = once.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "total")


def run_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Process what is there (the watermark's last step included), exactly once, into a parquet sink."""
    q = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def upsert_latest(stream: DataFrame, key: str, path: str, checkpoint: str) -> DataFrame:
    """The last event of each key. Each micro-batch leaves its own last events (one row for a key) in a folder
    named by its number, so a repeated batch overwrites its own; readers take the last over all."""

    def keep(batch: DataFrame, number: int) -> None:
        _last(batch, key).write.mode("overwrite").parquet(f"{path}/batch={number}")

    q = stream.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return _last(stream.sparkSession.read.parquet(path).drop("batch"), key)


def _last(df: DataFrame, key: str) -> DataFrame:
    others = [c for c in ("ts", "event_id", "event_type", "value") if c != key]
    return df.groupBy(key).agg(F.max(F.struct(*others)).alias("r")).select(key, "r.*")
