"""Structured Streaming over append-only logs: resume by key, event-time counts with late data (an extension)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.sources.held import shared_dir


def hourly_counts(events: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """Distinct events (by id and time) per hour and type; events later than the watermark are dropped in a stream."""
    rows = events.select(F.col("ts").cast("timestamp").alias("ts"), "event_id", "event_type").withWatermark("ts", watermark)
    rows = rows.dropDuplicates(["event_id", "ts"])
    return rows.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("hour"), "event_type", "n")


def run_once(spark: SparkSession, path: str, schema, build, name: str, checkpoint: str | None = None) -> DataFrame:
    """Runs a streaming aggregation over all files now present (availableNow) and returns its result, a table in the shared folder that each batch replaces; the driver holds no rows."""
    out = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    result = build(spark.readStream.schema(schema).parquet(path))
    writer = result.writeStream.outputMode("complete").trigger(availableNow=True).foreachBatch(lambda rows, _: rows.write.mode("overwrite").parquet(out))
    writer.option("checkpointLocation", checkpoint or f"{out}-checkpoint").start().awaitTermination()
    return spark.read.schema(result.schema).parquet(out)


def resume(schedule: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """What is still to do; a key done twice is an error, not a choice."""
    if twice := done.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").head():
        raise ValueError(f"done twice: {tuple(twice)[:-1]}")
    return schedule.join(done.select(*keys), keys, "left_anti")


def progress(done: DataFrame, expected: int) -> DataFrame:
    """Observed and expected rows of a log that is being written."""
    return done.agg(F.count(F.lit(1)).alias("observed")).withColumn("expected", F.lit(expected).cast("long")).withColumn("complete", F.col("observed") >= expected)
