"""Resumable scoring: a stream over the planned cases whose batches are written once each, however often the job is stopped."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.sources.files import _fs, write_small


def _batches(spark: SparkSession, out: str, but: str = "") -> DataFrame | None:
    """All finished batches (but one), or None before the first. A batch that was broken off has no completion marker and isn't read."""
    root, fs = _fs(spark, out)
    if not fs.exists(root):
        return None
    done = [str(x.getPath()) for x in fs.listStatus(root) if x.getPath().getName().startswith("batch=") and x.getPath().getName() != but and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(x.getPath(), "_SUCCESS"))]
    return spark.read.option("basePath", out).parquet(*done).drop("batch") if done else None


def scored(spark: SparkSession, out: str) -> DataFrame | None:
    """The finished cases under `out`, None if there are none yet."""
    return _batches(spark, out)


def _name(spark: SparkSession, checkpoint: str) -> str:
    """A name that lives and is lost with the checkpoint, so a new one's batches don't take the place of older ones."""
    path, fs = _fs(spark, f"{checkpoint}/name")
    if not fs.exists(path):
        write_small(spark, f"{checkpoint}/name", uuid.uuid4().hex[:12])
    return spark.read.text(f"{checkpoint}/name").first()[0]


def check_resume(planned: DataFrame, done: DataFrame, key: str, digest: str) -> None:
    """Finished cases must be planned, with the same content, and finished once; anything else is an error that names one."""
    both = done.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min(digest).alias("__a"), F.max(digest).alias("__b")).join(planned.select(key, F.col(digest).alias("__plan")), key, "left")
    reason = F.when(F.col("__plan").isNull(), "isn't planned").when((F.col("__a") != F.col("__plan")) | (F.col("__b") != F.col("__plan")), "has other content").when(F.col("n") > 1, "is finished twice")
    if bad := both.withColumn("reason", reason).where("reason is not null").orderBy(key).head():
        raise ValueError(f"finished case {bad[key]} {bad['reason']}")


def score_stream(spark: SparkSession, cases: str, out: str, checkpoint: str, score: Callable[[DataFrame], DataFrame], *, key: str = "case_id", digest: str = "input_sha256", files_per_batch: int = 1) -> DataFrame:
    """Scores the Parquet files of cases under `cases` to `out`, some files a batch, and returns all finished cases.

    A batch is written to the folder of its checkpoint's name and number and counts once its completion marker is there: a job killed in the middle leaves a torn folder, which the same batch, run again from the
    checkpoint, replaces.  Cases that are finished already (also by an earlier checkpoint that was lost) aren't scored again.  Files that come later are scored by the next call.
    A finished case that the plan lacks, or of other content, stops the job before anything is scored.
    """
    planned = spark.read.parquet(cases)
    before = _batches(spark, out)
    if before is not None:
        check_resume(planned, before, key, digest)

    name = _name(spark, checkpoint)

    def write(rows: DataFrame, number: int) -> None:
        own = f"batch={name}-{number}"
        done = _batches(spark, out, but=own)  # what this batch wrote before it was broken off doesn't count
        if done is not None:
            rows = rows.join(done.select(key), key, "left_anti")
        score(rows).write.mode("overwrite").parquet(f"{out}/{own}")

    stream = spark.readStream.schema(planned.schema).option("maxFilesPerTrigger", files_per_batch).parquet(cases)
    stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    finished = _batches(spark, out)
    return finished if finished is not None else score(planned.limit(0))
