"""Tables that several jobs read: written once to the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset on a local master, a temporary one, set once."""
    if found := spark.sparkContext.getCheckpointDir():
        return found
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        spark.sparkContext.setCheckpointDir(folder)
    elif spark.sparkContext.master.startswith("local["):
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="gristmill-"))
    else:
        raise ValueError("spark.checkpoint.dir is not set: on a cluster it must name a folder that driver and executors share")
    return spark.sparkContext.getCheckpointDir()


def held(df: DataFrame) -> DataFrame:
    """df computed once and written, so later jobs read it, also after executors are lost."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """held for wide tables, written as Parquet: a later job reads only the columns it needs."""
    path = f"{shared_dir(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
