"""Tables written in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only in local mode, where none need be set."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return (found or tempfile.mkdtemp(prefix="kiteloom-")).rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def published(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet and read back: readers see all of it or nothing.

    Spark's committer moves a job's files into place when all its tasks are done.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
