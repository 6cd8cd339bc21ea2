"""What the training-data operators share: table scans and stage tables.

A stage table is a Parquet table in the folder that the session names in
spark.checkpoint.dir. It cuts lineage, is read by every executor and survives
the loss of any of them. Only in local mode (tests, a notebook) may that setting be
absent; a folder under the system's temporary folder is used then.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Word separators: space, tab, newline, vertical tab, form feed, carriage return.
WORD_GAP = "[\\x20\\x09-\\x0D]+"
GAP_CHARS = " \t\n\x0b\x0c\r"
#: Rows of an Arrow batch: whole texts of some 100 kB each stay under 100 MB.
BATCH_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Lower the session's Arrow batch size to ``rows`` unless it is lower already.

    The setting stays lowered: results are lazy, and it counts when they run.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not found:
        found = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = getattr(shared_dir, "own", "") or tempfile.mkdtemp(prefix="kiteloom-")
        shared_dir.own = found
    return found.rstrip("/")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a stage table and read it back."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
