"""Structured Streaming versions of the event-driven operators.

Each function takes and returns a streaming DataFrame; ``drain`` runs a bounded
stream to its end into a Parquet table, for parity with the batch version. Event time
is a timestamp (session zone UTC), since watermarks need that type; rows later than
``LATENESS`` are dropped.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LATENESS = "1 hour"


def read_events(spark: SparkSession, path: str, per_trigger: int | None = None) -> DataFrame:
    """A stream over Parquet files of events, with ts as a timestamp."""
    known = spark.read.parquet(path)
    reader = spark.readStream.schema(known.schema)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    folder, _, name = path.rstrip("/").rpartition("/")
    if any(f.endswith(f"/{name}") for f in known.inputFiles()):  # a file: a stream reads folders
        reader, path = reader.option("pathGlobFilter", name), folder
    rows = reader.parquet(path)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def accepted(events: DataFrame, ignored: tuple[str, ...] = ("error",)) -> DataFrame:
    """Rows of categories that aren't ignored, with a flag for the positive ones."""
    return events.filter(~F.col("event_type").isin(*ignored)).withColumn("positive", F.col("event_type").isin("purchase", "signup"))


def daily_counts(events: DataFrame) -> DataFrame:
    """Rows and value by day and type."""
    late = events.withWatermark("ts", LATENESS)
    return late.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))


def sliding_counts(events: DataFrame) -> DataFrame:
    """Rows by type in windows of 15 minutes every 5 minutes."""
    late = events.withWatermark("ts", LATENESS)
    return late.groupBy(F.window("ts", "15 minutes", "5 minutes").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))


def once(events: DataFrame, key: str = "event_id") -> DataFrame:
    """The first row of each key within the watermark: re-seen polls count once."""
    return events.withWatermark("ts", LATENESS).dropDuplicatesWithinWatermark([key])


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Rows of each user's sessions; one ends after ``gap`` without a row."""
    late = events.withWatermark("ts", LATENESS)
    return late.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))


def clamped_counters(events: DataFrame, delta: str) -> DataFrame:
    """user_id and its counter, which never goes below zero, after each trigger's rows.

    The state of a user is its counter. Rows of a trigger are taken in order of time, by a
    sort of two numbers a row; a user's rows of one trigger are held, texts are not.
    """

    def step(key, frames, state):
        held = [(f["ts"].to_numpy(), f["event_id"].to_numpy(), f[delta].to_numpy()) for f in frames]
        ts, ids, deltas = (np.concatenate(c) for c in zip(*held, strict=True))
        steps = np.concatenate([[state.get[0] if state.exists else 0], deltas[np.lexsort((ids, ts))]]).cumsum()
        value = int(steps[-1] - min(0, steps.min()))
        state.update((value,))
        yield pd.DataFrame({"user_id": [key[0]], "value": [value]})

    out = T.StructType([T.StructField("user_id", T.LongType()), T.StructField("value", T.LongType())])
    own = T.StructType([T.StructField("value", T.LongType())])
    rows = events.select("user_id", "ts", "event_id", delta)
    return rows.groupBy("user_id").applyInPandasWithState(step, out, own, "update", "NoTimeout")


class KeyedSink:
    """A table in which a stream's rows overwrite those of the same ``keys``.

    A trigger's rows are the partition of its epoch, which a replay writes again in whole,
    and a key's row is that of its latest epoch: replaying any trigger, once or often, late
    or not, changes nothing. ``compact`` folds the epochs into one.
    """

    def __init__(self, folder: str, keys: list[str]):
        self.folder, self.keys = folder, keys

    def write(self, batch: DataFrame, epoch: int) -> None:
        """For foreachBatch; a trigger has one row a key."""
        batch.write.mode("overwrite").parquet(f"{self.folder}/epoch={epoch}")

    def read(self, spark: SparkSession) -> DataFrame:
        rows = spark.read.parquet(self.folder)
        values = [c for c in rows.columns if c not in (*self.keys, "epoch")]
        latest = rows.groupBy(*self.keys).agg(F.max_by(F.struct(*values), "epoch").alias("latest"))
        return latest.select(*self.keys, *[F.col(f"latest.{v}").alias(v) for v in values])

    def compact(self, spark: SparkSession, folder: str) -> KeyedSink:
        """The same rows as one epoch, the latest, of a new table."""
        last = spark.read.parquet(self.folder).agg(F.max("epoch")).first()[0]
        self.read(spark).write.parquet(f"{folder}/epoch={last}")
        return KeyedSink(folder, self.keys)


def late_rows(progress: list) -> int:
    """Rows that came behind the watermark, of the progress reports that ``drain`` gathers."""
    return sum(op.numRowsDroppedByWatermark for p in progress for op in p.stateOperators)


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run(stream: DataFrame, folder: str, mode: str, keep: Callable[[DataFrame, int], None], timers: bool = False, progress: list | None = None) -> None:
    """Run a bounded stream to its end, with ``keep`` for each trigger.

    ``timers``: operators with timers need another state store, set while the query starts.
    ``progress`` gets the reports of all triggers.
    """
    spark, key = stream.sparkSession, "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    if timers:
        spark.conf.set(key, ROCKSDB)
    try:
        query = stream.writeStream.outputMode(mode).option("checkpointLocation", folder).trigger(availableNow=True).foreachBatch(keep).start()
        query.awaitTermination()
    finally:
        if timers:
            spark.conf.set(key, before) if before else spark.conf.unset(key)
    if progress is not None:
        progress.extend(query.recentProgress)


def drain(stream: DataFrame, folder: str, mode: str = "append", timers: bool = False, progress: list | None = None) -> DataFrame:
    """The rows of a bounded stream run to its end: of the last trigger in complete mode, else of all."""
    spark = stream.sparkSession
    name = f"{folder}/{uuid.uuid4().hex}"
    run(stream, f"{name}/state", mode, lambda batch, epoch: batch.write.mode("overwrite").parquet(f"{name}/rows/epoch={epoch}"), timers, progress)
    rows = spark.read.parquet(f"{name}/rows")
    if mode == "complete":
        last = rows.agg(F.max("epoch")).first()[0]
        rows = rows.filter(F.col("epoch") == last)
    return rows.drop("epoch") if mode != "update" else rows


def upserted(stream: DataFrame, folder: str, keys: list[str]) -> DataFrame:
    """The table that a bounded stream in update mode leaves, keyed by ``keys``."""
    name = f"{folder}/{uuid.uuid4().hex}"
    sink = KeyedSink(f"{name}/rows", keys)
    run(stream, f"{name}/state", "update", sink.write)
    return sink.read(stream.sparkSession)
