"""Row numbers over a whole table without one task that sees it all."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kiteloom.sources.stages import published


def global_rank(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """Add ``name``: a row's place (from 1) in ascending ``order``, which must be unique.

    Rows are dealt by range and written once with their range's number, so that both
    passes over them see the same ranges. A range's first place is the sum of the
    counts before it, a row a range; within one, a window counts on.
    """
    rows = published(df.repartitionByRange(*order).withColumn("range_no", F.spark_partition_id()), "ranges")
    before = Window.orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    starts = rows.groupBy("range_no").agg(F.count(F.lit(1)).alias("n")).select("range_no", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = F.row_number().over(Window.partitionBy("range_no").orderBy(*order))
    ranked = rows.withColumn("inside", inside).join(F.broadcast(starts), "range_no")
    return ranked.select(*df.columns, (F.col("start") + F.col("inside")).alias(name))


def rank_within(df: DataFrame, by: str, order: Sequence[str], name: str) -> DataFrame:
    """Add ``name``: a row's place (from 1) within its ``by`` (not null), by the unique ascending ``order``.

    For few large groups: a window over them would be one task each. A group's first place
    of all is one row a group to join.
    """
    ranked = global_rank(df, [by, *order], "_place")
    firsts = ranked.groupBy(by).agg(F.min("_place").alias("_first"))
    return ranked.join(firsts, by).select(*df.columns, (F.col("_place") - F.col("_first") + 1).alias(name))


def running_within(df: DataFrame, by: str, order: Sequence[str], value: str, name: str, block: int = 4096) -> DataFrame:
    """Add ``name``: the running sum of ``value`` within ``by``, this row included, in the unique ``order``.

    Rows are summed by blocks of places first and then within a block, so that no task
    holds a group; a group's block sums are one window.
    """
    placed = rank_within(df, by, order, "_nth").withColumn("_block", F.floor((F.col("_nth") - 1) / block))
    before = Window.partitionBy(by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy(by, "_block").agg(F.sum(value).alias("_sum")).select(by, "_block", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    inside = F.sum(value).over(Window.partitionBy(by, "_block").orderBy("_nth").rowsBetween(Window.unboundedPreceding, 0))
    return placed.withColumn("_inside", inside).join(sums, [by, "_block"]).select(*df.columns, (F.col("_before") + F.col("_inside")).alias(name))
