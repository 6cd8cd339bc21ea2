"""Ranks and running totals within groups of any size, without one task that sees a group.

A group may hold most of the rows. Ranks count rows of ranges of the whole order first
and then within a range; totals over a dense place count blocks of places first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kiteloom.llm.common import stage

#: Places of one block of a group.
BLOCK = 1024


def rank_within(df: DataFrame, group: str, order: Sequence[str], name: str, label: str) -> DataFrame:
    """Add ``name``: a row's place (from 0) within its ``group`` (not null), in ascending ``order``, nulls first.

    Rows that agree in ``order`` get places of their own in any order. Rows are dealt by
    range and written once with their range's number, so that both passes see the same
    ranges; a range holds a part of a large group or many small ones.
    """
    rows = stage(df.repartitionByRange(group, *order).withColumn("_range", F.spark_partition_id()), label)
    before = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(group, "_range").agg(F.count(F.lit(1)).alias("_n"))
    starts = counts.select(group, "_range", F.sum("_n").over(before).alias("_start")).filter("_start IS NOT NULL")  # few: groups that go on
    inside = F.row_number().over(Window.partitionBy("_range", group).orderBy(*order)) - 1
    ranked = rows.withColumn("_inside", inside).join(starts, ["_range", group], "left")
    return ranked.select(*df.columns, (F.coalesce("_start", F.lit(0)) + F.col("_inside")).cast("long").alias(name))


def running(df: DataFrame, group: str, place: str, totals: dict[str, tuple[str, Column]], back: bool = False) -> DataFrame:
    """Add running totals over the dense places (from 0) of a ``group``, this row included.

    ``totals``: new column -> ("sum" or "bit_xor", value, a long that isn't null).
    ``back``: run from the last place to the first.
    """
    function = {"sum": F.sum, "bit_xor": F.bit_xor}
    join = {"sum": lambda a, b: a + b, "bit_xor": lambda a, b: a.bitwiseXOR(b)}
    turn = (lambda c: F.col(c).desc()) if back else F.col
    rows = df.withColumns({"_block": F.floor(F.col(place) / BLOCK)} | {f"_v{i}": value for i, (_, value) in enumerate(totals.values())})
    inside = Window.partitionBy(group, "_block").orderBy(turn(place)).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(group).orderBy(turn("_block")).rowsBetween(Window.unboundedPreceding, -1)
    kinds = [kind for kind, _ in totals.values()]
    blocks = rows.groupBy(group, "_block").agg(*[function[k](f"_v{i}").alias(f"_b{i}") for i, k in enumerate(kinds)])
    starts = blocks.select(group, "_block", *[function[k](f"_b{i}").over(before).alias(f"_s{i}") for i, k in enumerate(kinds)]).filter("_s0 IS NOT NULL")
    within = rows.withColumns({f"_r{i}": function[k](f"_v{i}").over(inside) for i, k in enumerate(kinds)}).join(starts, [group, "_block"], "left")
    return within.select(*df.columns, *[join[k](F.col(f"_r{i}"), F.coalesce(f"_s{i}", F.lit(0).cast("long"))).alias(name) for i, (name, k) in enumerate(zip(totals, kinds, strict=True))])
