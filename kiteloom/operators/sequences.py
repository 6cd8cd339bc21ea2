"""Ordered computations: runs, clamped sums, packing folds, plans by rank."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def runs(df: DataFrame, by: Sequence[str], order: Sequence[str], label: str) -> DataFrame:
    """One row a run of equal consecutive labels: its number, label, length and first place."""
    w = Window.partitionBy(*by).orderBy(*order)
    new = (F.row_number().over(w) == 1) | ~F.col(label).eqNullSafe(F.lag(label).over(w))
    tagged = df.withColumns({"new": new.cast("int"), "nth": F.row_number().over(w)})
    tagged = tagged.withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return tagged.groupBy(*by, "run").agg(F.first(label).alias(label), F.count(F.lit(1)).alias("length"), F.min("nth").alias("first"))


def folded_runs(found: DataFrame, by: Sequence[str], label: str, least: int = 2) -> DataFrame:
    """Runs with the label each gets when short ones join the run before; the first stays.

    The test uses a run's own length; the label is that of the last run that stayed.
    """
    w = Window.partitionBy(*by).orderBy("run").rowsBetween(Window.unboundedPreceding, 0)
    own = F.when((F.col("length") >= least) | (F.col("run") == 1), F.col(label))
    return found.withColumn("kept_label", F.last(own, ignorenulls=True).over(w))


def clamped_running_sum(df: DataFrame, by: Sequence[str], order: Sequence[str], delta: str) -> DataFrame:
    """Add ``value``: the counter after each delta, where it never goes below zero.

    With S the running sum, the clamped counter is S - min(0, least S so far).
    """
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("s", F.sum(delta).over(w)).withColumn("value", F.col("s") - F.least(F.lit(0), F.min("s").over(w))).drop("s")


def text_windows(text: Column, size: int, step: int) -> Column:
    """Array of (start, body) of overlapping windows; the last is the first to reach the end."""
    last = F.greatest(F.ceil((F.length(text) - size) / F.lit(float(step))), F.lit(0)).cast("int")
    starts = F.sequence(F.lit(0), last)
    return F.transform(starts, lambda i: F.struct((i * step).alias("start"), text.substr(i * step + 1, F.lit(size)).alias("body")))


def pack_fold(sizes: Column, full: int, flush: int) -> Column:
    """Group numbers of an ordered array of sizes, packed one after the other.

    A group is closed before a size that would take it over ``full``, and after one
    that brings it to ``flush``. A fold over an array, so it stays in the JVM and
    its memory is that of one group of rows.
    """
    start = F.struct(F.lit(0).cast("long").alias("cur"), F.lit(0).alias("g"), F.array().cast("array<int>").alias("out"))

    def add(acc: Column, size: Column) -> Column:
        over = (acc["cur"] > 0) & (acc["cur"] + size > full)
        g = F.when(over, acc["g"] + 1).otherwise(acc["g"])
        cur = F.when(over, size).otherwise(acc["cur"] + size).cast("long")
        done = cur >= flush
        return F.struct(
            F.when(done, F.lit(0).cast("long")).otherwise(cur).alias("cur"),
            F.when(done, g + 1).otherwise(g).alias("g"),
            F.concat(acc["out"], F.array(g)).alias("out"),
        )

    return F.aggregate(sizes, start, add, lambda acc: acc["out"])


def hash_order(seed: int, *columns: str) -> Column:
    """A shuffle that any engine repeats: md5 of "seed|value|value"."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in columns]))


def rounds(groups: DataFrame, by: str, types: str, count: int, seed: int) -> DataFrame:
    """by, place (from 1) and type: all types of a group in turn until ``count`` places are taken.

    Each round is shuffled by itself; where it would begin with the type that the round
    before ended with, its first two change places. A group's types are a short array.
    """
    order = lambda r: F.transform(F.array_sort(F.transform(types, lambda t: F.struct(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(by).cast("string"), r.cast("string"), t)).alias("h"), t.alias("t")))), lambda x: x["t"])

    def add(out: Column, r: Column) -> Column:
        fresh = order(r)
        seam = (F.size(fresh) > 1) & F.coalesce(F.get(fresh, F.lit(0)) == F.try_element_at(out, F.lit(-1)), F.lit(False))
        turned = F.concat(F.slice(fresh, 2, 1), F.slice(fresh, 1, 1), F.slice(fresh, 3, F.size(fresh)))
        return F.concat(out, F.when(seam, turned).otherwise(fresh))

    needed = F.sequence(F.lit(1), F.ceil(F.lit(count) / F.size(types)).cast("int"))
    filled = groups.filter(F.size(types) > 0).select(by, F.aggregate(needed, F.array().cast("array<string>"), add).alias("out"))
    return filled.select(by, F.posexplode(F.slice("out", 1, count)).alias("place", "type")).withColumn("place", F.col("place") + 1)
