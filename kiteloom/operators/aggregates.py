"""Aggregations: conditional counts, medians, shares and roll-ups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DAMAGE_LIMIT = 0.02
FRAGMENT_LIMIT = 0.40


def corpus_health(
    docs: DataFrame,
    by: str,
    detectors: dict[str, Column],
    damage: Sequence[str],
    fragments: str,
) -> DataFrame:
    """Rows and detector hits per group, with an unhealthy flag.

    A group is flagged when its damage detectors together hit more than 2 % of
    its rows, or the fragment detector more than 40 %. One map-side combined
    aggregation; order is left to the caller.
    """
    counted = docs.groupBy(by).agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(cond).alias(name) for name, cond in detectors.items()],
    )
    total = F.greatest(F.col("total"), F.lit(1)).cast("double")
    hits = sum((F.col(n) for n in damage[1:]), F.col(damage[0]))
    return counted.withColumn(
        "flagged",
        (hits / total > DAMAGE_LIMIT) | (F.col(fragments) / total > FRAGMENT_LIMIT),
    )


def bucket_medians(df: DataFrame, bucket: str, value: Column, count: bool = False) -> DataFrame:
    """Median (cut to an integer) of the parsed values per bucket; blank buckets are "(none)".

    Rows without a value are left out.
    """
    name = F.when(F.trim(F.coalesce(F.col(bucket).cast("string"), F.lit(""))) == "", "(none)").otherwise(F.col(bucket).cast("string"))
    rows = df.select(name.alias("bucket"), value.alias("v")).filter("v IS NOT NULL")
    return rows.groupBy("bucket").agg(F.median("v").cast("long").alias("median"), *[F.count(F.lit(1)).alias("n")] * count)


def engagement(*parts: Column) -> Column:
    """Sum of the parts with null as 0; null only where all are null."""
    none = parts[0].isNull()
    for p in parts[1:]:
        none &= p.isNull()
    total = F.lit(0)
    for p in parts:
        total = total + F.coalesce(p, F.lit(0))
    return F.when(~none, total)


def share_against_target(df: DataFrame, by: str, targets: DataFrame, slack: float = 0.10) -> DataFrame:
    """Count and share of each value, its target, and whether it is off by over ``slack``."""
    counts = df.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))  # one row
    both = counts.join(targets, by, "full_outer").crossJoin(F.broadcast(total))
    share = F.coalesce("n", F.lit(0)) / F.greatest(F.col("total"), F.lit(1))
    return both.select(by, F.coalesce("n", F.lit(0)).alias("n"), share.alias("share"), "target", (F.abs(share - F.col("target")) > slack).alias("off_target"))


def safe_ratio(n: Column, d: Column) -> Column:
    """n / d, and 0 where d is 0 or null."""
    return F.when(F.coalesce(d, F.lit(0)) == 0, F.lit(0.0)).otherwise(n / d)


def review_summary(rows: DataFrame, paper: str, question: str) -> DataFrame:
    """paper, total, flagged and the flagged questions, a row each; a null one for a paper without.

    A question is flagged by its own ``flag``, or with neither sources nor a solution
    (``no_sources``, ``no_solution``); papers with an ``official`` key have none.
    """
    flagged = ~F.col("official") & (F.col("flag") | (F.col("no_sources") & F.col("no_solution")))
    told = rows.select(paper, question, F.coalesce(flagged, F.lit(False)).alias("flagged"))
    totals = told.groupBy(paper).agg(F.count(F.lit(1)).alias("total"), F.count_if("flagged").alias("flagged"))
    return totals.join(told.filter("flagged").select(paper, question), paper, "left").select(paper, "total", "flagged", question)
