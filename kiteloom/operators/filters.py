"""Filters, first-matching rules and field fallbacks."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def equal_where_given(df: DataFrame, **wanted) -> DataFrame:
    """Rows equal to each wanted value; a wanted value of None is no condition."""
    for name, value in wanted.items():
        if value is not None:
            df = df.filter(F.col(name) == value)
    return df


def any_of(df: DataFrame, column: str, values: Sequence) -> DataFrame:
    """Rows whose column is among the values; no values is no condition."""
    return df.filter(F.col(column).isin(*values)) if values else df


def none_of(df: DataFrame, column: str, values: Sequence) -> DataFrame:
    """Rows whose column is not among the values; no values is no condition."""
    return df.filter(~F.col(column).isin(*values)) if values else df


def first_term(text: Column, terms: Sequence[str]) -> Column:
    """The first term, in the list's order, that the text contains; else null."""
    chain = F.lit(None).cast("string")
    for t in reversed(terms):
        chain = F.when(text.contains(t.lower()), F.lit(t)).otherwise(chain)
    return chain


def qualify(
    df: DataFrame, name: Column, description: Column, keywords: Column,
    name_block: Sequence[str], description_block: Sequence[str], keyword_block: Sequence[str], allow: Sequence[str],
) -> DataFrame:
    """Add ok and reason: block lists in order, then the allow list over name or keywords.

    Substring tests in lower case; the first rule that fits decides, and the first
    term of its list is named.
    """
    low = [F.lower(F.coalesce(c, F.lit(""))) for c in (name, description, keywords)]
    blocked = F.coalesce(
        *[F.concat(F.lit(f"{kind}_blacklist:"), first_term(c, terms)) for kind, c, terms in zip(("name", "desc", "keywords"), low, (name_block, description_block, keyword_block), strict=True)]
    )
    chosen = F.concat(F.lit("whitelist:"), F.coalesce(first_term(low[0], allow), first_term(low[2], allow)))
    return df.withColumns({
        "reason": F.coalesce(blocked, chosen, F.lit("no_match")),
        "ok": blocked.isNull() & chosen.isNotNull(),
    })


def first_truthy(*columns: Column) -> Column:
    """The first string that is neither null nor empty."""
    return F.coalesce(*[F.when(c != "", c) for c in columns])


def follow_up_due(df: DataFrame, cut: Column, skip: Iterable[str], most: int = 3, rows: int = 50) -> DataFrame:
    """Positive replies that are due for another message, newest first.

    A null intent is not due (three-valued logic), a null last message is.
    """
    due = (
        F.col("is_positive") & (F.col("follow_up_count") < most) & (F.col("replied_at") < cut)
        & ~F.col("intent").isin(*skip) & (F.col("last_at").isNull() | (F.col("last_at") < cut))
    )
    return df.filter(due).orderBy(F.desc("replied_at"), F.asc("id")).limit(rows)


def overlaps(low: Column, high: Column, least: Column, most: Column) -> Column:
    """Whether the closed ranges share a value."""
    return (high >= least) & (low <= most)


def all_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def first_failing(rules: Sequence[tuple[str, Column]]) -> Column:
    """Name of the first rule whose condition holds; null where none does."""
    chain = F.lit(None).cast("string")
    for name, fails in reversed(rules):
        chain = F.when(fails, F.lit(name)).otherwise(chain)
    return chain
