"""Puzzles as rows: letter ciphers, and arrangements on a line whose answer must be unique."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cipher_values(word: Column, rule: Column, k: Column) -> Column:
    """A number a letter of the word, by its place p in the alphabet (A is 1, either case).

    Rules: shift p + k, reverse 27 - p, double 2p, reverse_shift 27 - p + k. Other
    characters are passed over; an unknown rule gives null.
    """
    letters = F.regexp_extract_all(F.upper(word), F.lit("[A-Z]"), F.lit(0))

    def value(letter: Column) -> Column:
        p = F.ascii(letter) - 64
        return F.when(rule == "shift", p + k).when(rule == "reverse", 27 - p).when(rule == "double", p * 2).when(rule == "reverse_shift", 27 - p + k)

    known = rule.isin("shift", "reverse", "double", "reverse_shift")
    return F.when(known, F.transform(letters, value))


def cipher_code(values: Column, mode: Column) -> Column:
    """The numbers joined by hyphens ("sequence") or their sum ("sum"), as text."""
    total = F.aggregate(values, F.lit(0).cast("long"), lambda a, v: a + v)
    return F.when(mode == "sum", total.cast("string")).when(mode == "sequence", F.array_join(values.cast("array<string>"), "-"))


#: A clue about points given by their places in ``names``. dist: |a - b| = d; between: a lies
#: strictly between b and c; more: |a - b| = |c - e| + d.
CLUE = "struct<kind: string, a: int, b: int, c: int, e: int, d: int>"


def _holds(clue: Column, at) -> Column:
    gap = lambda x, y: F.abs(at(clue[x]) - at(clue[y]))
    between = (at(clue["a"]) > F.least(at(clue["b"]), at(clue["c"]))) & (at(clue["a"]) < F.greatest(at(clue["b"]), at(clue["c"])))
    return F.when(clue["kind"] == "dist", gap("a", "b") == clue["d"]).when(clue["kind"] == "between", between).when(clue["kind"] == "more", gap("a", "b") == gap("c", "e") + clue["d"])


def arrangement_answers(puzzles: DataFrame, key: str, most: int = 6) -> DataFrame:
    """``key``, layouts and answer: how many layouts meet a puzzle's clues, and the distance of
    its ``asked`` pair where all of them agree on it, else null.

    ``puzzles``: points (their number, ``most`` at most), span, clues (array of CLUE) and
    asked (two places). A layout puts the points at distinct whole places from 0 to the
    span, both of which are taken: every ordering with every way of gaps. Points are placed
    one after the other, and a layout goes as soon as a clue whose points all stand fails,
    so clues prune the search. A puzzle's layouts stay in its partition until they are
    counted; puzzles without any are absent, and so are those whose clues name other points.
    """
    last = lambda c: F.greatest(c["a"], c["b"], F.coalesce(c["c"], F.lit(0)), F.coalesce(c["e"], F.lit(0)))
    fine = (F.col("points").between(1, most)) & F.forall("clues", lambda c: last(c) < F.col("points"))
    held = puzzles.filter(fine).select(key, "points", "span", "clues", "asked", F.array().cast("array<int>").alias("places"))
    for i in range(most):
        more = F.col("points") > i
        place = F.explode(F.when(more, F.sequence(F.lit(0), F.col("span"))).otherwise(F.array(F.lit(-1))))
        tried = held.withColumn("place", place).filter(~more | ~F.array_contains("places", F.col("place")))
        stood = tried.withColumn("places", F.when(more, F.concat("places", F.array("place"))).otherwise(F.col("places"))).drop("place")
        at = lambda x: F.get(F.col("places"), x)
        held = stood.filter(F.forall("clues", lambda c: (last(c) != i) | _holds(c, at)))  # noqa: B023
    whole = held.filter((F.array_min("places") == 0) & (F.array_max("places") == F.col("span")))
    answer = F.abs(F.get("places", F.get("asked", F.lit(0))) - F.get("places", F.get("asked", F.lit(1))))
    found = whole.groupBy(key).agg(F.count(F.lit(1)).alias("layouts"), F.min(answer).alias("low"), F.max(answer).alias("high"))
    return found.select(key, "layouts", F.when(F.col("low") == F.col("high"), F.col("low")).alias("answer"))


# Figures whose four symbols stand at the top, left, right and bottom -------------------------------


def turned(figure: Column, clockwise: Column) -> Column:
    """The figure after a quarter turn of its symbols."""
    top, left, right, bottom = (F.get(figure, F.lit(i)) for i in range(4))
    return F.when(clockwise, F.array(left, bottom, top, right)).otherwise(F.array(right, top, bottom, left))


def turned_series(start: Column, clockwise: Column, n: int) -> Column:
    """``n`` figures, each a quarter turn after the one before."""
    steps = F.sequence(F.lit(2), F.lit(n))
    return F.aggregate(steps, F.array(start), lambda out, _: F.concat(out, F.array(turned(F.element_at(out, -1), clockwise))))


def exchanged(items: Column, i: Column, j: Column) -> Column:
    """The array with two of its places (from 0) exchanged."""
    return F.transform(items, lambda x, k: F.when(k == i, F.get(items, j)).when(k == j, F.get(items, i)).otherwise(x))


def restoring_swaps(shown: Column, truth: Column) -> Column:
    """All pairs of places (i < j, from 0) whose exchange turns ``shown`` into ``truth``, by trying each."""
    places = F.sequence(F.lit(0), F.size(shown) - 1)
    pairs = F.flatten(F.transform(places, lambda i: F.transform(F.filter(places, lambda j: j > i), lambda j: F.struct(i.alias("i"), j.alias("j")))))
    return F.filter(pairs, lambda p: exchanged(shown, p["i"], p["j"]) == truth)
