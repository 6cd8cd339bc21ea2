"""Seeded blocks of generated questions, each type an expression over drawn numbers.

A block's slots get their types in shuffled rounds. Each slot draws TRIES questions from
its seed, and takes the first whose stem the slots before it have not taken: acceptance
by the keys slot and stem, in rounds over all blocks at once. Draws come from md5, so any
engine and any partitioning gives equal rows.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kiteloom.operators import folds, planning, puzzles, sequences
from kiteloom.sources.stages import published

TRIES = 12
WORDS = ("RIVER", "STONE", "MAPLE", "CLOUD", "BRIDGE", "LANTERN", "HARVEST", "COPPER", "MEADOW", "ANCHOR", "PEBBLE", "QUARRY")
RULES = ("add", "multiply", "squares", "alternate")
CIPHERS = ("shift", "reverse", "double", "reverse_shift")
SYMBOLS = ("circle", "square", "triangle", "plus")


def drawn(key: Column, nth: int, low: int, high: int) -> Column:
    """A number in low..high from md5 of the key and ``nth``."""
    bits = F.conv(F.substring(F.md5(F.concat_ws("|", key, F.lit(str(nth)))), 1, 8), 16, 10).cast("long")
    return (bits % (high - low + 1) + low).cast("int")


def _pick(items: tuple[str, ...], i: Column) -> Column:
    return F.get(F.array(*map(F.lit, items)), i)


def _text(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _once(value: Column, f) -> Column:
    """``f`` of a value that is computed once, however often ``f`` uses it, also in lambdas."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


class Kind(NamedTuple):
    """A type of question: the numbers drawn from a key, and stem and answer from these."""

    drawn: Callable[[Column], dict[str, Column]]
    stem: Callable[[Column], Column]
    answer: Callable[[Column], Column]

    def of(self, key: Column, part: Callable[[Column], Column]) -> Column:
        return _once(F.struct(*[v.alias(n) for n, v in self.drawn(key).items()]), part)


def _series() -> Kind:
    term = lambda v, n: planning.series_term(v["rule"], v["first"], v["k"], F.lit(n)).cast("long").cast("string")
    return Kind(
        lambda key: {"rule": _pick(RULES, drawn(key, 0, 0, 3)), "first": drawn(key, 1, 1, 20), "k": drawn(key, 2, 2, 9)},
        lambda v: _text("series: ", F.array_join(F.array(*[term(v, n) for n in range(1, 6)]), ", "), ", ?"),
        lambda v: term(v, 6),
    )


def _coding() -> Kind:
    return Kind(
        lambda key: {"word": _pick(WORDS, drawn(key, 0, 0, len(WORDS) - 1)), "rule": _pick(CIPHERS, drawn(key, 1, 0, 3)), "k": drawn(key, 2, 2, 9)},
        lambda v: _text("code ", v["word"], " by ", v["rule"], " ", v["k"]),
        lambda v: puzzles.cipher_code(puzzles.cipher_values(v["word"], v["rule"], v["k"]), F.lit("sequence")),
    )


def _letter_sum() -> Kind:
    return Kind(
        lambda key: {"one": _pick(WORDS, drawn(key, 0, 0, len(WORDS) - 1)), "two": _pick(WORDS, drawn(key, 1, 0, len(WORDS) - 1))},
        lambda v: _text("sum of letters of ", v["one"], " and ", v["two"]),
        lambda v: puzzles.cipher_code(puzzles.cipher_values(F.concat(v["one"], v["two"]), F.lit("shift"), F.lit(0)), F.lit("sum")),
    )


def _calendar() -> Kind:
    return Kind(lambda key: {"year": drawn(key, 0, 1901, 2060)}, lambda v: _text("next year like ", v["year"]), lambda v: planning.same_calendar(v["year"]).cast("string"))


def _clock() -> Kind:
    return Kind(
        lambda key: {"minutes": drawn(key, 0, 0, 719), "water": drawn(key, 1, 0, 1) == 1},
        lambda v: _text(F.when(v["water"], "water").otherwise("mirror"), " image of ", v["minutes"], " minutes"),
        lambda v: F.when(v["water"], planning.water_clock(v["minutes"])).otherwise(planning.mirror_clock(v["minutes"])).cast("string"),
    )


def _sufficiency() -> Kind:
    def value(v: Column) -> Column:
        found = planning.sole_value([lambda x: x % v["m"] == v["r"], lambda x: x >= v["low"], lambda x: x < v["low"] + v["wide"]])
        return F.coalesce(found.cast("string"), F.lit("not sufficient"))

    return Kind(
        lambda key: {"m": drawn(key, 0, 3, 9), "r": drawn(key, 1, 0, 2), "low": drawn(key, 2, 1, 80), "wide": drawn(key, 3, 4, 12)},
        lambda v: _text("a number from ", v["low"], ", under ", v["low"] + v["wide"], ", that leaves ", v["r"], " by ", v["m"]),
        value,
    )


def _direction() -> Kind:
    legs = lambda v: [(v[f"d{i}"], v[f"n{i}"]) for i in range(4)]
    along = lambda v, plus, minus: sum((F.when(d == plus, n).when(d == minus, -n).otherwise(0) for d, n in legs(v)), F.lit(0)).cast("double")
    return Kind(
        lambda key: {f"d{i}": _pick(("N", "E", "S", "W"), drawn(key, 2 * i, 0, 3)) for i in range(4)} | {f"n{i}": drawn(key, 2 * i + 1, 1, 12) for i in range(4)},
        lambda v: _text("walk ", F.concat_ws(", ", *[_text(d, " ", n) for d, n in legs(v)])),
        lambda v: F.round(F.hypot(along(v, "E", "W"), along(v, "N", "S")), 2).cast("string"),
    )


def _figures() -> Kind:
    def series(v: Column, part: Callable[[Column, Column], Column]) -> Column:
        """``part`` of the figures shown and the true ones."""
        truth = puzzles.turned_series(v["start"], v["clockwise"], 5)
        return _once(truth, lambda t: _once(puzzles.exchanged(t, v["i"], v["j"]), lambda shown: part(shown, t)))

    drawing = lambda shown, t: F.array_join(F.transform(shown, lambda q: F.array_join(q, " ")), " / ")
    swaps = lambda shown, t: F.array_join(F.transform(puzzles.restoring_swaps(shown, t), lambda p: F.concat_ws("-", p["i"].cast("string"), p["j"].cast("string"))), " or ")
    return Kind(
        lambda key: {"start": shuffled_by(F.array(*map(F.lit, SYMBOLS)), key), "clockwise": drawn(key, 1, 0, 1) == 1, "i": drawn(key, 2, 1, 2), "j": drawn(key, 3, 3, 4)},
        lambda v: _text("which two figures are exchanged: ", series(v, drawing)),
        lambda v: series(v, swaps),
    )


def shuffled_by(items: Column, key: Column) -> Column:
    """Items in the order of md5 of the key and their places."""
    keyed = F.transform(items, lambda x, i: F.struct(F.md5(F.concat_ws("|", key, i.cast("string"))).alias("h"), x.alias("x")))
    return F.transform(F.array_sort(keyed), lambda k: k["x"])


TYPES = {"series": _series(), "coding": _coding(), "letter_sum": _letter_sum(), "calendar": _calendar(), "clock": _clock(), "sufficiency": _sufficiency(), "direction": _direction(), "figures": _figures()}


def _by_type(part: str) -> Column:
    """The stem or answer of a row's type, from its seed, slot and try."""
    key = F.concat_ws("|", F.col("seed").cast("string"), F.col("slot").cast("string"), F.col("try").cast("string"))
    chain = F
    for name, kind in TYPES.items():
        chain = chain.when(F.col("type") == name, kind.of(key, getattr(kind, part)))
    return chain


def question_blocks(seeds: DataFrame, count: int) -> DataFrame:
    """seed, slot (from 1), type, stem and answer of ``count`` slots a seed, without repeated stems.

    A slot whose draws have all been taken stays empty, so a block may fall short. All
    tries get their stems, and the accepted ones alone their answers.
    """
    kinds = seeds.select("seed", F.array(*map(F.lit, TYPES)).alias("types"))
    slots = published(sequences.rounds(kinds, "seed", "types", count, 16).withColumnRenamed("place", "slot"), "slots")
    tried = slots.withColumn("try", F.explode(F.sequence(F.lit(0), F.lit(TRIES - 1))))
    order = (F.col("slot") * TRIES + F.col("try")).cast("long")
    made = tried.select("seed", "slot", order.alias("nth"), _by_type("stem").alias("stem"))
    taken = folds.accepted(made, "seed", "nth", ["slot", "stem"]).withColumn("try", F.col("nth") - F.col("slot") * TRIES)
    return taken.join(slots, ["seed", "slot"]).select("seed", "slot", "type", "stem", _by_type("answer").alias("answer"))
