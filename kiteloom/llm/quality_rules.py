"""Quality rules: a threshold table compiled into one projection.

``measures`` adds the figures, ``compile_rules`` turns rows of RULES into
Boolean columns, ``judge`` applies both. Everything is built-in expressions over
one row at a time: no exchange, no user function, and memory for one text.

Defined results: a null or empty text has zero words, fails the base rule and is
not kept. Repeated rows are judged alike and each stays. Extra columns are
carried along by ``judge``; its own columns replace columns of the same name.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kiteloom.llm.common import GAP_CHARS, WORD_GAP

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Frequent function words of four languages.
STOP_WORDS = (
    "the of and to in a is that it for on with as was are be this by from or an at "
    "der die das und in den von zu mit ist im für nicht ein eine auf dem des sich "
    "le la les de des et un une du en que qui dans pour par sur au avec "
    "el la los las de del y en que un una con por para se su al no"
).split()

#: Bits of a packed key that hold a position; longer texts take the exact path.
POS_BITS = 20


@dataclass(frozen=True)
class Rule:
    """Reject where measure ``numerator`` / ``denominator`` is beyond ``limit``."""

    name: str
    numerator: str
    denominator: str | None
    op: str  # "<" or ">": the side that is rejected
    limit: float


RULES: tuple[Rule, ...] = (
    Rule("few_words", "n_words", None, "<", 50),
    Rule("many_words", "n_words", None, ">", 200_000),
    Rule("short_words", "word_chars", "n_words", "<", 2.0),
    Rule("long_words", "word_chars", "n_words", ">", 14.0),
    Rule("symbol_words", "n_symbols", "n_words", ">", 0.20),
    Rule("shouting", "n_marks", "n_words", ">", 0.30),
    Rule("dup_lines", "n_dup_lines", "n_lines", ">", 0.60),
    Rule("bullet_lines", "n_bullet_lines", "n_lines", ">", 0.90),
    Rule("ellipsis_lines", "n_ellipsis_lines", "n_lines", ">", 0.30),
    Rule("few_stop_words", "n_stop_words", None, "<", 2),
)


def _repeat_words() -> Column:
    """Words covered by 3-word windows found twice or more, from columns words and keys.

    keys is the sorted array of (44 bits of a window's hash, 20 bits of its
    place). Neighbours with equal hash bits are compared word by word; should two
    different windows ever share their bits, the exact path decides.
    """
    return F.expr(
        f"""
        CASE WHEN n_words < 3 THEN 0L
        WHEN n_words > {1 << POS_BITS} OR exists(
            sequence(1, greatest(size(keys) - 1, 1)),
            i -> size(keys) > 1 AND i < size(keys)
              AND shiftright(keys[i], {POS_BITS}) = shiftright(keys[i - 1], {POS_BITS})
              AND NOT (words[int(keys[i] & {(1 << POS_BITS) - 1})] = words[int(keys[i - 1] & {(1 << POS_BITS) - 1})]
                   AND words[int(keys[i] & {(1 << POS_BITS) - 1}) + 1] = words[int(keys[i - 1] & {(1 << POS_BITS) - 1}) + 1]
                   AND words[int(keys[i] & {(1 << POS_BITS) - 1}) + 2] = words[int(keys[i - 1] & {(1 << POS_BITS) - 1}) + 2]))
        THEN {_exact_path()}
        ELSE aggregate(
            array_sort(transform(
                filter(keys, (k, i) ->
                    (i > 0 AND shiftright(keys[greatest(i - 1, 0)], {POS_BITS}) = shiftright(k, {POS_BITS}))
                    OR (i + 1 < size(keys) AND shiftright(keys[least(i + 1, size(keys) - 1)], {POS_BITS}) = shiftright(k, {POS_BITS}))),
                k -> int(k & {(1 << POS_BITS) - 1}))),
            named_struct('last', -3, 'n', 0L),
            (a, p) -> named_struct('last', p, 'n', a.n + least(3, p - a.last)),
            a -> a.n)
        END
        """
    )


def _exact_path() -> str:
    """The same count by sorting whole windows with their places."""
    return """
        aggregate(
          array_sort(flatten(transform(
            array(array_sort(transform(sequence(0, n_words - 3),
                i -> named_struct('w', array(words[i], words[i + 1], words[i + 2]), 'p', int(i))))),
            s -> transform(filter(s, (x, i) ->
                (i > 0 AND s[greatest(i - 1, 0)].w = x.w)
                OR (i + 1 < size(s) AND s[least(i + 1, size(s) - 1)].w = x.w)), x -> x.p)))),
          named_struct('last', -3, 'n', 0L),
          (a, p) -> named_struct('last', p, 'n', a.n + least(3, p - a.last)),
          a -> a.n)
    """


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the columns that rules read."""
    whole = F.coalesce(F.col(text), F.lit(""))
    bare = F.expr(f"trim(BOTH '{GAP_CHARS}' FROM coalesce(`{text}`, ''))")
    words = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, WORD_GAP))
    full = lambda line: line.rlike("[^\\x20\\x09-\\x0D]")
    lines = F.filter(F.split(whole, "\n"), full)
    tagged = docs.withColumns({"words": words, "full_lines": lines})
    sized = tagged.withColumn("n_words", F.size("words"))
    keyed = sized.withColumn(
        "keys",
        F.expr(
            f"""
            sort_array(transform(
                CASE WHEN n_words >= 3 AND n_words <= {1 << POS_BITS} THEN sequence(0, n_words - 3) ELSE array() END,
                i -> shiftleft(xxhash64(words[i], words[i + 1], words[i + 2]), {POS_BITS}) | i))
            """
        ),
    )
    symbols = F.length(whole) - F.length(F.translate(whole, SYMBOLS, ""))
    marks = F.length(whole) - F.length(F.translate(whole, "!", ""))
    stop = F.array(*[F.lit(w) for w in dict.fromkeys(STOP_WORDS)])
    return keyed.withColumns(
        {
            "word_chars": F.length(F.array_join("words", "")).cast("long"),
            "n_symbols": symbols.cast("long"),
            "n_marks": marks.cast("long"),
            "n_lines": F.size("full_lines").cast("long"),
            "n_dup_lines": (F.size("full_lines") - F.size(F.array_distinct("full_lines"))).cast("long"),
            "n_bullet_lines": F.size(F.filter("full_lines", lambda x: x.rlike("^[\\x20\\x09]*[-*•]"))).cast("long"),
            "n_ellipsis_lines": F.size(F.filter("full_lines", lambda x: x.rlike("(\\.\\.\\.|…)[\\x20\\x09\\r]*$"))).cast("long"),
            "n_stop_words": F.size(F.array_intersect("words", stop)).cast("long"),
            "n_repeat_words": _repeat_words(),
        }
    ).withColumn("n_words", F.col("n_words").cast("long"))


def compile_rules(rules: Sequence[Rule]) -> Column:
    """Names of the rules that reject a row, in the table's order, as one array column.

    A ratio is compared as numerator against limit * denominator, so that a zero
    denominator never divides.
    """
    found = []
    for r in rules:
        bound = F.lit(float(r.limit)) * (F.col(r.denominator) if r.denominator else F.lit(1))
        value = F.col(r.numerator).cast("double")
        found.append(F.when(value < bound if r.op == "<" else value > bound, F.lit(r.name)))
    return F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


MEASURES = ("n_words", "word_chars", "n_symbols", "n_marks", "n_lines", "n_dup_lines", "n_bullet_lines", "n_ellipsis_lines", "n_stop_words", "n_repeat_words")
VERDICT = ("base_failed", "failed_rules", "kept")


def judge(docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text") -> DataFrame:
    """``docs`` with MEASURES and VERDICT, which replace columns of those names; all others stay."""
    # the row is packed, so that what measures work with can't clash with its columns
    packed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[text].alias("text"))
    seen = measures(packed, "text").withColumns({"base_failed": base_failed(), "failed_rules": compile_rules(rules)})
    told = seen.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))
    return told.select(*[F.col("row")[c].alias(c) for c in docs.columns if c not in MEASURES + VERDICT], *MEASURES, *VERDICT)


def reject(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """The rows of ``docs`` that every rule keeps, with their own columns only."""
    packed = docs.select(F.struct(*docs.columns).alias("row"), F.col("text").alias("text"))
    # a filter on kept would be pushed below and repeat every measure; a generator stays above
    return judge(packed, rules).select(F.inline(F.when(F.col("kept"), F.array("row"))))


RESULT = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed_rules")


def report(docs: DataFrame) -> DataFrame:
    return judge(docs.select("doc_id", "text")).select(*RESULT)
