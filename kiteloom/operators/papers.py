"""Question papers and book transcripts: questions, options, headings, sections.

A paper is one row. Its lines and segments are arrays and every rule an expression over
them, so nothing is exchanged and no Python runs; a row's memory is that of its paper.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kiteloom.functions import texts

#: The line patterns of question papers.
QUESTION_START = r"^(\d{1,3})\.\s+\S"
ANSWER_LINE = r"^\s*(?:Answer|उत्तर)\s*[-–—:]*\s*\(?\s*([A-Ea-e*])\s*\)?\s*[.।]?\s*$"
FURNITURE = r"^\s*(Show Answer/Hide|Hide Answer|Show Answer)\s*$"
OPTION_LINE = r"^\s*\(\s*[A-Ea-e]\s*\)\s*\S"
#: Answer lines from which on a paper counts as keyed; options, share of the
#: script and characters that make a question; options that complete a block without a key.
KEYED, OPTIONS, SHARE, LEAST, COMPLETE = 5, 2, 0.4, 30, 4
#: Digits of the two scripts, and what ends a line.
DIGITS = ("०१२३४५६७८९", "0123456789")
LINE_END = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x85\\u2028\\u2029]"


def _holds(line: Column, pattern: str) -> Column:
    return line.rlike(f"(?U){pattern}")


def _indices(lines: Column, pattern: str) -> Column:
    """Places (from 0) of the lines that hold the pattern."""
    marked = F.transform(lines, lambda x, i: F.when(_holds(x, pattern), i))
    return F.filter(marked, lambda i: i.isNotNull())


def _cleaned(lines: Column) -> Column:
    """Without furniture, ends of lines stripped, one blank line at most, none outside."""
    kept = F.transform(F.filter(lines, lambda x: ~_holds(x, FURNITURE)), lambda x: F.regexp_replace(x, r"(?U)\s+$", ""))
    return F.regexp_replace(F.regexp_replace(F.array_join(kept, "\n"), "\n{3,}", "\n\n"), "^\n+|\n+$", "")


def _slices(lines: Column, starts: Column, ends: Column) -> Column:
    return F.zip_with(starts, ends, lambda a, b: F.slice(lines, a + 1, b - a))


def _numbered_cuts(lines: Column) -> Column:
    """Places of numbered lines that open a new block: the one before has all its options."""

    def step(held: Column, at: Column) -> Column:
        opens = at["starts"] & (held["options"] >= COMPLETE)
        return F.struct(
            F.when(opens, F.concat(held["cuts"], F.array(at["i"]))).otherwise(held["cuts"]).alias("cuts"),
            (F.when(opens, 0).otherwise(held["options"]) + at["is_option"].cast("int")).alias("options"),
        )

    marks = F.transform(lines, lambda x, i: F.struct(i.alias("i"), _holds(x, QUESTION_START).alias("starts"), _holds(x, OPTION_LINE).alias("is_option")))
    none = F.struct(F.array().cast("array<int>").alias("cuts"), F.lit(0).alias("options"))
    return F.aggregate(marks, none, step, lambda held: held["cuts"])


def segmented(papers: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """keys, segment (from 0), lines and answer: what may hold a question of each paper.

    With at least KEYED answer lines a segment is what stands before each of them and after
    the one before it, so a numbered line within cannot cut it, and what follows the last
    belongs to none. Otherwise a numbered line opens a new one once the one before is complete.
    """
    lines = papers.select(*keys, F.split(F.coalesce(text, F.lit("")), LINE_END).alias("lines"))
    marked = lines.withColumn("ends", _indices(F.col("lines"), ANSWER_LINE))
    keyed = F.size("ends") >= KEYED
    cuts = marked.withColumn("cuts", F.when(keyed, F.col("ends")).otherwise(_numbered_cuts(F.col("lines"))))
    last = F.array(F.size("lines"))
    ends = F.when(keyed, F.col("cuts")).otherwise(F.concat("cuts", last))
    starts = F.concat(F.array(F.lit(0)), F.transform("cuts", lambda i: i + keyed.cast("int")))
    letter = F.when(keyed, F.transform("ends", lambda i: F.lower(F.regexp_extract(F.get("lines", i), f"(?U){ANSWER_LINE}", 1))))
    bounds = cuts.select(*keys, "lines", ends.alias("to"), F.slice(starts, 1, F.size(ends)).alias("since"), letter.alias("letters"))
    opened = bounds.select(*keys, "letters", F.posexplode(_slices(F.col("lines"), F.col("since"), F.col("to"))).alias("segment", "lines"))
    given = F.get("letters", F.col("segment"))
    return opened.select(*keys, "segment", "lines", F.when(given != "*", given).alias("answer"))


def questions(papers: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """keys, segment, n, text, answer (a letter or null) and format of each question.

    A segment's question begins at the first numbered line whose rest has enough options,
    enough of the script and enough characters; a segment without one is furniture. A null
    text holds no questions.
    """
    found = segmented(papers, keys, text)
    options = found.withColumn("options", _indices(F.col("lines"), OPTION_LINE))
    # where fewer than OPTIONS follow, no question starts
    latest = F.get("options", F.size("options") - OPTIONS)
    starts = F.filter(_indices(F.col("lines"), QUESTION_START), lambda i: i <= latest)
    rest = lambda i: F.slice("lines", i + 1, F.size("lines"))

    def first(held: Column, i: Column) -> Column:
        body = _cleaned(rest(i))
        fits = (texts.script_ratio(body, "[\\p{L}&&[\\u0900-\\u097F]]", "\\p{L}") >= SHARE) & (F.length(body) >= LEAST)
        return F.when(held.isNotNull(), held).when(fits, i)

    begun = options.withColumn("at", F.aggregate(starts, F.lit(None).cast("int"), first)).filter("at IS NOT NULL")
    number = F.translate(F.regexp_extract(F.get("lines", F.col("at")), f"(?U){QUESTION_START}", 1), *DIGITS).cast("int")
    whole = begun.select(*keys, "segment", number.alias("n"), _cleaned(rest(F.col("at"))).alias("text"), "answer")
    return whole.withColumn("format", texts.format_of(F.col("text")))


#: A numbered line; the highest number; least numbered lines, highest first number
#: and share of ascending ones that make a numbering reliable; questions of a chunk.
NUMBERED, HIGHEST, SOME, LOW, ASCENDING, CHUNK = r"^[\s>|*#\-\x{200B}\x{200C}\x{200D}\x{FEFF}\xA0]{0,6}(\d{1,3})[.)\-]\s", 300, 12, 3, 0.8, 20


def numbered_chunks(papers: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """keys, chunk (from 0) and body of papers that are cut at the first line of every 20th number.

    A paper is cut if it has enough numbered lines, begins low, mostly ascends and has more
    numbers than a chunk; others give no rows. A chunk begins one question early, so that
    neighbours overlap, and the first with the paper itself.
    """
    lines = papers.select(*keys, F.split(F.coalesce(text, F.lit("")), LINE_END).alias("lines"))
    number = lambda x: F.translate(F.regexp_extract(x, f"(?U){NUMBERED}", 1), *DIGITS).try_cast("int")
    marked = lines.withColumn("starts", F.filter(F.transform("lines", lambda x, i: F.struct(i.alias("at"), number(x).alias("n"))), lambda s: s["n"].between(1, HIGHEST)))
    rising = F.size(F.filter(F.transform("starts", lambda s, i: (i > 0) & (s["n"] > F.get("starts", i - 1)["n"])), lambda x: x))
    first = F.filter("starts", lambda s, i: ~F.exists(F.slice("starts", 1, i), lambda b: b["n"] == s["n"]))
    fine = (F.size("starts") >= SOME) & (F.get("starts", F.lit(0))["n"] <= LOW) & (rising >= ASCENDING * (F.size("starts") - 1))
    kept = marked.filter(fine).select(*keys, "lines", F.transform(first, lambda s: s["at"]).alias("anchors")).filter(F.size("anchors") > CHUNK)
    chunks = F.floor((F.size("anchors") - 1) / CHUNK).cast("int")
    opened = kept.select(*keys, "lines", "anchors", F.explode(F.sequence(F.lit(0), chunks)).alias("chunk"))
    since = F.when(F.col("chunk") == 0, 0).otherwise(F.get("anchors", F.col("chunk") * CHUNK - 1))
    until = F.coalesce(F.get("anchors", (F.col("chunk") + 1) * CHUNK), F.size("lines"))
    return opened.select(*keys, "chunk", _stripped(F.array_join(F.slice("lines", since + 1, until - since), "\n")).alias("body"))


#: Option markers of a legacy font and as scanned pages garble them, with what they stand for; a marker; the gap between columns.
LEGACY_MARKERS = tuple((p, f"({x}) ") for x in "abcd" for p in (rf"(?<![A-Za-z0-9]){x.upper()}½", rf"¼\s*[{x}{x.upper()}]\s*½"))
GARBLED_MARKERS = ((r";\s*इ\s*\)", "(b) "), (r";\s*ब\s*\)", "(c) "), (r";\s*क\s*\)", "(d) "), (r";\s*घ\s*\)", "(d) "))
MARKER = r"\(\s*([a-dA-D])\s*\)\s*"
COLUMN_GAP = r"\t+| {4,}"


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def options_of(text: Column) -> Column:
    """(stem, options) of a question: the text before the first marker, then what follows each
    of the markers a to d, the first of each that isn't blank, in that order. Markers of
    either case; garbled ones are repaired, gaps between columns closed."""
    flat = text
    for pattern, marker in LEGACY_MARKERS + GARBLED_MARKERS:
        flat = F.regexp_replace(flat, f"(?U){pattern}", marker)
    whole = flat
    flat = F.regexp_replace(flat, COLUMN_GAP, "  ")
    labels = F.transform(F.regexp_extract_all(flat, F.lit(f"(?U){MARKER}"), F.lit(1)), F.lower)
    bodies = F.transform(F.split(flat, f"(?U){MARKER}"), _stripped)
    pairs = F.filter(F.zip_with(labels, F.slice(bodies, 2, F.size(labels)), lambda a, b: F.struct(a.alias("label"), b.alias("body"))), lambda p: p["body"] != "")
    each = F.transform(F.array(*[F.lit(x) for x in "abcd"]), lambda x: F.get(F.filter(pairs, lambda p: p["label"] == x), F.lit(0))["body"])
    stem = F.when(F.size(labels) == 0, _stripped(whole)).otherwise(F.get(bodies, F.lit(0)))
    return F.struct(stem.alias("stem"), F.filter(each, lambda x: x.isNotNull()).alias("options"))


# Headings and sections ---------------------------------------------------------------------------

#: Headings that are structure and no topics; a heading; the longest title; the anchor's length.
NOISE_HEAD = (
    r"^(अध्याय\s*\d|UNIT\s*\d|तालिका|सारणी|Table|संक्षेप|Summing\s*Up|अशुद्ध|\d+\.\s"
    r"|Lecture\s*\W?\s*\d|Short\s*Trick|नोट|Note|प्रश्न\s*\d|अभ्यास|Practice|उदाहरण)"
)
HEADING = r"^(#{1,4})\s*(.+)"
MAX_HEAD, ANCHOR = 90, 150


def squeezed(text: Column) -> Column:
    """Whitespace runs as one blank, none outside. Both sides of a comparison go through it, composed (NFC) before."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), texts.SPACE + "+", " "))


def headings(text: Column) -> Column:
    """(place, level, title) of every heading, with its place in the squeezed text.

    One pass: the text is cut before each line that begins with a mark, and a fold over the
    pieces keeps the squeezed length so far, which grows by a piece's own and one blank
    between pieces that have any. A heading's place is that length where its piece begins,
    so its title follows one blank later. Long titles and noise are left out; a line of
    marks alone takes the next line of its piece as title.
    """
    pieces = F.split(F.coalesce(text, F.lit("")), "(?m)(?d)^(?=#)")
    start = F.struct(F.lit(0).alias("length"), F.array().cast("array<struct<place:int,level:int,title:string>>").alias("found"))
    parts = F.transform(
        pieces,
        lambda p: F.struct(F.length(squeezed(p)).alias("size"), F.length(F.regexp_extract(p, f"(?Ud){HEADING}", 1)).alias("level"), squeezed(F.regexp_extract(p, f"(?Ud){HEADING}", 2)).alias("title")),
    )

    def step(held: Column, p: Column) -> Column:
        grown = F.when(p["size"] == 0, held["length"]).when(held["length"] == 0, p["size"]).otherwise(held["length"] + 1 + p["size"])
        fits = (p["title"] != "") & (F.length(p["title"]) <= MAX_HEAD) & ~_holds(p["title"], "(?i)" + NOISE_HEAD)
        one = F.array(F.struct(held["length"].alias("place"), p["level"].alias("level"), p["title"].alias("title")))
        return F.struct(grown.alias("length"), F.when(fits, F.concat(held["found"], one)).otherwise(held["found"]).alias("found"))

    return F.aggregate(parts, start, step, lambda held: held["found"])


def sections(passages: DataFrame, sources: DataFrame, book: str, order: str, passage: str, source: str) -> DataFrame:
    """book, order, place and section of each passage: all of a book in one pass over its source.

    ``place``: where the first ANCHOR characters of the squeezed passage first stand in the
    squeezed source, -1 if nowhere (or without a source). ``section``: the title of the last
    heading at or before it; null without one. Passages travel as anchors of bounded length.
    """
    anchors = passages.select(book, F.struct(F.col(order).alias("nth"), F.substring(squeezed(F.col(passage)), 1, ANCHOR).alias("anchor")).alias("p"))
    listed = anchors.groupBy(book).agg(F.sort_array(F.collect_list("p")).alias("passages"))
    texts_of = sources.select(book, F.col(source).alias("_source"))
    both = listed.join(texts_of, book, "left").withColumns({"flat": squeezed(F.col("_source")), "heads": headings(F.col("_source"))})
    placed = both.withColumn("placed", F.transform("passages", lambda p: F.struct(p["nth"].alias(order), (F.call_function("locate", p["anchor"], F.col("flat")) - 1).alias("place"))))
    opened = placed.select(book, "heads", F.explode("placed").alias("p")).select(book, "heads", f"p.{order}", "p.place")
    before = F.filter("heads", lambda h: h["place"] <= F.col("place"))
    section = F.when(F.col("place") >= 0, F.try_element_at(before, F.lit(-1))["title"])
    return opened.select(book, order, "place", section.alias("section"))
