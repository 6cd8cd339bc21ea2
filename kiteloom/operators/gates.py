"""Gates and builders of exam questions, as expressions over a question's columns.

A gate gives the name of the first rule that a question breaks, or null. Question columns:
stem, options (array of texts), answer (a letter), format, reason, statements (array) and
match (array of [left, right] rows); any may be null.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kiteloom.functions import texts

LETTERS = "abcd"
#: Phrases that cite material which a student never sees.
MATERIAL_REFS = (
    "पाठ के अनुसार", "सामग्री के अनुसार", "अध्ययन सामग्री", "प्रदत्त सामग्री", "दी गई सामग्री", "उपरोक्त सामग्री", "पाठ में", "स्रोत [", "के साथ उल्लेखित", "सामग्री में", "सामग्री से",
    "तालिका के अनुसार", "सारणी के अनुसार", "तालिका में", "सारणी में", "उपर्युक्त तालिका", "दी गई तालिका", "चित्र के अनुसार", "आरेख के अनुसार",
)
#: Sequences that no text of the script has, by name, in order of test.
SIGNATURES = (("halant_vowel", r"्[ा-ौॢॣ]"), ("double_halant", r"््"), ("vedic_accent", r"[॒॑]"), ("angle_bracket_dev", r"<[ऀ-ॿ]|[ऀ-ॿ]>"), ("orphan_matra", r"(?:^|[\s(«»])[ा-ौ]"))
#: Letters of two scripts spliced in one word; years and those that are plausible.
MIXED_SCRIPT = r"[ऀ-ॿ][A-Za-z]{2,}|[A-Za-z]{2,}[ऀ-ॿ]"
YEAR, YEARS = r"\b([1-9][0-9]{3})\b(?!\s*ई[.०]?\s*पू)", (600, 2026)
#: The shapes of a year, a number and a measure with its units.
SHAPE_YEAR = r"^[0-9]{3,4}(\s*[-–]\s*[0-9]{2,4})?(\s*ई[.०]?(\s*पू[.०]?)?)?$"
SHAPE_NUMBER = r"^[0-9][0-9,.\s/%]*$"
UNITS = (
    r"मीटर|मी\.?|किमी|कि\.?मी\.?|किलोमीटर|सेमी|फीट|फुट|इंच|मील|हेक्टेयर|एकड़|वर्ग\s*किमी|वर्ग\s*किलोमीटर|वर्ग\s*मीटर|प्रतिशत|फीसदी|डिग्री|सेल्सियस|लाख|करोड़|हजार|अरब"
    r"|किलोग्राम|किग्रा|टन|क्विंटल|लीटर|मिलियन|बिलियन|वर्ष|साल|दिन|घंटे|मिनट|km|m|cm|ft|%"
)
SHAPE_MEASURE = rf"^[0-9][0-9,.\s/]*\s*(?:{UNITS})\.?$"


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def _collapsed(text: Column) -> Column:
    return _strip(F.regexp_replace(text, r"(?U)\s+", " "))


def script_share(text: Column) -> Column:
    return texts.script_ratio(text, "[\\p{L}&&[\\u0900-\\u097F]]", "\\p{L}")


def signature(text: Column) -> Column:
    """The name of the first signature of damage that a text holds; null without one."""
    chain = F
    for name, pattern in SIGNATURES:
        chain = chain.when(text.rlike(f"(?U){pattern}"), name)
    return chain.otherwise(F.lit(None).cast("string"))


def shape(text: Column) -> Column:
    """year, number (a measure too), devanagari-text or latin-text."""
    t = _strip(text)
    number = t.rlike(f"(?U){SHAPE_NUMBER}") | t.rlike(f"(?iU){SHAPE_MEASURE}")
    return F.when(t.rlike(f"(?U){SHAPE_YEAR}"), "year").when(number, "number").when(script_share(t) >= 0.5, "devanagari-text").otherwise("latin-text")


def odd_shape(items: Column) -> Column:
    """Whether of four items one has a shape that no other has."""
    shapes = F.transform(items, shape)
    return (F.size(items) == 4) & F.exists(shapes, lambda c: F.size(F.filter(shapes, lambda x: x == c)) == 1)


def first_broken(rules: list[tuple[str, Column]]) -> Column:
    """The name of the first rule that holds; a rule that can't be told does not."""
    chain = F
    for name, broken in rules:
        chain = chain.when(F.coalesce(broken, F.lit(False)), name)
    return chain.otherwise(F.lit(None).cast("string"))


def question_gate(stem: Column, options: Column, answer: Column, format: Column, reason: Column, statements: Column, match: Column) -> Column:
    """The first rule that a generated question breaks."""
    stem, reason = F.coalesce(stem, F.lit("")), F.coalesce(reason, F.lit(""))
    none = F.array().cast("array<string>")
    said, rows = F.coalesce(statements, none), F.coalesce(match, F.array().cast("array<array<string>>"))
    cells = F.flatten(rows)
    whole = F.array_join(F.concat(F.array(stem), said, F.transform(rows, lambda r: F.array_join(r, " "))), " ")
    refers = F.lit(False)
    for ref in MATERIAL_REFS:
        refers = refers | stem.contains(ref) | reason.contains(ref)
    fields = F.concat(F.array(stem, reason), F.coalesce(options, none), said, cells)
    rights = F.transform(F.filter(rows, lambda r: F.size(r) == 2), lambda r: F.element_at(F.split(r[1], "\\. ", 2), -1))
    years = F.regexp_extract_all(F.concat_ws(" ", whole, F.array_join(options, " ")), F.lit(f"(?U){YEAR}"), F.lit(1))
    told = F.coalesce(format, F.lit("plain"))
    return first_broken([
        ("short_stem", F.length(_strip(stem)) < 15),
        ("cites_material", refers),
        ("not_in_script", script_share(whole) < 0.5),
        ("option_count", options.isNull() | (F.size(options) != 4)),
        ("blank_option", F.exists(options, lambda o: o.isNull() | (_strip(o) == ""))),
        ("repeated_option", F.size(F.array_distinct(F.transform(options, lambda o: F.lower(_collapsed(o))))) != 4),
        ("garbled", F.exists(fields, lambda t: signature(t).isNotNull())),
        ("mixed_script", F.exists(fields, lambda t: t.rlike(MIXED_SCRIPT))),
        ("answer_letter", ~F.lower(F.coalesce(answer, F.lit(""))).isin(*LETTERS)),
        ("odd_option", (told == "plain") & odd_shape(options)),
        ("match_rows", (told == "match") & (F.size(rows) != 4)),
        ("odd_match", (told == "match") & (F.size(rights) == 4) & odd_shape(rights)),
        ("no_statements", told.isin("statement", "assertion", "order") & (F.size(said) == 0)),
        ("implausible_year", F.exists(years, lambda y: ~y.cast("int").between(*YEARS))),
    ])


#: What a cover page's description says; letters of option markers; the runs of them.
COVER_MARKERS = ("छवि", "लोगो", "तीरंदाज", "चित्र है", "गोलाकार", "logo", "image", "archer", "blank page", "खाली")
LABEL_LETTERS = "abcdABCDअआइईउऊएऐओऔकखगघ"
LABEL_RUNS = ("अबसद", "abcd", "ABCD", "कखगघ")


def extraction_gate(stem: Column, options: Column) -> Column:
    """The first rule that an extracted question breaks."""
    low, hits = F.lower(F.coalesce(stem, F.lit(""))), F.lit(0)
    for m in COVER_MARKERS:
        hits = hits + low.contains(m).cast("int")
    cores = F.transform(options, lambda o: _strip(F.regexp_replace(_strip(o), r"^[().\[\]। :-]+|[().\[\]। :-]+$", "")))
    single = F.forall(cores, lambda c: F.length(c) <= 1)
    distinct = F.size(F.array_distinct(cores)) == F.size(cores)
    run = F.array_join(cores, "").isin(*LABEL_RUNS)
    labels = F.size(F.filter(cores, lambda c: (F.length(c) == 1) & F.instr(F.lit(LABEL_LETTERS), c).cast("boolean")))
    return first_broken([
        ("short_stem", stem.isNull() | (F.length(_strip(stem)) < 8)),
        ("cover_page", hits >= 2),
        ("no_options", options.isNull()),
        ("option_count", F.size(options) != 4),
        ("blank_option", F.exists(options, lambda o: o.isNull() | (_strip(o) == ""))),
        ("placeholders", single & (~distinct | run)),
        ("label_letter", labels.between(1, 3)),
        ("repeated_option", F.size(F.array_distinct(F.transform(options, _strip))) < 4),
    ])


#: What a solution says that its passages don't bear out.
NOT_GROUNDED = ("नहीं है", "उल्लिखित नहीं", "उल्लेख नहीं", "नहीं मिलता", "not mentioned", "not in the passage", "does not")


def grounded_answer(confidence: Column, answer: Column, solution: Column, options: Column, markers: list[str]) -> Column:
    """(answer, solution) that a question is marked with; null where it stays unmarked.

    The confidence must be high, the letter one of the options', and the solution there and
    free of what admits that nothing bears it out. A circular solution (``markers``) is blank.
    """
    letter, said = F.lower(_strip(F.coalesce(answer, F.lit("")))), _strip(F.coalesce(solution, F.lit("")))
    place = F.when(letter.isin(*LETTERS), F.ascii(letter) - 97)
    doubtful = said == ""
    for m in NOT_GROUNDED:
        doubtful = doubtful | said.contains(m)
    option = _strip(F.coalesce(F.get(options, place), F.lit("")))
    low, circular = F.lower(said), F.lit(False)
    for m in markers:
        circular = circular | low.contains(m.lower())
    rest = F.regexp_replace(F.replace(said, option, F.lit("")), r"""^[ ।."'—:-]+|[ ।."'—:-]+$""", "")
    circular = circular | ((option != "") & said.contains(option) & (F.length(rest) < 12))
    fine = (F.lower(confidence) == "high") & (place < F.size(options)) & ~doubtful
    return F.when(fine, F.struct(letter.alias("answer"), F.when(circular, "").otherwise(said).alias("solution")))


def verdict(given: Column, sources: Column, confidence: Column) -> Column:
    """failed without a verdict (``given`` false), confirmed by two sources and a high or medium confidence, else weak."""
    firm = (F.size(F.coalesce(sources, F.array().cast("array<string>"))) >= 2) & F.coalesce(confidence, F.lit("")).isin("high", "medium")
    return F.when(~F.coalesce(given, F.lit(False)), "failed").when(firm, "confirmed").otherwise("weak")


# Builders ----------------------------------------------------------------------------------------

#: The answers of assertion and reason, and their order by relation; labels of statement sets.
RELATIONS = {
    "both-true-explains": "(A) और (R) दोनों सही हैं तथा (R), (A) की सही व्याख्या है",
    "both-true-not-explains": "(A) और (R) दोनों सही हैं, परन्तु (R), (A) की सही व्याख्या नहीं है",
    "a-true-r-false": "(A) सही है, परन्तु (R) गलत है",
    "a-false-r-true": "(A) गलत है, परन्तु (R) सही है",
}
NONE_OF, ALL_OF, ONLY, AND = "इनमें से कोई नहीं", "उपर्युक्त सभी", "केवल ", " और "
OPTION_LABEL = r"^[\(\[]?\s*[a-dA-D]\s*[\)\].:]\s*"
#: Built questions: statements are what stands between stem and options; error says why there is none.
BUILT = "struct<statements: array<string>, options: array<string>, answer: string, error: string>"


def shuffled(items: Column, seed: Column, salt: str) -> Column:
    """An array in the order of md5 of "seed|salt|place": the same in any engine."""
    keyed = F.transform(items, lambda x, i: F.struct(F.md5(F.concat_ws("|", seed, F.lit(salt), i.cast("string"))).alias("h"), x.alias("x")))
    return F.transform(F.array_sort(keyed), lambda k: k["x"])


def _built(options: Column, right: Column, statements: Column | None = None, error: Column | None = None) -> Column:
    place = F.array_position(options, right)
    letter = F.substring(F.lit(LETTERS), place.cast("int"), F.lit(1))
    said = F.array().cast("array<string>") if statements is None else statements
    whole = F.struct(said.alias("statements"), options.alias("options"), letter.alias("answer"), F.lit(None).cast("string").alias("error")).cast(BUILT)
    none = F.array().cast("array<string>")
    failed = F.struct(none.alias("statements"), none.alias("options"), F.lit(None).cast("string").alias("answer"), error.alias("error")).cast(BUILT)
    return F.when(error.isNotNull(), failed).otherwise(whole)


def build_plain(options: Column, right: Column, seed: Column) -> Column:
    """Four options without labels of their own, shuffled; ``right`` is the place (from 0) of the right one."""
    clean = F.transform(options, lambda o: F.regexp_replace(_collapsed(o), OPTION_LABEL, ""))
    clean = F.zip_with(clean, options, lambda c, o: F.when(c == "", _collapsed(o)).otherwise(c))
    error = first_broken([("option_count", options.isNull() | (F.size(options) != 4)), ("blank_option", F.exists(options, lambda o: o.isNull() | (_strip(o) == ""))), ("answer_index", right.isNull() | ~right.between(0, 3))])
    return _built(shuffled(clean, seed, "options"), F.get(clean, right), None, error)


def _codes(correct: Column, seed: Column, joint: str) -> tuple[Column, Column]:
    """Four orders of 1 to 4 as texts, the right one among them, and that one's text."""
    others = F.array(*[F.lit("".join(map(str, p))) for p in permutations((1, 2, 3, 4)) if p != (1, 2, 3, 4)])
    wrong = F.slice(shuffled(F.filter(others, lambda p: p != correct), seed, "codes"), 1, 3)
    spaced = lambda code: F.array_join(F.split(code, "(?<=.)(?=.)"), joint)
    return F.transform(shuffled(F.concat(wrong, F.array(correct)), seed, "options"), spaced), spaced(correct)


def _displayed(items: Column, seed: Column) -> tuple[Column, Column]:
    """Items in a shuffled order with their numbers, and the numbers that restore the given order."""
    order = shuffled(F.sequence(F.lit(0), F.lit(3)), seed, "display")
    correct = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.array_position(order, i).cast("string")), "")
    return F.transform(order, lambda i, n: F.concat((n + 1).cast("string"), F.lit(". "), F.get(items, i))), correct


def _fits_four(items: Column, what: str) -> list[tuple[str, Column]]:
    return [(f"{what}_count", items.isNull() | (F.size(items) != 4)), (f"blank_{what}", F.exists(items, lambda o: o.isNull() | (_strip(o) == "")))]


def build_order(items: Column, seed: Column) -> Column:
    """Four items, given in the right order, shown shuffled; the options are codes of that order."""
    clean = F.transform(items, _collapsed)
    error = first_broken([*_fits_four(items, "item"), ("repeated_item", F.size(F.array_distinct(clean)) != 4)])
    shown, correct = _displayed(clean, seed)
    codes, right = _codes(correct, seed, ", ")
    return _built(codes, right, shown, error)


def build_match(lefts: Column, rights: Column, seed: Column) -> Column:
    """Four pairs shown as lettered lefts beside numbered, shuffled rights; the options are codes of the pairing."""
    left, right = F.transform(lefts, _collapsed), F.transform(rights, _collapsed)
    error = first_broken([*_fits_four(lefts, "left"), *_fits_four(rights, "right"), ("repeated_item", (F.size(F.array_distinct(left)) != 4) | (F.size(F.array_distinct(right)) != 4))])
    shown, correct = _displayed(right, seed)
    rows = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.concat(F.substring(F.lit(LETTERS), i + 1, F.lit(1)), F.lit(". "), F.get(left, i), F.lit(" | "), F.get(shown, i)))
    codes, code = _codes(correct, seed, "  ")
    return _built(codes, code, rows, error)


def build_statement(statements: Column, true: Column, seed: Column) -> Column:
    """Two or three statements of which some, not all, are true (places from 0); the options are sets of them.

    The right set comes first, then single statements, pairs, all, and for two none; the
    first four of these, shuffled.
    """
    clean, n = F.transform(statements, _collapsed), F.size(statements)
    held = F.array_sort(F.array_distinct(F.filter(true, lambda i: i.between(0, n - 1))))
    error = first_broken([
        ("statement_count", statements.isNull() | ~n.between(2, 3)), ("blank_statement", F.exists(statements, lambda o: o.isNull() | (_strip(o) == ""))),
        ("all_or_none_true", true.isNull() | (F.size(held) == 0) | (F.size(held) == n)),
    ])
    sets = [(0,), (1,), (2,), (0, 1), (0, 2), (1, 2), (0, 1, 2)]
    known = F.array(*[F.array(*map(F.lit, s)) for s in sets])
    fitting = F.filter(known, lambda s: F.array_max(s) < n)
    cands = F.array_distinct(F.concat(F.array(held), fitting, F.when(n == 2, F.array(F.array().cast("array<int>"))).otherwise(F.array().cast("array<array<int>>"))))

    def label(s: Column) -> Column:
        numbers = F.array_join(F.transform(s, lambda i: (i + 1).cast("string")), AND)
        return F.when(F.size(s) == 0, NONE_OF).when(F.size(s) == n, ALL_OF).otherwise(F.concat(F.lit(ONLY), numbers))

    return _built(shuffled(F.transform(F.slice(cands, 1, 4), label), seed, "options"), label(held), clean, error)


def build_assertion(assertion: Column, reason: Column, relation: Column) -> Column:
    """An assertion and a reason that says something else; the options are the four relations in their fixed order."""
    options = F.array(*map(F.lit, RELATIONS.values()))
    a, r = _collapsed(assertion), _collapsed(reason)
    error = first_broken([
        ("blank_claim", assertion.isNull() | reason.isNull() | (a == "") | (r == "")), ("relation", relation.isNull() | ~relation.isin(*RELATIONS)), ("same_claim", F.lower(a) == F.lower(r)),
    ])
    right = F.element_at(F.create_map(*[F.lit(x) for kv in RELATIONS.items() for x in kv]), relation)
    return _built(options, right, F.array(F.concat(F.lit("अभिकथन (A) : "), a), F.concat(F.lit("कारण (R) : "), r)), error)
