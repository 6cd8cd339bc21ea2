"""Text functions as Spark expressions.

Whitespace is an explicit class, since the engines differ on what \\s holds.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Blanks that count as whitespace in texts.
SPACE = "[\\s\\u00A0\\u1680\\u2000-\\u200A\\u202F\\u205F\\u3000]"
DEVANAGARI = "[\\u0900-\\u097F]"
LETTER = "[\\p{L}\\u0900-\\u097F]"


def _trimmed(part: Column) -> Column:
    """F.trim for F.transform, which would give a function of two parameters the place as characters to trim."""
    return F.trim(part)


def normalise(text: Column) -> Column:
    """Whitespace runs as one blank, trimmed, lower-case."""
    return F.lower(F.trim(F.regexp_replace(text, SPACE + "+", " ")))


def composed(text: Column) -> Column:
    """The text in composed form (NFC), which no built-in makes: in Arrow batches."""

    @F.pandas_udf("string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield s.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))

    return run(text)


def sentences(text: Column) -> Column:
    """Split after a danda or . ! ? before whitespace, or at a blank line; no empty ones."""
    parts = F.split(text, "(?<=[\\u0964.!?])\\s+|\\n{2,}")
    return F.filter(F.transform(parts, _trimmed), lambda s: s != "")


#: What marks a text as promotion, a dump of questions, a table of contents
#: or a source of impossible years.
PROMOTION = r"@gmail\.com|@yahoo|youtube\.com|https?://|www\.|copyright|all rights reserved|£|हमारे\s+YouTube|जुड़ें\s+हमारे\s+साथ|निशुल्क\s+कोर्स|ननशुल्क"
QUESTION_NUMBER = r"Q\s*\d{1,3}\s*[.।]"
QUESTION_OPTION = r"(?:^|\s)[A-D]\s*[.)]\s*\S"
PAGE_RANGE = r"\d{1,3}\s*[-–]\s*\d{1,3}"
CONTENTS_WORDS = r"content\s+page|तिर्षय\s*सूची|विषय\s*सूची|अनुक्रम"
BAD_YEAR = r"\b[4-9][0-9]{3}\s*(?:में|तक|से|ई(?![.०]?\s*पू))"
BAD_YEAR_RANGE = r"\(\s*[0-9]{3,4}\s*[-–]\s*[4-9][0-9]{3}\s*\)"


def junk_class(text: Column) -> Column:
    """The first class of promo, mcq_dump, toc, bad_year that a text falls in; else null."""
    holds = lambda pattern, flags="": text.rlike(f"(?U{flags}){pattern}")
    times = lambda pattern: F.regexp_count(text, F.lit(f"(?U){pattern}"))
    return (
        F.when(holds(PROMOTION, "iu"), "promo")
        .when(holds(QUESTION_NUMBER) & (times(QUESTION_OPTION) >= 3), "mcq_dump")
        .when(holds(CONTENTS_WORDS, "iu") | (times(PAGE_RANGE) >= 4), "toc")
        .when(holds(BAD_YEAR) | holds(BAD_YEAR_RANGE), "bad_year")
    )


#: Question formats by their marker phrases, in order of priority.
FORMATS = (
    ("figure", r"प्रश्न\s*आकृति|उत्तर\s*आकृति|आकृति\s+में|निम्न\s*आकृति"),
    ("match", r"सुमेलित|सूची\s*[-–—]?\s*I|कूट\s*[:：]"),
    ("assertion", r"अभिकथन|कथन\s*\(\s*A\s*\)|कारण\s*\(\s*R\s*\)"),
    ("statement", r"कथनों?\s+पर\s+विचार|निम्नलिखित\s+कथन|सही\s+कथन|असत्य\s+कथन|सत्य\s+कथन"),
    ("order", r"(सही|काला?नुक्रम|आरोही|अवरोही)\s*क्रम|क्रम\s+में\s+व्यवस्थित|कालक्रम"),
)


def format_of(text: Column, rules: Sequence[tuple[str, str]] = FORMATS, default: str = "plain") -> Column:
    """The name of the first rule whose pattern the text holds; else ``default``."""
    chain = F
    for name, pattern in rules:
        chain = chain.when(text.rlike(f"(?U){pattern}"), name)
    return chain.otherwise(default) if rules else F.lit(default)


def needs_restructure(text: Column) -> Column:
    options = F.regexp_count(text, F.lit("\\([a-d]\\)"))
    formula = F.length(text) - F.length(F.translate(text, "=+√∑∫×÷", ""))
    return (F.lower(text).contains("mcq") & (options >= 2)) | (formula >= 4)


def table_text(html: Column) -> Column:
    """Cells divided by " | ", line breaks as blanks, other tags as newlines, at most one blank line."""
    cells = F.regexp_replace(html, "(?i)</t[dh]>", " | ")
    breaks = F.regexp_replace(cells, "(?i)<br\\s*/?>", " ")
    plain = F.regexp_replace(breaks, "<[^>]+>", "\n")
    return F.trim(F.regexp_replace(plain, "\\n{3,}", "\n\n"))


def unescape(text: Column) -> Column:
    """The five named entities of markup and the hard blank."""
    out = text
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(char))
    return out


def html_text(html: Column) -> Column:
    """Row ends and breaks as newlines, cells as two blanks, tags dropped, entities resolved."""
    rows = F.regexp_replace(html, "(?i)<br\\s*/?>|</tr>|</p>|</h[1-6]>|</li>", "\n")
    cells = F.regexp_replace(rows, "(?i)</t[dh]>", "  ")
    return unescape(F.regexp_replace(cells, "<[^>]+>", ""))


def page_text(html: Column, most: int = 8000) -> Column:
    """A page without scripts, styles, navigation and comments; blanks collapsed; cut."""
    bare = F.regexp_replace(html, "(?is)<(script|style|nav|header|footer|aside|iframe|noscript)\\b.*?</\\1>|<!--.*?-->", " ")
    return F.substring(F.trim(F.regexp_replace(unescape(F.regexp_replace(bare, "<[^>]+>", " ")), SPACE + "+", " ")), 1, most)


def article_text(html: Column) -> Column:
    """The article element (else the page) as lines, at most one of them blank in a row."""
    body = F.regexp_extract(html, "(?is)<article\\b[^>]*>(.*?)</article>", 1)
    chosen = F.when(body != "", body).otherwise(html)
    bare = F.regexp_replace(chosen, "(?is)<(script|style|iframe|nav)\\b.*?</\\1>|<!--.*?-->", "")
    lines = F.transform(F.split(html_text(bare), "\n"), _trimmed)
    return F.trim(F.regexp_replace(F.array_join(lines, "\n"), "\\n{3,}", "\n\n"))


def script_ratio(text: Column, script: str = DEVANAGARI, letters: str = LETTER) -> Column:
    """Letters of the script among all letters; 0.0 where there are none."""
    n = F.regexp_count(text, F.lit(letters))
    return F.when(n == 0, F.lit(0.0)).otherwise(F.regexp_count(text, F.lit(script)) / n)


#: Sequences that no Devanagari text has, and a joined consonant four or more times running.
IMPOSSIBLE = r"्[ा-ौॢॣ]|््|[॒॑]|<[ऀ-ॿ]|[ऀ-ॿ]>|(?:^|[\s(«»])[ा-ौ]"
STUTTER = r"((.्)\2{3,})"


def garble_density(text: Column, impossible: str = IMPOSSIBLE, stutter: str | None = STUTTER) -> Column:
    """Places where an impossible sequence begins, and characters of stutters, per 100 characters.

    Sequences may overlap: each place counts. ``stutter`` has a run in group 1; None counts places alone.
    """
    places = F.regexp_count(text, F.lit(f"(?={impossible})"))
    runs = F.lit(0) if stutter is None else F.aggregate(F.regexp_extract_all(text, F.lit(stutter), F.lit(1)), F.lit(0), lambda a, r: a + F.length(r))
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, F.lit(0.0)).otherwise((places + runs) * 100.0 / F.length(text))


#: Letter sequences that a legacy Devanagari font leaves in extracted text.
LEGACY_MARKS = ("dk ", " dh ", " esa ", "Hkk", "izk", "iz'", "vè;", ".kk", "'kk", "Lo;", "Ùk", "{k", "T;k", "|k", "/kk")


def legacy_font(text: Column, marks: Sequence[str] = LEGACY_MARKS, window: int = 15000, least: int = 2000) -> Column:
    """Whether most samples have under 15 % of the script and over one mark in 120 characters.

    The samples are ``window`` characters from 25, 50 and 75 % of the text on, or the
    whole of a text of under ``least`` characters. A sample without letters is not legacy.
    """

    def vote(sample: Column) -> Column:
        letters = F.regexp_count(sample, F.lit(LETTER))
        hits = F.lit(0)
        for m in marks:
            hits = hits + (F.length(sample) - F.length(F.replace(sample, F.lit(m), F.lit("")))) / len(m)
        few = (letters > 0) & (F.regexp_count(sample, F.lit(DEVANAGARI)) < 0.15 * letters)
        return (few & (hits * 120 > F.length(sample))).cast("int")

    n = F.length(text)
    votes = [vote(F.substr(text, F.floor(n * q).cast("int") + 1, F.lit(window))) for q in (0.25, 0.5, 0.75)]
    return F.coalesce(F.when(n < least, vote(text) == 1).otherwise(votes[0] + votes[1] + votes[2] >= 2), F.lit(False))


def option_texts(text: Column) -> Column:
    """Texts after the markers (a) to (d), first of each, in order of appearance."""
    return F.regexp_extract_all(text, F.lit("\\([a-d]\\)\\s*([^()]*)"), F.lit(1))


def value_class(text: Column) -> Column:
    """year, number, measure, script or text."""
    t = F.trim(text)
    return (
        F.when(t.rlike("^(1[0-9]|20)[0-9]{2}$"), "year").when(t.rlike("^[0-9][0-9,]*([.][0-9]+)?$"), "number")
        .when(t.rlike("^[0-9][0-9,.]* *[a-zA-Z%]+$"), "measure").when(F.regexp_count(t, F.lit(DEVANAGARI)) > 0, "script").otherwise("text")
    )


def parse_int(text: Column) -> Column:
    """Trimmed, commas dropped, cut towards zero; null where it is no number."""
    return F.replace(F.trim(text), F.lit(","), F.lit("")).try_cast("double").cast("long")


def shortened(text: Column, most: int, mark: str = "... [cut]") -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit(mark))).otherwise(text)


def fill(template: Column, values: dict[str, Column]) -> Column:
    """{{name}} replaced by its value; three newlines and more become two."""
    out = template
    for name, value in values.items():
        out = F.replace(out, F.lit("{{" + name + "}}"), F.coalesce(value, F.lit("")))
    return F.regexp_replace(out, "\\n{3,}", "\n\n")


def row_numbers(spec: Column) -> Column:
    """"2,3,5-9" as an array of integers."""
    part = lambda p: F.sequence(F.split_part(p, F.lit("-"), F.lit(1)).cast("int"), F.element_at(F.split(p, "-"), -1).cast("int"))
    return F.flatten(F.transform(F.split(F.replace(spec, F.lit(" "), F.lit("")), ","), part))


def first_line(text: Column, last: bool = False) -> Column:
    """The first (or last) non-blank line, trimmed; null where there is none."""
    lines = F.filter(F.transform(F.split(text, "\n"), _trimmed), lambda x: x != "")
    return F.try_element_at(lines, F.lit(-1 if last else 1))


def domain(url: Column) -> Column:
    """Without scheme and www., up to the first slash."""
    return F.split_part(F.regexp_replace(url, "^https?://(www\\.)?", ""), F.lit("/"), F.lit(1))


def profile_name(url: Column) -> Column:
    """Title-cased name of the slug after /in/, without a last hex token of six or more if it
    isn't all there is; underscores are blanks. Blank where there is no slug."""
    slug = F.regexp_extract(F.coalesce(url, F.lit("")), "/in/([^/?#]+)", 1)
    parts = F.filter(F.split(slug, "-"), lambda x: x != "")
    coded = (F.size(parts) > 1) & F.coalesce(F.try_element_at(parts, F.lit(-1)).rlike("^[0-9a-f]{6,}$"), F.lit(False))
    named = F.when(coded, F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)
    return F.initcap(F.replace(F.array_join(named, " "), F.lit("_"), F.lit(" ")))


def mail_first_name(mail: Column) -> Column:
    """The first word of the local part, without digits, capitalised."""
    local = F.regexp_replace(F.split_part(mail, F.lit("@"), F.lit(1)), "[0-9]", "")
    word = F.try_element_at(F.filter(F.split(local, "[._+-]"), lambda x: x != ""), F.lit(1))
    return F.concat(F.upper(F.substring(word, 1, 1)), F.lower(F.substr(word, F.lit(2))))


def video_id(url: Column) -> Column:
    """The eleven-character id of the known URL forms; null where there is none."""
    found = F.regexp_extract(url, "(?:v=|youtu\\.be/|/embed/|/shorts/)([A-Za-z0-9_-]{11})", 1)
    return F.when(found != "", found)


def us_phone(raw: Column) -> Column:
    """A ten-digit North American number as +1..., else null."""
    digits = F.regexp_replace(raw, "[^0-9]", "")
    ten = F.when(F.length(digits) == 10, digits).when((F.length(digits) == 11) & digits.startswith("1"), F.substr(digits, F.lit(2)))
    return F.when(ten.rlike("^[2-9][0-9]{2}[2-9][0-9]{6}$"), F.concat(F.lit("+1"), ten))


#: The calling block of a time zone.
CALLING_BLOCKS = {"America/Los_Angeles": "morning", "America/Denver": "morning", "America/Phoenix": "morning", "America/Chicago": "night", "America/New_York": "night"}


def callable_phones(rows: DataFrame, raw: str, zones: DataFrame) -> DataFrame:
    """Rows with a valid number of a known zone: phone, area_code, time_zone and calling_block (blank for other zones).

    ``zones`` (area_code, time_zone): one row a code, some hundreds at most.
    """
    blocks = F.create_map(*[F.lit(x) for kv in CALLING_BLOCKS.items() for x in kv])
    parsed = rows.withColumn("phone", us_phone(F.col(raw))).withColumn("area_code", F.substring("phone", 3, 3))
    return parsed.join(F.broadcast(zones), "area_code").withColumn("calling_block", F.coalesce(F.try_element_at(blocks, F.col("time_zone")), F.lit("")))


def circular(reason: Column, answer: Column, markers: list[str]) -> Column:
    """A reason that holds a marker, or says under 12 characters besides the answer."""
    low = F.lower(F.coalesce(reason, F.lit("")))
    marked = F.lit(False)
    for m in markers:
        marked = marked | low.contains(m)
    return marked | (F.length(F.trim(F.replace(low, F.lower(answer), F.lit("")))) < 12)


#: Punctuation that scans are inconsistent about.
WOBBLY = "[।'\"‘’“”()\\[\\]{}.,:;?!\\-–—/\\\\]"


def stem_key(text: Column) -> Column:
    """What identifies a stem: blanks collapsed, wobbly punctuation dropped, lower case; blank if under six characters."""
    flat = F.regexp_replace(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE + "+", " ")), WOBBLY, "")
    key = F.trim(F.lower(flat))
    return F.when(F.length(key) >= 6, key).otherwise("")


def question_key(stem: Column, options: Column) -> Column:
    """The keys of the stem and of the first option that has one, joined; null for a stem without a key, which nothing repeats."""
    first = F.coalesce(F.get(F.filter(F.transform(options, stem_key), lambda k: k != ""), F.lit(0)), F.lit(""))
    return F.when(stem_key(stem) != "", F.concat(stem_key(stem), F.lit("||"), first))


def safe_correction(text: Column, corrected: Column) -> Column:
    """Whether a correction keeps all numbers and Latin words, in any order, and most of the length."""
    bag = lambda c, pattern: F.array_sort(F.transform(F.regexp_extract_all(c, F.lit(pattern), F.lit(0)), F.lower))
    same = lambda pattern: bag(text, pattern) == bag(corrected, pattern)
    low, high = F.least(F.length(text), F.length(corrected)), F.greatest(F.length(text), F.length(corrected))
    there = F.coalesce(F.regexp_replace(corrected, SPACE, "") != "", F.lit(False))
    return there & same(r"(?U)\d+") & same("[A-Za-z]+") & ((high == 0) | (low >= 0.6 * high))


#: Days from the date of a stage to its next action; stages whose cadence a reply ends.
STAGE_DAYS = {"commented": 2, "accepted": 0, "first_msg": 3, "loom_sent": 7, "engaged": 30}
SILENT_STAGES = ("first_msg", "loom_sent", "engaged")


def next_action(stage: Column, entered: Column, replied: Column) -> Column:
    """The day of the next action of a stage that was entered on a day; null for other stages and where a reply ended the cadence."""
    days = F
    for name, n in STAGE_DAYS.items():
        days = days.when(stage == name, F.lit(n))
    quiet = stage.isin(*SILENT_STAGES) & F.coalesce(replied, F.lit(False))
    return F.when(~quiet, F.date_add(entered, days.otherwise(F.lit(None))))
