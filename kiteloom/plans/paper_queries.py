"""Question papers and book transcripts: papers and books are derived from the tables, in both engines alike."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kiteloom.functions import texts
from kiteloom.operators import papers
from kiteloom.plans.registry import Family
from kiteloom.plans.script import in_script
from kiteloom.sources.tables import table

FAMILY = Family("papers")
add = FAMILY.add

_NUMBER = "cast(p_partkey % 12 + 1 AS STRING)"
#: A question of a paper: some with an English twin before, a numbered item within, marker
#: phrases or page furniture; two papers of three have answer lines.
_BLOCK = f"""concat(
    CASE WHEN p_partkey % 4 = 1 THEN concat({_NUMBER}, '. Which of these is ', p_name, chr(10), '(A) one', chr(10), '(B) two', chr(10)) ELSE '' END,
    {_NUMBER}, '. ', {in_script('p_type')}, ' ', {in_script('p_name')}, CASE WHEN p_partkey % 6 = 0 THEN ' सुमेलित' ELSE '' END, chr(10),
    CASE WHEN p_partkey % 3 = 0 THEN concat('1. ', {in_script('p_brand')}, '  ', chr(10), chr(10), chr(10)) ELSE '' END,
    '(A) ', {in_script('p_name')}, '   ', chr(10), '(B) ', {in_script('p_type')}, chr(10), ' ( c ) ', cast(p_size AS STRING), chr(10), '(D) ', p_brand, chr(10),
    CASE WHEN p_partkey % 5 = 0 THEN concat('Show Answer/Hide', chr(10)) ELSE '' END,
    CASE WHEN floor(p_partkey / 12) % 3 <> 2 THEN concat(CASE p_partkey % 3 WHEN 0 THEN 'Answer – (' WHEN 1 THEN 'उत्तर (' ELSE 'Answer- ( ' END,
        CASE p_partkey % 7 WHEN 0 THEN '*' WHEN 1 THEN 'b' WHEN 2 THEN 'C' ELSE 'A' END, ' )', chr(10)) ELSE '' END)"""
_PAPERS = f"""SELECT paper, string_agg(block, '' ORDER BY p_partkey) || 'Page 3 of 4' AS body FROM (SELECT CAST(floor(p_partkey / 12) AS BIGINT) AS paper, p_partkey, {_BLOCK} AS block FROM part) GROUP BY paper"""


def _papers(spark, d) -> DataFrame:
    """Twelve questions a paper at most."""
    blocks = table(spark, d, "part").select(F.expr("CAST(floor(p_partkey / 12) AS BIGINT)").alias("paper"), F.struct("p_partkey", F.expr(_BLOCK).alias("block")).alias("b"))
    listed = blocks.groupBy("paper").agg(F.sort_array(F.collect_list("b")).alias("b"))
    return listed.select("paper", F.concat(F.array_join("b.block", ""), F.lit("Page 3 of 4")).alias("body"))


_SEGMENTS = f"""
    WITH RECURSIVE p AS ({_PAPERS}), l AS (SELECT paper, unnest(range(1, len(string_split(body, chr(10))) + 1)) AS pos, unnest(string_split(body, chr(10))) AS line FROM p),
    f AS (SELECT *, nullif(regexp_extract(line, '^\\s*(?:Answer|उत्तर)\\s*[-–—:]*\\s*\\(?\\s*([A-Ea-e*])\\s*\\)?\\s*[.।]?\\s*$', 1), '') AS letter, regexp_matches(line, '^[0-9]{{1,3}}\\.\\s+\\S') AS starts,
        regexp_matches(line, '^\\s*\\(\\s*[A-Ea-e]\\s*\\)\\s*\\S') AS opt FROM l),
    k AS (SELECT *, count(letter) OVER (PARTITION BY paper) >= 5 AS keyed, count(letter) OVER (PARTITION BY paper ORDER BY pos) - CASE WHEN letter IS NULL THEN 0 ELSE 1 END AS before, count(letter) OVER (PARTITION BY paper) AS n_letters FROM f),
    w AS (SELECT paper, pos, 0 AS block, CASE WHEN opt THEN 1 ELSE 0 END AS opts FROM k WHERE NOT keyed AND pos = 1
        UNION ALL SELECT k.paper, k.pos, w.block + CASE WHEN k.starts AND w.opts >= 4 THEN 1 ELSE 0 END, CASE WHEN k.starts AND w.opts >= 4 THEN 0 ELSE w.opts END + CASE WHEN k.opt THEN 1 ELSE 0 END FROM w JOIN k ON k.paper = w.paper AND k.pos = w.pos + 1),
    s AS (SELECT paper, pos, line, starts, opt, before AS segment FROM k WHERE keyed AND letter IS NULL AND before < n_letters
        UNION ALL SELECT k.paper, k.pos, line, starts, opt, block FROM k JOIN w ON w.paper = k.paper AND w.pos = k.pos),
    c AS (SELECT a.paper, a.segment, a.pos, any_value(a.line) AS first_line, count(*) FILTER (WHERE b.opt) AS opts,
        regexp_replace(regexp_replace(string_agg(regexp_replace(b.line, '\\s+$', ''), chr(10) ORDER BY b.pos) FILTER (WHERE trim(b.line) NOT IN ('Show Answer/Hide', 'Hide Answer', 'Show Answer')), '\\n{{3,}}', chr(10) || chr(10), 'g'), '\\n+$', '') AS body
        FROM s a JOIN s b ON a.paper = b.paper AND a.segment = b.segment AND b.pos >= a.pos WHERE a.starts GROUP BY a.paper, a.segment, a.pos),
    q AS (SELECT * FROM c WHERE opts >= 2 AND length(body) >= 30 AND length(regexp_replace(body, '[^\\x{{0904}}-\\x{{0939}}]', '', 'g')) >= 0.4 * length(regexp_replace(body, '[^\\p{{L}}]', '', 'g'))
        QUALIFY row_number() OVER (PARTITION BY paper, segment ORDER BY pos) = 1)
    SELECT q.paper, CAST(regexp_extract(first_line, '^[0-9]+') AS INTEGER) AS n, md5(body) AS body, nullif(lower(a.letter), '*') AS answer, CASE WHEN contains(body, 'सुमेलित') THEN 'match' ELSE 'plain' END AS format
    FROM q LEFT JOIN k a ON a.paper = q.paper AND a.keyed AND a.letter IS NOT NULL AND a.before = q.segment
    """


@add("tx19_segments", _SEGMENTS.replace("AS STRING", "AS VARCHAR"))
def tx19(spark, d):
    """The questions of every paper; a third of the papers have no answer lines."""
    return papers.questions(_papers(spark, d), ["paper"], "body").select("paper", "n", F.md5("text").alias("body"), "answer", "format")


#: A question's text with clean, repeated, missing, blank and garbled markers.
_MARKED = f"""concat(p_name, '?', CASE WHEN p_partkey % 5 = 0 THEN '' ELSE concat(chr(10), '(a) ', p_brand, chr(9), chr(9)) END, CASE p_partkey % 3 WHEN 0 THEN '(B)' WHEN 1 THEN '; इ )' ELSE '( b ) ' END, p_type, '     ',
    CASE WHEN p_partkey % 4 = 0 THEN ';ब)' ELSE '(c)' END, CASE WHEN p_partkey % 7 = 0 THEN '' ELSE cast(p_size AS STRING) END, CASE p_partkey % 6 WHEN 0 THEN '' WHEN 1 THEN '(a) again' WHEN 2 THEN ';क)last' ELSE ';घ) last' END)"""
_OPTION = "nullif(trim(regexp_extract(t, '\\(\\s*[{0}]\\s*\\)\\s*([^(]+)', 1)), '')"


@add("tx20_options", f"""WITH m AS (SELECT p_partkey, {_MARKED.replace('STRING', 'VARCHAR')} AS t FROM part),
    r AS (SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, ';\\s*इ\\s*\\)', '(b) ', 'g'), ';\\s*ब\\s*\\)', '(c) ', 'g'), ';\\s*[कघ]\\s*\\)', '(d) ', 'g'), '\\t+| {{4,}}', '  ', 'g') AS t FROM m)
    SELECT p_partkey, rtrim(split_part(t, '(', 1), ' ' || chr(10)) AS stem, concat_ws('|', {', '.join(_OPTION.format(c + c.upper()) for c in 'abcd')}) AS options FROM r""")
def tx20(spark, d):
    split = table(spark, d, "part").select("p_partkey", papers.options_of(F.expr(_MARKED)).alias("q"))
    return split.select("p_partkey", "q.stem", F.array_join("q.options", "|").alias("options"))


#: Lines that begin with some letters become headings, some of them noise.
_BOOK = "regexp_replace(regexp_replace(text, '(^|\\n)T', '\\1# Note T', 'g'), '(^|\\n)([A-S])', '\\1##  \\2', 'g')"
_FLAT = "trim(regexp_replace({}, '[\\s\\x{{00A0}}]+', ' ', 'g'))"
_HEADINGS = f"""b AS (SELECT doc_id, {_BOOK} AS src FROM documents), l AS (SELECT doc_id, src, unnest(range(1, len(string_split(src, chr(10))) + 1)) AS pos, unnest(string_split(src, chr(10))) AS line FROM b),
    o AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS chars FROM l),
    h AS (SELECT doc_id, length({_FLAT.format('substr(src, 1, CAST(chars AS BIGINT))')}) AS place, length(regexp_extract(line, '^#{{1,4}}')) AS level, {_FLAT.format("regexp_extract(line, '^#{1,4}[[:space:]]*(.+)$', 1)".replace('{', '{{').replace('}', '}}')).replace('{{', '{').replace('}}', '}')} AS title FROM o WHERE starts_with(line, '#')),
    t AS (SELECT * FROM h WHERE title <> '' AND length(title) <= 90 AND NOT regexp_matches(title, '^(?i)(UNIT\\s*\\d|Table|Summing\\s*Up|[0-9]+\\.\\s|Lecture\\s*\\W?\\s*\\d|Short\\s*Trick|Note|Practice)'))"""


def _books(spark, d) -> DataFrame:
    src = F.regexp_replace(F.regexp_replace("text", "(^|\n)T", "$1# Note T"), "(^|\n)([A-S])", "$1##  $2")
    return table(spark, d, "documents").select("doc_id", texts.composed(src).alias("src"))


@add("tx43_headings", f"WITH {_HEADINGS} SELECT doc_id, CAST(place AS BIGINT) AS place, CAST(level AS BIGINT) AS level, title FROM t")
def tx43(spark, d):
    found = _books(spark, d).select("doc_id", F.explode(papers.headings(F.col("src"))).alias("h"))
    return found.select("doc_id", F.col("h.place").cast("long").alias("place"), F.col("h.level").cast("long").alias("level"), "h.title")


#: Passages of 1,200 characters, 1,000 apart, with doubled blanks; one of seven isn't from its book.
_PASSAGES = "SELECT doc_id, i AS nth, concat(CASE WHEN (doc_id + i) % 7 = 0 THEN 'zz' ELSE '' END, replace(substr(src, i * 1000 + 1, 1200), ' ', '  ')) AS passage FROM (SELECT doc_id, src, unnest(range(0, 1 + length(src) // 1000)) AS i FROM b)"
_SECTIONS = f"""WITH {_HEADINGS}, p AS ({_PASSAGES}), f AS (SELECT doc_id, {_FLAT.format('src')} AS flat FROM b),
    a AS (SELECT doc_id, nth, position(substr({_FLAT.format('passage')}, 1, 150) IN flat) - 1 AS place FROM p JOIN f USING (doc_id))"""


def _sections(spark, d) -> DataFrame:
    books = _books(spark, d)
    starts = F.explode(F.sequence(F.lit(0), F.floor(F.length("src") / 1000).cast("int")))
    cut = books.select("doc_id", "src", starts.alias("nth")).select("doc_id", "nth", F.replace(F.substr("src", F.col("nth") * 1000 + 1, F.lit(1200)), F.lit(" "), F.lit("  ")).alias("cut"))
    passages = cut.select("doc_id", "nth", F.concat(F.when((F.col("doc_id") + F.col("nth")) % 7 == 0, "zz").otherwise(""), "cut").alias("passage"))
    return papers.sections(passages, books, "doc_id", "nth", "passage", "src")


@add("tx44_passage_offset", f"{_SECTIONS} SELECT doc_id, CAST(nth AS BIGINT) AS nth, CAST(place AS BIGINT) AS place FROM a")
def tx44(spark, d):
    """Where each passage stands in its book's squeezed text, -1 where it doesn't."""
    return _sections(spark, d).select("doc_id", F.col("nth").cast("long").alias("nth"), F.col("place").cast("long").alias("place"))


@add("tx44_section_of_passage", f"{_SECTIONS} SELECT a.doc_id, CAST(nth AS BIGINT) AS nth, max_by(t.title, t.place) AS section FROM a LEFT JOIN t ON t.doc_id = a.doc_id AND t.place <= a.place AND a.place >= 0 GROUP BY 1, 2")
def section_of_passage(spark, d):
    """Each passage with the title of the last heading at or before it."""
    return _sections(spark, d).select("doc_id", F.col("nth").cast("long").alias("nth"), "section")
