"""Gates and builders of exam questions; the questions are derived from the parts, in both engines alike."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kiteloom.operators import gates
from kiteloom.plans.registry import Family
from kiteloom.plans.script import in_script
from kiteloom.sources.tables import table

FAMILY = Family("gates")
add = FAMILY.add

#: Columns of a question a part, with faults of all kinds in some.
_COLUMNS = {
    "stem": f"""CASE p_partkey % 11 WHEN 0 THEN 'क्या' WHEN 1 THEN concat({in_script('p_type')}, ' पाठ के अनुसार कौन है') WHEN 2 THEN concat(p_type, ' is which of these') WHEN 3 THEN concat({in_script('p_type')}, ' क्ा कौन')
        WHEN 4 THEN concat({in_script('p_type')}, 'ab कौन') WHEN 5 THEN concat({in_script('p_type')}, ' 7370 कौन') WHEN 6 THEN concat({in_script('p_type')}, ' 4000 ई० पू० कौन') WHEN 7 THEN concat({in_script('p_type')}, ' का logo और image')
        ELSE concat({in_script('p_type')}, ' ', {in_script('p_name')}, ' कौन') END""",
    "o1": in_script("p_brand"), "o2": in_script("p_type"), "o3": in_script("p_name"),
    "o4": f"CASE p_partkey % 7 WHEN 0 THEN concat(' ', {in_script('p_brand')}) WHEN 1 THEN ' ' WHEN 2 THEN '1857' WHEN 3 THEN concat(CAST(p_size AS STRING), ' km') WHEN 4 THEN '(क)' ELSE concat('अन्य ', {in_script('p_name')}) END",
    "answer": "CASE p_partkey % 9 WHEN 0 THEN 'e' WHEN 1 THEN 'B' WHEN 2 THEN '' ELSE 'a' END",
    "format": "CASE p_partkey % 5 WHEN 0 THEN 'plain' WHEN 1 THEN 'match' WHEN 2 THEN 'statement' WHEN 4 THEN 'order' END",
    "reason": f"CASE WHEN p_partkey % 17 = 0 THEN 'तालिका में लिखा है' ELSE {in_script('p_name')} END",
}
_DERIVED = "SELECT p_partkey, p_size, p_name, " + ", ".join(f"{e} AS {n}" for n, e in _COLUMNS.items()) + ", p_partkey % 13 = 0 AS three, p_partkey % 2 = 0 AS said, p_partkey % 4 AS pairs FROM part"
_DUCK = _DERIVED.replace("AS STRING", "AS VARCHAR")


def _questions(spark, d) -> DataFrame:
    table(spark, d, "part").createOrReplaceTempView("part")
    rows = spark.sql(_DERIVED)
    options = F.when(F.col("three"), F.array("o1", "o2", "o3")).otherwise(F.array("o1", "o2", "o3", "o4"))
    said = F.when(F.col("said"), F.array("o3", "o2"))
    right = lambda i: F.concat(F.lit(f"{i}. "), F.when((F.col("pairs") == 1) & F.lit(i == 2), "1857").otherwise(F.col("o3")))
    match = F.when(F.col("pairs") > 0, F.array(*[F.array(F.col("o2"), right(i)) for i in (1, 2, 3, 4)]))
    return rows.withColumns({"options": options, "statements": said, "match": match})


_SCRIPT_LETTERS = "[^\\x{0904}-\\x{0939}\\x{093D}\\x{0950}\\x{0958}-\\x{0961}\\x{0971}-\\x{097F}]"


def _share(t: str) -> str:
    return f"coalesce(length(regexp_replace({t}, '{_SCRIPT_LETTERS}', '', 'g'))::DOUBLE / nullif(length(regexp_replace({t}, '[^\\p{{L}}]', '', 'g')), 0), 0.0)"


def _shape(t: str) -> str:
    return f"CASE WHEN regexp_matches(trim({t}), '{gates.SHAPE_YEAR}') THEN 'year' WHEN regexp_matches(trim({t}), '{gates.SHAPE_NUMBER}') OR regexp_matches(trim({t}), '(?i){gates.SHAPE_MEASURE}') THEN 'number' WHEN {_share(f'trim({t})')} >= 0.5 THEN 'd' ELSE 'l' END"


def _odd(items: str) -> str:
    kinds = f"list_transform({items}, lambda t: {_shape('t')})"
    return f"(len({items}) = 4 AND len(list_filter({kinds}, lambda c: len(list_filter({kinds}, lambda x: x = c)) = 1)) > 0)"


_LISTED = f"""q AS (SELECT *, CASE WHEN three THEN [o1, o2, o3] ELSE [o1, o2, o3, o4] END AS options, CASE WHEN said THEN [o3, o2] ELSE [] END AS statements,
    CASE WHEN pairs > 0 THEN ['1. ' || o3, '2. ' || CASE WHEN pairs = 1 THEN '1857' ELSE o3 END, '3. ' || o3, '4. ' || o3] ELSE [] END AS rights FROM ({_DUCK})),
    w AS (SELECT *, array_to_string(list_concat([stem], statements, list_transform(rights, lambda r: o2 || ' ' || r)), ' ') AS whole, list_concat([stem, reason], options, statements, rights) AS fields FROM q)"""
_REFS = " OR ".join(f"contains(stem, '{r}') OR contains(reason, '{r}')" for r in gates.MATERIAL_REFS)
_DAMAGE = "|".join(f"(?:{p})" for _, p in gates.SIGNATURES)
_GATE = f"""WITH {_LISTED}, y AS (SELECT *, list_transform(regexp_extract_all(regexp_replace(whole || ' ' || array_to_string(options, ' '), '\\b[1-9][0-9]{{3}}\\s*ई[.०]?\\s*पू', '', 'g'), '\\b[1-9][0-9]{{3}}\\b'), lambda y: CAST(y AS INTEGER)) AS years FROM w)
  SELECT p_partkey, CASE WHEN length(trim(stem)) < 15 THEN 'short_stem' WHEN {_REFS} THEN 'cites_material' WHEN {_share('whole')} < 0.5 THEN 'not_in_script' WHEN three THEN 'option_count' WHEN trim(o4) = '' THEN 'blank_option'
    WHEN len(list_distinct(list_transform(options, lambda o: lower(trim(o))))) < 4 THEN 'repeated_option' WHEN len(list_filter(fields, lambda t: regexp_matches(t, '{_DAMAGE}'))) > 0 THEN 'garbled'
    WHEN len(list_filter(fields, lambda t: regexp_matches(t, '{gates.MIXED_SCRIPT}'))) > 0 THEN 'mixed_script' WHEN lower(answer) NOT IN ('a', 'b', 'c', 'd') THEN 'answer_letter'
    WHEN coalesce(format, 'plain') = 'plain' AND {_odd('options')} THEN 'odd_option' WHEN format = 'match' AND len(rights) <> 4 THEN 'match_rows'
    WHEN format = 'match' AND {_odd("list_transform(rights, lambda r: substr(r, 4))")} THEN 'odd_match' WHEN format IN ('statement', 'order') AND len(statements) = 0 THEN 'no_statements'
    WHEN len(list_filter(years, lambda y: y < 600 OR y > 2026)) > 0 THEN 'implausible_year' END AS reason FROM y"""


@add("qg1_first_failing", _GATE)
def qg1(spark, d):
    q = _questions(spark, d)
    return q.select("p_partkey", gates.question_gate(*map(F.col, ("stem", "options", "answer", "format", "reason", "statements", "match"))).alias("reason"))


@add("tx17_first_signature", f"SELECT p_partkey, CASE {' '.join(f'WHEN regexp_matches(t, {chr(39)}{p}{chr(39)}) THEN {chr(39)}{n}{chr(39)}' for n, p in gates.SIGNATURES)} END AS signature FROM (SELECT p_partkey, translate(p_name || ' ' || p_type, 'aeiAEOR ', '्ाी॒<>क ') AS t FROM part)")
def tx17(spark, d):
    """The first damage in a name whose letters stand for signs."""
    signs = F.translate(F.concat("p_name", F.lit(" "), "p_type"), "aeiAEOR ", "्ाी॒<>क ")
    return table(spark, d, "part").select("p_partkey", gates.signature(signs).alias("signature"))


#: Options that are markers only, in some, or the same text twice.
_SHORT = "CASE p_partkey % 6 WHEN 0 THEN {a} WHEN 1 THEN {b} ELSE {c} END"
_EXTRACTED = [_SHORT.format(a=f"'({r})'", b=f"' {p} '", c=f"o{i}") for i, (r, p) in enumerate(zip("abcd", "बफवम", strict=True), 1)]
_CORES = "list_transform(options, lambda o: trim(regexp_replace(trim(o), '^[().\\[\\]। :-]+|[().\\[\\]। :-]+$', '', 'g')))"


@add("qg3_extraction_gate", f"""WITH {_LISTED.split(', w AS', 1)[0].rstrip().rstrip(',')}, x AS (SELECT p_partkey, stem, CASE WHEN three THEN [{', '.join(_EXTRACTED[:3])}] ELSE [{', '.join(_EXTRACTED)}] END AS options FROM q), k AS (SELECT *, {_CORES} AS cores FROM x)
  SELECT p_partkey, CASE WHEN length(trim(stem)) < 8 THEN 'short_stem' WHEN contains(stem, 'logo') AND contains(stem, 'image') THEN 'cover_page' WHEN len(options) <> 4 THEN 'option_count' WHEN len(list_filter(options, lambda o: trim(o) = '')) > 0 THEN 'blank_option'
    WHEN len(list_filter(cores, lambda c: length(c) > 1)) = 0 AND (len(list_distinct(cores)) < len(cores) OR array_to_string(cores, '') IN ('अबसद', 'abcd', 'ABCD', 'कखगघ')) THEN 'placeholders'
    WHEN len(list_filter(cores, lambda c: length(c) = 1 AND contains('{gates.LABEL_LETTERS}', c))) BETWEEN 1 AND 3 THEN 'label_letter' WHEN len(list_distinct(list_transform(options, lambda o: trim(o)))) < 4 THEN 'repeated_option' END AS reason FROM k""")
def qg3(spark, d):
    made = [F.expr(e) for e in _EXTRACTED]
    q = _questions(spark, d).withColumn("options", F.when(F.col("three"), F.array(*made[:3])).otherwise(F.array(*made)))
    return q.select("p_partkey", gates.extraction_gate(F.col("stem"), F.col("options")).alias("reason"))


def _shuffle(items: str, n: str, salt: str) -> str:
    """SQL: a list in the order of md5 of "key|salt|place"."""
    keys = f"list_sort(list_transform(range(0, CAST({n} AS BIGINT)), lambda i: md5(p_partkey || '|{salt}|' || i) || i))"
    return f"list_transform({keys}, lambda k: ({items})[CAST(substr(k, 33) AS INTEGER) + 1])"


_OTHERS = "[" + ", ".join(f"'{''.join(map(str, p))}'" for p in permutations((1, 2, 3, 4)) if p != (1, 2, 3, 4)) + "]"


def _coded(joint: str) -> str:
    """SQL: codes and the right one, of a shuffled list ``display`` of places."""
    spaced = f"regexp_replace(c, '(.)(.)(.)(.)', '\\1{joint}\\2{joint}\\3{joint}\\4')"
    return f"""codes AS (SELECT *, list_position(display, 0) || '' || list_position(display, 1) || list_position(display, 2) || list_position(display, 3) AS correct FROM (SELECT *, {_shuffle('[0, 1, 2, 3]', '4', 'display')} AS display FROM q0)),
        picked AS (SELECT *, list_append(({_shuffle(f"list_filter({_OTHERS}, lambda p: p <> correct)", f"len(list_filter({_OTHERS}, lambda p: p <> correct))", 'codes')})[1:3], correct) AS four FROM codes),
        done AS (SELECT *, list_transform({_shuffle('four', '4', 'options')}, lambda c: {spaced}) AS built, (SELECT {spaced} FROM (SELECT correct AS c)) AS hit FROM picked)"""


_ITEMS = "[o1, o2, o3, 'अन्य ' || o3]"
_BASE = f"q0 AS (SELECT *, p_partkey % 5 AS kind FROM ({_DUCK}))"
_LETTER = "substr('abcd', CAST(list_position(built, hit) AS BIGINT), 1)"
_SETS = "[[0], [1], [2], [0, 1], [0, 2], [1, 2], [0, 1, 2]]"
_LABEL = "CASE WHEN len(s) = 0 THEN 'इनमें से कोई नहीं' WHEN len(s) = n THEN 'उपर्युक्त सभी' ELSE 'केवल ' || array_to_string(list_transform(s, lambda i: i + 1), ' और ') END"
_PLAIN = f"SELECT p_partkey, kind, [] AS shown, built, {_LETTER} AS letter, CASE WHEN three THEN 'option_count' WHEN trim(o4) = '' THEN 'blank_option' END AS error FROM (SELECT *, {_shuffle('l', '4', 'options')} AS built, l[p_size % 4 + 1] AS hit FROM (SELECT *, [o1, o2, o3, CASE WHEN o4 = '(क)' THEN o4 ELSE trim(o4) END] AS l FROM q0 WHERE kind = 0))"
_ORDER = f"SELECT p_partkey, kind, list_transform(range(0, 4), lambda n: (n + 1) || '. ' || ({_ITEMS})[display[n + 1] + 1]) AS shown, built, {_LETTER}, NULL FROM done WHERE kind = 1"
_MATCH = f"SELECT p_partkey, kind, list_transform(range(0, 4), lambda n: substr('abcd', n + 1, 1) || '. ' || (['w', 'x', 'y', 'z'])[n + 1] || ' | ' || (n + 1) || '. ' || ({_ITEMS})[display[n + 1] + 1]), built, {_LETTER}, NULL FROM done WHERE kind = 2"
_STATEMENT = f"""SELECT p_partkey, kind, stmts, built, {_LETTER}, CASE WHEN len(held) = 0 OR len(held) = n THEN 'all_or_none_true' END FROM (SELECT *, {_shuffle('labels', '4', 'options')} AS built, (SELECT {_LABEL} FROM (SELECT held AS s)) AS hit FROM
    (SELECT *, list_transform(cands[1:4], lambda s: {_LABEL}) AS labels FROM (SELECT *, list_concat([held], list_filter(list_filter({_SETS}, lambda s: list_max(s) < n), lambda s: s <> held), CASE WHEN n = 2 AND len(held) > 0 THEN [[]] ELSE [] END) AS cands FROM
    (SELECT *, len(stmts) AS n, list_filter(list_sort(list_distinct([p_size % 4, p_partkey % 3])), lambda i: i < len(stmts)) AS held FROM (SELECT *, CASE WHEN said THEN [o1, o2] ELSE [o1, o2, o3] END AS stmts FROM q0 WHERE kind = 3)))))"""
_RELATIONS = "[" + ", ".join(f"'{v}'" for v in gates.RELATIONS.values()) + "]"
_ASSERTION = f"SELECT p_partkey, kind, ['अभिकथन (A) : ' || o1, 'कारण (R) : ' || CASE WHEN three THEN o1 ELSE o2 END], {_RELATIONS}, substr('abcd', p_size % 4 + 1, 1), CASE WHEN three THEN 'same_claim' END FROM q0 WHERE kind = 4"
_BUILT = f"""WITH {_BASE}, {_coded(', ')}, a AS ({_PLAIN} UNION ALL {_ORDER}), {_coded('  ').replace('codes AS', 'codes2 AS').replace('FROM codes)', 'FROM codes2)').replace('picked AS', 'picked2 AS').replace('FROM picked)', 'FROM picked2)').replace('done AS', 'done2 AS')},
  b AS (SELECT * FROM a UNION ALL {_MATCH.replace('FROM done', 'FROM done2')} UNION ALL {_STATEMENT} UNION ALL {_ASSERTION})
  SELECT p_partkey, CAST(kind AS BIGINT) AS kind, error, CASE WHEN error IS NULL THEN array_to_string(shown, chr(10)) ELSE '' END AS statements, CASE WHEN error IS NULL THEN array_to_string(built, chr(10)) ELSE '' END AS options, CASE WHEN error IS NULL THEN letter END AS answer FROM b"""


@add("qg5_format_builder", _BUILT)
def qg5(spark, d):
    """A question a part in one of the five formats, or why it can't be built."""
    q = _questions(spark, d)
    seed = F.col("p_partkey").cast("string")
    items = F.array("o1", "o2", "o3", F.concat(F.lit("अन्य "), "o3"))
    right = (F.col("p_size") % 4).cast("int")
    said = F.when(F.col("said"), F.array("o1", "o2")).otherwise(F.array("o1", "o2", "o3"))
    true = F.array(right, (F.col("p_partkey") % 3).cast("int"))
    relation = F.get(F.array(*map(F.lit, gates.RELATIONS)), right)
    built = (
        F.when(F.col("p_partkey") % 5 == 0, gates.build_plain(F.col("options"), right, seed)).when(F.col("p_partkey") % 5 == 1, gates.build_order(items, seed))
        .when(F.col("p_partkey") % 5 == 2, gates.build_match(F.array(*map(F.lit, "wxyz")), items, seed)).when(F.col("p_partkey") % 5 == 3, gates.build_statement(said, true, seed))
        .otherwise(gates.build_assertion(F.col("o1"), F.when(F.col("three"), F.col("o1")).otherwise(F.col("o2")), relation))
    )
    made = q.select("p_partkey", (F.col("p_partkey") % 5).alias("kind"), built.alias("b"))
    return made.select("p_partkey", "kind", "b.error", F.array_join("b.statements", "\n").alias("statements"), F.array_join("b.options", "\n").alias("options"), "b.answer")


_MARKERS = ["stated in", "प्रश्न में"]
_SOLUTION = "CASE p_partkey % 8 WHEN 0 THEN '' WHEN 1 THEN 'यह उल्लेख नहीं है' WHEN 2 THEN concat(o1, ' सही है।') WHEN 3 THEN 'It is Stated in the book at length' ELSE concat(o1, ' was known for ', reason, ' everywhere') END"


@add("qg7_marked_answers", f"""WITH {_LISTED.split(', w AS', 1)[0].rstrip().rstrip(',')}, s AS (SELECT p_partkey, options, o1, lower(trim(answer)) AS letter, CASE p_size % 3 WHEN 0 THEN 'High' WHEN 1 THEN 'low' END AS confidence, trim({_SOLUTION}) AS said FROM q),
  f AS (SELECT *, lower(confidence) = 'high' AND letter IN ('a', 'b', 'c', 'd') AND said <> '' AND NOT contains(said, 'उल्लेख नहीं') AND NOT contains(said, 'नहीं है') AS fine, trim(options[ascii(letter) - 96]) AS opt FROM s)
  SELECT p_partkey, letter AS answer, CASE WHEN contains(lower(said), 'stated in') OR contains(said, 'प्रश्न में') OR (contains(said, opt) AND opt <> '' AND length(trim(replace(said, opt, ''), ' ।."''-—:')) < 12) THEN '' ELSE said END AS solution FROM f WHERE fine""")
def qg7(spark, d):
    """The questions that an answer may be marked in, with it and its solution."""
    confidence = F.when(F.col("p_size") % 3 == 0, "High").when(F.col("p_size") % 3 == 1, "low")
    marked = _questions(spark, d).select("p_partkey", gates.grounded_answer(confidence, F.col("answer"), F.expr(_SOLUTION), F.col("options"), _MARKERS).alias("m"))
    return marked.filter("m IS NOT NULL").select("p_partkey", "m.answer", "m.solution")


@add("qg8_verdict", """SELECT l_orderkey, CASE WHEN count(*) FILTER (WHERE l_returnflag <> 'N') = 0 THEN 'failed' WHEN count(DISTINCT l_suppkey) FILTER (WHERE l_returnflag <> 'N') >= 2 AND max(CASE l_linestatus WHEN 'F' THEN 1 ELSE 0 END) = 1 THEN 'confirmed' ELSE 'weak' END AS verdict FROM lineitem GROUP BY l_orderkey""")
def qg8(spark, d):
    """Orders as answers: returned lines are verdicts, their suppliers the sources; a closed line makes them sure."""
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.when(F.col("l_returnflag") != "N", F.col("l_suppkey").cast("string"))).alias("sources"), F.max(F.when(F.col("l_linestatus") == "F", "high")).alias("confidence"))
    given = F.size("sources") > 0
    return lines.select("l_orderkey", gates.verdict(given, F.col("sources"), F.coalesce("confidence", F.lit("low"))).alias("verdict"))
