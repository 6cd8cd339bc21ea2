"""Planning, quality-gate and puzzle queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kiteloom.operators import folds, planning, puzzles, sequences
from kiteloom.operators.generators import question_blocks
from kiteloom.operators.ranking import rank_within
from kiteloom.plans.registry import Family
from kiteloom.sources.tables import table

FAMILY = Family("planning")
add, sql = FAMILY.add, FAMILY.sql

_ALLOCATE = """WITH s AS (SELECT p_brand, p_type, count(*) AS share FROM part GROUP BY 1, 2), i AS (SELECT *, CAST(share AS DOUBLE) / sum(CAST(share AS DOUBLE)) OVER (PARTITION BY p_brand) * 40 AS ideal FROM s),
  b AS (SELECT *, CAST(floor(ideal) AS BIGINT) AS base FROM i), l AS (SELECT *, 40 - sum(base) OVER (PARTITION BY p_brand) AS spare, row_number() OVER (PARTITION BY p_brand ORDER BY round(ideal - base, 9) DESC, share DESC, p_type) AS nth FROM b)
  SELECT p_brand, p_type, CAST(base + CASE WHEN nth <= spare THEN 1 ELSE 0 END AS BIGINT) AS n FROM l"""


def _allocated(spark, d):
    shares = table(spark, d, "part").groupBy("p_brand", "p_type").agg(F.count(F.lit(1)).alias("share"))
    return planning.largest_remainder(shares, ["p_brand"], "p_type", "share", F.lit(40)).select("p_brand", "p_type", "n")


@add("pl1_largest_remainder", _ALLOCATE)
def pl1(spark, d):
    return _allocated(spark, d)


#: A mix a part, of up to three keys; one of five has no number for a key.
_MIX = "concat('plain:', CAST(p_size AS STRING), ', match :', CAST(p_partkey % 7 AS STRING), CASE p_partkey % 5 WHEN 0 THEN ',order:x' WHEN 1 THEN ',order:-1' WHEN 2 THEN ', order:0.5' WHEN 3 THEN '' ELSE ',order:2' END)"


@add("pl2_parse_mix", """WITH m AS (SELECT p_partkey, p_size::DOUBLE AS a, (p_partkey % 7)::DOUBLE AS b, CASE p_partkey % 5 WHEN 1 THEN -1 WHEN 2 THEN 0.5 WHEN 4 THEN 2 END::DOUBLE AS c FROM part WHERE p_partkey % 5 <> 0)
  SELECT p_partkey, key, value / (a + b + coalesce(c, 0)) AS share FROM (SELECT *, 'plain' AS key, a AS value FROM m UNION ALL SELECT *, 'match', b FROM m UNION ALL SELECT *, 'order', c FROM m WHERE c IS NOT NULL) WHERE a + b + coalesce(c, 0) > 0""")
def pl2(spark, d):
    mixes = table(spark, d, "part").select("p_partkey", F.expr(_MIX).alias("mix"))
    return mixes.select("p_partkey", F.explode(planning.parse_mix(F.col("mix"))).alias("key", "share"))


#: Shares of difficulties, and 40 places a brand; formats are allocated by type, too few for some brands and too many for others.
_LEVELS = {"easy": 0.5, "moderate": 0.3, "hard": 0.2}
_AXES = f"""WITH f AS (SELECT p_brand, p_type AS key, CASE WHEN contains(p_brand, '1') THEN n // 2 ELSE n + 1 END AS n FROM ({_ALLOCATE})), h AS (SELECT p_brand, sum(n) AS have FROM f GROUP BY 1),
  p AS (SELECT p_brand, key, n FROM f UNION ALL SELECT p_brand, 'plain', greatest(40 - have, 0) FROM h), e AS (SELECT p_brand, key, unnest(range(1, CAST(n AS BIGINT) + 1)) AS copy FROM p),
  a AS (SELECT p_brand, key, row_number() OVER (PARTITION BY p_brand ORDER BY md5('9|first|' || p_brand || '|' || key || '|' || copy)) AS place FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY key, copy) AS kept FROM e) WHERE kept <= 40),
  s AS (SELECT p_brand, key, unnest(range(1, n + 1)) AS copy FROM (SELECT DISTINCT p_brand FROM part), (VALUES ('easy', 20), ('moderate', 12), ('hard', 8)) v(key, n)),
  b AS (SELECT p_brand, key, row_number() OVER (PARTITION BY p_brand ORDER BY md5('9|second|' || p_brand || '|' || key || '|' || copy)) AS place FROM s)
  SELECT a.p_brand, a.place, a.key AS format, b.key AS difficulty FROM a JOIN b USING (p_brand, place)"""


@add("pl3_expand_plan", _AXES)
def pl3(spark, d):
    """Formats and difficulties of 40 places a brand, each with its own counts."""
    allocated = _allocated(spark, d)
    lean = F.col("p_brand").contains("1")
    formats = allocated.select("p_brand", F.col("p_type").alias("key"), F.when(lean, F.floor(F.col("n") / 2)).otherwise(F.col("n") + 1).alias("n"))
    plans = allocated.select("p_brand").distinct().withColumn("count", F.lit(40))
    shares = plans.select("p_brand", "count", F.explode(F.create_map(*[F.lit(x) for kv in _LEVELS.items() for x in kv])).alias("key", "share"))
    levels = planning.largest_remainder(shares, ["p_brand"], "key", "share", F.col("count")).select("p_brand", "key", "n")
    planned = planning.two_axes(plans, "p_brand", formats, levels, "count", "plain", 9)
    return planned.select("p_brand", "place", F.col("first").alias("format"), F.col("second").alias("difficulty"))


sql("pl4_grouped_plan", "SELECT p_type, count(*) AS n, count(DISTINCT p_brand) AS brands FROM part GROUP BY p_type")

_CHUNKS = """WITH RECURSIVE t AS (SELECT source AS grp, doc_id AS id, n_chars AS size, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM documents),
 f AS (SELECT grp, id, i, 0 AS chunk, size AS total, 1 AS number FROM t WHERE i = 1 UNION ALL
   SELECT t.grp, t.id, t.i, f.chunk + CASE WHEN f.total + t.size > 20000 OR f.number >= 6 THEN 1 ELSE 0 END,
     CASE WHEN f.total + t.size > 20000 OR f.number >= 6 THEN t.size ELSE f.total + t.size END, CASE WHEN f.total + t.size > 20000 OR f.number >= 6 THEN 1 ELSE f.number + 1 END
   FROM f JOIN t ON t.grp = f.grp AND t.i = f.i + 1) SELECT grp, id, chunk FROM f"""


@add("pl5_budget_chunks", _CHUNKS)
def pl5(spark, d):
    rows = table(spark, d, "documents").select(F.col("source").alias("grp"), F.col("doc_id").alias("id"), F.col("n_chars").alias("size"))
    return folds.budget_chunks(rows, 20000, 6)


_TOP_UP = """WITH RECURSIVE a AS (SELECT doc_id, lang, source, quality, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) AS nth FROM documents JOIN labels USING (doc_id)),
  g AS (SELECT lang, source, count(*) FILTER (WHERE nth <= 5 AND quality = 0) AS gap0 FROM a GROUP BY 1, 2), s AS (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) AS i FROM a WHERE nth > 5),
  r1 AS (SELECT s.*, g.gap0 FROM s JOIN g USING (lang, source) WHERE i <= gap0), g1 AS (SELECT lang, source, gap0, gap0 - count(r1.doc_id) FILTER (WHERE quality = 1) AS gap1 FROM g LEFT JOIN r1 USING (lang, source, gap0) GROUP BY 1, 2, 3),
  r2 AS (SELECT s.* FROM s JOIN g1 USING (lang, source) WHERE i > gap0 AND i <= gap0 + gap1)
  SELECT lang, source, doc_id, 1 AS round, quality = 1 AS kept FROM r1 UNION ALL SELECT lang, source, doc_id, 2, quality = 1 FROM r2"""


@add("pl6_top_up", _TOP_UP)
def pl6(spark, d):
    """Of the first five of each language and source, the bad ones are made up for in two rounds at most."""
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select("doc_id", "lang", "source", (F.col("quality") == 1).alias("good"), F.concat_ws("\n", "lang", "source").alias("slot"))
    nth = rank_within(rows, "slot", ["doc_id"], "nth")
    gaps = nth.filter("nth <= 5 AND NOT good").groupBy("slot").agg(F.count(F.lit(1)).alias("gap"))
    spare = nth.filter("nth > 5").withColumn("i", F.col("nth") - 5).drop("nth")
    return planning.topped_up(gaps, spare, "slot", rounds=2).select("lang", "source", "doc_id", "round", F.col("good").alias("kept"))


_GUARD = """WITH RECURSIVE t AS (SELECT p_brand AS paper, p_partkey AS id, p_type AS stem, CASE WHEN p_partkey % 4 = 0 THEN p_name ELSE CAST(p_size AS VARCHAR) END AS answer, p_partkey % 4 <> 0 AS numeric, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS i FROM part),
 f AS (SELECT paper, id, i, CAST(NULL AS VARCHAR) AS reason, [stem] AS stems, [answer] AS answers, CASE WHEN numeric THEN 1 ELSE 0 END AS n FROM t WHERE i = 1 UNION ALL
   SELECT paper, id, i, reason, CASE WHEN reason IS NULL THEN list_append(stems, stem) ELSE stems END, CASE WHEN reason IS NULL THEN list_append(answers, answer) ELSE answers END, n + CASE WHEN reason IS NULL AND numeric THEN 1 ELSE 0 END
   FROM (SELECT t.*, f.stems, f.answers, f.n, CASE WHEN list_contains(f.stems, t.stem) THEN 'duplicate_stem' WHEN list_contains(f.answers, t.answer) THEN 'repeated_answer' WHEN t.numeric AND f.n >= 4 THEN 'numeric_cap' END AS reason FROM f JOIN t ON t.paper = f.paper AND t.i = f.i + 1))
 SELECT paper, id, reason FROM f"""


@add("qg2_paper_guard", _GUARD)
def qg2(spark, d):
    """A paper a brand, of 20 planned questions; three of four answers are numbers."""
    named = F.col("p_partkey") % 4 == 0
    answer = F.when(named, F.col("p_name")).otherwise(F.col("p_size").cast("string"))
    rows = table(spark, d, "part").select(F.col("p_brand").alias("paper"), F.col("p_partkey").alias("id"), F.col("p_type").alias("stem"), answer.alias("answer"), (~named).alias("numeric"), F.lit(20).alias("planned"))
    return folds.paper_guard(rows)


sql("qg4_structural_gate", "SELECT count(*) AS kept, count(*) = 0 AS failed FROM part WHERE length(trim(p_name)) >= 3 AND p_type IS NOT NULL AND p_size BETWEEN 1 AND 50")


@add("qg6_first_reply", "SELECT conv_id, CAST(n AS BIGINT) AS section, min_by(md5(text), turn) AS stem FROM (SELECT conv_id, turn, text, (turn * 7 + conv_id) % 5 AS n, max(turn) OVER (PARTITION BY conv_id) AS last FROM conversations) WHERE n BETWEEN 1 AND least(3, last) GROUP BY conv_id, n")
def qg6(spark, d):
    """Each conversation as one JSON reply, whose turns name sections 0 to 4 of up to three."""
    turns = table(spark, d, "conversations").select("conv_id", "turn", F.struct(((F.col("turn") * 7 + F.col("conv_id")) % 5).alias("section_number"), F.md5("text").alias("stem")).alias("q"))
    listed = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "q"))).alias("l"), F.max("turn").alias("last"))
    replies = listed.select("conv_id", "last", F.to_json(F.struct(F.col("l.q").alias("questions"))).alias("raw"))
    return planning.batch_replies(replies, ["conv_id"], "raw", F.least(F.lit(3), F.col("last")), ["stem"])


sql("qg9_drop_reasons", "SELECT reason, count(*) AS n FROM (SELECT CASE WHEN n_chars < 100 THEN 'short' WHEN n_chars > 15000 THEN 'long' ELSE 'kept' END AS reason FROM documents) t GROUP BY reason")
sql("qg10_difficulty_lookup", "SELECT p_partkey, coalesce(a.text, b.text, 'normal') AS difficulty FROM part LEFT JOIN (SELECT * FROM (VALUES ('Brand#11', 'hard'), ('Brand#12', 'easy')) AS x(k, text)) a ON p_brand = a.k LEFT JOIN (SELECT * FROM (VALUES (1, 'tiny'), (50, 'huge')) AS y(k, text)) b ON p_size = b.k")


@add("rg1_displacement", "SELECT user_id, CAST(sum(CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN -1 ELSE 0 END) AS BIGINT) AS x, CAST(sum(CASE event_type WHEN 'error' THEN 1 WHEN 'signup' THEN -1 ELSE 0 END) AS BIGINT) AS y, round(sqrt(pow(sum(CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN -1 ELSE 0 END), 2) + pow(sum(CASE event_type WHEN 'error' THEN 1 WHEN 'signup' THEN -1 ELSE 0 END), 2)), 6) AS distance FROM events GROUP BY user_id")
def rg1(spark, d):
    compass = F.when(F.col("event_type") == "view", "E").when(F.col("event_type") == "click", "W").when(F.col("event_type") == "error", "N").when(F.col("event_type") == "signup", "S")
    legs = table(spark, d, "events").select("user_id", compass.alias("dir"), F.lit(1).alias("len"))
    return planning.displacement(legs, ["user_id"], "dir", "len").withColumn("distance", F.round("distance", 6))


_SERIES = "CASE p_partkey % 3 WHEN 0 THEN 'add' WHEN 1 THEN 'multiply' ELSE 'squares' END"


@add("rg2_series_term", f"SELECT p_partkey, CASE rule WHEN 'add' THEN p_size + 3.0 * 5 WHEN 'multiply' THEN p_size * pow(3.0, 5) ELSE p_size + 55.0 END::DOUBLE AS term FROM (SELECT p_partkey, p_size, {_SERIES} AS rule FROM part)")
def rg2(spark, d):
    return table(spark, d, "part").select("p_partkey", planning.series_term(F.expr(_SERIES), F.col("p_size"), F.lit(3.0), F.lit(6)).alias("term"))


_RULES = ["shift", "reverse", "double", "reverse_shift"]


@add("rg3_cipher", """WITH c AS (SELECT p_partkey, rule, list_transform(list_filter(string_split(upper(p_name), ''), lambda x: x BETWEEN 'A' AND 'Z'), lambda x: CASE rule WHEN 'shift' THEN ascii(x) - 64 + k WHEN 'reverse' THEN 91 - ascii(x) WHEN 'double' THEN 2 * (ascii(x) - 64) ELSE 91 - ascii(x) + k END) AS v
    FROM (SELECT p_partkey, p_name, p_size % 5 + 1 AS k FROM part), (VALUES ('shift'), ('reverse'), ('double'), ('reverse_shift')) r(rule))
  SELECT p_partkey, rule, array_to_string(v, '-') AS sequence, CAST(list_sum(v) AS VARCHAR) AS total FROM c""")
def rg3(spark, d):
    """Every part's name in all four ciphers, as a sequence and as a sum."""
    words = table(spark, d, "part").select("p_partkey", "p_name", (F.col("p_size") % 5 + 1).alias("k"), F.explode(F.array(*map(F.lit, _RULES))).alias("rule"))
    coded = words.select("p_partkey", "rule", puzzles.cipher_values(F.col("p_name"), F.col("rule"), F.col("k")).alias("v"))
    return coded.select("p_partkey", "rule", puzzles.cipher_code(F.col("v"), F.lit("sequence")).alias("sequence"), puzzles.cipher_code(F.col("v"), F.lit("sum")).alias("total"))


_KIN = {("father", "father"): "grandfather", ("father", "mother"): "grandmother", ("mother", "father"): "grandfather", ("father", "brother"): "uncle", ("mother", "brother"): "uncle"}


@add("rg4_walk_end", "SELECT start, r3.n AS stop FROM (SELECT n_nationkey AS start, (n_nationkey * 2 + 1) % 25 AS a FROM nation) r1, LATERAL (SELECT (a * 2 + 1) % 25 AS b) r2, LATERAL (SELECT CAST((b * 2 + 1) % 25 AS INTEGER) AS n) r3")
def rg4(spark, d):
    """The end of a path of three steps over an edge table, as equality joins."""
    edges = table(spark, d, "nation").select(F.col("n_nationkey").alias("a"), ((F.col("n_nationkey") * 2 + 1) % 25).alias("b"))
    at = edges.select(F.col("a").alias("start"), F.col("b").alias("stop"))
    for _ in range(2):
        at = at.join(edges, at["stop"] == edges["a"]).select("start", F.col("b").alias("stop"))
    return at


@add("rg5_role_composition", "SELECT s_suppkey, CASE WHEN a = 'father' AND b = 'father' THEN 'grandfather' WHEN a = 'father' AND b = 'mother' THEN 'grandmother' WHEN a = 'mother' AND b = 'father' THEN 'grandfather' WHEN b = 'brother' AND a <> 'brother' THEN 'uncle' END AS role FROM (SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'father' WHEN 1 THEN 'mother' ELSE 'brother' END AS a, CASE s_nationkey % 3 WHEN 0 THEN 'father' WHEN 1 THEN 'mother' ELSE 'brother' END AS b FROM supplier)")
def rg5(spark, d):
    role = lambda c: F.when(F.col(c) % 3 == 0, "father").when(F.col(c) % 3 == 1, "mother").otherwise("brother")
    path = F.array(role("s_suppkey"), role("s_nationkey"))
    return table(spark, d, "supplier").select("s_suppkey", planning.compose(path, _KIN).alias("role"))


#: Four points of each part at distances from its columns; the clues of some leave the answer open.
_GAPS = "p_size % 3 + 1 AS g1, CAST(p_partkey % 2 + 1 AS INT) AS g2, CAST(floor(p_partkey / 7) % 3 + 1 AS INT) AS g3"
_LAYOUTS = f"""WITH p AS (SELECT p_partkey, p_partkey % 4 AS kind, {_GAPS.replace('AS INT)', 'AS INTEGER)')} FROM part), s AS (SELECT *, g1 + g2 + g3 AS span FROM p),
  l AS (SELECT s.*, a, b, c, e FROM s, range(0, 10) x(a), range(0, 10) y(b), range(0, 10) z(c), range(0, 10) v(e)
    WHERE a <= span AND b <= span AND c <= span AND e <= span AND a <> b AND a <> c AND a <> e AND b <> c AND b <> e AND c <> e AND least(a, b, c, e) = 0 AND greatest(a, b, c, e) = span
    AND CASE kind WHEN 0 THEN abs(a - c) = g1 + g2 AND abs(b - e) = g2 + g3 AND b > least(a, c) AND b < greatest(a, c) WHEN 1 THEN abs(a - b) = g1 AND abs(c - e) = g3
      WHEN 2 THEN abs(a - b) = abs(c - e) + (g1 - g3) AND abs(a - c) = g1 + g2 AND b > least(a, c) AND b < greatest(a, c) ELSE abs(a - e) = span AND b > least(a, c) AND b < greatest(a, c) AND abs(a - b) = g1 END)
  SELECT p_partkey, count(*) AS layouts, CASE WHEN min(abs(b - c)) = max(abs(b - c)) THEN min(abs(b - c)) END::INTEGER AS answer FROM l GROUP BY p_partkey"""


@add("rg6_unique_layouts", _LAYOUTS)
def rg6(spark, d):
    """Layouts of four points that meet each part's clues, and the distance of the middle two where it is certain."""
    rows = table(spark, d, "part").select("p_partkey", *[F.expr(g) for g in _GAPS.split(", ")])

    def clue(kind, a, b, c=None, e=None, far=None):
        return F.struct(F.lit(kind).alias("kind"), *[F.lit(x).cast("int").alias(n) for n, x in zip("abce", (a, b, c, e), strict=True)], (F.lit(None) if far is None else F.expr(far)).cast("int").alias("d"))

    kinds = [
        [clue("dist", 0, 2, far="g1 + g2"), clue("dist", 1, 3, far="g2 + g3"), clue("between", 1, 0, 2)], [clue("dist", 0, 1, far="g1"), clue("dist", 2, 3, far="g3")],
        [clue("more", 0, 1, 2, 3, "g1 - g3"), clue("dist", 0, 2, far="g1 + g2"), clue("between", 1, 0, 2)], [clue("dist", 0, 3, far="g1 + g2 + g3"), clue("between", 1, 0, 2), clue("dist", 0, 1, far="g1")],
    ]
    chosen = F
    for k, clues in enumerate(kinds):
        chosen = chosen.when(F.col("p_partkey") % 4 == k, F.array(*clues).cast(f"array<{puzzles.CLUE}>"))
    asked = rows.select("p_partkey", F.lit(4).alias("points"), F.expr("g1 + g2 + g3").alias("span"), chosen.alias("clues"), F.array(F.lit(1), F.lit(2)).alias("asked"))
    return puzzles.arrangement_answers(asked, "p_partkey", most=4)


@add("rg7_same_calendar", "SELECT y, min(z) AS again FROM (SELECT DISTINCT year(o_orderdate) AS y FROM orders), (SELECT 1900 + j AS z FROM range(300) u(j)) WHERE z > y AND dayofweek(make_date(CAST(y AS INTEGER), 1, 1)) = dayofweek(make_date(CAST(z AS INTEGER), 1, 1)) AND ((y % 4 = 0 AND y % 100 <> 0) OR y % 400 = 0) = ((z % 4 = 0 AND z % 100 <> 0) OR z % 400 = 0) GROUP BY y")
def rg7(spark, d):
    """The next year with the same calendar, of every year with orders."""
    years = table(spark, d, "orders").select(F.year("o_orderdate").alias("y")).distinct()
    return years.select(F.col("y").cast("long").alias("y"), planning.same_calendar(F.col("y")).cast("long").alias("again"))


@add("rg8_clock_images", "SELECT p_partkey, CAST((720 - m) % 720 AS BIGINT) AS water, CAST((1080 - m) % 720 AS BIGINT) AS mirror FROM (SELECT p_partkey, p_partkey * 37 % 720 AS m FROM part)")
def rg8(spark, d):
    m = F.col("p_partkey") * 37 % 720
    return table(spark, d, "part").select("p_partkey", planning.mirror_clock(m).alias("mirror"), planning.water_clock(m).alias("water"))


@add("rg9_set_properties", "SELECT o_custkey FROM orders GROUP BY o_custkey HAVING count(*) FILTER (WHERE o_orderpriority LIKE '1%') > 0 AND count(*) FILTER (WHERE o_orderpriority LIKE '5%') = 0")
def rg9(spark, d):
    """Customers with an order of the first priority and none of the fifth."""
    orders = table(spark, d, "orders").select("o_custkey", F.substring("o_orderpriority", 1, 1).alias("level"))
    return planning.has_exactly(orders, "o_custkey", "level", {"1": True, "5": False})


@add("rg10_sufficiency", "SELECT p_partkey, CASE WHEN count(*) = 1 THEN CAST(min(v) AS INTEGER) END AS value FROM (SELECT p_partkey, p_size, v FROM part, range(1, 100) t(v) WHERE v % 7 = p_size % 7 AND v > p_size * 2 - 10 AND v < p_size * 2 + 2) GROUP BY p_partkey")
def rg10(spark, d):
    s = F.col("p_size")
    value = planning.sole_value([lambda v: v % 7 == s % 7, lambda v: v > s * 2 - 10, lambda v: v < s * 2 + 2])
    some = F.size(F.filter(F.sequence(F.lit(1), F.lit(99)), lambda v: (v % 7 == s % 7) & (v > s * 2 - 10) & (v < s * 2 + 2))) > 0
    return table(spark, d, "part").filter(some).select("p_partkey", value.alias("value"))


#: A die an order, of which each line shows three faces that meet at a corner.
_CORNER = "l_partkey % 8"
_FACES = {"top": f"CASE WHEN {_CORNER} % 2 = 0 THEN 1 ELSE 6 END", "left": f"CASE WHEN floor({_CORNER} / 2) % 2 = 0 THEN 2 ELSE 5 END", "right": f"CASE WHEN floor({_CORNER} / 4) % 2 = 0 THEN 3 ELSE 4 END"}


@add("rg11_dice", f"""WITH v AS (SELECT l_orderkey, {', '.join(f'{e} AS {n}_face' for n, e in _FACES.items())} FROM lineitem), p AS (SELECT l_orderkey, unnest([top_face, top_face, left_face, left_face, right_face, right_face]) AS face, unnest([left_face, right_face, top_face, right_face, top_face, left_face]) AS next FROM v)
  SELECT l_orderkey, CAST(face AS INTEGER) AS face, CAST(21 - face - sum(DISTINCT next) AS INTEGER) AS opposite FROM p GROUP BY l_orderkey, face HAVING count(DISTINCT next) = 4""")
def rg11(spark, d):
    """The opposite faces that the views of each order's die tell."""
    views = table(spark, d, "lineitem").select("l_orderkey", *[F.expr(f"CAST({e} AS INT)").alias(n) for n, e in _FACES.items()])
    return planning.opposite_faces(views, "l_orderkey")


#: A series of five figures a part, of which two are exchanged.
_FIGURES = """f AS (SELECT p_partkey, p_partkey % 2 = 0 AS cw, p_size % 2 + 1 AS i, p_size % 3 + 2 AS j, CASE p_partkey % 3 WHEN 0 THEN 'cstp' WHEN 1 THEN 'tpsc' ELSE 'ccsp' END AS q0 FROM part)"""
_TURN = "CASE WHEN cw THEN {0}[2] || {0}[4] || {0}[1] || {0}[3] ELSE {0}[3] || {0}[1] || {0}[4] || {0}[2] END"


@add("rg12_rotation", f"""WITH {_FIGURES}, q1 AS (SELECT *, {_TURN.format('q0')} AS q1 FROM f), q2 AS (SELECT *, {_TURN.format('q1')} AS q2 FROM q1), q3 AS (SELECT *, {_TURN.format('q2')} AS q3 FROM q2), q4 AS (SELECT *, {_TURN.format('q3')} AS q4 FROM q3),
  t AS (SELECT p_partkey, [q0, q1, q2, q3, q4] AS truth, i, j FROM q4), s AS (SELECT *, list_transform(range(0, 5), lambda k: CASE k WHEN i THEN truth[j + 1] WHEN j THEN truth[i + 1] ELSE truth[k + 1] END) AS shown FROM t),
  p AS (SELECT p_partkey, shown, a, b, list_transform(range(0, 5), lambda k: CASE k WHEN a THEN shown[b + 1] WHEN b THEN shown[a + 1] ELSE shown[k + 1] END) = truth AS fits FROM s, range(0, 5) x(a), range(0, 5) y(b) WHERE a < b)
  SELECT p_partkey, array_to_string(any_value(shown), ' ') AS shown, coalesce(string_agg(a || '-' || b, ' ' ORDER BY a, b) FILTER (WHERE fits), '') AS swaps FROM p GROUP BY p_partkey""")
def rg12(spark, d):
    """The exchanges that restore each part's series."""
    kind = F.col("p_partkey") % 3
    quad = lambda letters: F.array(*map(F.lit, letters))
    start = F.when(kind == 0, quad("cstp")).when(kind == 1, quad("tpsc")).otherwise(quad("ccsp"))
    rows = table(spark, d, "part").select("p_partkey", "p_size", puzzles.turned_series(start, F.col("p_partkey") % 2 == 0, 5).alias("truth"))
    i, j = F.col("p_size") % 2 + 1, F.col("p_size") % 3 + 2
    shown = rows.withColumn("figures", F.when(i == j, F.col("truth")).otherwise(puzzles.exchanged(F.col("truth"), i, j)))
    found = puzzles.restoring_swaps(F.col("figures"), F.col("truth"))
    joined = F.array_join(F.transform("figures", lambda q: F.array_join(q, "")), " ")
    return shown.select("p_partkey", joined.alias("shown"), F.array_join(F.transform(found, lambda p: F.concat_ws("-", p["i"].cast("string"), p["j"].cast("string"))), " ").alias("swaps"))


sql("rg13_layout_lookup", "SELECT n_nationkey, coalesce(l.layout, 'apart') AS layout FROM nation LEFT JOIN (SELECT * FROM (VALUES (0, 'nested'), (1, 'crossed'), (2, 'apart')) AS v(k, layout)) l ON n_regionkey = l.k")


_SEGMENTS = "SELECT s_nationkey AS figure, s_suppkey AS id, CAST(s_suppkey * 7 % 11 AS DOUBLE) AS x1, CAST(s_suppkey * 5 % 13 AS DOUBLE) AS y1, CAST(s_suppkey * 3 % 17 AS DOUBLE) AS x2, CAST(s_suppkey * 11 % 19 AS DOUBLE) AS y2 FROM supplier"
_TRIANGLES = f"""WITH s AS ({_SEGMENTS}), p AS (SELECT a.figure, a.id AS i, b.id AS j, a.x1 AS ax, a.y1 AS ay, a.x2 - a.x1 AS dx, a.y2 - a.y1 AS dy,
    (a.x1 - a.x2) * (b.y1 - b.y2) - (a.y1 - a.y2) * (b.x1 - b.x2) AS den, (a.x1 - b.x1) * (b.y1 - b.y2) - (a.y1 - b.y1) * (b.x1 - b.x2) AS tn, (a.x1 - b.x1) * (a.y1 - a.y2) - (a.y1 - b.y1) * (a.x1 - a.x2) AS un
    FROM s a JOIN s b ON a.figure = b.figure AND a.id < b.id),
  c AS (SELECT figure, i, j, ax + tn / den * dx AS x, ay + tn / den * dy AS y FROM p WHERE abs(den) >= 1e-9 AND tn / den BETWEEN -1e-9 AND 1 + 1e-9 AND un / den BETWEEN -1e-9 AND 1 + 1e-9)
  SELECT u.figure, count(*) AS triangles FROM c u JOIN c v ON u.figure = v.figure AND u.j = v.i JOIN c w ON w.figure = u.figure AND w.i = u.i AND w.j = v.j
  WHERE (abs(u.x - v.x) >= 1e-6 OR abs(u.y - v.y) >= 1e-6) AND (abs(v.x - w.x) >= 1e-6 OR abs(v.y - w.y) >= 1e-6) AND (abs(u.x - w.x) >= 1e-6 OR abs(u.y - w.y) >= 1e-6)
    AND abs((v.x - u.x) * (w.y - u.y) - (w.x - u.x) * (v.y - u.y)) >= 1e-9 GROUP BY u.figure"""


@add("rg14_triangle_count", _TRIANGLES)
def rg14(spark, d):
    k = F.col("s_suppkey")
    ends = {c: (k * m % n).alias(c) for c, m, n in (("x1", 7, 11), ("y1", 5, 13), ("x2", 3, 17), ("y2", 11, 19))}
    return planning.triangles(table(spark, d, "supplier").select(F.col("s_nationkey").alias("figure"), k.alias("id"), *ends.values()), "figure", "id")


@add("rg15_distractors", """WITH c AS (SELECT p_partkey, p_size AS s, unnest([p_size * 2, p_size - 5, p_size, p_size + 1, p_size - 1, p_size + 2, p_size - 2, p_size + 3, p_size - 3, p_size + 4, p_size - 4]) AS v, unnest(range(11)) AS i FROM part),
  d AS (SELECT p_partkey, v, min(i) AS i FROM c WHERE v > 0 AND v <> s GROUP BY p_partkey, v QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY min(i)) <= 3)
  SELECT p_partkey, string_agg(v, ',' ORDER BY i) AS choices FROM d GROUP BY p_partkey""")
def rg15(spark, d):
    s = F.col("p_size")
    return table(spark, d, "part").select("p_partkey", F.array_join(planning.distractors(s, F.array(s * 2, s - 5, s)).cast("array<string>"), ",").alias("choices"))


@add("rg16_question_blocks")
def rg16(spark, d):
    """A block of sixteen questions of eight types a supplier."""
    return question_blocks(table(spark, d, "supplier").select(F.col("s_suppkey").alias("seed")), 16)
