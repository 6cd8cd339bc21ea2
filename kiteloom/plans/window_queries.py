"""Ordered-sequence, sorting, sampling and de-duplication queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kiteloom.functions import texts
from kiteloom.operators import papers
from kiteloom.operators import sequences as ops
from kiteloom.operators.folds import interleave, two_key_dedupe
from kiteloom.operators.ranking import global_rank, rank_within
from kiteloom.operators.vectors import cosine_topk
from kiteloom.plans.registry import Family
from kiteloom.sources.tables import table

FAMILY = Family("windows")
add, sql = FAMILY.add, FAMILY.sql


@add("wn1_topk_per_group", "SELECT q.vec_id AS query_id, b.vec_id FROM embeddings q, embeddings b WHERE q.vec_id % 100 = 0 AND b.vec_id <> q.vec_id QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_dot_product(q.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) DESC, b.vec_id) <= 5")
def wn1(spark, d):
    e = table(spark, d, "embeddings")
    return cosine_topk(e.filter("vec_id % 100 = 0"), e, 5).select("query_id", "vec_id")


_RUNS = """WITH t AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nth, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events),
  r AS (SELECT *, sum(CASE WHEN prev IS NULL OR prev <> event_type THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY nth) AS run FROM t),
  g AS (SELECT user_id, CAST(run AS BIGINT) AS run, any_value(event_type) AS event_type, count(*) AS length, CAST(min(nth) AS INTEGER) AS first FROM r GROUP BY user_id, run)"""


@add("wn2_runs", f"{_RUNS} SELECT * FROM g")
def wn2(spark, d):
    return ops.runs(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], "event_type")


@add("wn3_folded_runs", f"{_RUNS} SELECT user_id, run, last_value(CASE WHEN length >= 2 OR run = 1 THEN event_type END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY run ROWS UNBOUNDED PRECEDING) AS kept_label FROM g")
def wn3(spark, d):
    found = ops.runs(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], "event_type")
    return ops.folded_runs(found, ["user_id"], "event_type").select("user_id", "run", "kept_label")


sql("wn4_first_per_key", "SELECT min(doc_id) AS doc_id FROM documents GROUP BY md5(text)")


@add("wn5_most_complete", "SELECT o_custkey, arg_max(o_orderkey, (o_totalprice, -o_orderkey)) AS best, min(o_orderdate) AS first_seen FROM orders GROUP BY o_custkey")
def wn5(spark, d):
    order = F.struct("o_totalprice", -F.col("o_orderkey"))
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", order).alias("best"), F.min("o_orderdate").alias("first_seen"))


@add("wn6_rank_from_zero", "SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) - 1 AS rank0 FROM events")
def wn6(spark, d):
    """Ranks within a handful of large channels."""
    rows = table(spark, d, "events").select("event_id", "event_type", (-F.col("value")).alias("low"))
    return rank_within(rows, "event_type", ["low", "event_id"], "rank").select("event_id", (F.col("rank") - 1).alias("rank0"))


@add("wn7_text_windows", "SELECT doc_id, CAST(i * 1850 AS INTEGER) AS start, CAST(length(substr(text, i * 1850 + 1, 2000)) AS INTEGER) AS size FROM (SELECT doc_id, text, unnest(range(0, CAST(greatest(ceil((length(text) - 2000) / 1850.0), 0) AS BIGINT) + 1)) AS i FROM documents)")
def wn7(spark, d):
    parts = table(spark, d, "documents").select("doc_id", F.explode(ops.text_windows(F.col("text"), 2000, 1850)).alias("w"))
    return parts.select("doc_id", "w.start", F.length("w.body").alias("size"))


sql("wn8_last_stage_entry", "SELECT user_id, max(CASE WHEN event_type = 'purchase' THEN ts END) AS entered FROM events GROUP BY user_id")


#: Papers of up to sixty numbered lines; some don't begin low, some don't ascend, some repeat numbers within.
_NUMBERED = """concat(CASE CAST(floor(p_partkey / 60) AS BIGINT) % 5 WHEN 1 THEN CAST(p_partkey % 60 + 11 AS STRING) WHEN 2 THEN CAST(60 - p_partkey % 60 AS STRING) ELSE CAST(p_partkey % 60 + 1 AS STRING) END, '. ', p_name, chr(10), CASE WHEN p_partkey % 7 = 0 THEN concat(' 2) ', p_type, chr(10)) ELSE '' END)"""
_CUT = f"""WITH p AS (SELECT CAST(floor(p_partkey / 60) AS BIGINT) AS paper, string_agg({_NUMBERED.replace('AS STRING', 'AS VARCHAR')}, '' ORDER BY p_partkey) AS body FROM part GROUP BY 1),
  l AS (SELECT paper, unnest(range(0, len(string_split(body, chr(10))))) AS pos, unnest(string_split(body, chr(10))) AS line FROM p), n AS (SELECT *, try_cast(regexp_extract(line, '^[\\s>|*#-]{{0,6}}([0-9]{{1,3}})[.)-]\\s', 1) AS INTEGER) AS n FROM l),
  s AS (SELECT paper, pos, n, row_number() OVER (PARTITION BY paper ORDER BY pos) AS i, lag(n) OVER (PARTITION BY paper ORDER BY pos) AS before FROM n WHERE n BETWEEN 1 AND 300),
  g AS (SELECT paper FROM s GROUP BY paper HAVING count(*) >= 12 AND min_by(n, i) <= 3 AND count(*) FILTER (WHERE n > before) >= 0.8 * (count(*) - 1) AND count(DISTINCT n) > 20),
  a AS (SELECT paper, pos, row_number() OVER (PARTITION BY paper ORDER BY pos) - 1 AS k FROM (SELECT paper, n, min(pos) AS pos FROM s WHERE paper IN (SELECT paper FROM g) GROUP BY paper, n)),
  c AS (SELECT paper, k // 20 AS chunk, CASE WHEN min(k) = 0 THEN 0 ELSE (SELECT pos FROM a b WHERE b.paper = a.paper AND b.k = min(a.k) - 1) END AS since, coalesce((SELECT pos FROM a b WHERE b.paper = a.paper AND b.k = max(a.k) + 1), 1000000) AS until FROM a GROUP BY paper, k // 20)
  SELECT c.paper, CAST(chunk AS BIGINT) AS chunk, md5(trim(string_agg(line, chr(10) ORDER BY pos), ' ' || chr(10))) AS body FROM c JOIN l ON l.paper = c.paper AND pos >= since AND pos < until GROUP BY c.paper, chunk"""


@add("wn9_anchor_chunks", _CUT)
def wn9(spark, d):
    """Papers cut at every twentieth number, where their numbering can be relied on."""
    lines = table(spark, d, "part").select(F.expr("CAST(floor(p_partkey / 60) AS BIGINT)").alias("paper"), F.struct("p_partkey", F.expr(_NUMBERED).alias("line")).alias("l"))
    listed = lines.groupBy("paper").agg(F.array_join(F.sort_array(F.collect_list("l"))["line"], "").alias("body"))
    return papers.numbered_chunks(listed, ["paper"], "body").select("paper", F.col("chunk").cast("long").alias("chunk"), F.md5("body").alias("body"))


@add("wn10_post_ids", "SELECT o_orderkey, lower(o_orderstatus) || '-' || strftime(o_orderdate, '%Y%m%d') || '-' || row_number() OVER (PARTITION BY o_orderstatus, CAST(o_orderdate AS DATE) ORDER BY o_orderkey) AS post_id FROM orders")
def wn10(spark, d):
    n = F.row_number().over(Window.partitionBy("o_orderstatus", F.to_date("o_orderdate")).orderBy("o_orderkey"))
    return table(spark, d, "orders").select("o_orderkey", F.concat_ws("-", F.lower("o_orderstatus"), F.date_format("o_orderdate", "yyyyMMdd"), n.cast("string")).alias("post_id"))


_PACK = """WITH RECURSIVE t AS (SELECT conv_id, turn, length(text) AS size, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations WHERE length(text) >= 30),
 f AS (SELECT conv_id, turn, i, 0 AS g, CASE WHEN size >= 800 THEN 0 ELSE size END AS cur, CASE WHEN size >= 800 THEN 1 ELSE 0 END AS nxt FROM t WHERE i = 1
   UNION ALL
   SELECT t.conv_id, t.turn, t.i, CASE WHEN f.cur > 0 AND f.cur + t.size > 1600 THEN f.nxt + 1 ELSE f.nxt END,
     CASE WHEN (CASE WHEN f.cur > 0 AND f.cur + t.size > 1600 THEN t.size ELSE f.cur + t.size END) >= 800 THEN 0 ELSE (CASE WHEN f.cur > 0 AND f.cur + t.size > 1600 THEN t.size ELSE f.cur + t.size END) END,
     (CASE WHEN f.cur > 0 AND f.cur + t.size > 1600 THEN f.nxt + 1 ELSE f.nxt END) + CASE WHEN (CASE WHEN f.cur > 0 AND f.cur + t.size > 1600 THEN t.size ELSE f.cur + t.size END) >= 800 THEN 1 ELSE 0 END
   FROM f JOIN t ON t.conv_id = f.conv_id AND t.i = f.i + 1)"""


def _packed(spark, d):
    rows = table(spark, d, "conversations").filter(F.length("text") >= 30)
    lists = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", F.length("text").alias("size")))).alias("parts"))
    groups = ops.pack_fold(F.transform("parts", lambda p: p["size"].cast("long")), 1600, 800)
    return lists.select("conv_id", F.explode(F.arrays_zip(F.col("parts"), groups.alias("g"))).alias("p")).select("conv_id", "p.parts.turn", F.col("p.g").alias("passage"))


@add("wn11_sequential_packing", f"{_PACK} SELECT conv_id, turn, g AS passage FROM f")
def wn11(spark, d):
    return _packed(spark, d)


@add("tx5_chunk_passages", f"{_PACK} SELECT conv_id, g AS passage, count(*) AS n_chunks, min(f.turn) AS first_turn, max(f.turn) AS last_turn FROM f GROUP BY conv_id, g")
def tx5(spark, d):
    return _packed(spark, d).groupBy("conv_id", "passage").agg(F.count(F.lit(1)).alias("n_chunks"), F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"))


@add("wn12_interleave")
def wn12(spark, d):
    return interleave(table(spark, d, "part").select(F.col("p_brand").alias("grp"), F.col("p_type").alias("kind"), F.col("p_partkey").alias("id")))


@add("wn13_rounds", """WITH RECURSIVE t AS (SELECT p_brand, count(DISTINCT p_type) AS n FROM part GROUP BY p_brand), k AS (SELECT DISTINCT p_brand, p_type FROM part),
  r AS (SELECT p_brand, round, list(p_type ORDER BY md5('3|' || p_brand || '|' || round || '|' || p_type)) AS types FROM k, range(1, 41) x(round) GROUP BY p_brand, round),
  f AS (SELECT p_brand, round, types AS kept FROM r WHERE round = 1 UNION ALL SELECT r.p_brand, r.round, CASE WHEN len(r.types) > 1 AND r.types[1] = f.kept[len(f.kept)] THEN list_concat([r.types[2], r.types[1]], r.types[3:]) ELSE r.types END FROM f JOIN r ON r.p_brand = f.p_brand AND r.round = f.round + 1)
  SELECT * FROM (SELECT p_brand, (round - 1) * n + i AS place, kept[i] AS p_type FROM (SELECT f.p_brand, round, kept, n, unnest(range(1, n + 1)) AS i FROM f JOIN t USING (p_brand))) WHERE place <= 40""")
def wn13(spark, d):
    """Forty places a brand: its types in turn, each round shuffled, no type beside itself at a seam."""
    kinds = table(spark, d, "part").groupBy("p_brand").agg(F.collect_set("p_type").alias("types"))
    return ops.rounds(kinds, "p_brand", "types", 40, 3).withColumnRenamed("type", "p_type")


sql("or1_nulls_last", "SELECT doc_id, quality FROM documents LEFT JOIN labels USING (doc_id) ORDER BY quality ASC NULLS LAST, doc_id DESC LIMIT 100")
sql("or2_desc_nulls_last", "SELECT doc_id, quality FROM documents LEFT JOIN labels USING (doc_id) ORDER BY quality DESC NULLS LAST, doc_id LIMIT 50")
sql("or3_day_then_step", "SELECT l_orderkey, l_linenumber, l_shipdate FROM lineitem ORDER BY l_shipdate DESC, l_linenumber, l_orderkey, l_partkey, l_suppkey LIMIT 80")
sql("or4_history_cap", "SELECT event_id FROM events ORDER BY ts DESC, event_id LIMIT 280")


@add("or5_shuffled_sample", "SELECT doc_id FROM documents ORDER BY md5('11|' || doc_id), doc_id LIMIT 50")
def or5(spark, d):
    return table(spark, d, "documents").orderBy(ops.hash_order(11, "doc_id"), "doc_id").limit(50).select("doc_id")


_USE = "SELECT p_partkey, p_brand, p_type, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_partkey % 6 END AS used_ago FROM part"
sql("or6_eligible_groups", f"SELECT p_type FROM ({_USE}) u GROUP BY p_type HAVING count(*) FILTER (WHERE used_ago IS NULL) > 0 ORDER BY md5(concat('5|', p_type)) LIMIT 20")
sql("or7_lru_groups", f"SELECT p_type, max(coalesce(used_ago, 0)) AS idle FROM ({_USE}) u WHERE p_type NOT LIKE '%STEEL%' GROUP BY p_type ORDER BY idle DESC, md5(concat('5|', p_type)) LIMIT 20")
sql("or8_rows_in_group", f"SELECT p_brand, p_partkey, nth FROM (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY CASE WHEN used_ago IS NULL THEN 0 ELSE 1 END, used_ago DESC NULLS FIRST, p_partkey) AS nth FROM ({_USE}) u) v WHERE nth <= 3")
_PRIORITY = "CASE WHEN contains(url, 'example.org') THEN 0 WHEN contains(url, 'example.net') THEN 1 WHEN contains(url, 'blog.') THEN 2 ELSE 3 END"


@add("or9_stable_priority", f"SELECT page_id, {_PRIORITY} AS priority, row_number() OVER (ORDER BY {_PRIORITY}, page_id) AS place FROM pages")
def or9(spark, d):
    rows = table(spark, d, "pages").select("page_id", F.expr(_PRIORITY).alias("priority"))
    return global_rank(rows, ["priority", "page_id"], "place")


sql("or10_domain_priority", f"SELECT page_id, {_PRIORITY} AS priority FROM pages")
sql("or11_prefer_hits", f"WITH b AS (SELECT page_id, {_PRIORITY} AS p FROM pages), h AS (SELECT max(CASE WHEN p = 2 THEN 1 ELSE 0 END) AS any_hit FROM b) SELECT page_id FROM b CROSS JOIN h WHERE any_hit = 0 OR p = 2 ORDER BY page_id LIMIT 3")
sql("or12_latest_name", "SELECT max(concat('Scrape ', cast(cast(o_orderdate AS DATE) AS STRING))) AS tab FROM orders")
sql("or13_newest_jobs", "SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 50")

sql("st1_union_all", "SELECT s_nationkey AS k FROM supplier UNION ALL SELECT c_nationkey FROM customer")


@add("st2_renumber", "SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) AS n FROM (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)")
def st2(spark, d):
    return global_rank(table(spark, d, "supplier").filter("s_acctbal > 0").select("s_suppkey"), ["s_suppkey"], "n")


@add("st3_set_difference", "SELECT p_brand, CAST(len(list_filter(range(1, 51), lambda x: NOT list_contains(seen, x))) AS INTEGER) AS missing FROM (SELECT p_brand, list(DISTINCT p_size) AS seen FROM part GROUP BY p_brand)")
def st3(spark, d):
    seen = table(spark, d, "part").groupBy("p_brand").agg(F.collect_set("p_size").alias("seen"))
    return seen.select("p_brand", F.size(F.array_except(F.sequence(F.lit(1), F.lit(50)), "seen")).alias("missing"))


sql("st4_stem_dedupe", "WITH known AS (SELECT trim(substring(text, 1, 40)) AS stem FROM documents WHERE text IS NOT NULL AND doc_id IN (SELECT doc_id FROM labels)) SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) AND NOT EXISTS (SELECT 1 FROM known WHERE stem = trim(substring(text, 1, 40)))")
sql("st5_lead_key", "SELECT min(c_custkey) AS c_custkey, coalesce(nullif(lower(CASE WHEN c_custkey % 4 = 0 THEN '' ELSE c_name END), ''), lower(concat(c_mktsegment, '|', c_nationkey))) AS key FROM customer GROUP BY 2")


@add("st6_ordered_distinct", "SELECT conv_id, array_to_string(list_slice(list(role ORDER BY first), 1, 6), ' | ') AS roles FROM (SELECT conv_id, role, min(turn) AS first FROM conversations GROUP BY 1, 2) GROUP BY conv_id")
def st6(spark, d):
    lists = table(spark, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role"))).alias("r"))
    return lists.select("conv_id", F.array_join(F.slice(F.array_distinct("r.role"), 1, 6), " | ").alias("roles"))


@add("st7_top_sources", "SELECT user_id, array_to_string(list_sort(list_distinct(list_slice(list(event_type ORDER BY ts, event_id), 1, 4))), ',') AS kinds FROM events GROUP BY user_id")
def st7(spark, d):
    nth = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    top = table(spark, d, "events").withColumn("nth", nth).filter("nth <= 4")
    return top.groupBy("user_id").agg(F.array_join(F.sort_array(F.collect_set("event_type")), ",").alias("kinds"))


#: Questions of which some share stem and first option but for punctuation, blanks and case, and some have none.
_KEYED = {"stem": "CASE WHEN p_partkey % 10 = 0 THEN ' ?! ' WHEN p_partkey % 10 = 1 THEN 'abc' ELSE concat(CASE WHEN p_partkey % 2 = 0 THEN '«' ELSE '' END, p_type, '  of — ', p_brand, '?') END", "o1": "CASE WHEN p_size % 2 = 0 THEN ' - ' ELSE concat('(', upper(p_name), ')') END", "o2": "p_name"}
_WOBBLY = "[।''\"‘’“”()\\[\\]{}.,:;?!\\-–—/\\\\]"


def _stem_key(t: str) -> str:
    core = f"trim(lower(regexp_replace(trim(regexp_replace({t}, '\\s+', ' ', 'g')), '{_WOBBLY}', '', 'g')))"
    return f"CASE WHEN length({core}) >= 6 THEN {core} ELSE '' END"


@add("st8_question_key", f"""WITH q AS (SELECT p_partkey, {', '.join(f'{e} AS {n}' for n, e in _KEYED.items())} FROM part), k AS (SELECT p_partkey, {_stem_key('stem')} AS s, coalesce(nullif({_stem_key('o1')}, ''), {_stem_key('o2')}) AS o FROM q)
  SELECT p_partkey, CASE WHEN s = '' THEN p_partkey ELSE min(p_partkey) OVER (PARTITION BY s, o) END AS first FROM k""")
def st8(spark, d):
    """Each question with the first that has its key; those without a key stand for themselves."""
    keyed = table(spark, d, "part").select("p_partkey", texts.question_key(F.expr(_KEYED["stem"]), F.array(F.expr(_KEYED["o1"]), F.expr(_KEYED["o2"]))).alias("key"))
    firsts = keyed.filter("key IS NOT NULL").groupBy("key").agg(F.min("p_partkey").alias("least"))
    return keyed.join(firsts, "key", "left").select("p_partkey", F.coalesce("least", "p_partkey").alias("first"))


sql("st9_repeated_text", "SELECT doc_id FROM (SELECT doc_id, count(*) OVER (PARTITION BY lang, md5(lower(text))) AS n FROM documents) t WHERE n <= 2")
sql("st10_distinct_pairs", "SELECT DISTINCT source, lang FROM documents")


_FIXED = {"text": "concat(p_name, ' अनुच्छेद ', CAST(p_size AS STRING), ' and ', p_type)", "fixed": "CASE p_partkey % 6 WHEN 0 THEN concat(upper(p_type), ' AND अनुच्छेद ', CAST(p_size AS STRING), ' ', p_name) WHEN 1 THEN concat(p_name, ' अनुच्छेद ', CAST(p_size + 1 AS STRING), ' and ', p_type) WHEN 2 THEN concat(p_name, ' अनुछेद ', CAST(p_size AS STRING), ' or ', p_type) WHEN 3 THEN ' ' WHEN 4 THEN concat(p_name, repeat(' अनुच्छेद', 12), ' ', CAST(p_size AS STRING), ' and ', p_type) ELSE concat(p_name, ' अनुछेद ', CAST(p_size AS STRING), ' and ', p_type) END"}
_BAG = "list_sort(list_transform(regexp_extract_all({0}, '{1}'), lambda x: lower(x)))"


@add("st11_number_multisets", f"SELECT p_partkey, trim(fixed) <> '' AND {_BAG.format('text', '[0-9]+')} = {_BAG.format('fixed', '[0-9]+')} AND {_BAG.format('text', '[A-Za-z]+')} = {_BAG.format('fixed', '[A-Za-z]+')} AND least(length(text), length(fixed)) >= 0.6 * greatest(length(text), length(fixed)) AS safe FROM (SELECT p_partkey, {', '.join(f'{e} AS {n}' for n, e in _FIXED.items()).replace('AS STRING', 'AS VARCHAR')} FROM part)")
def st11(spark, d):
    return table(spark, d, "part").select("p_partkey", texts.safe_correction(F.expr(_FIXED["text"]), F.expr(_FIXED["fixed"])).alias("safe"))


@add("st12_two_key_dedupe", """WITH RECURSIVE t AS (SELECT p_brand AS grp, p_partkey AS id, p_type AS a, p_size AS b, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS i FROM part),
 f AS (SELECT grp, id, i, TRUE AS kept, [a] AS la, [b] AS lb FROM t WHERE i = 1 UNION ALL
   SELECT grp, id, i, kept, CASE WHEN kept THEN list_append(la, a) ELSE la END, CASE WHEN kept THEN list_append(lb, b) ELSE lb END
   FROM (SELECT t.*, f.la, f.lb, NOT list_contains(f.la, t.a) AND NOT list_contains(f.lb, t.b) AS kept FROM f JOIN t ON t.grp = f.grp AND t.i = f.i + 1))
 SELECT grp, id FROM f WHERE kept""")
def st12(spark, d):
    rows = table(spark, d, "part").select(F.col("p_brand").alias("grp"), F.col("p_partkey").alias("id"), F.col("p_type").alias("key_a"), F.col("p_size").cast("string").alias("key_b"))
    return two_key_dedupe(rows)


sql("st13_first_per_marker", "SELECT o_custkey, o_orderstatus, min_by(o_orderkey, o_orderkey) AS first_key FROM orders GROUP BY o_custkey, o_orderstatus")
sql("st14_merge_by_id", "SELECT k, max_by(v, seq) AS v, min(seq) AS place FROM (SELECT c_nationkey AS k, c_custkey AS v, c_custkey AS seq FROM customer UNION ALL SELECT s_nationkey, s_suppkey, s_suppkey + 1000000 FROM supplier) t GROUP BY k")
