"""Join queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kiteloom.functions.texts import normalise
from kiteloom.operators import joins as ops
from kiteloom.operators.vectors import cosine_topk
from kiteloom.plans.registry import Family
from kiteloom.sources.tables import table

FAMILY = Family("joins")
add, sql = FAMILY.add, FAMILY.sql


@add("jn1_nested_children", "SELECT c_custkey, CAST(count(o_orderkey) AS INTEGER) AS n_orders, min(o_orderkey) AS first_order FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 200000 GROUP BY c_custkey")
def jn1(spark, d):
    orders = table(spark, d, "orders").filter("o_totalprice > 200000").withColumnRenamed("o_custkey", "c_custkey")
    both = ops.nested(table(spark, d, "customer").select("c_custkey"), orders, "c_custkey", ["o_orderkey", "o_orderdate"], "orders")
    return both.select("c_custkey", F.size("orders").alias("n_orders"), F.get("orders", F.lit(0)).getField("o_orderkey").alias("first_order"))


@add("jn2_rollup", "SELECT c_custkey, coalesce(n, 0) AS n, round(coalesce(total, 0), 2) AS total FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, sum(o_totalprice) AS total FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) ON c_custkey = o_custkey")
def jn2(spark, d):
    sums = table(spark, d, "orders").filter("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total"))
    both = table(spark, d, "customer").select("c_custkey").join(sums, "c_custkey", "left")
    return both.select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"), F.round(F.coalesce("total", F.lit(0.0)), 2).alias("total"))


sql("jn3_exists", "SELECT n_nationkey, n_name FROM nation WHERE EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal > 5000)")


_BAND = "{0}_nationkey || '|' || CAST(floor({0}_acctbal / 100) AS BIGINT)"  # nation and band of the balance


def _band(p: str) -> F.Column:
    return F.concat_ws("|", F.col(f"{p}_nationkey").cast("string"), F.floor(F.col(f"{p}_acctbal") / 100).cast("string"))


@add("jn4_new_rows", f"SELECT count(*) AS n, count(DISTINCT k) AS distinct_keys FROM (SELECT {_BAND.format('c')} AS k FROM customer) WHERE k NOT IN (SELECT {_BAND.format('s')} FROM supplier)")
def jn4(spark, d):
    new = ops.new_rows(table(spark, d, "customer"), table(spark, d, "supplier"), _band("c"), _band("s"))
    return new.agg(F.count(F.lit(1)).alias("n"), F.countDistinct(_band("c")).alias("distinct_keys"))


@add("jn5_new_first_rows", f"SELECT min(c_custkey) AS c_custkey FROM (SELECT c_custkey, {_BAND.format('c')} AS k FROM customer) WHERE k NOT IN (SELECT {_BAND.format('s')} FROM supplier) GROUP BY k")
def jn5(spark, d):
    return ops.new_first_rows(table(spark, d, "customer"), table(spark, d, "supplier"), _band("c"), _band("s"), ["c_custkey"]).select("c_custkey")


@add("jn6_new_urls", "WITH b AS (SELECT page_id, CASE WHEN page_id % 5 = 0 THEN '' ELSE regexp_extract(url, '://([^/]*)', 1) END AS k FROM pages), r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY page_id) AS nth FROM b) SELECT page_id, k FROM r WHERE k = '' OR (nth = 1 AND k NOT LIKE 'www.%')")
def jn6(spark, d):
    host = F.regexp_extract("url", "://([^/]*)", 1)
    pages = table(spark, d, "pages").withColumn("k", F.when(F.col("page_id") % 5 == 0, "").otherwise(host))
    known = pages.filter(F.col("k").startswith("www."))
    return ops.new_first_rows(pages, known, F.col("k"), F.col("k"), ["page_id"], blank_passes=True).select("page_id", "k")


sql("jn7_not_cooling", "SELECT p_partkey FROM part LEFT ANTI JOIN (SELECT l_partkey AS k FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-06-01') s ON p_partkey = k", "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-06-01')")
sql("jn8_lru_candidates", "SELECT p_partkey, used_ago FROM (SELECT p_partkey, p_type, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_partkey % 6 END AS used_ago FROM part) WHERE p_type LIKE '%BRASS%' OR p_partkey % 11 = 0 ORDER BY used_ago DESC NULLS FIRST, p_partkey LIMIT 25")


@add("jn9_update_join", "SELECT d.doc_id, coalesce(CASE WHEN l.quality = 0 THEN 'low' END, d.source) AS source FROM documents d LEFT JOIN labels l USING (doc_id)")
def jn9(spark, d):
    changes = table(spark, d, "labels").filter("quality = 0").select("doc_id", F.lit("low").alias("source"))
    return ops.updated(table(spark, d, "documents").select("doc_id", "source"), changes, "doc_id", ["source"])


@add("jn10_asof", "SELECT e.event_id, p.event_id AS mark_id, p.value AS mark_value FROM (SELECT * FROM events WHERE event_type = 'purchase') e ASOF LEFT JOIN (SELECT user_id, ts, event_id, value FROM events WHERE event_type = 'view') p ON e.user_id = p.user_id AND e.ts >= p.ts")
def jn10(spark, d):
    events = table(spark, d, "events")
    marks = events.filter("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("mark_id"), F.col("value").alias("mark_value"))
    left = events.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    return ops.asof_backward(left, marks, ["user_id"], "ts", "ts", ["mark_id", "mark_value"], "mark_id").select("event_id", "mark_id", "mark_value")


_TEXTS = "SELECT conv_id, turn, lower(trim(regexp_replace(text, '[\\x09-\\x0D\\x20\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{202F}\\x{205F}\\x{3000}]+', ' ', 'g'))) AS line FROM conversations"


@add("jn11_whole_texts", f"WITH l AS (SELECT * FROM ({_TEXTS}) WHERE line <> '') SELECT conv_id, turn FROM l c WHERE NOT EXISTS (SELECT 1 FROM l e WHERE e.conv_id = c.conv_id AND e.turn < c.turn AND contains(e.line, c.line))")
def jn11_whole(spark, d):
    lines = table(spark, d, "conversations").select("conv_id", "turn", normalise(F.col("text")).alias("line")).filter("line <> ''")
    return ops.not_contained(lines, ["conv_id"], "turn", "line").select("conv_id", "turn")


@add("jn12_vector_cross_topk", """SELECT q.vec_id AS query_id, b.vec_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_dot_product(q.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) DESC, b.vec_id) AS rank
    FROM embeddings q, embeddings b WHERE q.vec_id % 100 = 0 AND b.vec_id <> q.vec_id QUALIFY rank <= 5""")
def jn12(spark, d):
    e = table(spark, d, "embeddings")
    return cosine_topk(e.filter("vec_id % 100 = 0"), e, 5).select("query_id", "vec_id", "rank")


@add("jn13_fuse", "SELECT id, sum(1.0::DOUBLE / (60 + r)) AS score FROM (SELECT p_partkey AS id, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) - 1 AS r FROM part QUALIFY r < 50 UNION ALL SELECT p_partkey, row_number() OVER (ORDER BY p_size DESC, p_partkey) - 1 AS r FROM part QUALIFY r < 50) GROUP BY id")
def jn13(spark, d):
    part = table(spark, d, "part").withColumnRenamed("p_partkey", "id")
    lists = [
        part.orderBy(F.desc(c), "id").limit(50).select("id", (F.row_number().over(Window.orderBy(F.desc(c), "id")) - 1).alias("rank0"))
        for c in ("p_retailprice", "p_size")
    ]
    return ops.fused(lists, [], "id")


@add("jn14_positional_zip", "SELECT a.n_nationkey, b.s_suppkey FROM (SELECT n_nationkey, n_regionkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) AS i FROM nation) a JOIN (SELECT s_suppkey, s_nationkey % 5 AS g, row_number() OVER (PARTITION BY s_nationkey % 5 ORDER BY s_acctbal DESC, s_suppkey) AS i FROM supplier) b ON a.n_regionkey = b.g AND a.i = b.i")
def jn14(spark, d):
    n = table(spark, d, "nation").withColumn("g", F.col("n_regionkey"))
    s = table(spark, d, "supplier").withColumn("g", F.col("s_nationkey") % 5)
    return ops.zipped(n, s, [F.col("n_name")], [F.desc("s_acctbal"), F.col("s_suppkey")], ["g"]).select("n_nationkey", "s_suppkey")


sql("jn15_lookup_default", "SELECT n_nationkey, coalesce(s.first_name, '') AS first_name FROM nation LEFT JOIN (SELECT s_nationkey, min_by(s_name, s_suppkey) AS first_name FROM supplier GROUP BY s_nationkey) s ON n_nationkey = s.s_nationkey")
sql("jn16_map_lookup", "SELECT c_custkey, coalesce(n_name, '') AS nation, coalesce(r_name, '') AS region FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_regionkey <> 2 LEFT JOIN region ON n_regionkey = r_regionkey")
sql("jn17_cross_product", "SELECT r_name, size, theme FROM region CROSS JOIN (SELECT * FROM (VALUES ('small'), ('mid'), ('big')) AS s(size)) CROSS JOIN (SELECT * FROM (VALUES ('a'), ('b'), ('c')) AS t(theme))")
sql("jn18_drift", "SELECT DISTINCT p_brand FROM part WHERE p_brand NOT IN (SELECT p_brand FROM part WHERE p_size > 48)")


@add("jn19_triangles", """WITH s AS (SELECT s_suppkey AS id, s_nationkey AS a, (s_nationkey * 7 + s_suppkey) % 25 AS b FROM supplier WHERE s_nationkey <> (s_nationkey * 7 + s_suppkey) % 25)
    SELECT x.id AS i, y.id AS j, z.id AS k FROM s x, s y, s z WHERE x.id < y.id AND y.id < z.id AND x.b = y.a AND y.b = z.a AND z.b = x.a""")
def jn19(spark, d):
    far = (F.col("s_nationkey") * 7 + F.col("s_suppkey")) % 25
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").cast("long").alias("a"), far.alias("b")).filter("a <> b")
    side = lambda p, n: s.select(F.col("id").alias(n), F.col("a").alias(f"{p}a"), F.col("b").alias(f"{p}b"))
    two = side("x", "i").join(side("y", "j"), (F.col("xb") == F.col("ya")) & (F.col("i") < F.col("j")))
    return two.join(side("z", "k"), (F.col("yb") == F.col("za")) & (F.col("zb") == F.col("xa")) & (F.col("j") < F.col("k"))).select("i", "j", "k")


sql("jn20_restoring_pairs", "SELECT a.n_nationkey AS i, b.n_nationkey AS j FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey = (b.n_nationkey * 3) % 5 AND b.n_regionkey = (a.n_nationkey * 3) % 5")
sql("jn21_chain", "SELECT e.event_id, c.c_custkey, min(o.o_orderkey) AS open_order FROM events e JOIN customer c ON lower(cast(e.user_id AS STRING)) = lower(cast(c.c_custkey AS STRING)) JOIN orders o ON o.o_custkey = c.c_custkey AND o.o_orderstatus = 'O' WHERE e.event_type = 'purchase' GROUP BY e.event_id, c.c_custkey")
