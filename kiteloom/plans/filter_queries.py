"""Filter, predicate and projection queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from kiteloom.operators import filters as ops
from kiteloom.plans.registry import Family
from kiteloom.sources.tables import table

FAMILY = Family("filters")
add = FAMILY.add


@add("flt1_optional_equality", "SELECT doc_id, lang, source FROM documents WHERE lang = 'en' AND source = 'src1'")
def flt1(spark, d):
    return ops.equal_where_given(table(spark, d, "documents"), lang="en", source="src1", n_chars=None).select("doc_id", "lang", "source")


@add("flt2_eligible", "SELECT d.doc_id FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.quality IS NULL")
def flt2(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left").filter(F.col("quality").isNull()).select("doc_id")


@add("flt3_any_all", "SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_nationkey NOT IN (1, 2, 3)")
def flt3(spark, d):
    c = ops.any_of(table(spark, d, "customer"), "c_mktsegment", ["BUILDING", "MACHINERY"])
    return ops.none_of(c, "c_nationkey", [1, 2, 3]).select("c_custkey")


_REPLIES = """SELECT event_id AS id, ts AS replied_at, event_type IN ('purchase', 'signup', 'click') AS is_positive,
    user_id % 5 AS follow_up_count, CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 5 = 0 THEN 'OOO' ELSE 'Interested' END AS intent,
    CASE WHEN event_id % 3 = 0 THEN NULL ELSE ts END AS last_at FROM events"""


@add("flt4_follow_up_due", f"SELECT id, follow_up_count FROM ({_REPLIES}) WHERE is_positive AND follow_up_count < 3 AND replied_at < TIMESTAMP '2024-01-20' AND intent NOT IN ('OOO', 'OptOut') AND (last_at IS NULL OR last_at < TIMESTAMP '2024-01-20') ORDER BY replied_at DESC, id LIMIT 50")
def flt4(spark, d):
    table(spark, d, "events").createOrReplaceTempView("events_flt4")
    rows = spark.sql(_REPLIES.replace("FROM events", "FROM events_flt4"))
    return ops.follow_up_due(rows, F.lit("2024-01-20").cast("timestamp_ntz"), ["OOO", "OptOut"]).select("id", "follow_up_count")


@add("flt5_ping_cap", "SELECT user_id, CAST(count(*) AS BIGINT) AS pings, count(*) + 1 AS next_count FROM events WHERE event_type = 'click' GROUP BY user_id HAVING count(*) < 20")
def flt5(spark, d):
    pings = table(spark, d, "events").filter("event_type = 'click'").groupBy("user_id").agg(F.count(F.lit(1)).alias("pings"))
    return pings.filter("pings < 20").withColumn("next_count", F.col("pings") + 1)


@add("flt6_due_today", "SELECT o_orderkey FROM orders WHERE o_orderdate < TIMESTAMP '1995-06-18' AND o_orderstatus = 'O'")
def flt6(spark, d):
    end = F.lit("1995-06-17").cast("date")
    due = F.col("o_orderdate") < F.date_add(end, 1).cast("timestamp_ntz")
    return ops.equal_where_given(table(spark, d, "orders").filter(due), o_orderstatus="O").select("o_orderkey")


@add("flt7_non_blank_keys", "SELECT DISTINCT c_mktsegment AS key FROM customer WHERE c_mktsegment <> ''")
def flt7(spark, d):
    return table(spark, d, "customer").filter("c_mktsegment <> ''").select(F.col("c_mktsegment").alias("key")).distinct()


_NAME, _DESC, _KEY, _ALLOW = ["almond", "puff"], ["promo"], ["brass"], ["steel", "tin", "copper"]


def _case(column, terms):
    return "CASE " + " ".join(f"WHEN contains({column}, '{t}') THEN '{t}'" for t in terms) + " END"


_QUALIFY = f"""SELECT p_partkey, COALESCE('name_blacklist:' || {_case('n', _NAME)}, 'desc_blacklist:' || {_case('b', _DESC)}, 'keywords_blacklist:' || {_case('t', _KEY)}) AS blocked,
   'whitelist:' || COALESCE({_case('n', _ALLOW)}, {_case('t', _ALLOW)}) AS chosen
   FROM (SELECT p_partkey, lower(p_name) AS n, lower(p_brand) AS b, lower(p_type) AS t FROM part)"""


def _qualified(spark, d):
    return ops.qualify(table(spark, d, "part"), F.col("p_name"), F.col("p_brand"), F.col("p_type"), _NAME, _DESC, _KEY, _ALLOW)


@add("flt8_qualify", f"SELECT p_partkey, COALESCE(blocked, chosen, 'no_match') AS reason, blocked IS NULL AND chosen IS NOT NULL AS ok FROM ({_QUALIFY})")
def flt8(spark, d):
    return _qualified(spark, d).select("p_partkey", "reason", "ok")


@add("flt9_match_rate", f"SELECT count(*) FILTER (WHERE ok) AS kept, count(*) FILTER (WHERE NOT ok) AS dropped, round(100.0 * count(*) FILTER (WHERE ok) / CAST(count(*) AS DOUBLE), 3) AS rate FROM (SELECT blocked IS NULL AND chosen IS NOT NULL AS ok FROM ({_QUALIFY}))")
def flt9(spark, d):
    return _qualified(spark, d).agg(
        F.count_if("ok").alias("kept"), F.count_if(~F.col("ok")).alias("dropped"),
        F.round(100.0 * F.count_if("ok") / F.count(F.lit(1)).cast("double"), 3).alias("rate"),
    )


@add("flt10_allowed_columns", "SELECT c_custkey, c_name, c_mktsegment FROM customer")
def flt10(spark, d):
    allowed = ("c_custkey", "c_name", "c_mktsegment", "not_there")
    c = table(spark, d, "customer")
    return c.select(*[n for n in allowed if n in c.columns])


@add("flt11_enum_check", "SELECT o_orderstatus, o_orderstatus IN ('O', 'F') AS valid, count(*) AS n FROM orders GROUP BY ALL")
def flt11(spark, d):
    return table(spark, d, "orders").groupBy("o_orderstatus", F.col("o_orderstatus").isin("O", "F").alias("valid")).agg(F.count(F.lit(1)).alias("n"))


@add("flt12_own_posts", "SELECT event_id FROM events WHERE NOT (event_type = 'view' OR user_id <> 7 OR props = '')")
def flt12(spark, d):
    return table(spark, d, "events").filter(~((F.col("event_type") == "view") | (F.col("user_id") != 7) | (F.col("props") == ""))).select("event_id")


@add("flt13_pending_metrics", "SELECT d.doc_id FROM documents d LEFT JOIN labels l USING (doc_id) WHERE trim(coalesce(CAST(l.quality AS VARCHAR), '')) = '' OR trim(coalesce(CAST(l.toxic AS VARCHAR), '')) = ''")
def flt13(spark, d):
    blank = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == ""
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left").filter(blank("quality") | blank("toxic")).select("doc_id")


@add("flt14_category_sets", "SELECT event_id, lower(trim(event_type)) IN ('purchase', 'signup') AS positive, lower(trim(event_type)) IN ('error') AS ignored FROM events")
def flt14(spark, d):
    kind = F.lower(F.trim("event_type"))
    return table(spark, d, "events").select("event_id", kind.isin("purchase", "signup").alias("positive"), kind.isin("error").alias("ignored"))


@add("flt15_stalled", "SELECT user_id, n, CAST(floor(epoch(TIMESTAMP '2024-02-15' - last) / 86400) AS BIGINT) AS days FROM (SELECT user_id, count(*) AS n, max(ts) AS last FROM events GROUP BY user_id) WHERE n >= 5 AND floor(epoch(TIMESTAMP '2024-02-15' - last) / 86400) >= 15")
def flt15(spark, d):
    seen = table(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last"))
    age = F.floor((F.unix_micros(F.lit("2024-02-15").cast("timestamp")) - F.unix_micros(F.col("last").cast("timestamp"))) / 86400e6)
    return seen.withColumn("days", age).filter("n >= 5 AND days >= 15").select("user_id", "n", "days")


@add("flt16_waiting_on_them", "SELECT o_custkey FROM orders GROUP BY o_custkey HAVING arg_max(o_orderstatus, (o_orderdate, o_orderkey)) = 'O' AND max(o_orderdate) < (SELECT max(o_orderdate) FROM orders) - INTERVAL '24' HOUR")
def flt16(spark, d):
    """Customers as threads whose latest order is open (ours) and over a day older than the latest of all."""
    orders = table(spark, d, "orders")
    now = orders.agg(F.max("o_orderdate").alias("now"))  # one row
    last = orders.groupBy("o_custkey").agg(F.max_by("o_orderstatus", F.struct("o_orderdate", "o_orderkey")).alias("status"), F.max("o_orderdate").alias("at"))
    return last.crossJoin(F.broadcast(now)).filter((F.col("status") == "O") & (F.col("at") < F.col("now") - F.expr("INTERVAL '24' HOUR"))).select("o_custkey")


@add("flt17_bucket_overlap", "SELECT b.name, count(*) AS n FROM (VALUES ('tiny', 1, 10), ('small', 11, 20), ('mid', 21, 35), ('big', 36, 60)) b(name, lo, hi), part WHERE b.hi >= p_size AND b.lo <= p_size + 5 GROUP BY b.name")
def flt17(spark, d):
    buckets = spark.createDataFrame([("tiny", 1, 10), ("small", 11, 20), ("mid", 21, 35), ("big", 36, 60)], "name string, lo int, hi int")
    # four rows: the bucket table's size is fixed
    hit = table(spark, d, "part").join(F.broadcast(buckets), ops.overlaps(F.col("lo"), F.col("hi"), F.col("p_size"), F.col("p_size") + 5))
    return hit.groupBy("name").agg(F.count(F.lit(1)).alias("n"))


@add("flt18_active_jobs", "SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('O', 'P') ORDER BY o_orderdate DESC, o_orderkey LIMIT 200")
def flt18(spark, d):
    return list_jobs(table(spark, d, "orders"), ("O", "P"), 500)


def list_jobs(orders, statuses, limit):
    """The newest rows of the statuses; the limit is kept within 1 and 200."""
    return orders.filter(F.col("o_orderstatus").isin(*statuses)).orderBy(F.desc("o_orderdate"), "o_orderkey").limit(max(1, min(200, limit))).select("o_orderkey")


@add("prj1_first_truthy", "SELECT event_id, COALESCE(nullif(json_extract_string(props, '$.name'), ''), nullif(json_extract_string(props, '$.k'), ''), nullif(event_type, '')) AS name FROM events")
def prj1(spark, d):
    pick = ops.first_truthy(F.get_json_object("props", "$.name"), F.get_json_object("props", "$.k"), F.col("event_type"))
    return table(spark, d, "events").select("event_id", pick.alias("name"))


@add("prj2_null_or_empty_list", "SELECT doc_id, CASE WHEN quality IS NULL THEN NULL WHEN quality = 0 THEN 0 ELSE 1 END AS restricted, coalesce(CASE WHEN toxic = 1 THEN 1 ELSE 0 END, 0) AS tags FROM documents LEFT JOIN labels USING (doc_id)")
def prj2(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    kept = F.when(F.col("quality").isNull(), F.lit(None)).when(F.col("quality") == 0, F.array().cast("array<int>")).otherwise(F.array("quality"))
    filled = F.when(F.col("toxic") == 1, F.array("toxic")).otherwise(F.array().cast("array<int>"))
    return rows.select("doc_id", F.when(kept.isNotNull(), F.size(kept)).alias("restricted"), F.size(filled).alias("tags"))


@add("prj3_exact_count", "SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'F'")
def prj3(spark, d):
    return table(spark, d, "orders").filter("o_orderstatus = 'F'").agg(F.count(F.lit(1)).alias("n"))
