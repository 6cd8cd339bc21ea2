"""Aggregation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kiteloom.operators import aggregates as ops
from kiteloom.operators.ranking import rank_within, running_within
from kiteloom.plans.registry import Family
from kiteloom.sources.tables import table

FAMILY = Family("aggregates")


@FAMILY.add(
    "ag1_corpus_health",
    """
    SELECT source, total, n_short, n_markup, n_link, n_long,
           ((n_short + n_markup) / CAST(greatest(total, 1) AS DOUBLE) > 0.02
            OR n_link / CAST(greatest(total, 1) AS DOUBLE) > 0.40) AS flagged
    FROM (SELECT source, count(*) AS total,
                 count(*) FILTER (WHERE length(text) < 200) AS n_short,
                 count(*) FILTER (WHERE contains(text, '|')) AS n_markup,
                 count(*) FILTER (WHERE contains(text, 'http')) AS n_link,
                 count(*) FILTER (WHERE length(text) > 8000) AS n_long
          FROM documents GROUP BY source)
    """,
)
def ag1_corpus_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return ops.corpus_health(
        table(spark, sf_dir, "documents"),
        "source",
        {
            "n_short": F.length(text) < 200,
            "n_markup": text.contains("|"),
            "n_link": text.contains("http"),
            "n_long": F.length(text) > 8000,
        },
        damage=["n_short", "n_markup"],
        fragments="n_link",
    )


sql = FAMILY.sql
_SOURCES = """SELECT source, count(*) AS total, count(*) FILTER (WHERE length(text) < 200) AS n_short, count(*) FILTER (WHERE contains(text, '|')) AS n_markup, count(*) FILTER (WHERE contains(text, 'http')) AS n_link FROM documents GROUP BY source"""
sql("ag2_unhealthy_sources", f"SELECT count(*) AS flagged FROM ({_SOURCES}) s WHERE (n_short + n_markup) / cast(greatest(total, 1) AS DOUBLE) > 0.02 OR n_link / cast(greatest(total, 1) AS DOUBLE) > 0.40")
sql("ag3_group_counts", "SELECT p_type, count(*) AS n FROM part GROUP BY p_type ORDER BY n DESC, p_type")
sql("ag4_nested_histogram", "SELECT lang, source, count(*) AS n FROM documents GROUP BY lang, source")
sql("ag5_first_example", "SELECT source, min(doc_id) AS doc_id, min_by(n_chars, doc_id) AS n_chars FROM documents GROUP BY source")


@FAMILY.add("ag6_bucket_medians", "SELECT CASE WHEN trim(coalesce(CAST(quality AS VARCHAR), '')) = '' THEN '(none)' ELSE CAST(quality AS VARCHAR) END AS bucket, CAST(trunc(median(n_chars)) AS BIGINT) AS median FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def ag6(spark, d):
    return ops.bucket_medians(table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left"), "quality", F.col("n_chars"))


@FAMILY.add("ag7_bucket_stats", "SELECT CAST(o_orderpriority AS VARCHAR) AS bucket, count(*) AS n, CAST(trunc(median(o_totalprice)) AS BIGINT) AS median FROM orders GROUP BY 1")
def ag7(spark, d):
    return ops.bucket_medians(table(spark, d, "orders"), "o_orderpriority", F.col("o_totalprice"), count=True).select("bucket", "n", "median")


@FAMILY.add("ag8_engagement", "SELECT doc_id, CASE WHEN quality IS NULL AND toxic IS NULL THEN NULL ELSE coalesce(quality, 0) + coalesce(toxic, 0) END AS engagement FROM documents LEFT JOIN labels USING (doc_id)")
def ag8(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    return rows.select("doc_id", ops.engagement(F.col("quality"), F.col("toxic")).alias("engagement"))


@FAMILY.add("ag9_content_mix", "WITH c AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1), t AS (SELECT * FROM (VALUES ('view', 0.5::DOUBLE), ('click', 0.2::DOUBLE), ('podcast', 0.1::DOUBLE)) v(event_type, target)) SELECT event_type, coalesce(n, 0) AS n, round(coalesce(n, 0) / CAST(greatest((SELECT sum(n) FROM c), 1) AS DOUBLE), 6) AS share, target, abs(coalesce(n, 0) / CAST(greatest((SELECT sum(n) FROM c), 1) AS DOUBLE) - target) > 0.10 AS off_target FROM c FULL OUTER JOIN t USING (event_type)")
def ag9(spark, d):
    targets = spark.createDataFrame([("view", 0.5), ("click", 0.2), ("podcast", 0.1)], "event_type string, target double")
    return ops.share_against_target(table(spark, d, "events"), "event_type", targets).withColumn("share", F.round("share", 6))


@FAMILY.add("ag10_lifetime", "SELECT o_custkey, count(*) AS sent, count(*) FILTER (WHERE o_orderstatus = 'F') AS replies, round(CASE WHEN count(*) FILTER (WHERE o_orderstatus <> 'O') = 0 THEN 0.0 ELSE count(*) FILTER (WHERE o_orderstatus = 'F') / CAST(count(*) FILTER (WHERE o_orderstatus <> 'O') AS DOUBLE) END, 6) AS rate FROM orders GROUP BY o_custkey")
def ag10(spark, d):
    sums = table(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("sent"), F.count_if(F.col("o_orderstatus") == "F").alias("replies"), F.count_if(F.col("o_orderstatus") != "O").alias("done"))
    return sums.select("o_custkey", "sent", "replies", F.round(ops.safe_ratio(F.col("replies"), F.col("done")), 6).alias("rate"))


sql("ag11_step_sums", "SELECT l_linenumber AS step, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY l_linenumber")
sql("ag12_daily_sums", "SELECT cast(ts AS DATE) AS day, count(*) AS n, round(sum(value), 2) AS value FROM events GROUP BY 1 ORDER BY 1 DESC LIMIT 30")
sql("ag13_category_histogram", "SELECT coalesce(nullif(trim(CASE WHEN event_type = 'view' THEN ' ' ELSE event_type END), ''), 'uncategorized') AS category, count(*) AS n, count(*) FILTER (WHERE event_type IN ('purchase', 'signup')) AS positive FROM events GROUP BY 1")
sql("ag14_tab_counts", "SELECT count(*) FILTER (WHERE o_orderstatus = 'O') AS o, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) FILTER (WHERE o_orderstatus = 'X') AS x FROM orders")
sql("ag15_sample_verdict", "SELECT source, CASE WHEN avg(noise) > 1.0 THEN 're-ocr' WHEN avg(CASE WHEN short THEN 1.0 ELSE 0.0 END) > 0.15 THEN 'restructure' ELSE 'clean' END AS verdict FROM (SELECT source, length(text) - length(replace(text, '!', '')) AS marks, (length(text) - length(replace(text, '!', ''))) * 100.0 / greatest(length(text), 1) AS noise, length(text) < 600 AS short, row_number() OVER (PARTITION BY source ORDER BY md5(concat('7|', cast(doc_id AS STRING)))) AS nth FROM documents) s WHERE nth <= 60 GROUP BY source")


@FAMILY.add("ag16_distinct_numbers", "SELECT page_id, CAST(len(list_distinct(list_filter(list_transform(regexp_extract_all(html, '[0-9]+'), lambda x: try_cast(x AS INTEGER)), lambda x: x BETWEEN 1 AND 300))) AS INTEGER) AS n FROM pages")
def ag16(spark, d):
    found = F.transform(F.regexp_extract_all("html", F.lit("([0-9]+)"), F.lit(1)), lambda x: x.try_cast("int"))
    return table(spark, d, "pages").select("page_id", F.size(F.array_distinct(F.filter(found, lambda x: x.between(1, 300)))).alias("n"))


sql("ag17_facets", "SELECT count(DISTINCT p_brand) AS facets, count(*) AS leaves FROM part WHERE p_type IS NOT NULL")


@FAMILY.add("ag18_day_map", "SELECT CAST(ts AS DATE) AS day, count(*) FILTER (WHERE event_type = 'view') AS view, count(*) FILTER (WHERE event_type = 'click') AS click FROM events WHERE CAST(ts AS DATE) = DATE '2024-01-05' GROUP BY 1")
def ag18(spark, d):
    day = table(spark, d, "events").withColumn("day", F.col("ts").cast("date")).filter(F.col("day") == F.lit("2024-01-05").cast("date"))
    cells = day.groupBy("day", "event_type").agg(F.count(F.lit(1)).alias("n"))
    return cells.groupBy("day").pivot("event_type", ["view", "click"]).agg(F.coalesce(F.sum("n"), F.lit(0))).na.fill(0, ["view", "click"])


sql("ag19_cost", "SELECT round(sum(n_chars * price / 1000.0), 4) AS cost FROM documents JOIN (SELECT * FROM (VALUES ('en', 0.5), ('de', 0.7), ('fr', 0.6)) AS p(lang, price)) q ON documents.lang = q.lang")


@FAMILY.add("ag20_letter_sum", "SELECT n_name, CAST(list_sum(list_transform(string_split(lower(n_name), ''), lambda c: CASE WHEN c BETWEEN 'a' AND 'z' THEN ascii(c) - 96 ELSE 0 END)) AS INTEGER) AS total FROM nation")
def ag20(spark, d):
    value = lambda c: F.when(c.between("a", "z"), F.ascii(c) - 96).otherwise(0)
    return table(spark, d, "nation").select("n_name", F.aggregate(F.split(F.lower("n_name"), ""), F.lit(0), lambda s, c: s + value(c)).alias("total"))


_REVIEWED = "SELECT d.source, d.doc_id, l.quality = 0 AS flag, l.toxic = 1 AS no_sources, d.lang = 'fr' AS no_solution, d.source LIKE '%0' AS official FROM documents d JOIN labels l USING (doc_id)"


@FAMILY.add("ag21_review_summary", f"WITH r AS (SELECT source, doc_id, NOT official AND (flag OR (no_sources AND no_solution)) AS flagged FROM ({_REVIEWED})), t AS (SELECT source, count(*) AS total, count(*) FILTER (WHERE flagged) AS flagged FROM r GROUP BY source) SELECT t.source, total, t.flagged, r.doc_id FROM t LEFT JOIN r ON r.source = t.source AND r.flagged")
def ag21(spark, d):
    """Each source's counts with a row for each of its flagged documents, one without any where there are none."""
    for name in ("documents", "labels"):
        table(spark, d, name).createOrReplaceTempView(name)
    return ops.review_summary(spark.sql(_REVIEWED), "source", "doc_id")


sql("ag22_shortfall", "SELECT built, extracted, built < 0.9 * extracted AS short FROM (SELECT (SELECT count(*) FROM labels) AS built, (SELECT count(*) FROM documents) AS extracted) t")
sql("ag23_retained", "SELECT count(*) FILTER (WHERE o_orderdate >= TIMESTAMP '1995-01-01') AS retained, count(*) FILTER (WHERE o_orderdate < TIMESTAMP '1995-01-01') AS expired FROM orders")
sql("ag24_leaderboard", "SELECT user_id, round(sum(value), 2) AS total FROM events GROUP BY user_id ORDER BY total DESC, user_id LIMIT 20")
sql("ag25_members", "SELECT c_nationkey, count(*) FILTER (WHERE c_custkey % 2 = 0) AS even, count(*) FILTER (WHERE c_custkey % 2 = 1) AS odd FROM customer GROUP BY c_nationkey")

sql("bonus_rollup", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
sql("bonus_grouping_sets", "SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY GROUPING SETS ((p_brand), (p_size), ())")
sql("bonus_cube", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
@FAMILY.add("bonus_rank_ntile", "SELECT event_id, rank() OVER (PARTITION BY event_type ORDER BY user_id) AS rnk, ntile(4) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS quart FROM events")
def rank_ntile(spark, d):
    """Ranks and quarters within a handful of large types."""
    rows = table(spark, d, "events").select("event_id", "event_type", "user_id", "ts")
    users = running_within(rows.groupBy("event_type", "user_id").agg(F.count(F.lit(1)).alias("n")), "event_type", ["user_id"], "n", "upto")
    sizes = rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("size"))
    placed = rank_within(rows, "event_type", ["ts", "event_id"], "nth").join(sizes, "event_type").join(users, ["event_type", "user_id"])
    low, more, at = F.floor(F.col("size") / 4), F.col("size") % 4, F.col("nth") - 1
    quart = F.when(at < more * (low + 1), F.floor(at / (low + 1))).otherwise(more + F.floor((at - more * (low + 1)) / F.greatest(low, F.lit(1))))
    return placed.select("event_id", (F.col("upto") - F.col("n") + 1).alias("rnk"), (quart + 1).alias("quart"))


sql("bonus_moving_average", "SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), 6) AS mean4 FROM events")
sql("bonus_intersect_except", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier EXCEPT SELECT n_nationkey FROM nation WHERE n_regionkey = 1")
sql("bonus_pricing_summary", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus")
