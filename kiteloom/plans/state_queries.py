"""Queries of state transitions: upserts, counters, cooldowns and job life cycles."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kiteloom.operators import state as ops
from kiteloom.operators.joins import updated
from kiteloom.operators.sequences import clamped_running_sum
from kiteloom.plans.registry import Family
from kiteloom.sources.tables import table

FAMILY = Family("state")
add, sql = FAMILY.add, FAMILY.sql


@add("up1_upsert", "SELECT c_custkey AS k, CASE WHEN e.user_id IS NULL THEN c_name ELSE e.event_type END AS v FROM customer FULL JOIN (SELECT user_id, arg_max(event_type, (event_id)) AS event_type FROM events WHERE user_id IN (SELECT c_custkey FROM customer) GROUP BY user_id) e ON c_custkey = user_id")
def up1(spark, d):
    base = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("v"))
    changes = table(spark, d, "events").select(F.col("user_id").alias("k"), F.col("event_type").alias("v"), F.col("event_id").alias("seq")).join(base.select("k"), "k", "left_semi")
    return ops.upsert(base, changes, ["k"], "seq")


@add("up2_owned_columns", "SELECT coalesce(n_nationkey, k) AS n_nationkey, coalesce(new_name, n_name) AS n_name, n_regionkey FROM nation FULL JOIN (SELECT CAST(s_suppkey AS INTEGER) AS k, s_name AS new_name FROM supplier) ON n_nationkey = k")
def up2(spark, d):
    changes = table(spark, d, "supplier").select(F.col("s_suppkey").cast("int").alias("n_nationkey"), F.col("s_name").alias("n_name"))
    return ops.upsert_owned(table(spark, d, "nation"), changes, "n_nationkey", ["n_name"])


_DELTA = "CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'error' THEN -3 ELSE -1 END"


@add("up3_clamped_counter", f"WITH s AS (SELECT event_id, user_id, ts, sum({_DELTA}) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM events) SELECT event_id, CAST(s - least(0, min(s) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)) AS BIGINT) AS value FROM s")
def up3(spark, d):
    rows = table(spark, d, "events").withColumn("delta", F.expr(_DELTA))
    return clamped_running_sum(rows, ["user_id"], ["ts", "event_id"], "delta").select("event_id", "value")


sql("up4_set_absolute", "SELECT user_id, greatest(0.0, max_by(value - 20, struct(ts, event_id))) AS value FROM events GROUP BY user_id", "SELECT user_id, greatest(0.0, max_by(value - 20, (ts, event_id))) AS value FROM events GROUP BY user_id")
_STATE = "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE CAST(p_partkey % 6 AS INTEGER) END AS used_ago, CAST(p_size AS INTEGER) AS use_count FROM part"


def _state(spark, d):
    table(spark, d, "part").createOrReplaceTempView("part")
    return spark.sql(_STATE.replace("INTEGER", "INT"))


_SOLD = "p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 50)"


@add("up5_mark_used", f"SELECT p_partkey, CASE WHEN {_SOLD} THEN 0 ELSE used_ago END AS used_ago, use_count + CASE WHEN {_SOLD} THEN 1 ELSE 0 END AS use_count FROM ({_STATE})")
def up5(spark, d):
    """Parts sold in the largest quantity are used."""
    sold = table(spark, d, "lineitem").filter("l_quantity >= 50").select(F.col("l_partkey").alias("p_partkey"))
    return ops.mark_used(_state(spark, d), sold, "p_partkey")


@add("up6_mark_or_insert", "SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.k IS NOT NULL THEN 0 ELSE a.used_ago END AS used_ago, coalesce(a.use_count, 0) + CASE WHEN b.k IS NOT NULL THEN 1 ELSE 0 END AS use_count FROM (SELECT l_partkey AS k, 2 AS used_ago, count(*) AS use_count FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_partkey) a FULL JOIN (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_linestatus = 'O') b ON a.k = b.k")
def up6(spark, d):
    """Parts that came back have a state; parts on open lines are used, with or without one."""
    lines = table(spark, d, "lineitem").withColumnRenamed("l_partkey", "k")
    rows = lines.filter("l_returnflag = 'R'").groupBy("k").agg(F.count(F.lit(1)).alias("use_count")).select("k", F.lit(2).alias("used_ago"), "use_count")
    return ops.mark_used_or_insert(rows, lines.filter("l_linestatus = 'O'").select("k"), ["k"])


@add("up7_advance", f"SELECT p_partkey, CASE WHEN used_ago + 1 <= 5 THEN used_ago + 1 END AS used_ago, use_count FROM ({_STATE})")
def up7(spark, d):
    return ops.advance(_state(spark, d))


_STATUS = "CASE o_orderstatus WHEN 'O' THEN 'applied' WHEN 'F' THEN 'new' WHEN 'P' THEN 'skipped' END"
_BEFORE = {"seen": "CASE WHEN o_orderkey % 2 = 0 THEN o_orderdate - INTERVAL '1' DAY END", "applied": "CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate - INTERVAL '1' DAY END", "link": "CASE WHEN o_orderkey % 5 = 0 THEN o_orderpriority END", "new_link": "CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN concat('doc ', o_orderpriority) END"}


@add("up8_status_times", f"""SELECT o_orderkey, s AS status, CASE s WHEN 'new' THEN NULL WHEN 'applied' THEN o_orderdate WHEN 'skipped' THEN o_orderdate ELSE seen END AS seen, CASE s WHEN 'new' THEN NULL WHEN 'applied' THEN o_orderdate ELSE applied END AS applied,
    CASE WHEN s = 'new' THEN NULL WHEN s = 'applied' AND coalesce(new_link, '') <> '' THEN new_link ELSE link END AS link FROM (SELECT o_orderkey, o_orderdate, {_STATUS} AS s, {', '.join(f'{e} AS {n}' for n, e in _BEFORE.items())} FROM orders)""")
def up8(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderdate", F.expr(_STATUS).alias("status"), *[F.expr(e).alias(n) for n, e in _BEFORE.items()])
    changed = ops.status_times(*map(F.col, ("status", "o_orderdate", "seen", "applied", "link", "new_link")))
    return rows.select("o_orderkey", "status", *[c.alias(n) for c, n in zip(changed, ("seen", "applied", "link"), strict=True)])


sql("up9_append_and_status", "SELECT c_custkey, coalesce(s.status, 'none') AS status, coalesce(s.n, 0) AS logs FROM customer LEFT JOIN (SELECT o_custkey, max_by(o_orderstatus, o_orderkey) AS status, count(*) AS n FROM orders GROUP BY o_custkey) s ON c_custkey = s.o_custkey")
sql("up10_follow_up_sent", "SELECT user_id, count(*) + 1 AS follow_ups, max(ts) AS last_at FROM events WHERE event_type = 'signup' GROUP BY user_id")


#: Events as changes of a user's job.
_CHANGE = {"status": "CASE event_type WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'FAILED' ELSE 'RUNNING' END", "stage": "CASE event_type WHEN 'view' THEN 'extract' WHEN 'click' THEN 'Generate' WHEN 'signup' THEN 'review' ELSE 'other' END", "progress": "CASE WHEN event_id % 3 = 0 THEN CAST(floor(value) - 20 AS INT) END"}


@add("up11_job_progress", f"""WITH c AS (SELECT event_id, user_id, ts, {', '.join(f"{e.replace('AS INT)', 'AS INTEGER)')} AS {n}" for n, e in _CHANGE.items())} FROM events),
  s AS (SELECT *, CASE WHEN status = 'done' THEN 100 WHEN progress IS NOT NULL THEN least(greatest(progress, 0), 100) ELSE CASE stage WHEN 'extract' THEN 10 WHEN 'Generate' THEN 20 WHEN 'review' THEN 55 ELSE 0 END END AS step FROM c)
  SELECT event_id, max(step) OVER u AS progress, min(CASE WHEN status IN ('done', 'FAILED') THEN ts END) OVER u AS finished_at FROM s WINDOW u AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""")
def up11(spark, d):
    changes = table(spark, d, "events").select("event_id", "user_id", "ts", *[F.expr(e).alias(n) for n, e in _CHANGE.items()])
    return ops.job_lifecycle(changes, "user_id", ["ts", "event_id"], "ts").select("event_id", "progress", "finished_at")


@add("up12_expire", "SELECT o_orderkey, CASE WHEN gone THEN 'EXPIRED' ELSE o_orderstatus END AS status, CASE WHEN gone THEN 0 ELSE 2 END AS outputs, CASE WHEN gone THEN 'Generated files expired.' END AS error FROM (SELECT *, (SELECT max(o_orderdate) FROM orders) > coalesce(CASE WHEN o_orderkey % 4 = 0 THEN o_orderdate END, o_orderdate + INTERVAL '400' DAY) AS gone FROM orders)")
def up12(spark, d):
    """Orders as jobs at the time of the latest; one of four has an end of its own, the others are kept for 400 days."""
    orders = table(spark, d, "orders")
    latest = orders.agg(F.max("o_orderdate").alias("now"))  # one row
    jobs = orders.select("o_orderkey", F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("created_at"), F.when(F.col("o_orderkey") % 4 == 0, F.col("o_orderdate")).alias("expires_at"), F.array("o_orderpriority", "o_orderstatus").alias("outputs"), F.lit(None).cast("string").alias("error"))
    done = ops.expired(jobs.crossJoin(F.broadcast(latest)), F.col("now"), F.expr("INTERVAL '400' DAY"))
    return done.select("o_orderkey", "status", F.size("outputs").alias("outputs"), "error")


sql("up13_reap", "SELECT user_id, CASE WHEN max(ts) < TIMESTAMP '2024-01-28' THEN 'FAILED' ELSE 'RUNNING' END AS status FROM events GROUP BY user_id")


@add("up14_metrics_patch", "SELECT d.doc_id, coalesce(CAST(l.quality AS BIGINT), d.n_chars) AS n_chars FROM documents d LEFT JOIN labels l USING (doc_id)")
def up14(spark, d):
    changes = table(spark, d, "labels").select("doc_id", F.col("quality").cast("long").alias("n_chars"))
    return updated(table(spark, d, "documents").select("doc_id", "n_chars"), changes, "doc_id", ["n_chars"])


@add("up15_nested_import", "SELECT event_id, 'k' AS metric, try_cast(json_extract_string(props, '$.k') AS INTEGER) AS value FROM events WHERE try_cast(json_extract_string(props, '$.k') AS INTEGER) IS NOT NULL")
def up15(spark, d):
    cells = F.explode(F.from_json("props", "map<string,string>"))
    rows = table(spark, d, "events").select("event_id", cells.alias("metric", "raw"))
    return rows.select("event_id", "metric", F.col("raw").try_cast("int").alias("value")).filter("value IS NOT NULL")
