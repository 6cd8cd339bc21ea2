"""Queries of sources and sinks whose meaning is relational."""

from __future__ import annotations

from pyspark.sql import functions as F

from kiteloom.operators.ranking import global_rank
from kiteloom.plans.registry import Family
from kiteloom.sources import files, sinks, stages
from kiteloom.sources.tables import table

FAMILY = Family("sources")
add, sql = FAMILY.add, FAMILY.sql

sql("src1_ordered_scan", "SELECT doc_id, lang, n_chars FROM documents ORDER BY doc_id")


@add("src2_csv_read", "SELECT n_name, CAST(n_regionkey AS VARCHAR) AS n_regionkey, CAST(NULL AS VARCHAR) AS missing FROM nation")
def src2(spark, d):
    """A CSV file of nations read as strings; a column it lacks is null."""
    path = stages.new_path(spark, "csv")
    sinks.write_csv(table(spark, d, "nation"), path, ["n_name", "n_regionkey"])
    return files.read_csv(spark, path, ["n_name", "n_regionkey", "missing"])


@add("src3_csv_write", "SELECT c_mktsegment || ',' || c_custkey || ',' AS line FROM customer")
def src3(spark, d):
    """The lines of a CSV file of fixed columns, of which one is absent."""
    path = stages.new_path(spark, "csv")
    sinks.write_csv(table(spark, d, "customer"), path, ["c_mktsegment", "c_custkey", "absent"])
    lines = spark.read.text(path).select(F.col("value").alias("line"))
    return lines.filter("line <> 'c_mktsegment,c_custkey,absent'").select(F.regexp_replace("line", '""$', "").alias("line"))


@add("src4_mapped_columns", "SELECT concat(c_name, ' ', chr(65533), 't') AS name, coalesce(trim(c_mktsegment), '') AS company, '' AS phone FROM customer")
def src4(spark, d):
    """An upload with a byte order mark and bytes that are no UTF-8, read under the caller's column names."""
    path = stages.new_path(spark, "upload")
    upload = table(spark, d, "customer").select(F.concat(F.lit("  "), "c_name", F.lit(" ét ")).alias("ï»¿Full Name"), F.col("c_mktsegment").alias("Company"))
    upload.write.csv(path, header=True, encoding="ISO-8859-1", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return files.mapped_columns(files.read_csv(spark, path, ["Full Name", "Company"]), {"name": "Full Name", "company": "Company", "phone": "missing"})


@add("src5_ordered_concat", "SELECT n, k, name FROM (SELECT 0 AS n, s_suppkey AS k, s_name AS name FROM supplier UNION ALL SELECT 1, c_custkey, c_name FROM customer)")
def src5(spark, d):
    """Files of JSON arrays of two tables, read in the order of the arguments."""
    paths = [stages.new_path(spark, "arrays") for _ in range(2)]
    sinks.write_json_arrays(table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name")), paths[0])
    sinks.write_json_arrays(table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name")), paths[1])
    return files.read_json_arrays(spark, paths, "k long, name string").select(F.col("input_no").alias("n"), "k", "name")


@add("src6_rule_terms", "SELECT p_partkey, unnest(['block', 'block', 'allow']) AS list_name, lower(unnest([p_type, p_brand, trim(p_name)])) AS term FROM part")
def src6(spark, d):
    """A rule file a part, with quoted terms, comments and blank lines."""
    text = F.concat(F.lit("# rules\nblock:\n  - '"), "p_type", F.lit("'\n\n  -  "), F.replace("p_brand", F.lit(" #"), F.lit("#")), F.lit("  # a comment\nallow:\n- \" "), "p_name", F.lit(" \"\n"))
    return files.rule_terms(table(spark, d, "part").select("p_partkey", text.alias("text")), "p_partkey", "text")


@add("src7_topic_leaves", "SELECT p_partkey, unnest([0, 0, 1]) AS bullet, unnest([p_brand, p_brand, 'b1']) AS text, unnest([p_type, p_type, 'f1']) AS facet, unnest([p_name, CAST(p_size AS VARCHAR), p_brand]) AS leaf FROM part")
def src7(spark, d):
    """A topic tree a part, as JSON, with a blank label and a facet without leaves."""
    leaf = lambda *labels: F.array(*[F.struct(x.alias("label")) for x in labels])
    facet = lambda label, leaves: F.struct(label.alias("label"), leaves.alias("leaves"))
    none = F.array().cast("array<struct<label:string>>")
    bullets = F.array(
        F.struct(F.col("p_brand").alias("text"), F.array(facet(F.col("p_type"), leaf(F.col("p_name"), F.lit(" "), F.col("p_size").cast("string"))), facet(F.lit("empty"), none)).alias("facets")),
        F.struct(F.lit("b1").alias("text"), F.array(facet(F.lit("f1"), leaf(F.col("p_brand")))).alias("facets")),
    )
    return files.topic_leaves(table(spark, d, "part").select("p_partkey", F.to_json(bullets).alias("tree")), "p_partkey", "tree")


@add("src8_split_by_range", "SELECT p_partkey, CASE WHEN p_size < 10 THEN 'a' WHEN p_size < 25 THEN 'b' WHEN p_size < 40 THEN 'c' ELSE 'd' END AS part FROM part")
def src8(spark, d):
    return files.split_by_range(table(spark, d, "part"), "p_size", [("a", 10), ("b", 25), ("c", 40), ("d", None)]).select("p_partkey", "part")


@add("src9_page_sources", "SELECT md5(text) AS body, length(text) AS n FROM benchmark")
def src9(spark, d):
    """The benchmark's texts, a file each, read back whole."""
    path = stages.new_path(spark, "texts")
    sinks.write_each(table(spark, d, "benchmark"), path, "text")
    body = F.regexp_replace("text", "\n\\z", "")  # the last line's end is the file's
    return files.read_texts(spark, path).select(F.md5(body).alias("body"), F.length(body).cast("long").alias("n"))


@add("src10_job_listing", "SELECT 'job' || s_suppkey AS job_id, CASE WHEN s_acctbal > 0 THEN 'DONE' ELSE 'RUNNING' END AS status, CASE WHEN s_acctbal > 0 THEN 100 ELSE 50 END AS progress, s_suppkey AS created_at, s_name AS error FROM supplier")
def src10(spark, d):
    """Job records, a JSON file each, as a listing."""
    path = stages.new_path(spark, "jobs")
    done = F.col("s_acctbal") > 0
    record = F.struct(F.concat(F.lit("job"), "s_suppkey").alias("job_id"), F.when(done, "DONE").otherwise("RUNNING").alias("status"), F.when(done, 100).otherwise(50).alias("progress"), F.col("s_suppkey").alias("created_at"), F.col("s_name").alias("error"))
    sinks.write_each(table(spark, d, "supplier").select(F.to_json(record).alias("record")), path, "record")
    return files.read_jobs(spark, path).select("job_id", "status", "progress", "created_at", "error")


@add("src11_paging", "SELECT page, count(*) AS n FROM (SELECT CAST(floor((row_number() OVER (ORDER BY c_custkey) - 1) / 500) AS BIGINT) AS page FROM customer) t GROUP BY page")
def src11(spark, d):
    ranked = global_rank(table(spark, d, "customer").select("c_custkey"), ["c_custkey"], "nth")
    return ranked.groupBy(F.floor((F.col("nth") - 1) / 500).alias("page")).agg(F.count(F.lit(1)).alias("n"))


@add("snk1_replace_by_source", "SELECT doc_id, source FROM documents WHERE source <> 'src3' UNION ALL SELECT doc_id + 1000000, source FROM documents WHERE source = 'src3'")
def snk1(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source")
    fresh = docs.filter("source = 'src3'").withColumn("doc_id", F.col("doc_id") + 1000000)
    return sinks.replaced(docs, fresh, "source")


@add("snk2_skip_loaded", "SELECT doc_id FROM documents WHERE source NOT IN (SELECT source FROM documents JOIN labels USING (doc_id) WHERE toxic = 1 GROUP BY source HAVING count(*) > 1)")
def snk2(spark, d):
    docs = table(spark, d, "documents")
    toxic = docs.join(table(spark, d, "labels").filter("toxic = 1"), "doc_id").groupBy("source").count()
    return sinks.not_loaded(docs, toxic.filter("count > 1"), "source").select("doc_id")


sql("snk3_incremental", "SELECT doc_id FROM documents LEFT ANTI JOIN (SELECT doc_id AS done FROM labels) l ON doc_id = done", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
sql("snk4_wipe_key", "SELECT doc_id FROM documents WHERE source <> 'src5'")


@add("snk5_atomic_publish", "SELECT p_partkey, p_size FROM part")
def snk5(spark, d):
    return stages.published(table(spark, d, "part").select("p_partkey", "p_size"), "published")


@add("snk6_export_projection", "SELECT CAST(c_custkey AS VARCHAR) AS id, coalesce(c_name, '') AS name, '' AS email, coalesce(c_mktsegment, '') AS industry, 'New' AS stage FROM customer")
def snk6(spark, d):
    return sinks.export_rows(table(spark, d, "customer"), {"id": "c_custkey", "name": "c_name", "email": None, "industry": "c_mktsegment"}, {"stage": "New"})
