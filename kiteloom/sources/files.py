"""File sources: CSV, JSON and rules as DataFrames of defined columns."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException


def read_csv(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """All-string rows with the given columns; a blank is missing, no file is no rows."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    try:
        rows = spark.read.csv(path, header=True, inferSchema=False, multiLine=True, escape='"')
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)
    have = {c.lstrip("﻿").strip(): c for c in rows.columns}
    return rows.select(*[(F.col(f"`{have[c]}`") if c in have else F.lit(None).cast("string")).alias(c) for c in columns])


def mapped_columns(rows: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Columns under the caller's names: trimmed strings, blank where absent or null."""
    return rows.select(*[F.coalesce(F.trim(F.col(f"`{c}`").cast("string")), F.lit("")).alias(k) if c in rows.columns else F.lit("").alias(k) for k, c in mapping.items()])


def read_json_arrays(spark: SparkSession, paths: Sequence[str], schema: str) -> DataFrame:
    """Rows of JSON array files in the order of the arguments (column ``input_no``)."""
    return concatenated([spark.read.schema(schema).json(p, multiLine=True) for p in paths], "input_no")


def concatenated(parts: Sequence[DataFrame], name: str) -> DataFrame:
    """Union with the number of the part that a row is from."""
    numbered = [p.withColumn(name, F.lit(i)) for i, p in enumerate(parts)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), numbered)


def rule_terms(rules: DataFrame, key: str, text: str) -> DataFrame:
    """key, list_name and lower-cased, trimmed terms of plain YAML mappings of lists, one text a row.

    A line that ends with a colon begins a list, "- term" adds to it (in quotes or not);
    comments and blank lines are passed over. Any other line fails the query, as a rule
    that is silently lost would.
    """
    lines = F.transform(F.split(text, "\r?\n"), lambda x: F.rtrim(F.regexp_replace(x, "(^|\\s)#.*$", "")))
    bare = F.filter(lines, lambda x: F.trim(x) != "")
    start = F.struct(F.lit(None).cast("string").alias("name"), F.array().cast("array<struct<list_name:string,term:string>>").alias("out"))

    def step(held: Column, line: Column) -> Column:
        item = F.ltrim(line).startswith("- ") & held["name"].isNotNull()
        head = ~item & line.endswith(":")
        term = F.lower(F.trim(F.regexp_replace(F.trim(F.substring(F.ltrim(line), 3, 1 << 20)), "^['\"]|['\"]$", "")))
        wrong = F.raise_error(F.concat(F.lit("not a list of terms: "), line)).cast("string")
        name = F.when(item, held["name"]).when(head, F.trim(F.regexp_replace(line, ":$", ""))).otherwise(wrong)
        return F.struct(name.alias("name"), F.when(item, F.concat(held["out"], F.array(F.struct(held["name"].alias("list_name"), term.alias("term"))))).otherwise(held["out"]).alias("out"))

    found = rules.select(key, F.explode(F.aggregate(bare, start, step, lambda held: held["out"])).alias("r"))
    return found.select(key, "r.list_name", "r.term")


TREE = "array<struct<text: string, facets: array<struct<label: string, from_source: string, leaves: array<struct<label: string>>>>>>"


def topic_leaves(trees: DataFrame, key: str, column: str) -> DataFrame:
    """One row a leaf with a label: key, bullet, its text, facet and leaf."""
    bullets = trees.select(key, F.posexplode(F.from_json(column, TREE)).alias("bullet", "b"))
    facets = bullets.select(key, "bullet", F.col("b.text").alias("text"), F.explode("b.facets").alias("f"))
    leaves = facets.select(key, "bullet", "text", F.col("f.label").alias("facet"), F.explode("f.leaves.label").alias("leaf"))
    return leaves.filter(F.trim("leaf") != "")


def split_by_range(rows: DataFrame, column: str, parts: Sequence[tuple[str, int | None]]) -> DataFrame:
    """Add ``part``: the first whose end is above the value (half-open); None has no end."""
    chain = F.lit(None).cast("string")
    for name, end in reversed(parts):
        chain = F.lit(name) if end is None else F.when(F.col(column) < end, F.lit(name)).otherwise(chain)
    return rows.withColumn("part", chain)


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """One row a text file: its path and whole text. A file is held whole."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


JOB = "job_id string, status string, stage string, progress int, created_at long, expires_at long, finished_at long, error string"


def read_jobs(spark: SparkSession, path: str) -> DataFrame:
    """Job records, one JSON file each."""
    return spark.read.schema(JOB).json(path, multiLine=True)
