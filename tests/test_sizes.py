"""Queries against their SQL on rows that the smallest tables lack."""

from __future__ import annotations

import os
import shutil

from pyspark.sql import functions as F

from kiteloom.operators import folds, generators, planning
from kiteloom.plans import registry
from kiteloom.sources import files, sinks
from kiteloom.sources.tables import table
from tests.compare import difference, oracle

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def changed(spark, tmp_path, name, rows) -> str:
    """A folder of the test tables in which ``name`` has ``rows``."""
    d = tmp_path / "tables"
    d.mkdir()
    for f in os.listdir(SF):
        if f != f"{name}.parquet":
            os.symlink(f"{SF}/{f}", d / f)
    rows.coalesce(1).write.parquet(f"{tmp_path}/written")
    part = next(p for p in (tmp_path / "written").iterdir() if p.name.endswith(".parquet"))
    shutil.copy(part, d / f"{name}.parquet")
    return str(d)


def agrees(spark, name, d) -> None:
    assert difference(registry.queries()[name](spark, d), oracle(d), registry.oracle_sql()[name]) == ""


def test_rerank_with_stutters_among_the_candidates(spark, tmp_path):
    docs = table(spark, SF, "documents")
    d = changed(spark, tmp_path, "documents", docs.selectExpr("doc_id", "concat(text, repeat(' a', doc_id % 9 + 4)) AS text", "lang", "source", "n_chars"))
    agrees(spark, "or14_rerank", d)


def test_hooks_that_begin_with_a_nought(spark, tmp_path):
    docs = table(spark, SF, "documents")
    d = changed(spark, tmp_path, "documents", docs.selectExpr("doc_id", "concat('0', text, '\n 1 last 1 ') AS text", "lang", "source", "n_chars"))
    agrees(spark, "tx39_hook_closing", d)


def test_question_blocks_draw_each_number_once(spark, monkeypatch):
    """A try costs its draws: no number is drawn again wherever it is used, and no try gets an answer."""
    made, kept = [], folds.accepted
    monkeypatch.setattr(folds, "accepted", lambda rows, *a: made.append(rows) or kept(rows, *a))
    generators.question_blocks(spark.range(2).select(F.col("id").alias("seed")), 16)
    assert "answer" not in made[0].columns
    assert made[0]._jdf.queryExecution().optimizedPlan().toString().count("md5(") < 60


def test_a_file_each_is_written_by_many_tasks(spark, tmp_path):
    rows = spark.range(64).coalesce(1).select(F.concat(F.lit('{"job_id": "'), "id", F.lit('"}')).alias("record"))
    sinks.write_each(rows, f"{tmp_path}/jobs", "record")
    names = [p.name for p in (tmp_path / "jobs").iterdir() if p.name.startswith("part-")]
    assert len(names) == 64 and len({n[:10] for n in names}) > 4
    assert sorted(r["job_id"] for r in files.read_jobs(spark, f"{tmp_path}/jobs").collect()) == sorted(map(str, range(64)))


def test_triangles_across_blocks(spark):
    """Blocks of seven segments count as the SQL does, concurrent and nearly parallel segments among them, and no crossing is a row."""
    con = oracle(SF)
    sides = "(id * 7919 + id // 3) % 11 AS x1, (id * 104729) % 13 AS y1, (id * 31 + id // 7) % 17 AS x2, (id * 57) % 19 AS y2"
    con.execute(f"CREATE TABLE s AS SELECT figure::BIGINT AS figure, id::BIGINT AS id, x1::DOUBLE + CASE WHEN id % 5 = 0 THEN 0.0001 ELSE 0 END AS x1, y1::DOUBLE AS y1, x2::DOUBLE AS x2, y2::DOUBLE AS y2 FROM (SELECT id % 2 AS figure, id, {sides} FROM range(90) t(id))")
    want = dict(con.execute(registry.oracle_sql()["rg14_triangle_count"].replace(_segments(), "SELECT * FROM s")).fetchall())
    rows = spark.createDataFrame(con.execute("SELECT * FROM s").fetchall(), "figure long, id long, x1 double, y1 double, x2 double, y2 double")
    for block in (7, 1024):
        got = planning.triangles(rows, "figure", "id", block)
        assert {r["figure"]: r["triangles"] for r in got.collect()} == want
    assert "px0" not in got._jdf.queryExecution().optimizedPlan().toString()


def _segments() -> str:
    from kiteloom.plans.planning_queries import _SEGMENTS

    return _SEGMENTS
