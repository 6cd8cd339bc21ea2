"""Exact vector search and rank fusion.

Queries and corpus are dealt into blocks by hash, each block paired with each of the
other side: a task multiplies one pair of blocks and keeps the k best of each query, so
what leaves it is k rows a query, never a pair a row. The corpus is read once and sent
once for each block of queries, and a query once for each block of the corpus.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows of a block of queries and of the corpus: a task holds one of each.
BLOCK, CORPUS_BLOCK = 4096, 65536
#: Queries of a matrix product: with a corpus block it bounds the products in memory.
PART = 64


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two arrays in double precision; 0 where a norm is 0."""
    da, db = a.cast("array<double>"), b.cast("array<double>")
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(dot(da, da)) * F.sqrt(dot(db, db))
    return F.when(norms == 0, F.lit(0.0)).otherwise(dot(da, db) / norms)


def normalised(v: Column) -> Column:
    """The array divided by its Euclidean norm; unchanged where that is 0."""
    d = v.cast("array<double>")
    norm = F.sqrt(F.aggregate(d, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(norm == 0, d).otherwise(F.transform(d, lambda x: x / norm))


def _unit(m: np.ndarray) -> np.ndarray:
    norm = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def _dealt(df: DataFrame, rows: int, own: str, other: DataFrame, other_rows: int, facing: str) -> DataFrame:
    """``df`` with its block in ``own``, once for every block of the ``other`` side in ``facing``.

    The numbers of blocks come from one-row counts within the plan.
    """
    n = df.agg(F.ceil(F.count(F.lit(1)) / rows).cast("int").alias("_own"))
    m = other.agg(F.ceil(F.count(F.lit(1)) / other_rows).cast("int").alias("_facing"))
    counted = df.crossJoin(F.broadcast(n)).crossJoin(F.broadcast(m))
    faces = F.explode(F.sequence(F.lit(0), F.greatest("_facing", F.lit(1)) - 1))
    fresh = [F.col(c).alias(c) for c in df.columns]  # both sides may come from one table
    return counted.select(*fresh, F.pmod(F.xxhash64("vec_id"), F.col("_own")).cast("int").alias(own), faces.alias(facing))


def cosine_topk(queries: DataFrame, corpus: DataFrame, k: int, threshold: float | None = None, digits: int = 6) -> DataFrame:
    """query_id, vec_id, similarity and rank (from 1) of the k nearest others of each query.

    Both sides have vec_id and embedding, of one length. Similarities are rounded to
    ``digits`` and ties go to the smaller id. Nothing runs until the result is read.
    """
    q, c = queries.select("vec_id", "embedding"), corpus.select("vec_id", "embedding")
    left = _dealt(q, BLOCK, "_q", c, CORPUS_BLOCK, "_c").groupBy("_q", "_c")
    right = _dealt(c, CORPUS_BLOCK, "_c", q, BLOCK, "_q").groupBy("_q", "_c")
    near = left.cogroup(right).applyInArrow(lambda a, b: _pair(a, b, k, threshold, digits), "query_id long, vec_id long, similarity double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id"))
    return near.withColumn("rank", rank).filter(F.col("rank") <= k)


def _sides(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    flat = table["embedding"].combine_chunks().flatten()
    return np.asarray(table["vec_id"], np.int64), _unit(np.asarray(flat, np.float64).reshape(len(table), -1))


def _pair(queries: pa.Table, corpus: pa.Table, k: int, threshold: float | None, digits: int) -> pa.Table:
    """The k best of a block of the corpus for each of a block of queries."""
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    if len(queries) and len(corpus):
        q_ids, q = _sides(queries)
        ids, m = _sides(corpus)
        for at in range(0, len(q_ids), PART):
            own = q_ids[at : at + PART]
            sims = np.round(q[at : at + PART] @ m.T, digits)
            sims[own[:, None] == ids[None]] = -np.inf
            least = np.partition(sims, -k, axis=1)[:, -k] if len(ids) > k else np.full(len(own), -np.inf)
            least = np.maximum(least, -np.inf if threshold is None else threshold)
            i, j = np.nonzero((sims >= least[:, None]) & np.isfinite(sims))  # with all that tie with the last one
            s = sims[i, j]
            order = np.lexsort((ids[j], -s, i))
            i, j, s = i[order], j[order], s[order]
            keep = np.arange(len(i)) - np.searchsorted(i, i) < k
            found.append((own[i[keep]], ids[j[keep]], s[keep]))
    q_col, v_col, s_col = (np.concatenate(c) for c in zip(*found, strict=True))
    return pa.table({"query_id": pa.array(q_col, pa.int64()), "vec_id": pa.array(v_col, pa.int64()), "similarity": pa.array(s_col, pa.float64())})
