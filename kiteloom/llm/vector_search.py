"""Nearest neighbours by inner product: an inverted index with an adaptive dimension scan.

Index. A bounded sample is clustered; every vector goes to the list of its nearest
centre. A list is stored in blocks of about BLOCK vectors: ids, vectors as given, and the
vectors in a seeded random rotation, cut into groups of columns.

Probing. Within a list, inner products with a query are taken to be normal around that
of the centre, with the list's mean squared residual. This says how many of a query's
neighbours each list should hold, and the best lists are probed until their expected
share reaches TARGET. So clustered data need few lists and shapeless data most of them.

Scan. A block of the nearest list gives each query a first threshold t, the k-th best
inner product there. A candidate can reach t only if its squared distance is at most
r = |q|^2 + |x|^2 - 2t. Group by group of rotated columns the partial distance grows;
after d of D columns it is a Beta(d/2, (D-d)/2) share of the whole, since the rotation is
random, so a candidate is abandoned if its partial distance is above the quantile 1 - RISK
of that share times r. Survivors of all groups are scored exactly, in double precision.

Work is dealt in tiles, at most SLICE blocks by WAVE queries of one list: a list that
holds most of the rows or of the queries is many tiles. Of equal vectors only the first
k + 1 ids can be neighbours of anything, so only those are indexed. The driver gets the
sample (SAMPLE numbers at most) and a row a list (LISTS at most), never more.

Defined results: vectors that are null or zero, or hold a null, a NaN or an infinity, take
no part, nor do rows without an id or with another length than most vectors have; of rows
that share an id the one with the smallest vector counts. Equal scores go by id. With k
candidates or fewer all are returned. No vectors, no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kiteloom.llm.common import small_batches, stage

LISTS, SAMPLE, ROWS_A_LIST = 1024, 1 << 22, 1024
BLOCK, SLICE, WAVE = 1024, 4, 4096
GROUPS, RISK, TARGET, SEED = 4, 0.001, 0.985, 17
NEAR = "query_id long, vec_id long, score double"


def usable(rows: DataFrame) -> DataFrame:
    """vec_id and v (double, -0 as 0) of the rows that take part."""
    v = F.transform(F.col("embedding").cast("array<double>"), lambda x: x + F.lit(0.0))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    found = rows.filter("vec_id IS NOT NULL AND embedding IS NOT NULL").select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    found = found.filter(finite & F.exists("v", lambda x: x != 0))
    usual = found.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).select("n").first()
    kept = found.filter(F.size("v") == (usual[0] if usual else 0))
    first = F.row_number().over(Window.partitionBy("vec_id").orderBy("v"))
    return kept.withColumn("nth", first).filter("nth = 1").drop("nth")


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


class Index:
    """Centres, rotation and test limits; with ``sizes`` and ``spread`` of the lists once rows are assigned."""

    def __init__(self, sample: np.ndarray, lists: int, reach: float, seed: int = SEED):
        rng = np.random.default_rng(seed)
        dim = sample.shape[1]
        self.reach, self.dim = reach, dim  # reach: the largest norm
        self.centres = self._cluster(self._lifted(sample), lists)
        self.rotation = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
        self.cuts = [len(c) for c in np.array_split(np.arange(dim), min(GROUPS, dim))]
        seen = np.cumsum(self.cuts)
        self.limits = [1.0 if d == dim else float(np.quantile(rng.beta(d / 2, (dim - d) / 2, 200_000), 1 - RISK)) for d in seen]
        self.sizes = self.spread = None

    def _lifted(self, x: np.ndarray) -> np.ndarray:
        """With one component more that gives all vectors the norm ``reach``: then nearest is largest inner product."""
        rest = np.sqrt(np.maximum(self.reach**2 - (x * x).sum(1, keepdims=True), 0))
        return np.hstack([x, rest])

    @staticmethod
    def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
        return np.argmax(x @ centres.T - 0.5 * (centres * centres).sum(1), axis=1)

    def _cluster(self, x: np.ndarray, lists: int) -> np.ndarray:
        centres = x[:lists].copy()
        for _ in range(10):
            at = self._nearest(x, centres)
            n = np.bincount(at, minlength=lists)
            sums = np.zeros_like(centres)
            np.add.at(sums, at, x)
            centres[n > 0] = sums[n > 0] / n[n > 0, None]
        return centres

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """List of each vector and its squared residual."""
        at = self._nearest(self._lifted(x), self.centres)
        return at, ((x - self.centres[at, :-1]) ** 2).sum(1)

    def first(self, q: np.ndarray) -> np.ndarray:
        """The list that holds the likeliest neighbours of each query."""
        scaled = q * (self.reach / np.linalg.norm(q, axis=1, keepdims=True))
        at = scaled @ self.centres[:, :-1].T - 0.5 * (self.centres**2).sum(1)
        return np.argmax(np.where(self.sizes > 0, at, -np.inf), axis=1)

    def probes(self, q: np.ndarray, k: int, target: float) -> list[np.ndarray]:
        """The lists that each query is to look into."""
        mean = q @ self.centres[:, :-1].T
        width = np.linalg.norm(q, axis=1, keepdims=True) * self.spread + 1e-12
        low, high = (mean - 9 * width).min(1), (mean + 9 * width).max(1)
        for _ in range(30):  # the inner product above which k vectors are expected
            mid = (low + high) / 2
            many = (self.sizes * _tail((mid[:, None] - mean) / width)).sum(1) > k
            low, high = np.where(many, mid, low), np.where(many, high, mid)
        due = self.sizes * _tail((low[:, None] - mean) / width)
        order = np.argsort(-due, axis=1)
        share = np.cumsum(np.take_along_axis(due, order, 1), axis=1)
        held = np.cumsum(self.sizes[order], axis=1)
        enough = (share >= target * share[:, -1:]) & (held > k)
        last = np.where(enough.any(1), enough.argmax(1), len(self.sizes) - 1)
        return [o[: n + 1][self.sizes[o[: n + 1]] > 0] for o, n in zip(order, last, strict=True)]

    def columns(self, x: np.ndarray) -> list[np.ndarray]:
        """Groups of rotated columns."""
        return np.split((x @ self.rotation).astype(np.float32), np.cumsum(self.cuts)[:-1], axis=1)


def _tail(z: np.ndarray) -> np.ndarray:
    """Upper tail of the normal distribution, by a rational approximation (7e-8)."""
    a = np.abs(z)
    t = 1 / (1 + 0.2316419 * a)
    p = np.exp(-np.minimum(a, 38) ** 2 / 2) * 0.3989422804014327 * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return np.where(z >= 0, p, 1 - p)


class Best:
    """The k best of each query so far, and the threshold that they set."""

    def __init__(self, t: np.ndarray, k: int):
        self.t, self.k = t, k
        self.q, self.ids, self.scores = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def add(self, q: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        q, ids, scores = np.concatenate([self.q, q]), np.concatenate([self.ids, ids]), np.concatenate([self.scores, scores])
        order = np.lexsort((ids, -scores, q))
        q, ids, scores = q[order], ids[order], scores[order]
        starts = np.flatnonzero(np.diff(q, prepend=-1))
        rank = np.arange(len(q)) - np.repeat(starts, np.diff(np.append(starts, len(q))))
        keep = rank < self.k
        self.q, self.ids, self.scores = q[keep], ids[keep], scores[keep]
        full = rank[keep] == self.k - 1
        self.t[self.q[full]] = np.maximum(self.t[self.q[full]], self.scores[full])


def scan(index: Index, best: Best, q_ids: np.ndarray, q: np.ndarray, skip: np.ndarray, ids: np.ndarray, x: np.ndarray, columns: list[np.ndarray]) -> int:
    """Take what a block holds for the queries without ``skip``; returns the column values that were read."""
    read, pairs = 0, []
    fresh = np.flatnonzero(~np.isfinite(best.t) & ~skip)
    if len(fresh):
        s = np.where(q_ids[fresh, None] == ids[None], -np.inf, q[fresh] @ x.T)
        read += s.size * index.dim
        floor = np.partition(s, -best.k, axis=1)[:, -best.k] if s.shape[1] > best.k else np.full(len(fresh), -np.inf)
        i, j = np.nonzero((s >= floor[:, None] - 1e-9 * (1 + np.abs(floor[:, None]))) & np.isfinite(s))
        pairs.append((fresh[i], j))
    known = np.flatnonzero(np.isfinite(best.t) & ~skip)
    if len(known):
        mine = index.columns(q[known])
        qn, xn = (q[known] ** 2).sum(1), (x * x).sum(1)
        room = qn[:, None] + xn[None] - 2 * best.t[known, None]
        room = (room + 1e-5 * (qn[:, None] + xn[None])).astype(np.float32)
        alive = (q_ids[known, None] != ids[None]) & (room >= 0)
        part, i, j = np.zeros_like(room), None, None
        for g, (a, b) in enumerate(zip(mine, columns, strict=True)):
            if i is None and alive.mean() < 0.1:
                i, j = np.nonzero(alive)
                p, r = part[i, j], room[i, j]
            if i is None:
                part += (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * (a @ b.T)
                alive &= part <= index.limits[g] * room
                read += part.size * a.shape[1]
            else:
                read += len(i) * a.shape[1]
                for at in range(0, len(i), 1 << 16):
                    cut = slice(at, at + (1 << 16))
                    p[cut] += ((a[i[cut]] - b[j[cut]]) ** 2).sum(1)
                keep = p <= index.limits[g] * r
                i, j, p, r = i[keep], j[keep], p[keep], r[keep]
        if i is None:
            i, j = np.nonzero(alive)
        pairs.append((known[i], j))
    for i, j in pairs:
        for at in range(0, len(i), 1 << 16):
            a, b = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
            scores = (q[a] * x[b]).sum(1)
            keep = scores >= best.t[a]
            best.add(a[keep], ids[b[keep]], scores[keep])
    return read


def _pack(index: Index):
    def run(table: pa.Table) -> pa.Table:
        x, ids = _matrix(table["v"]), np.asarray(table["vec_id"], np.int64)
        held = [np.ascontiguousarray(c).tobytes() for c in index.columns(x)]
        return pa.table(
            {"list": table["list"][:1], "block": table["block"][:1], "ids": pa.array([ids.tobytes()], pa.binary()), "vectors": pa.array([x.tobytes()], pa.binary()), "columns": pa.array([held], pa.list_(pa.binary()))}
        )

    return run


def _tile(index: Index, k: int):
    def run(blocks: pa.Table, queries: pa.Table) -> pa.Table:
        best, q_ids = Best(np.zeros(0), k), np.zeros(0, np.int64)
        if len(blocks) and len(queries):
            q_ids, q = np.asarray(queries["query_id"], np.int64), _matrix(queries["v"])
            t = np.array([float("-inf") if x is None else x for x in queries["t"].to_pylist()])
            done, best = np.asarray(queries["done"], np.int64), Best(t, k)
            for block in blocks.sort_by("block").to_pylist():
                ids, x = np.frombuffer(block["ids"], np.int64), np.frombuffer(block["vectors"]).reshape(-1, index.dim)
                held = [np.frombuffer(c, np.float32).reshape(len(ids), -1) for c in block["columns"]]
                for at in range(0, len(q_ids), 1024):  # bounds the matrices of a block
                    own = np.zeros(len(q_ids), bool)
                    own[at : at + 1024] = True
                    scan(index, best, q_ids, q, ~own | (done == block["block"]), ids, x, held)
        return pa.table({"query_id": pa.array(q_ids[best.q], pa.int64()), "vec_id": pa.array(best.ids, pa.int64()), "score": pa.array(best.scores, pa.float64())})

    return run


def _mapped(fields: str, step):
    """mapInArrow of ``step``, from a batch to lists of columns; each output has one schema."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                yield pa.RecordBatch.from_arrays(step(batch), [f.split()[0] for f in fields.split(", ")])

    return run


def _tiles(n: int, size: int) -> int:
    return max(1, -(-n // size))


def search(rows: DataFrame, k: int = 20, every: int = 20, target: float = TARGET) -> DataFrame:
    """query_id, rank, vec_id and score of the ``k`` nearest found of each row whose id ``every`` divides."""
    spark = rows.sparkSession
    small_batches(spark)
    vectors = stage(usable(rows), "vectors")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    n, dim, reach = vectors.agg(F.count(F.lit(1)), F.max(F.size("v")), F.max(norm)).first()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    copies = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    candidates = vectors.withColumn("nth", copies).filter(F.col("nth") <= k + 1).drop("nth")
    lists = max(1, min(LISTS, n // ROWS_A_LIST, SAMPLE // dim // 16))
    drawn = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(min(64 * lists, max(lists, SAMPLE // dim))).select("v").toArrow()
    index = Index(_matrix(drawn["v"]), lists, float(reach))

    def assigned(batch: pa.RecordBatch) -> list[pa.Array]:
        at, rest = index.assign(_matrix(batch.column(1)))
        return [batch.column(0), batch.column(1), pa.array(at, pa.int32()), pa.array(rest, pa.float64())]

    fields = "vec_id long, v array<double>, list int, rest double"
    placed = stage(candidates.select("vec_id", "v").mapInArrow(_mapped(fields, assigned), fields), "vector-lists")
    sizes, rest = np.zeros(lists, np.int64), np.zeros(lists)
    for at, size, mean in placed.groupBy("list").agg(F.count(F.lit(1)), F.avg("rest")).collect():  # a row a list
        sizes[at], rest[at] = size, mean
    index.sizes, index.spread = sizes, np.sqrt(rest / dim)

    def by_list(column: str, values: list[int]) -> DataFrame:
        """A row a list, to be broadcast."""
        return F.broadcast(spark.createDataFrame([(i, int(v)) for i, v in enumerate(values)], f"list int, {column} int"))

    blocks_of = [_tiles(s, BLOCK) for s in sizes]
    n_blocks = by_list("n_blocks", blocks_of)
    cut = placed.join(n_blocks, "list").select("list", F.pmod(F.xxhash64("vec_id"), F.col("n_blocks")).cast("int").alias("block"), "vec_id", "v")
    stored = stage(cut.groupBy("list", "block").applyInArrow(_pack(index), "list int, block int, ids binary, vectors binary, columns array<binary>"), "vector-index")

    def met(queries: DataFrame, slices: int | None) -> DataFrame:
        """NEAR of (query_id, v, t, done, list, block or null) within the tiles of each list.

        ``slices``: blocks of a tile; None if a query meets one ``block``. ``done``: a block that it has met already.
        """
        counts = {r[0]: r[1] for r in queries.groupBy("list").count().collect()}  # a row a list
        waves = [_tiles(counts.get(i, 0), WAVE * (blocks_of[i] if slices is None else 1)) for i in range(lists)]
        n_waves = by_list("n_waves", waves)
        part = F.col("block") if slices is None else F.floor(F.col("block") / slices).cast("int")
        left = stored.join(n_waves, "list").select("list", part.alias("part"), "block", "ids", "vectors", "columns", F.explode(F.sequence(F.lit(0), F.col("n_waves") - 1)).alias("wave"))
        each = F.array("block") if slices is None else F.sequence(F.lit(0), F.floor((F.col("n_blocks") - 1) / slices).cast("int"))
        wave = F.pmod(F.xxhash64("query_id"), F.col("n_waves")).cast("int")
        right = queries.join(n_waves, "list").join(n_blocks, "list").select("list", F.explode(each).alias("part"), wave.alias("wave"), "query_id", "v", "t", "done")
        keys = ["list", "part", "wave"]
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_tile(index, k), NEAR)

    def firsts(batch: pa.RecordBatch) -> list[pa.Array]:
        return [batch.column(0), batch.column(1), pa.array(index.first(_matrix(batch.column(1))), pa.int32())]

    fields = "query_id long, v array<double>, list int"
    asked = vectors.filter(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "v").mapInArrow(_mapped(fields, firsts), fields)
    block = F.pmod(F.xxhash64("query_id", F.lit(1)), F.col("n_blocks")).cast("int")
    asked = stage(asked.join(n_blocks, "list").select("query_id", "v", "list", block.alias("block")), "vector-queries")
    near = stage(met(asked.withColumns({"t": F.lit(None).cast("double"), "done": F.lit(-1)}), None), "vector-near")
    known = near.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("t"))

    def probed(batch: pa.RecordBatch) -> list[pa.Array]:
        found = index.probes(_matrix(batch.column(1)), k, target)
        nth = pa.array(np.repeat(np.arange(len(batch)), [len(f) for f in found]))
        at = np.concatenate(found)
        home = np.asarray(batch.column(3).take(nth)) == at
        done = np.where(home, np.asarray(batch.column(4).take(nth)), -1)
        return [batch.column(0).take(nth), batch.column(1).take(nth), batch.column(2).take(nth), pa.array(at, pa.int32()), pa.array(done, pa.int32())]

    fields = "query_id long, v array<double>, t double, list int, done int"
    opened = asked.join(known, "query_id", "left").select("query_id", "v", "t", "list", "block").mapInArrow(_mapped(fields, probed), fields)
    further = met(stage(opened, "vector-probes"), SLICE)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return near.unionByName(further).withColumn("rank", rank.cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
