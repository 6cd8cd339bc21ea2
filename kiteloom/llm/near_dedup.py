"""MinHash near-dedup with fast similarity sketches, banding and exact verification.

Sketch: in each of the first rounds every shingle is thrown into one of t bins by a
fresh hash; then follows a round for each bin, in which all shingles go to that bin. A
bin keeps the least (round, value) it gets, so every coordinate is filled for sure, and
a few rounds fill them all for sets of about t shingles or more. Equal coordinates of two sketches
estimate the similarity of the sets with the concentration of independent hashes.

Documents with equal shingle sets form a class, represented by its least id. Bands
of coordinates put representatives into buckets. Within a bucket not all pairs are
made. In a star turn one centre a bucket, of its largest component, is compared with
the bucket's members of other components on full shingle sets, and the links found
join components; a group of close copies is mostly one component after one turn.

What is then left of a bucket that still holds several components is compared in
blocks, each streamed through one task: the members outside the largest component
(the probes) with all members. Members are dealt to slices and probes to slices by
hash, of at most about ``BLOCK`` shingles each, and a block is a slice of members with
a slice of probes, so that one huge bucket is many blocks. A first pass needs only
sketches of a byte a coordinate: a pair goes on if its equal coordinates don't rule
the threshold out (``SPREAD`` standard deviations: a link is lost so with about 1e-8),
and it is looked at only in the bucket of the first band that the two share. A second
pass has the texts of what is left and confirms links on full sets, skipping pairs
that the block has already connected. No row is made for a pair.

While a bucket is of many blocks, more star turns with more centres come first. So a
group of n copies costs a few times n comparisons; members that are candidates but
not linked cost a few nanoseconds a pair of sketches.

Components are found by sending least ids along links, in Spark. Joins have one row a
key on one side; counts combine on the map side; stage tables cut lineage.

Defined results: null and empty texts have no shingles, n_shingles 0 and a component
of their own; a text of fewer than ``n`` words has its whole sequence as its one
shingle. Rows with one id are one node: they get the component of the least id that
any of them reaches; a row without an id is kept and linked with nothing. Extra columns
are ignored. Words, shingles and sets are 64-bit hashes, equal sets a 128-bit key of
them: results are exact but for their collisions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kiteloom.llm import words as W
from kiteloom.llm.common import small_batches, stage

COORDINATES = 512
#: A pair at the threshold misses all bands with this probability at most; at 0.85, 56 bands of 9 miss it with 4e-7.
MISS = 1e-5
ROWS = 9
#: Rounds with random bins; what is left then is filled bin by bin, for every set alike.
ROUNDS = 32
SHINGLE = 3
NUMERATOR, DENOMINATOR = 85, 100
_RNG = np.random.default_rng(97)
SEEDS = _RNG.integers(0, 2**64, 2 * COORDINATES, dtype=np.uint64) | np.uint64(1)
BITS = COORDINATES.bit_length() - 1
#: Shingles in a slice of a block, each document counting COORDINATES more.
BLOCK = 1 << 20
#: Star turns for all buckets, then at most LATE more for buckets of more than WIDE blocks.
EARLY, LATE, WIDE = 1, 4, 16
#: Deviations under the expected number of equal coordinates at which a pair is ruled out.
SPREAD = 5.6


def shingles(w: W.Words, k: int, n: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles of text ``k``."""
    h = w.hashes[w.first[k] : w.first[k + 1]]
    if len(h) == 0:
        return h
    return np.unique(W.windows(h, n) if len(h) >= n else W.windows(h, len(h), second=True))


def sketch(items: np.ndarray) -> np.ndarray:
    """The fast similarity sketch of a non-empty set of 64-bit hashes."""
    out = np.zeros(COORDINATES, np.uint64)
    free = np.ones(COORDINATES, bool)
    for i in range(ROUNDS):
        # the top bits are the bin, the rest is the value: after sorting, a bin's first is its least
        h = np.sort(W.mix(items * SEEDS[i] + SEEDS[-1 - i]))
        bins = (h >> np.uint64(64 - BITS)).astype(np.int64)
        first = np.ones(len(h), bool)
        first[1:] = bins[1:] != bins[:-1]
        at = bins[first]
        new = free[at]
        out[at[new]] = h[first][new] * SEEDS[i]
        free[at[new]] = False
        if not free.any():
            return out
    rest = np.flatnonzero(free)
    out[rest] = W.mix(items[None, :] * SEEDS[COORDINATES + rest][:, None] + rest.astype(np.uint64)[:, None]).min(axis=1)
    return out


def band_rows(numerator: int, denominator: int) -> int:
    """The most coordinates a band with which a pair at the threshold is missed with ``MISS`` at most."""
    miss = lambda rows: (1 - (numerator / denominator) ** rows) ** (COORDINATES // rows)
    fit = [rows for rows in range(1, ROWS + 1) if miss(rows) <= MISS]
    if not fit:
        raise ValueError(f"{COORDINATES} coordinates can't find pairs at {numerator}/{denominator}")
    return max(fit)


def bands(made: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """The bucket numbers of a sketch, one a band of ``rows`` coordinates."""
    s = made[: COORDINATES // rows * rows].reshape(-1, rows)
    out = np.arange(len(s), dtype=np.uint64)
    for c in range(rows):
        out = W.mix(out * np.uint64(W.BASE_A) + s[:, c])
    return out


def small(made: np.ndarray) -> np.ndarray:
    """A byte of each coordinate; unequal coordinates have equal bytes with 1/256."""
    return (made >> np.uint64(40)).astype(np.uint8)


def least_equal(numerator: int, denominator: int, share: float = 1.0) -> float:
    """Equal coordinates that a pair at the threshold has, but for ``SPREAD`` deviations.

    Of unequal coordinates, ``1 - share`` count as equal by chance.
    """
    p = 1 - (1 - numerator / denominator) * share
    return COORDINATES * p - SPREAD * (COORDINATES * p * (1 - p)) ** 0.5


SURVEY = "doc_id long, n_shingles long, key binary, bands array<long>, sketch binary"


def _survey(n: int, rows: int = ROWS):
    """doc_id, n_shingles, a 128-bit key of the shingle set, the bands and the small sketch of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in W.pieces(batch.column(1)):
                part = batch.slice(i, j - i)
                w = W.words(part.column(1), fold=True)
                sizes, keys, found, bytes_of = [], [], [], []
                for k in range(len(w)):
                    s = shingles(w, k, n)
                    made = sketch(s) if len(s) else s
                    sizes.append(len(s))
                    keys.append(W.mix(np.array([s.sum(dtype=np.uint64), W.mix(s).sum(dtype=np.uint64)], "<u8")).tobytes())
                    found.append(bands(made, rows).view(np.int64) if len(s) else np.zeros(0, np.int64))
                    bytes_of.append(small(made).tobytes())
                at = np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(found))), pa.array(bytes_of, pa.binary())],
                    ["doc_id", "n_shingles", "key", "bands", "sketch"],
                )

    return run


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    squeeze = zstandard.ZstdCompressor(level=3, write_content_size=True)
    for batch in batches:
        z = [squeeze.compress(t.as_buffer() if t.is_valid else b"") for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(z, pa.binary())], ["doc_id", "z"])


def _verify(n: int, numerator: int, denominator: int):
    """Of pairs (a, b, za, zb), the linked ones, by their full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        memo: dict[bytes, np.ndarray] = {}

        def full(z: pa.Scalar) -> np.ndarray:
            found = memo.get(raw := z.as_py())
            if found is None:
                if len(memo) >= 128:
                    memo.clear()
                found = memo[raw] = shingles(W.words(pa.array([unpack.decompress(raw)], pa.binary()), fold=True), 0, n)
            return found

        for batch in batches:
            a_out, b_out = [], []
            for a, b, za, zb in zip(*batch.columns, strict=True):
                x, y = full(za), full(zb)
                least, most = sorted((len(x), len(y)))
                if least == 0 or denominator * least < numerator * most:
                    continue
                both = len(np.intersect1d(x, y, assume_unique=True))
                if denominator * both >= numerator * (len(x) + len(y) - both):
                    a_out.append(a.as_py())
                    b_out.append(b.as_py())
            yield pa.RecordBatch.from_arrays([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64())], ["a", "b"])

    return run


#: A row of a block (bucket, s, p): the band of its bucket, and whether the document is in the
#: slice of members or of probes; ``other`` says that it isn't of the largest component.
ROW = "bucket long, s int, p int, band int, doc_id long, n_shingles long, component long, other boolean, member boolean, probe boolean, sketch binary"
COLUMNS = [c.split()[0] for c in ROW.split(", ")]


def _whole_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[tuple[int, int]]]]:
    """Rows with the ranges of whole blocks in them, from batches in which a block's rows follow each other."""
    rest: pa.RecordBatch | None = None
    for batch in batches:
        if not len(batch):
            continue
        rows = batch if rest is None else pa.concat_batches([rest, batch])
        key = np.stack([rows.column(k).to_numpy().astype(np.int64) for k in range(3)])
        ends = (np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1).tolist()
        if ends:
            yield rows.slice(0, ends[-1]), list(zip([0, *ends], ends, strict=False))
        rest = rows.slice(ends[-1]) if ends else rows
    if rest is not None:
        yield rest, [(0, len(rest))]


class _Pairs:
    """Pairs of rows, in blocks, of two components that may be linked."""

    def __init__(self, rows: pa.RecordBatch, band_rows: int, numerator: int, denominator: int):
        self.ids, self.sizes, self.comps, self.band = (rows.column(c).to_numpy() for c in ("doc_id", "n_shingles", "component", "band"))
        self.other, self.member, self.probe = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("other", "member", "probe"))
        self.full = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), np.uint8).reshape(-1, COORDINATES)
        self.bits = np.packbits(self.full & 1, axis=1).view(np.uint64)
        self.most = COORDINATES - least_equal(numerator, denominator, 0.5)
        self.least = least_equal(numerator, denominator)
        self.rows, self.numerator, self.denominator = band_rows, numerator, denominator

    def of(self, i: int, j: int) -> Iterator[tuple[int, np.ndarray]]:
        """(probe, its members, likeliest first) of the block of rows ``i`` to ``j``."""
        members = np.flatnonzero(self.member[i:j]) + i
        lined = self.bits[members]
        for p in (np.flatnonzero(self.probe[i:j]) + i).tolist():
            to = members[np.bitwise_count(lined ^ self.bits[p]).sum(axis=1, dtype=np.int32) <= self.most]
            least, most = np.minimum(self.sizes[to], self.sizes[p]), np.maximum(self.sizes[to], self.sizes[p])
            # two probes are a pair in two blocks, or twice in one
            once = ~self.other[to] | (self.ids[to] > self.ids[p])
            to = to[once & (self.comps[to] != self.comps[p]) & (self.denominator * least >= self.numerator * most)]
            if not len(to):
                continue
            same = self.full[to] == self.full[p]
            count = same.sum(axis=1)
            first = same[:, : COORDINATES // self.rows * self.rows].reshape(len(to), -1, self.rows).all(axis=2).argmax(axis=1)
            keep = (count >= self.least) & (first == self.band[p])
            if keep.any():
                yield p, to[keep][np.argsort(-count[keep], kind="stable")]


def _sift(band_rows: int, numerator: int, denominator: int):
    """The rows of blocks that are in some pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, blocks in _whole_blocks(batches):
            pairs, keep = _Pairs(rows, band_rows, numerator, denominator), np.zeros(len(rows), bool)
            for i, j in blocks:
                for p, to in pairs.of(i, j):
                    keep[p] = keep[to] = True
            yield rows.filter(pa.array(keep))

    return run


def _confirm(n: int, band_rows: int, numerator: int, denominator: int):
    """Links between components of each block, by full sets; pairs that earlier links connect are skipped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for rows, blocks in _whole_blocks(batches):
            pairs, z, a_out, b_out = _Pairs(rows, band_rows, numerator, denominator), rows.column("z"), [], []
            for i, j in blocks:
                root: dict[int, int] = {}
                sets: dict[int, np.ndarray] = {}

                def find(c: int) -> int:
                    while (up := root.get(c, c)) != c:
                        root[c] = c = root.get(up, up)
                    return c

                def full(k: int) -> np.ndarray:
                    if k not in sets:
                        sets[k] = shingles(W.words(pa.array([unpack.decompress(z[k].as_buffer())], pa.binary()), fold=True), 0, n)
                    return sets[k]

                for p, to in pairs.of(i, j):
                    for q in to.tolist():
                        a, b = find(int(pairs.comps[p])), find(int(pairs.comps[q]))
                        if a == b:
                            continue
                        x, y = full(p), full(q)
                        if len(x) < len(y):
                            x, y = y, x
                        if not len(y):
                            continue
                        at = np.searchsorted(x, y)
                        at[at == len(x)] = 0
                        both = int((x[at] == y).sum())
                        if denominator * both >= numerator * (len(x) + len(y) - both):
                            root[max(a, b)] = min(a, b)
                            a_out.append(int(pairs.ids[p]))
                            b_out.append(int(pairs.ids[q]))
            yield pa.RecordBatch.from_arrays([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64())], ["a", "b"])

    return run


def components(label: DataFrame, links: DataFrame, name: str = "components") -> DataFrame:
    """``label`` (id, component) with the components that ``links`` (a, b) join made one.

    A component is named by its least id. Each round hooks every component to the least
    neighbouring one and follows these pointers to their end, so that chains shrink by
    far more than a step a round. Links are contracted to their components as it goes.
    """
    named = lambda side: label.select(F.col("id").alias(side), F.col("component").alias(f"c{side}"))
    edges = links.join(named("a"), "a").join(named("b"), "b").filter("ca <> cb").select(F.greatest("ca", "cb").alias("high"), F.least("ca", "cb").alias("low"))
    edges = stage(edges.distinct(), "edges")
    if edges.isEmpty():
        return label
    moves = None  # component -> the one it has become part of
    while True:
        hook = stage(edges.groupBy("high").agg(F.min("low").alias("low")), "hooks")
        while True:  # pointers go down, so this ends
            onward = hook.select(F.col("high").alias("low"), F.col("low").alias("next"))
            jumped = stage(hook.join(onward, "low", "left").select("high", F.coalesce("next", "low").alias("low"), F.col("next").isNotNull().alias("moved")), "hooks")
            hook = jumped.select("high", "low")
            if jumped.filter("moved").isEmpty():
                break
        to = hook.select(F.col("high").alias("was"), F.col("low").alias("now"))
        moves = hook if moves is None else moves.join(to, moves["low"] == to["was"], "left").select("high", F.coalesce("now", "low").alias("low")).unionByName(hook)
        over = edges.join(to, edges["high"] == to["was"], "left").select(F.coalesce("now", "high").alias("x"), "low")
        over = over.join(to, over["low"] == to["was"], "left").select("x", F.coalesce("now", "low").alias("y")).filter("x <> y")
        edges = stage(over.select(F.greatest("x", "y").alias("high"), F.least("x", "y").alias("low")).distinct(), "edges")
        if edges.isEmpty():
            break
    moves = moves.select(F.col("high").alias("component"), F.col("low").alias("to"))
    return stage(label.join(moves, "component", "left").select("id", F.coalesce("to", "component").alias("component")), name)


def _dealt(left: DataFrame, spread: DataFrame) -> DataFrame:
    """Rows of blocks, but for the sketch, of the members (bucket, band, doc_id, n_shingles, component) left."""
    slices = lambda weight: F.ceil(F.col(weight) / F.lit(BLOCK)).cast("int")
    wide = spread.select("bucket", "main", slices("weight").alias("slices"), slices("rest").alias("probes"))
    rows = left.join(wide, "bucket").withColumn("other", F.col("component") != F.col("main"))
    rows = rows.withColumn("slice", F.pmod(F.xxhash64("doc_id"), "slices").cast("int")).withColumn("turn", F.pmod(F.xxhash64("doc_id", F.lit(1)), "probes").cast("int"))
    as_member = F.expr("transform(sequence(0, probes - 1), p -> struct(slice AS s, p AS p))")
    as_probe = F.expr("IF(other, transform(sequence(0, slices - 1), s -> struct(s AS s, turn AS p)), array())")
    placed = rows.withColumn("place", F.explode(F.array_distinct(F.concat(as_member, as_probe))))
    return placed.select(
        "bucket", "place.s", "place.p", "band", "doc_id", "n_shingles", "component", "other",
        (F.col("place.s") == F.col("slice")).alias("member"), (F.col("other") & (F.col("place.p") == F.col("turn"))).alias("probe"),
    )


def classes(docs: DataFrame, n: int = SHINGLE, numerator: int = NUMERATOR, denominator: int = DENOMINATOR) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each row."""
    rows = band_rows(numerator, denominator)
    small_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    survey = stage(texts.mapInArrow(_survey(n, rows), SURVEY), "sketches")
    full = survey.filter("n_shingles > 0")
    represent = full.groupBy("key").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))

    # one representative a set, and a bucket a band that two or more of them share
    first = full.groupBy("key").agg(F.min_by(F.struct("doc_id", "n_shingles", "bands"), "doc_id").alias("first")).select("first.*")
    entries = first.select("doc_id", "n_shingles", F.posexplode("bands").alias("band", "bucket"))
    crowded = entries.groupBy("bucket").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).filter("low < high").select("bucket")
    members = stage(entries.join(crowded, "bucket"), "buckets")
    packed = texts.mapInArrow(_pack, "doc_id long, z binary")
    met = members.select("doc_id").distinct()
    bodies = stage(packed.join(met, "doc_id").dropDuplicates(["doc_id", "z"]), "bodies")
    sketches = full.select("doc_id", "n_shingles", "sketch")

    # equal sets and equal ids are links without a comparison
    same = full.join(represent.filter("least < most"), "key").select(F.col("least").alias("a"), F.col("doc_id").alias("b")).filter("a <> b")
    label, links, turn = None, None, 0
    while True:
        known = members.withColumn("component", F.col("doc_id")) if label is None else members.join(label.withColumnRenamed("id", "doc_id"), "doc_id")
        # of each component in a bucket its weight and its member of the least hash, then of each bucket the largest
        order = F.struct(F.xxhash64("doc_id", F.lit(turn)), F.col("doc_id"))
        parts = known.groupBy("bucket", "component").agg(F.sum(F.col("n_shingles") + COORDINATES).alias("weight"), F.count(F.lit(1)).alias("size"), F.min(order).alias("first"))
        spread = parts.groupBy("bucket").agg(
            F.count(F.lit(1)).alias("components"), F.sum("weight").alias("weight"),
            F.max(F.struct("size", F.bitwise_not(F.col("first").getField("col1")), F.col("first.doc_id").alias("centre"), "component", "weight")).alias("top"),
        ).filter("components > 1")
        spread = spread.select("bucket", "weight", (F.col("weight") - F.col("top.weight")).alias("rest"), F.col("top.component").alias("main"), F.col("top.centre").alias("centre"))
        left = known.join(spread.select("bucket"), "bucket")
        if turn >= EARLY:
            left, spread = stage(left, "left"), stage(spread, "spread")
            wide = spread.filter(F.ceil(F.col("weight") / BLOCK) * F.ceil(F.col("rest") / BLOCK) > WIDE)
            if turn >= EARLY + LATE or wide.isEmpty():
                break
            # more centres, of the other components, in what would be many blocks
            salt = F.pmod(F.xxhash64("doc_id", F.lit(-turn)), F.lit(8 ** (turn - EARLY + 1)))
            picked = left.join(wide.select("bucket", "main"), "bucket").filter("component <> main").groupBy("bucket", salt.alias("salt")).agg(F.min(order).alias("first"))
            centre = picked.select("bucket", F.col("first.doc_id").alias("centre"))
        else:
            centre = spread.select("bucket", "centre")
        of = known.select("bucket", F.col("doc_id").alias("centre"), F.col("component").alias("own"), F.col("n_shingles").alias("size"))
        of = centre.join(of, ["bucket", "centre"])
        # sets whose sizes are too far apart can't be similar enough
        near = F.least("size", "n_shingles") * denominator >= F.greatest("size", "n_shingles") * numerator
        pairs = known.join(of, "bucket").filter((F.col("component") != F.col("own")) & near)
        pairs = pairs.select(F.least("centre", "doc_id").alias("a"), F.greatest("centre", "doc_id").alias("b")).distinct()
        both = pairs.join(bodies.select(F.col("doc_id").alias("a"), F.col("z").alias("za")), "a")
        both = both.join(bodies.select(F.col("doc_id").alias("b"), F.col("z").alias("zb")), "b").select("a", "b", "za", "zb")
        found = stage(both.mapInArrow(_verify(n, numerator, denominator), "a long, b long"), "links")
        links = found if links is None else links.unionByName(found)
        if label is None:
            label = stage(met.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("component")), "components")
        label = components(label, found)
        turn += 1

    def laid(rows: DataFrame) -> DataFrame:
        return rows.repartition("bucket", "s", "p").sortWithinPartitions("bucket", "s", "p", "doc_id")

    dealt = _dealt(left, spread).join(sketches, ["doc_id", "n_shingles"]).select(*COLUMNS)
    plausible = stage(laid(dealt).mapInArrow(_sift(rows, numerator, denominator), ROW), "candidates")
    texts_too = laid(plausible.join(bodies, "doc_id").select(*COLUMNS, "z"))
    found = stage(texts_too.mapInArrow(_confirm(n, rows, numerator, denominator), "a long, b long"), "links")
    links = links.unionByName(found)
    label = components(label, found)

    # rows of one id, or of one set, join what the representatives' links have joined
    every = same.unionByName(links)
    touched = every.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    own = touched.join(label, "id", "left").select("id", F.coalesce("component", "id").alias("component"))
    final = components(stage(own, "components"), same)
    out = survey.join(final.withColumnRenamed("id", "doc_id"), "doc_id", "left")
    return out.select(
        "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"),
        F.coalesce(F.coalesce("component", "doc_id") == F.col("doc_id"), F.lit(True)).alias("kept"),
    )


def thin(docs: DataFrame, n: int = SHINGLE, numerator: int = NUMERATOR, denominator: int = DENOMINATOR) -> DataFrame:
    """The rows of ``docs`` that represent their component, with all their columns.

    Of rows that share id and text the one stays whose other columns hash least; rows of one
    id that differ in their text stay or go together. Rows without an id are linked with
    nothing, so all of them stay.
    """
    gone = classes(docs, n, numerator, denominator).filter("NOT kept").select("doc_id").distinct()
    # rows travel packed, so that columns of any name stay as they are
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["doc_id"], docs["text"]).join(gone, "doc_id", "left_anti")
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    order = F.xxhash64(F.to_json(F.struct(*[F.col("row")[c].alias(c) for c in others]))) if others else F.lit(0)
    # a row without an id is a group of its own
    alone = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id())
    nth = F.row_number().over(Window.partitionBy("doc_id", "text", "alone").orderBy("order"))
    named = rows.withColumns({"order": order, "alone": alone}).withColumn("nth", nth).filter("nth = 1")
    return named.select([F.col("row")[c].alias(c) for c in docs.columns])
