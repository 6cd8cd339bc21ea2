"""Media columns kept as content-defined chunks.

A text's payload is its UTF-8 bytes with zero bytes up to a positive multiple of 64.
Its media form is a mono WAV file of unsigned 8-bit samples, one a payload byte. The
file is cut where a rolling gear hash of the last bytes has its low bits zero, so equal
passages of different media make equal chunks.

* stored: a stage table in buckets of its key. A document's row has doc_id, bytes, media key
  and chunk digests in order; a chunk's row has its digest as key and its compressed body,
  once for each distinct digest;
* chunk store: the chunks' rows of that table;
* manifest: one row a chunk of distinct media: (media key, place, digest), a stage table.

Chunks are small, so they are compressed with a dictionary that is trained on a bounded
sample: what the first SAMPLE rows that are read begin with. It is stored like the rest
and changes no result.

Documents are added in BATCHES: each text is cut once, its chunks are exchanged by digest,
and those that the table does not hold yet are appended. Reading back takes everything from
these tables; texts are not read again. The manifest is joined with the store on the digest,
for every file, and the chunks travel to their file's key to be put in order of place, for
one ROUNDS-th of the files after the other. So no second copy of all bodies is on the way
at once. Rebuilt files must have the digest that names them; samples and features are taken
from the file read back, and joined to its documents.

The store lies in buckets, so the manifest comes to it. A task stores a chunk once and
digests are exchanged with map-side combining; chunks of more than HOT places are sent to
all tasks instead, so no task has all places of one. A payload that very many rows share
has one row on the other side of its join, which adaptive execution splits. One payload's
chunks are gathered, which its own size bounds.

Defined results: null counts as the empty text, whose payload is 64 zero bytes; equal
texts get equal values; repeated rows each get a row; extra columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kiteloom.llm.common import shared_dir, small_batches, stage

UNIT = 64
RATE = 8000
#: Bytes of a chunk at least and at most; between, one place in 2**CUT_BITS is a cut. Smaller
#: chunks find more repeats, but compress worse.
LEAST, MOST = 256, 4096
CUT_BITS = 9
#: Rows and bytes of each that the compression's dictionary is trained on, and its size.
SAMPLE, HEAD, DICTIONARY, LEVEL = 512, 8192, 65536, 9
GEAR = np.random.default_rng(5150).integers(0, 2**32, 256, dtype=np.uint32)
#: What is computed of a rebuilt file; digests and figures travel as they are and are spelled out last.
FEATURES = "payload_bytes long, payload_digest binary, tail_crc32 long, media_bytes long, media_digest binary, sum long, energy long, crossings long, peak int"


def payload_of(text: bytes) -> bytes:
    return text + b"\0" * (UNIT - len(text) % UNIT if len(text) % UNIT or not text else 0)


def header(samples: int) -> bytes:
    """The 44 bytes before the samples of a mono 8-bit WAV file."""
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", (36 + samples) & 0xFFFFFFFF, b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", samples & 0xFFFFFFFF)


def samples_of(media: bytes) -> bytes:
    """The samples of a WAV file made with ``header``."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE" or media[36:40] != b"data":
        raise ValueError("not a WAV file of this form")
    return media[44:]


def gear(data: np.ndarray) -> np.ndarray:
    """Rolling hash at each byte: sum over the last 16 bytes b of GEAR[b] << age."""
    h = GEAR[data]
    for age in (1, 2, 4, 8):
        older = np.zeros_like(h)
        older[age:] = h[:-age] << np.uint32(age)
        h = h + older
    return h


def cuts(data: bytes, least: int = LEAST, most: int = MOST, bits: int = CUT_BITS) -> list[int]:
    """Ends of the chunks of ``data``: content decides, within ``least`` and ``most`` bytes."""
    if len(data) <= least:
        return [len(data)]
    mask = np.uint32((1 << bits) - 1)
    marks = np.flatnonzero(gear(np.frombuffer(data, np.uint8)) & mask == 0) + 1
    out, at = [], 0
    while len(data) - at > least:
        i = int(np.searchsorted(marks, at + least))
        end = min(int(marks[i]) if i < len(marks) else len(data), at + most, len(data))
        out.append(end)
        at = end
    if at < len(data):
        out.append(len(data))
    return out


def media_of(text: bytes) -> bytes:
    samples = payload_of(text)
    return header(len(samples)) + samples


def features(media: bytes) -> tuple:
    """Values of FEATURES for a rebuilt file."""
    back = samples_of(media)
    wave = np.frombuffer(back, np.uint8).astype(np.int32) - 128
    crossings = int(np.count_nonzero((wave[1:] < 0) != (wave[:-1] < 0)))
    return (
        len(back), hashlib.sha256(back).digest(), zlib.crc32(back[-UNIT:]), len(media), hashlib.sha256(media).digest(),
        int(wave.sum(dtype=np.int64)), int((wave * wave).sum(dtype=np.int64)), crossings, int(np.abs(wave).max()),
    )


def _digest(data: bytes) -> bytes:
    return hashlib.sha256(data).digest()[:16]


def _emit(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names)


STORED = "key binary, doc_id long, n_bytes long, media binary, chunks array<binary>, body binary"
#: Places of one chunk in the manifest that are joined by exchange at most. The chunks of more
#: are sent to every task: one in HOT of the manifest's rows at most.
HOT = 1024
#: Parts of the documents that are stored, and of the files that are put together, one after the other.
BATCHES, ROUNDS = 2, 4


@contextmanager
def short_exchanges(spark: SparkSession):
    """Within, a job's exchanged rows go when it ends; else they stay until the driver collects its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _cut(dictionary: bytes, batch_no: int):
    """Cuts, digests and compresses the media of each text: its row, and those of its chunks that the task has not stored yet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze, seen = zstandard.ZstdCompressor(level=LEVEL, dict_data=_trained(dictionary)), set()
        names = [x.split()[0] for x in STORED.split(", ")]
        kinds = [pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.binary()), pa.binary()]
        task, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            rows, held = [], 0
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                body = text.as_buffer().to_pybytes() if text.is_valid else b""
                media = media_of(body)
                ends = cuts(media)
                parts = [media[a:b] for a, b in zip([0, *ends], ends, strict=False)]
                found = [_digest(p) for p in parts]
                for d, part in zip(found, parts, strict=True):
                    if len(seen) > 200_000:
                        seen.clear()
                    if d not in seen:
                        rows.append((d, None, None, None, None, squeeze.compress(part)))
                        seen.add(d)
                # a key that no other row has, and shorter than a digest
                rows.append((struct.pack("<HIQ", batch_no, task, at), doc, len(body), found[0] if len(found) == 1 else _digest(media), found, None))
                at += 1
                held += len(media)
                if held > 1 << 24:
                    yield _emit(rows, names, kinds)
                    rows, held = [], 0
            yield _emit(rows, names, kinds)

    return run


def _trained(dictionary: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(dictionary) if dictionary else None


def train(docs: DataFrame) -> bytes:
    """The compression's dictionary; none where the sample is too small for one."""
    heads = [r[0].encode()[:HEAD] for r in docs.select(F.left("text", F.lit(HEAD))).filter("text IS NOT NULL").limit(SAMPLE).collect()]
    parts = [h[a:b] for h in heads for ends in [cuts(h)] for a, b in zip([0, *ends], ends, strict=False) if b > a]
    try:
        return zstandard.train_dictionary(DICTIONARY, parts).as_bytes() if len(parts) > 64 else b""
    except zstandard.ZstdError:
        return b""


def stored(docs: DataFrame, dictionary: bytes = b"") -> DataFrame:
    """STORED rows of the documents and of their distinct chunks, as a stage table in buckets of the key."""
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    turn = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(BATCHES))
    name = f"media_{uuid.uuid4().hex}"
    path, buckets = f"{shared_dir(spark)}/{name.replace('_', '-')}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    with short_exchanges(spark):
        for k in range(BATCHES):
            rows = texts.filter(turn == k).mapInArrow(_cut(dictionary, k), STORED).dropDuplicates(["key"])
            if k:
                rows = rows.join(spark.table(name).select("key"), "key", "left_anti")
            rows.write.mode("append").bucketBy(buckets, "key").option("compression", "zstd").option("path", path).saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the name only, the files stay
    return table


def catalogue(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media (its key) and chunks (digests in order) of each row, stored without a dictionary."""
    return listed_in(stored(docs))


def listed_in(held: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media and chunks of each document, of stored rows."""
    return held.filter("media IS NOT NULL").select("doc_id", "n_bytes", "media", "chunks")


def chunk_store(held: DataFrame) -> DataFrame:
    """digest and compressed body of each distinct chunk, of stored rows or of documents that are stored first."""
    held = held if "body" in held.columns else stored(held)
    return held.filter("body IS NOT NULL").select(F.col("key").alias("digest"), "body")


def manifest(listed: DataFrame) -> DataFrame:
    """media, place, total and digest: the ordered chunk list of each distinct file."""
    once = listed.filter("media IS NOT NULL").select("media", "chunks").dropDuplicates(["media"])
    return once.select("media", F.size("chunks").alias("total"), F.posexplode("chunks").alias("place", "digest"))


_KINDS = [pa.binary(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]
_REBUILT = "media binary, " + FEATURES
_NAMES = [x.split()[0] for x in _REBUILT.split(", ")]


def _whole(key: bytes, media: bytes) -> tuple:
    if _digest(media) != key:
        raise ValueError("a rebuilt file does not have the digest that names it")
    return features(media)


def _rebuild(dictionary: bytes):
    """Puts the chunks of each file together; they follow each other in order of place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor(dict_data=_trained(dictionary))
        parts: list[bytes] = []
        for batch in batches:
            rows = []
            for key, total, place, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if place != len(parts) or body is None:
                    raise ValueError("a chunk of a file is missing")
                parts.append(unpack.decompress(body))
                if len(parts) == total:
                    rows.append((key, *_whole(key, b"".join(parts))))
                    parts = []
            yield _emit(rows, _NAMES, _KINDS)
        if parts:
            raise ValueError("a chunk of a file is missing")

    return run


def reconstruct(listing: DataFrame, store: DataFrame, dictionary: bytes = b"", hot: DataFrame | None = None) -> DataFrame:
    """media and FEATURES of each distinct file, from the manifest and the store. ``hot``: the rows of the store that very many places have."""
    rest = listing if hot is None else listing.join(F.broadcast(hot.select("digest")), "digest", "left_anti")
    got = rest.join(store, "digest", "left").select("media", "total", "place", "body")
    if hot is not None:
        got = got.unionByName(listing.join(F.broadcast(hot), "digest").select("media", "total", "place", "body"))
    return got.repartition("media").sortWithinPartitions("media", "place").mapInArrow(_rebuild(dictionary), _REBUILT)


def read_back(held: DataFrame, dictionary: bytes = b"") -> DataFrame:
    """media and FEATURES of each distinct file, from the stored rows, as stage tables."""
    store = chunk_store(held)
    with short_exchanges(held.sparkSession):
        listing = stage(manifest(held), "media-manifest")
        often = listing.groupBy("digest").count().filter(F.col("count") > HOT).select("digest")
        hot = stage(store.join(F.broadcast(often), "digest", "left_semi"), "media-hot")
        turn = F.pmod(F.crc32("media"), F.lit(ROUNDS))
        parts = [stage(reconstruct(listing.filter(turn == k), store, dictionary, hot), "media-features") for k in range(ROUNDS)]
    return reduce(DataFrame.unionByName, parts)


def savings(listed: DataFrame, store: DataFrame) -> DataFrame:
    """One row: chunks of all documents, of distinct files, and distinct chunks."""
    every = listed.filter("media IS NOT NULL").agg(F.coalesce(F.sum(F.size("chunks")), F.lit(0)).alias("chunks"))
    files = manifest(listed).agg(F.count(F.lit(1)).alias("chunks_of_distinct_files"))
    return every.crossJoin(files).crossJoin(store.agg(F.count(F.lit(1)).alias("distinct_chunks")))  # one row each


def columns(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and the media columns of each row."""
    spark = docs.sparkSession
    kept = stage(spark.createDataFrame([(train(docs),)], "dictionary binary"), "media-dictionary")
    dictionary = bytes(kept.first()[0])  # what readers will find
    held = stored(docs, dictionary)
    rebuilt = read_back(held, dictionary)
    spelled = {
        "payload_sha256": F.lower(F.hex("payload_digest")), "media_sha256": F.lower(F.hex("media_digest")),
        "feature": F.format_string("samples=%d;sum=%d;energy=%d;crossings=%d;peak=%d", "payload_bytes", "sum", "energy", "crossings", "peak"),
    }
    return listed_in(held).drop("chunks").join(rebuilt, "media").withColumns(spelled).select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"
    )
