"""Sharding by histogram sort: shards of near equal bytes, one exchange.

Rows are ordered by the key (hash of the text, doc_id), so equal texts lie side
by side. Each round counts, over all partitions, the exact rows and bytes of the
cells that 4,096 equally spaced probes cut out of the key intervals that still
hold a splitter; the cell where the running bytes pass a splitter's target is the
next interval. It ends when what is left in every interval is within tolerance,
or is one key. The driver sees at most 4,096 counts a splitter in a round, never
rows. Then every row is given its shard by comparing its key with the splitters,
and its slot from exact counts of (shard, salt) cells, with one exchange.

Defined results: a null text counts as no bytes (size 16) and hashes as empty;
repeated rows are rows of their own and get slots of their own; a group of equal
texts is split only where a splitter falls inside it. Fewer rows than shards
leaves shards empty. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kiteloom.llm.common import stage

SHARDS = 40
ROW_BYTES = 16
SALTS = 256


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32 and the key (k1, k2), two signed longs, of every row."""
    body = F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")
    return docs.select(
        "doc_id",
        (F.length(body) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(body).cast("long").alias("text_crc32"),
        F.xxhash64(body).alias("k1"),
        F.xxhash64(F.col("doc_id")).alias("k2"),
    )


#: Widths of the digits that a key is refined by, over k1 and then k2.
WIDTHS = (12, 12, 12, 12, 12, 4) * 2
LEVELS = len(WIDTHS)
SIGN = 1 << 63
END = 1 << 128


def _signed(u: int) -> int:
    """The signed long that orders as the unsigned number ``u`` does."""
    return u - SIGN


def _digit(level: int) -> Column:
    """Digit number ``level`` of a key from the top; signed order becomes unsigned order."""
    half, at = ("k1", level) if level < 6 else ("k2", level - 6)
    part = F.shiftrightunsigned(F.col(half), 64 - sum(WIDTHS[: at + 1])).bitwiseAND(F.lit((1 << WIDTHS[level]) - 1))
    return part.bitwiseXOR(F.lit(1 << (WIDTHS[level] - 1))) if at == 0 else part


def _within(low: int, level: int) -> Column:
    """Whether a key shares its first ``level`` digits with the key number ``low``."""
    span = 1 << (128 - sum(WIDTHS[:level]))
    if span >= 1 << 64:
        a, b = low >> 64, (low + span - 1) >> 64
        return F.col("k1").between(_signed(a), _signed(b))
    a, b = low & (2**64 - 1), (low & (2**64 - 1)) + span - 1
    return (F.col("k1") == _signed(low >> 64)) & F.col("k2").between(_signed(a), _signed(b))


def splitters(rows: DataFrame, shards: int, tolerance: float) -> list[int]:
    """The key numbers (128 bits) at which shards 1.. begin."""
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("t")).first()["t"]
    slack = tolerance * total / shards
    # a splitter in work: the low end of its interval, the bytes below that, its target
    work = {s: (0, 0, total * s / shards) for s in range(1, shards)}
    done: dict[int, int] = {}
    for level in range(LEVELS):
        if not work:
            break
        lows = sorted({low for low, _, _ in work.values()})
        which = F.lit(None).cast("int")
        for i, low in enumerate(lows):
            which = F.when(_within(low, level), F.lit(i)).otherwise(which)
        cells: dict[int, list] = {}
        counted = (
            rows.withColumn("interval", which)
            .filter("interval IS NOT NULL")
            .groupBy("interval", _digit(level).alias("cell"))
            .agg(F.sum("size").alias("bytes"), (F.min("k1") == F.max("k1")) & (F.min("k2") == F.max("k2")))
        )
        for i, cell, size, single in counted.collect():
            cells.setdefault(i, []).append((cell, size, single))
        step = 1 << (128 - sum(WIDTHS[: level + 1]))
        for s, (low, below, target) in list(work.items()):
            cell, size, single = 0, 0, True
            for cell, size, single in sorted(cells.get(lows.index(low), [])):
                if below + size >= target:
                    break
                below += size
            near, far = target - below, below + size - target
            if single or level == LEVELS - 1 or min(near, far) <= slack:
                done[s] = low + (cell + (near > far)) * step
                del work[s]
            else:
                work[s] = (low + cell * step, below, target)
    return [done[s] for s in sorted(done)]


def _shard(bounds: list[int], low: int = 0, high: int | None = None) -> Column:
    """Number of boundaries not above a row's key, as a balanced decision tree."""
    high = len(bounds) if high is None else high
    if low >= high:
        return F.lit(low)
    mid = (low + high) // 2
    right, left = _shard(bounds, mid + 1, high), _shard(bounds, low, mid)
    if bounds[mid] >= END:
        return left
    a, b = _signed(bounds[mid] >> 64), _signed(bounds[mid] & (2**64 - 1))
    return F.when((F.col("k1") > a) | ((F.col("k1") == a) & (F.col("k2") >= b)), right).otherwise(left)


def shard(docs: DataFrame, shards: int = SHARDS, tolerance: float = 0.001) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row.

    ``tolerance``: how far a splitter's running bytes may be from its target, as a
    part of a shard's mean size.
    """
    rows = stage(keyed(docs), "shard-keys")
    bounds = splitters(rows, shards, tolerance)
    placed = rows.select("doc_id", "size", "text_crc32", "k2", _shard(bounds).alias("shard"), F.pmod("k2", F.lit(SALTS)).alias("salt"))
    # at most shards * SALTS rows, whatever the input
    counts = placed.groupBy("shard", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("shard", "salt").orderBy("k2", "doc_id", "text_crc32")
    ranked = placed.withColumn("rank", F.row_number().over(inside) - 1)
    return ranked.join(F.broadcast(starts), ["shard", "salt"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"),
        (F.col("start") + F.col("rank")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
