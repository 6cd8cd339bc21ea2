"""Joins that go beyond an equality: as-of, containment, fused ranks, defaults."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from kiteloom.sources.stages import published

#: Characters of a piece, and numbers of neighbouring pieces of which one is kept.
WIDTH, SPANS = 8, (1, 8, 64)


def nested(parents: DataFrame, children: DataFrame, on: str, fields: Sequence[str], name: str) -> DataFrame:
    """Parents with their children as a sorted array, empty where there are none."""
    grouped = children.groupBy(on).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias(name))
    kind = grouped.schema[name].dataType
    return parents.join(grouped, on, "left").withColumn(name, F.coalesce(name, F.array().cast(kind)))


def new_rows(batch: DataFrame, known: DataFrame, key: Column, known_key: Column) -> DataFrame:
    """Rows of the batch whose key is not among the known ones; repeats within the batch stay."""
    seen = known.select(known_key.alias("known_key")).filter("known_key IS NOT NULL").distinct()
    return batch.withColumn("batch_key", key).join(seen, F.col("batch_key") == F.col("known_key"), "left_anti").drop("batch_key")


def new_first_rows(batch: DataFrame, known: DataFrame, key: Column, known_key: Column, order: Sequence[str], blank_passes: bool = False) -> DataFrame:
    """As ``new_rows``, and of repeats within the batch only the first in ``order``.

    ``blank_passes``: a blank key is never taken for a repeat.
    """
    keyed = batch.withColumn("batch_key", key)
    rank = F.row_number().over(Window.partitionBy("batch_key").orderBy(*order))
    seen = known.select(known_key.alias("known_key")).filter("known_key IS NOT NULL").distinct()
    blank = (F.col("batch_key") == "") & F.lit(blank_passes)
    fresh = keyed.withColumn("nth", rank).filter((F.col("nth") == 1) | blank)
    return fresh.join(seen, (F.col("batch_key") == F.col("known_key")) & ~blank, "left_anti").drop("batch_key", "nth")


def asof_backward(left: DataFrame, right: DataFrame, by: Sequence[str], left_at: str, right_at: str, value: Sequence[str], tie: str) -> DataFrame:
    """Left rows with the values of the last right row at or before them; null where none is.

    Union and one window: each side is shuffled once and nothing is multiplied. Of
    right rows at one place the last by ``tie`` counts.
    """
    marks = right.select(*by, F.col(right_at).alias("at"), F.lit(0).alias("side"), F.col(tie).cast("string").alias("tie_text"), F.col(tie).alias("tie"), F.struct(*value).alias("mark"))
    kind = marks.schema["mark"].dataType
    rows = left.select(*by, F.col(left_at).alias("at"), F.lit(1).alias("side"), F.lit(None).cast("string").alias("tie_text"), F.lit(None).cast(marks.schema["tie"].dataType).alias("tie"), F.lit(None).cast(kind).alias("mark"), F.struct(*left.columns).alias("row"))
    both = marks.withColumn("row", F.lit(None).cast(rows.schema["row"].dataType)).unionByName(rows)
    upto = Window.partitionBy(*by).orderBy("at", "side", "tie").rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("last", F.last("mark", ignorenulls=True).over(upto)).filter("side = 1")
    return seen.select("row.*", *[F.col(f"last.{v}").alias(v) for v in value])


def _pieces(span: int, least: bool):
    """Rows (..., text) as (..., piece): hashes of pieces of eight characters.

    Of each ``span`` neighbouring pieces the least hash, so texts that share ``span``
    neighbours share a hash; ``least``: only the least of all, which is one of these.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # in small parts, since a text has as many pieces as characters
        for batch in (b.slice(i, 128) for b in batches for i in range(0, b.num_rows, 128)):
            at, found = [], []
            for i, t in enumerate(batch.columns[-1].to_pylist()):
                c = np.frombuffer(t.encode("utf-32-le"), np.uint32).astype(np.uint64)
                h = np.zeros(len(c) - WIDTH + 1, np.uint64)
                for k in range(WIDTH):
                    h = h * np.uint64(0x9E3779B97F4A7C15) + c[k : len(c) - WIDTH + 1 + k]
                h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
                h ^= h >> np.uint64(29)
                kept = h.min(keepdims=True) if least else np.unique(np.lib.stride_tricks.sliding_window_view(h, span).min(axis=1))
                at.append(np.full(len(kept), i))
                found.append(kept.view(np.int64))
            own = batch.take(pa.array(np.concatenate(at) if at else [], pa.int64()))
            piece = pa.array(np.concatenate(found) if found else [], pa.int64())
            yield pa.RecordBatch.from_arrays([*own.columns[:-1], piece], [*own.schema.names[:-1], "piece"])

    return run


def _tiny_held(plain: DataFrame, keys: list[str]) -> DataFrame:
    """keys, seq, text of the texts under WIDTH characters that an earlier text of the group holds.

    The texts of groups with such short ones are cut into all their parts of just these
    lengths; the least ``seq`` of the parts that equal a short text tells whether it comes
    after. No pair of texts is formed.
    """
    tiny = plain.filter(F.length("text") < WIDTH)
    lengths = tiny.groupBy(*keys).agg(F.collect_set(F.length("text")).alias("lengths"))  # WIDTH at most
    near = plain.join(lengths, keys) if keys else plain.crossJoin(F.broadcast(lengths))
    sized = near.select(*keys, "seq", "text", F.explode("lengths").alias("n")).filter(F.length("text") >= F.col("n"))
    parts = F.transform(F.sequence(F.lit(1), F.length("text") - F.col("n") + 1), lambda i: F.substr("text", i, F.col("n")))
    cut = sized.select(*keys, "seq", F.explode(F.array_distinct(F.when(F.col("n") == 0, F.array(F.lit(""))).otherwise(parts))).alias("text"))
    firsts = cut.join(tiny.select(*keys, "text").distinct(), [*keys, "text"], "left_semi").groupBy(*keys, "text").agg(F.min("seq").alias("first"))
    return tiny.join(firsts, [*keys, "text"]).filter("first < seq").select(*keys, "seq", "text")


def not_contained(rows: DataFrame, by: Sequence[str], seq: str, text: str) -> DataFrame:
    """Rows whose text isn't equal to, or part of, that of an earlier row of the group.

    Being contained is transitive, so "earlier" and "earlier and kept" mean the same.
    Equal texts go first by a grouping. What is left is compared only where a longer
    text holds the least hash of a text's pieces of eight characters: the pairs come
    from an equality join on these hashes and are then checked in full. The longer the
    contained text, the fewer pieces of the longer ones are needed; all are made only
    in groups with a text that is too short for the next of ``SPANS``.
    """
    keys = [f"b{i}" for i in range(len(by))]
    first = rows.filter(F.col(text).isNotNull()).groupBy(*by, text).agg(F.min(seq).alias(seq))
    plain = first.select(*[F.col(b).alias(k) for b, k in zip(by, keys, strict=True)], F.col(seq).alias("seq"), F.col(text).alias("text"))
    plain = published(plain, "contained")
    size = F.length("text")

    def cut(part: DataFrame, span: int, least: bool, name: str) -> DataFrame:
        kind = StructType([*[f for f in part.schema.fields if f.name != "text"], StructField("piece", LongType())])
        return part.mapInArrow(_pieces(span, least), kind).withColumnRenamed("seq", name)

    pairs = None
    for span, longer in zip(SPANS, [*SPANS[1:], None], strict=True):
        c = plain.filter(size >= WIDTH + span - 1)
        e = c
        if longer:
            c = c.filter(size < WIDTH + longer - 1)
            if keys:  # only what comes before one of the group's shorter texts can hold it
                e = e.join(c.groupBy(*keys).agg(F.max("seq").alias("last")), keys).filter("seq < last").select(*plain.columns)
        both = cut(c, span, True, "c_seq").join(cut(e, span, False, "e_seq"), [*keys, "piece"]).filter("e_seq < c_seq").select(*keys, "c_seq", "e_seq")
        pairs = pairs.unionByName(both) if pairs else both
    side = lambda p: plain.select(*keys, F.col("seq").alias(f"{p}_seq"), F.col("text").alias(f"{p}_text"))
    held = F.col("e_text").contains(F.col("c_text"))
    gone = pairs.distinct().join(side("c"), [*keys, "c_seq"]).join(side("e"), [*keys, "e_seq"]).filter(held)
    gone_tiny = _tiny_held(plain, keys)
    told = [*keys, F.col("c_seq").alias("seq"), F.col("c_text").alias("text")]
    kept = plain.join(gone.select(*told).unionByName(gone_tiny).distinct(), [*keys, "seq", "text"], "left_anti")
    kept = kept.select(*[F.col(k).alias(b) for k, b in zip(keys, by, strict=True)], F.col("seq").alias(seq), F.col("text").alias(text))
    return rows.join(kept, [*by, text, seq], "left_semi")


def zipped(a: DataFrame, b: DataFrame, a_order: Sequence[Column], b_order: Sequence[Column], by: Sequence[str]) -> DataFrame:
    """Rows of both sides paired by place within a group, up to the shorter side."""
    left = a.withColumn("nth", F.row_number().over(Window.partitionBy(*by).orderBy(*a_order)))
    right = b.withColumn("nth", F.row_number().over(Window.partitionBy(*by).orderBy(*b_order)))
    return left.join(right, [*by, "nth"])


def updated(base: DataFrame, changes: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Base rows with the changes' non-null values of ``columns``."""
    new = changes.select(key, *[F.col(c).alias(f"new_{c}") for c in columns])
    out = base.join(new, key, "left")
    return out.withColumns({c: F.coalesce(f"new_{c}", c) for c in columns}).drop(*[f"new_{c}" for c in columns])


def fused(lists: Sequence[DataFrame], by: Sequence[str], item: str, k: int = 60) -> DataFrame:
    """Reciprocal-rank fusion: sum of 1 / (k + rank) over the lists, with ranks from 0."""
    union = lists[0].select(*by, item, "rank0")
    for other in lists[1:]:
        union = union.unionByName(other.select(*by, item, "rank0"))
    return union.groupBy(*by, item).agg(F.sum(1.0 / (F.lit(float(k)) + F.col("rank0"))).alias("score"))
