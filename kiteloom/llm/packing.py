"""Best-fit packing planned over a histogram of lengths.

Texts become token ids and an end id; only longer ones are cut into pieces of
``capacity`` (the first piece takes what is left over). The plan needs nothing but
the number of pieces of each length, at most ``capacity`` numbers: longest first,
as many pieces as possible at once go to the sequences with the least room that
still fits them. It says for each length which ranks go to which sequences at
which offset. Pieces then take their slots by joining on length and rank.

A rank is the place among the pieces of a length: exact counts of (length, salt)
cells give each cell's first rank, a window within a cell the rest, so that one
very common length is spread over many tasks.

Defined results: a null or empty text is the end id alone; repeated rows are packed
as rows of their own; an empty table gives no pieces; extra columns are ignored.
"""

from __future__ import annotations

import json
import re
import sys
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kiteloom.llm.common import small_batches, stage

CAPACITY = 1024
END_ID = 2
SALTS = 64
#: Words in each half of the memo.
MEMO = 300_000
#: Characters whose classes the byte-level split below knows. A text with others is split
#: by the tokenizer itself, with its own Unicode tables.
SETTLED = [chr(c) for c in (*range(0x530), *range(0x2000, 0x2070))]
UNSETTLED = re.compile("[^\\x00-\\u052f\\u2000-\\u206f]")


def _class(unicode_class: str) -> str:
    fits = regex.compile(unicode_class).fullmatch
    return "".join(re.escape(c) for c in SETTLED if fits(c))


def byte_level_pattern() -> re.Pattern:
    """The split of byte-level vocabularies into words, for ``SETTLED`` characters."""
    letter, number, space = _class(r"\p{L}"), _class(r"\p{N}"), _class(r"\s")
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+")


def byte_letters() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if it prints, else one from U+0100 on."""
    prints = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in prints]
    return {b: chr(b) for b in prints} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Memo(dict):
    """Ids of words as bytes. At ``MEMO`` words it becomes the old half, from which words in use come back."""

    def __init__(self, model):
        super().__init__()
        self.model, self.letters, self.old = model, byte_letters(), {}

    def __missing__(self, word: str) -> bytes:
        found = self.old.get(word)
        if found is None:
            found = array("I", [t.id for t in self.model.tokenize(word.encode().decode("latin-1").translate(self.letters))]).tobytes()
        if len(word) <= 64:  # longer ones are rare, and of any length
            if len(self) >= MEMO:
                self.old = dict(self)
                self.clear()
            self[word] = found
        return found


class Ids:
    """Token ids of whole texts, as the tokenizer gives them, with a bounded memo of words."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        told = json.loads(self.tokenizer.to_str())
        split = told["pre_tokenizer"] or {}
        #: whether words can be looked up one by one
        self.by_word = told["normalizer"] is None and split.get("type") == "ByteLevel" and not split["add_prefix_space"] and split.get("use_regex", True) and sys.byteorder == "little"
        self.words, self.memo = byte_level_pattern().findall, Memo(self.tokenizer.model)

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if not self.by_word or UNSETTLED.search(text) or any(s in text for s in self.special):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(map(self.memo.__getitem__, self.words(text)))


@lru_cache(maxsize=2)
def ids_of(path: str) -> Ids:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Ids(path)


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``n`` ids."""
    head = n % capacity or min(n, capacity)
    return [(0, head), *((s, capacity) for s in range(head, n, capacity))]


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and (if ``ids``) the ids' bytes of every piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, end = ids_of(path), np.array([end_id], "<u4").tobytes()
        names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * ids
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64()] + [pa.binary()] * ids
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = own.encode(text.as_py() or "") + end
                for k, (s, n) in enumerate(cut(len(found) // 4, capacity)):
                    body = found[4 * s : 4 * (s + n)]
                    rows.append((doc, k, s, n, zlib.crc32(body), body)[: len(names)])
            cols = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names)

    small_batches(docs.sparkSession)
    schema = "doc_id long, piece int, start long, length int, ids_crc32 long" + ", ids binary" * ids
    return docs.select(docs["doc_id"].cast("long"), "text").mapInArrow(run, schema)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Best fit, longest first, over ``counts`` of pieces by length.

    Rows (length, first rank, last rank, first sequence, offset): rank r of the
    length goes to sequence first sequence + (r - first rank) at the offset.
    """
    room: dict[int, list[tuple[int, int]]] = {}  # room left -> runs of sequences (first, number)
    rooms = np.zeros(capacity + 1, bool)
    out, made = [], 0

    def put(run: tuple[int, int], left: int) -> None:
        if left:
            room.setdefault(left, []).append(run)
            rooms[left] = True

    for length in sorted(counts, reverse=True):
        rank, todo = 0, counts[length]
        while todo:
            fits = np.flatnonzero(rooms[length:])
            if len(fits):
                left = length + int(fits[0])
                first, n = room[left].pop()
                if not room[left]:
                    rooms[left] = False
                if n > todo:
                    put((first + todo, n - todo), left)
                    n = todo
            else:
                # best fit would fill each new sequence with this length before it opens another
                left, first = capacity, made
                n = max(1, todo // (capacity // length))
                made += n
            out.append((length, rank, rank + n - 1, first, capacity - left))
            put((first, n), left - length)
            rank, todo = rank + n, todo - n
    return out


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, ids: bool = False) -> DataFrame:
    """Every piece with its sequence_id and its offset there."""
    spark = docs.sparkSession
    found = stage(pieces(docs, path, capacity, end_id, ids), "pieces")
    salted = found.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(SALTS)).cast("int"))
    # at most capacity * SALTS rows, whatever the input
    cells = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = cells.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    # at most capacity rows reach the driver, and the plan has a few rows for each of them
    counts = {r["length"]: r["n"] for r in found.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    slots = spark.createDataFrame(
        plan(counts, capacity) or [], "slot_length int, low long, high long, first_sequence long, offset long"
    )
    inside = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("in_cell", F.row_number().over(inside) - 1).join(F.broadcast(starts), ["length", "salt"])
    ranked = ranked.withColumn("rank", F.col("first") + F.col("in_cell"))
    taken = ranked.join(
        F.broadcast(slots), (F.col("length") == F.col("slot_length")) & F.col("rank").between(F.col("low"), F.col("high"))
    )
    return taken.select(
        "doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32",
        (F.col("first_sequence") + F.col("rank") - F.col("low")).alias("sequence_id"), "offset", *["ids"] * ids,
    )
