"""Byte-level BPE encoding and decoding by prefix dynamic programming.

For each prefix of a byte string exactly one token can be the last one of the
prefix's own encoding. ``Prefixes`` stores that token for every prefix: the last
token of a prefix is the one that ends there, whose start has a last token it may
follow. Two tokens may follow each other if merging their bytes in rank order gives
the two back. An append only adds entries; an edit drops the entries behind it and
adds new ones until they agree with the old table for a token's length.

``Codec`` splits a text by the pattern of its ranks, encodes each match by such a
table, and keeps matches it has met in a bounded memo, since words repeat.

Defined results: null is an empty text, which gives no ids; special tokens' strings
are ordinary text; repeated rows get equal results. A match of any length takes
memory in proportion to it.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from kiteloom.llm.common import small_batches

#: Matches that a worker remembers before it starts afresh.
MEMO = 400_000


class Ranks:
    """A vocabulary of byte tokens, where a lower rank merges earlier."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = [b""] * (max(ranks.values()) + 1)
        for b, r in ranks.items():
            self.token[r] = b
        self.longest = max(map(len, ranks))
        self.split = self._splits()
        self._pairs: dict[tuple[int, int], bool] = {}

    @classmethod
    def read(cls, path: str) -> Ranks:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})

    def _splits(self) -> list[tuple[int, int] | None]:
        """The last merge that makes each token of over one byte."""
        out: list[tuple[int, int] | None] = [None] * len(self.token)
        for b, r in sorted(self.ranks.items(), key=lambda x: x[1]):
            if len(b) > 1:
                parts = self._merge([b[i : i + 1] for i in range(len(b))], r)
                if len(parts) == 2:
                    out[r] = (self.ranks[parts[0]], self.ranks[parts[1]])
        return out

    def _merge(self, parts: list[bytes], below: int) -> list[bytes]:
        """Merge neighbours in rank order, by ranks under ``below`` only."""
        while len(parts) > 1:
            best, at = below, -1
            for i in range(len(parts) - 1):
                r = self.ranks.get(parts[i] + parts[i + 1], below)
                if r < best:
                    best, at = r, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def may_follow(self, left: int, right: int) -> bool:
        """Whether the encoding of the two tokens' joined bytes is these two tokens.

        Undoes the later merge of the two again and again and looks whether a
        merge across the border would have come before it.
        """
        key = (left, right)
        known = self._pairs.get(key)
        if known is None:
            if len(self._pairs) > 4 * MEMO:
                self._pairs.clear()
            known = self._pairs[key] = self._border(left, right)
        return known

    def _border(self, left: int, right: int) -> bool:
        limit = len(self.token)
        while True:
            across = self.ranks.get(self.token[left] + self.token[right])
            if across is not None and across < limit:
                return False
            # undo the later of the two merges; a single byte has none to undo
            later_is_left = left > right
            for undo_left in (later_is_left, not later_is_left):
                parts = self.split[left if undo_left else right]
                if parts is not None:
                    break
            else:
                return True
            if undo_left:
                limit, left = left, parts[1]
            else:
                limit, right = right + 1, parts[0]


class Prefixes:
    """The unique last token of each prefix of a growing byte string."""

    def __init__(self, ranks: Ranks, data: bytes = b""):
        self.ranks, self.data, self.last = ranks, bytearray(), [-1]
        self.append(data)

    def append(self, data: bytes) -> None:
        """Add bytes at the end: exact, and only the new prefixes are worked out."""
        r, last, begin = self.ranks, self.last, len(self.data)
        self.data += data
        base = max(0, begin - r.longest)
        body, get = bytes(self.data[base:]), r.ranks.get
        for end in range(begin + 1, len(self.data) + 1):
            found = -1
            # the longest valid token first; exactly one is valid
            for start in range(max(0, end - r.longest), end):
                t = get(body[start - base : end - base])
                if t is None:
                    continue
                before = last[start]
                if end - start > 1 and r.split[t] is None:  # no merge reaches it
                    continue
                if start == 0 or r.may_follow(before, t):
                    found = t
                    break
            last.append(found)

    def truncate(self, n: int) -> None:
        del self.data[n:]
        del self.last[n + 1 :]

    def edit(self, start: int, end: int, data: bytes) -> None:
        """Replace the bytes start:end; only prefixes near the edit are worked out.

        An entry depends on as many entries before it as the longest token has
        bytes. Once that many new entries equal the old ones, all later ones do.
        """
        tail, old = bytes(self.data[end:]), self.last[end + 1 :]
        self.truncate(start)
        self.append(data)
        same = 0
        for n in range(len(tail)):
            self.append(tail[n : n + 1])
            same = same + 1 if self.last[-1] == old[n] else 0
            if same >= self.ranks.longest:
                self.data += tail[n + 1 :]
                self.last += old[n + 1 :]
                return

    def ids(self) -> list[int]:
        out, at = [], len(self.data)
        while at:
            t = self.last[at]
            out.append(t)
            at -= len(self.ranks.token[t])
        out.reverse()
        return out


class Codec:
    """Encodes whole texts to ids and back."""

    class _Memo(dict):
        def __init__(self, codec: Codec):
            super().__init__()
            self.codec = codec

        def __missing__(self, piece: str) -> bytes:
            if len(self) >= MEMO:
                self.clear()
            ids = self.codec.encode_piece(piece.encode())
            out = np.array(ids, "<u4").tobytes()
            if len(piece) <= 64:
                self[piece] = out
            return out

    def __init__(self, ranks: Ranks, pattern: str):
        self.ranks, self.pieces = ranks, regex.compile(pattern).findall
        self.memo = self._Memo(self)

    def encode_piece(self, piece: bytes) -> list[int]:
        known = self.ranks.ranks.get(piece)
        if known is not None:
            return [known]
        return Prefixes(self.ranks, piece).ids()

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.memo.__getitem__, self.pieces(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.ranks.token.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    """A worker's own codec, read once from the installed vocabulary file."""
    return Codec(Ranks.read(path), pattern)


def encode(docs: DataFrame, path: str, pattern: str, ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and (if ``ids``) the ids' bytes.

    No exchange: a row's result depends on its text alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            n, sha, back, kept = [], [], [], []
            for text in batch.column(1):
                found = own.encode(text.as_py() or "")
                n.append(len(found) // 4)
                sha.append(hashlib.sha256(found).hexdigest())
                back.append(hashlib.sha256(own.decode(found)).hexdigest())
                if ids:
                    kept.append(found)
            cols = [batch.column(0), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(back, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if ids:
                cols, names = [*cols, pa.array(kept, pa.binary())], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(cols, names)

    small_batches(docs.sparkSession)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * ids
    return docs.select(docs["doc_id"].cast("long"), "text").mapInArrow(run, schema)
