"""Words of Arrow string arrays as numpy arrays: places and 64-bit hashes.

A word is a run of bytes outside space, \\t, \\n, \\v, \\f and \\r, all of them
single bytes in UTF-8, so words are found on the raw buffer of an Arrow array
without making a Python string. A hash is a polynomial of random byte codes
modulo 2**64, finished by a mixing step.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_RNG = np.random.default_rng(20240229)
GAP = np.zeros(256, bool)
GAP[[9, 10, 11, 12, 13, 32]] = True
CODE = _RNG.integers(0, 2**64, 256, dtype=np.uint64)
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32  # A-Z
BASE = 0x9E3779B97F4A7C15
#: Two more odd bases, for sequences of words.
BASE_A, BASE_B = 0xD1B54A32D192ED03, 0x8CB92BA72F3D8DD7
BLOCK = 1 << 20
#: Bytes of text that are worked on at once; a longer single text is one piece.
PIECE = 1 << 21


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 2**64)
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 4096)
            grow = lambda b: np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size - 1, b, np.uint64))])
            self.up, self.down = grow(self.base), grow(self.inverse)
        return self.up[:n], self.down[:n]


_BYTES, _A, _B = Powers(BASE), Powers(BASE_A), Powers(BASE_B)


@dataclass
class Words:
    """Words of some texts: byte places in ``data``, hashes, and the words of each text."""

    data: np.ndarray  # uint8, the texts one after the other
    texts: np.ndarray  # int64, n + 1 byte places
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray  # int64, n + 1: text i has words first[i]:first[i + 1]

    def __len__(self) -> int:
        return len(self.texts) - 1

    def bytes_of(self, word: int, n: int = 1) -> list[bytes]:
        raw = self.data
        return [raw[self.starts[i] : self.ends[i]].tobytes() for i in range(word, word + n)]


def raw(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary array and its n + 1 offsets; null counts as empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if array.null_count:
        array = array.fill_null(b"" if pa.types.is_binary(array.type) or pa.types.is_large_binary(array.type) else "")
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    _, offsets, data = array.buffers()
    if not len(array):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    body = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return body, at - at[0]


def pieces(array: pa.Array, most: int = PIECE) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``most`` bytes, one row at least."""
    _, at = raw(array)
    i = 0
    while i < len(array):
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        yield i, j
        i = j


def words(array: pa.Array, fold: bool = False) -> Words:
    """The words of each text of ``array``; ``fold`` lower-cases A-Z."""
    data, at = raw(array)
    if fold:
        data = FOLD[data]
    full = ~GAP[data] if len(data) else np.zeros(0, bool)
    edge = np.zeros(len(data) + 1, bool)  # where a word can't continue
    edge[at] = True
    before = np.concatenate([[False], full[:-1]]) if len(data) else full
    after = np.concatenate([full[1:], [False]]) if len(data) else full
    starts = np.flatnonzero(full & (~before | edge[:-1]))
    ends = np.flatnonzero(full & (~after | edge[1:])) + 1
    first = np.searchsorted(starts, at)
    return Words(data, at, starts, ends, _hash_spans(data, starts, ends), first)


def _hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    out = np.zeros(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        low = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, low + BLOCK, "right")))
        high = ends[j - 1]
        up, down = _BYTES.upto(int(high - low))
        sums = np.zeros(high - low + 1, np.uint64)
        np.cumsum(CODE[data[low:high]] * up, out=sums[1:])
        s, e = starts[i:j] - low, ends[i:j] - low
        out[i:j] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))
        i = j
    return out


def windows(hashes: np.ndarray, n: int, second: bool = False) -> np.ndarray:
    """Hash of each ``n`` consecutive numbers of ``hashes``; ``second``: by an independent base."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    up, down = (_B if second else _A).upto(len(hashes))
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * up, out=sums[1:])
    return mix((sums[n:] - sums[:-n]) * down[: len(hashes) - n + 1])


def inside(first: np.ndarray, n: int) -> np.ndarray:
    """For windows of ``n`` words over all texts: whether a window lies in one text."""
    total = int(first[-1])
    ok = np.ones(max(total - n + 1, 0), bool)
    for k in first[1:-1]:
        ok[max(k - n + 1, 0) : k] = False
    return ok


def sequence_keys(w: Words) -> list[bytes]:
    """A 128-bit key of the whole word sequence of each text."""
    up_a, _ = _A.upto(len(w.hashes) + 1)
    up_b, _ = _B.upto(len(w.hashes) + 1)
    out = []
    for i in range(len(w)):
        h = w.hashes[w.first[i] : w.first[i + 1]]
        a = (h * up_a[: len(h)]).sum(dtype=np.uint64)
        b = (mix(h) * up_b[: len(h)]).sum(dtype=np.uint64)
        out.append(mix(np.array([a, b], "<u8")).tobytes())
    return out


def sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    """The least of each ``n`` consecutive numbers."""
    if len(x) < n:
        return x[:0]
    done = 1
    while 2 * done <= n:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    rest = n - done
    return np.minimum(x[:-rest], x[rest:]) if rest else x
