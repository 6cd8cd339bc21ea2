"""Substring dedup by repeated-phrase automata.

Removes each word that a window of ``span`` words covers whose word sequence also
starts in a document with a smaller id; windows are judged on the input.

1. Anchors. Every window of ``span`` words holds ``span - phrase + 1`` phrases of
   ``phrase`` words; the one with the least hash is the window's anchor. Two equal
   windows have equal anchors, so a document sends one hash for about each 20 words.
2. Confirm. An anchor is recurring if documents with different ids have it.
3. Automata. The recurring anchors' own words, read from the texts, are the phrases.
   Documents are streamed in shards; a shard compiles an Aho-Corasick automaton of
   all its phrases and locates every occurrence of them in all its documents. Phrases
   never leave the shard that holds a document with them, so no automaton grows with
   the corpus.
4. Windows around an occurrence are sent as 128-bit hashes; the least id of each is
   joined back, and a last pass over the texts removes what it covers.

Documents with one and the same word sequence are represented by the least id among
them: all windows of the others start there, so they need no windows of their own.
Counts combine on the map side, and the joins have one row a key on one side, so a
hot passage, which every document sends once, is split by adaptive execution. What is
collected for a document is in proportion to the document.

Defined results: null and empty texts have no words and lose none; a text of fewer
than ``span`` words loses none; rows with one id never remove from each other, be
they equal or not; extra columns are ignored by ``removals`` and carried by ``apply``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kiteloom.llm import words as W
from kiteloom.llm.common import small_batches, stage

SPAN = 50
PHRASE = 10
NEVER = np.uint64(2**64 - 1)


def _anchors(w: W.Words, span: int, phrase: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, anchor) pairs, neighbours without repeats."""
    grams = W.windows(w.hashes, phrase)
    ok = W.inside(w.first, span)
    least = W.sliding_min(grams, span - phrase + 1)
    at = np.flatnonzero(ok)
    if not len(at):
        return at, least[:0]
    text = np.searchsorted(w.first, at, "right") - 1
    found = least[at]
    new = np.ones(len(at), bool)
    new[1:] = (found[1:] != found[:-1]) | (text[1:] != text[:-1])
    return text[new], found[new]


def _survey(span: int, phrase: int):
    """doc_id, key of the word sequence, number of words and anchors of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in W.pieces(batch.column(1)):
                part = batch.slice(i, j - i)
                w = W.words(part.column(1))
                text, found = _anchors(w, span, phrase)
                at = np.searchsorted(text, np.arange(len(part) + 1)).astype(np.int32)
                anchors = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(found.view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(W.sequence_keys(w), pa.binary()), pa.array(np.diff(w.first)), anchors],
                    ["doc_id", "key", "n_words", "anchors"],
                )

    return run


def _automaton(phrases: set[str]) -> ahocorasick.Automaton:
    made = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
    for p in phrases:
        made.add_word(p)
    made.make_automaton()
    return made


def _locate(span: int, phrase: int):
    """(doc_id, w1, w2) of every window around an occurrence of a shard's phrases."""

    def shard(docs: list[int], texts: list[bytes], wanted: list[np.ndarray]) -> pa.RecordBatch:
        w = W.words(pa.array(texts, pa.binary()))
        grams = W.windows(w.hashes, phrase)
        phrases, plain = set(), []
        for k in range(len(w)):
            a, b = int(w.first[k]), int(w.first[k + 1])
            spelled = w.bytes_of(a, b - a)
            own = grams[a : max(b - phrase + 1, a)]
            hit = np.flatnonzero(np.isin(own, wanted[k]))
            phrases.update((b" " + b" ".join(spelled[h : h + phrase]) + b" ").decode("utf-8", "surrogateescape") for h in hit.tolist())
            plain.append((" " + b" ".join(spelled).decode("utf-8", "surrogateescape") + " ", [len(x.decode("utf-8", "surrogateescape")) for x in spelled]))
        made = _automaton(phrases) if phrases else None
        one, two = W.windows(w.hashes, span), W.windows(w.hashes, span, second=True)
        starts, owners = [], []
        for k, (line, lengths) in enumerate(plain):
            if made is None or len(lengths) < span:
                continue
            # places of the blank after each word; an occurrence ends at one
            blanks = np.cumsum(np.asarray(lengths) + 1)
            ends = np.fromiter((e for e, _ in made.iter(line)), np.int64)
            if not len(ends):
                continue
            last = np.searchsorted(blanks, ends)  # the last word of each occurrence
            lead = np.zeros(len(lengths) + 1, np.int64)
            low = np.maximum(last - span + 1, 0)
            high = np.minimum(last - phrase + 1, len(lengths) - span) + 1
            keep = high > low
            np.add.at(lead, low[keep], 1)
            np.add.at(lead, high[keep], -1)
            at = np.flatnonzero(np.cumsum(lead[:-1]) > 0) + w.first[k]
            # a window goes once, however often a line repeats within the document
            at = at[np.unique(one[at], return_index=True)[1]]
            starts.append(at)
            owners.append(np.full(len(at), docs[k], np.int64))
        at = np.concatenate(starts) if starts else np.zeros(0, np.int64)
        doc = np.concatenate(owners) if owners else np.zeros(0, np.int64)
        return pa.RecordBatch.from_arrays(
            [pa.array(doc), pa.array(one[at].view(np.int64)), pa.array(two[at].view(np.int64))], ["doc_id", "w1", "w2"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        docs, texts, wanted, size = [], [], [], 0
        for batch in batches:
            for doc, z, a in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                docs.append(doc)
                texts.append(unpack.decompress(z.as_buffer()))
                wanted.append(np.asarray(a.values, np.int64).view(np.uint64))
                size += len(texts[-1])
                if size > W.PIECE:
                    yield shard(docs, texts, wanted)
                    docs, texts, wanted, size = [], [], [], 0
        if docs:
            yield shard(docs, texts, wanted)

    return run


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as compressed bytes, which every later exchange carries."""
    squeeze = zstandard.ZstdCompressor(level=3, write_content_size=True)
    for batch in batches:
        z = [squeeze.compress(t.as_buffer() if t.is_valid else b"") for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(z, pa.binary())], ["doc_id", "z"])


def _kept(body: bytes, keys: pa.Scalar, cut: pa.Scalar, span: int) -> tuple[int, bytes]:
    """Number of removed words of a text and its kept words joined by a blank."""
    spelled = body.split()
    if len(spelled) < span or not (keys.is_valid or cut.is_valid):
        return 0, b" ".join(spelled)
    w = W.words(pa.array([body], pa.binary()))
    if keys.is_valid and W.sequence_keys(w)[0] in keys.as_py():
        return len(spelled), b""
    if not cut.is_valid:
        return 0, b" ".join(spelled)
    gone = np.asarray(cut.values, np.int64).view(np.uint64)
    hit = np.isin(W.windows(w.hashes, span), gone)
    edge = np.zeros(len(spelled) + 1, np.int64)
    edge[:-span][hit] += 1
    edge[span:][hit] -= 1
    drop = np.cumsum(edge[:-1]) > 0
    return int(drop.sum()), b" ".join(x for x, d in zip(spelled, drop.tolist(), strict=True) if not d)


def _remove(span: int):
    """Per row: number of words, of removed words, digest of the kept words, the kept text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            out = []
            for doc, z, keys, cut in zip(*batch.columns, strict=True):
                body = unpack.decompress(z.as_buffer())
                n, kept = _kept(body, keys, cut, span)
                out.append((doc.as_py(), n + len(kept.split()), n, hashlib.sha256(kept).hexdigest(), kept))
            cols = list(zip(*out, strict=True)) or [()] * 5
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    return run


def _rewrite(span: int, columns: list[str]):
    """The rows themselves, each with its own kept words as text where it loses some."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = dict(zip(columns, batch.column(0).flatten(), strict=True))
            texts, chars = own["text"].to_pylist(), own["n_chars"].to_pylist() if "n_chars" in own else None
            for k, (text, keys, cut) in enumerate(zip(texts, batch.column(1), batch.column(2), strict=True)):
                if text and (keys.is_valid or cut.is_valid):
                    n, kept = _kept(text.encode(), keys, cut, span)
                    if n:
                        texts[k] = kept.decode()
                        if chars:
                            chars[k] = len(texts[k])
            own["text"] = pa.array(texts, own["text"].type)
            if chars is not None:
                own["n_chars"] = pa.array(chars, own["n_chars"].type)
            yield pa.RecordBatch.from_arrays(list(own.values()), columns)

    return run


def _places(docs: DataFrame, span: int, phrase: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(doc_id, z) of each row, (doc_id, keys) of sequences repeated as a whole, (doc_id, cut) of windows to remove."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    survey = stage(texts.mapInArrow(_survey(span, phrase), "doc_id long, key binary, n_words long, anchors array<long>"), "anchors")

    classes = survey.filter(F.col("n_words") >= span).groupBy("key").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
    repeated = survey.select("doc_id", "key").join(classes.filter("least < most"), "key").filter("doc_id > least")
    copies = stage(repeated.groupBy("doc_id").agg(F.collect_set("key").alias("keys")), "copies")

    one = survey.join(copies, "doc_id", "left")
    one = one.filter("keys IS NULL OR NOT array_contains(keys, key)").select("doc_id", F.explode("anchors").alias("anchor"))
    recurring = one.groupBy("anchor").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).filter("least < most")
    wanted = one.join(recurring.select("anchor"), "anchor").groupBy("doc_id").agg(F.collect_set("anchor").alias("anchors"))

    packed = texts.mapInArrow(_pack, "doc_id long, z binary")
    around = packed.join(wanted, "doc_id").select("doc_id", "z", "anchors")
    found = stage(around.mapInArrow(_locate(span, phrase), "doc_id long, w1 long, w2 long"), "windows")
    owner = found.groupBy("w1", "w2").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).filter("least < most")
    covered = found.join(owner, ["w1", "w2"]).filter("doc_id > least").groupBy("doc_id").agg(F.collect_set("w1").alias("cut"))

    return packed, copies, covered


def removals(docs: DataFrame, span: int = SPAN, phrase: int = PHRASE) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and kept (the kept words as UTF-8 bytes) of each row."""
    packed, copies, covered = _places(docs, span, phrase)
    told = packed.join(copies, "doc_id", "left").join(covered, "doc_id", "left").select("doc_id", "z", "keys", "cut")
    return told.mapInArrow(_remove(span), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept binary")


def apply(docs: DataFrame, span: int = SPAN, phrase: int = PHRASE) -> DataFrame:
    """``docs`` with the kept words as text and, if it is a column, n_chars of that text.

    A row that loses no word keeps its text as it is. Rows travel whole, so rows that
    share an id, and columns of any name, stay apart.
    """
    _, copies, covered = _places(docs, span, phrase)
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["doc_id"].cast("long").alias("doc_id"))
    told = rows.join(copies, "doc_id", "left").join(covered, "doc_id", "left").select("row", "keys", "cut")
    return told.mapInArrow(_rewrite(span, docs.columns), docs.schema)


def report(docs: DataFrame) -> DataFrame:
    return removals(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")
