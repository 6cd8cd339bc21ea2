"""The training-data queries against oracle SQL or plain versions over the small tables."""

from __future__ import annotations

import base64
import collections
import hashlib
import io
import math
import re
import struct
import wave
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from kiteloom.llm import media, toxicity
from kiteloom.llm.common import stage
from kiteloom.llm.oracles import ORACLE_SQL
from kiteloom.llm.queries import QUERIES, VOCABULARY
from tests.compare import difference, oracle

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle(SF)


@pytest.fixture(scope="module")
def docs(con):
    return dict(con.execute("SELECT doc_id, text FROM documents").fetchall())


@pytest.mark.parametrize("name", list(ORACLE_SQL))
def test_oracle(spark, con, name):
    assert difference(QUERIES[name](spark, SF), con, ORACLE_SQL[name]) == ""


def test_op3_is_the_reference_encoding(spark, docs):
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = QUERIES["op3_byte_bpe"](spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = np.array(own.encode_ordinary(docs[r["doc_id"]]), "<u4")
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(ids.tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(docs[r["doc_id"]].encode()).hexdigest()


def test_op7_is_a_balanced_partition(spark, docs):
    rows = QUERIES["op7_histogram_sharding"](spark, SF).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    sizes, slots = collections.Counter(), collections.defaultdict(list)
    for r in rows:
        body = docs[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(body) + 16, zlib.crc32(body), "bytes")
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert set(sizes) <= set(range(40))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    largest = max(len(t.encode()) + 16 for t in docs.values())
    assert max(sizes.values()) <= sum(sizes.values()) / 40 + 2 * largest


def test_op9_gives_back_every_payload(spark, docs):
    rows = QUERIES["op9_media_chunks"](spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        body = docs[r["doc_id"]].encode()
        padded = body + b"\0" * (max(64, -(-len(body) // 64) * 64) - len(body))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(body), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        made = io.BytesIO()
        with wave.open(made, "wb") as out:
            out.setparams((1, 1, media.RATE, 0, "NONE", ""))
            out.writeframes(padded)
        assert (r["media_bytes"], r["media_sha256"]) == (len(made.getvalue()), hashlib.sha256(made.getvalue()).hexdigest())
        x = [b - 128 for b in padded]
        crossings = sum((a < 0) != (b < 0) for a, b in zip(x, x[1:], strict=False))
        assert r["feature"] == f"samples={len(x)};sum={sum(x)};energy={sum(v * v for v in x)};crossings={crossings};peak={max(map(abs, x))}"


def test_op10_packs_every_token_once_and_tightly(spark, docs):
    tokenizer = Tokenizer.from_file(VOCABULARY)
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in QUERIES["op10_best_fit_packing"](spark, SF).collect():
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    assert pieces.keys() == docs.keys()
    total = 0
    for doc, own in pieces.items():
        ids, at = [*tokenizer.encode(docs[doc], add_special_tokens=False).ids, 2], 0
        for k, p in enumerate(sorted(own, key=lambda p: p["piece"])):
            body = np.array(ids[at : at + p["length"]], "<u4").tobytes()
            assert (p["piece"], p["start"], p["ids_crc32"]) == (k, at, zlib.crc32(body))
            assert p["length"] == 1024 or k == 0
            at += p["length"]
        assert at == len(ids)
        total += at
    for own in sequences.values():
        at = 0
        for p in sorted(own, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 1024
    assert len(sequences) <= 1.02 * -(-total // 1024) + 1


def test_op1_learns_on_rows_that_may_be_learnt_from(spark, con, docs):
    rows = {r["doc_id"]: r for r in QUERIES["op1_toxicity"](spark, SF).collect()}
    assert rows.keys() == docs.keys()
    for d, r in rows.items():
        assert r["held_out"] == (zlib.crc32(str(d).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5)
    same = collections.defaultdict(set)
    for d, t in docs.items():
        same[t].add(rows[d]["score"])
    assert all(len(s) == 1 for s in same.values())


def test_op1_tells_held_out_rows_and_never_learns_from_them(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    assert model.pairs > 0
    held = toxicity.held_out(F.col("doc_id"))
    turned = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.fit(docs, turned) == model
    rows = toxicity.score(docs, model).join(labels, "doc_id").filter("held_out").collect()
    bad, good = ([r["predicted"] for r in rows if r["toxic"] == t] for t in (1, 0))
    assert len(bad) > 50 and np.mean(bad) >= 0.85 and np.mean(good) <= 0.02
    plain = toxicity.fit(docs, labels, pairing=0.0)
    assert plain.weights != model.weights


def test_op1_is_the_plain_sum_of_its_features(spark, docs):
    model = toxicity.fit(*(spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels")))
    for r in QUERIES["op1_toxicity"](spark, SF).collect():
        found = {f for w in re.findall(r"[^\W\d_]+", docs[r["doc_id"]].lower()) for f in toxicity.features(w)}
        z = model.bias + sum(w for f, w in model.weights.items() if f in found)
        assert abs(r["score"] - 1 / (1 + math.exp(-max(-35, min(35, z))))) < 1e-9


def test_op7_is_the_plain_sort(spark, docs):
    """Shards are ranges of all rows sorted by the keys, cut where the running bytes are nearest to each target."""
    signed = lambda u: u - 2**64 if u >= 2**63 else u
    key = lambda d: (signed(xxhash.xxh64_intdigest(docs[d].encode(), 42)), signed(xxhash.xxh64_intdigest(struct.pack("<q", d), 42)))
    rows = {r["doc_id"]: r for r in QUERIES["op7_histogram_sharding"](spark, SF).collect()}
    order = sorted(docs, key=key)
    shards = [rows[d]["shard"] for d in order]
    assert shards == sorted(shards)
    total, before = sum(r["size"] for r in rows.values()), 0
    begun = {}
    for d in order:
        begun.setdefault(rows[d]["shard"], (before, rows[d]["size"]))
        before += rows[d]["size"]
    for s, (at, size) in begun.items():
        assert abs(at - total * s / 40) <= 0.001 * total / 40 + max(size, max(r["size"] for r in rows.values()))


def test_pipeline_stages_take_effect(spark):
    """Every stage changes what it gets, at the least size at which each has work."""
    sf = "/root/testdata/sf0.01"
    seen = spark.read.parquet(f"{sf}/documents.parquet")
    columns, n = seen.columns, seen.count()
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    for name, step in corpus_pipeline.STAGES[:-1]:
        kept = stage(step(spark, seen, sf), f"test-{name}")
        assert kept.columns == columns
        assert kept.join(seen, "doc_id", "left_anti").count() == 0
        gone = [r["doc_id"] for r in seen.join(kept, "doc_id", "left_anti").select("doc_id").collect()]
        if name == "substring_dedup":
            assert kept.join(seen.select("doc_id", F.col("n_chars").alias("had")), "doc_id").filter("n_chars < had").count() > 0
        else:
            assert gone
        if name == "toxicity":
            told = [labels[d] for d in gone if d in labels]
            assert told and np.mean(told) >= 0.8
        seen = kept
    assert 0.3 * n < seen.count() < n
    rows = corpus_pipeline.STAGES[-1][1](spark, seen, sf).collect()
    assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in seen.select("doc_id").collect()}
