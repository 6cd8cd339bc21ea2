"""Vector search, Merkle manifest and prefix trie against brute force on small and odd inputs."""

from __future__ import annotations

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from kiteloom.llm import manifest, ordered, prefix_trie, vector_search
from kiteloom.llm.queries import QUERIES


def sha(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


# ordered ---------------------------------------------------------------------------------------


def test_ranks_and_running_totals_of_a_hot_group(spark, monkeypatch):
    monkeypatch.setattr(ordered, "BLOCK", 4)
    rows = [("hot", i * 7 % 50, i) for i in range(50)] + [("b", None, 1), ("b", 3, 2), ("c", 1, 5)]
    df = spark.createDataFrame(rows, "g string, o int, v long").repartition(5)
    got = ordered.rank_within(df, "g", ["o", "v"], "place", "test-rank")
    want, by = {}, collections.defaultdict(list)
    for g, o, v in rows:
        by[g].append((o is not None, o or 0, v))
    for g, all_ in by.items():
        for i, (_, _, v) in enumerate(sorted(all_)):
            want[g, v] = i
    assert {(r["g"], r["v"]): r["place"] for r in got.collect()} == want
    for back in (False, True):
        totals = ordered.running(got, "g", "place", {"s": ("sum", F.col("v")), "x": ("bit_xor", F.col("v"))}, back)
        for r in totals.collect():
            part = [v for (g, v), p in want.items() if g == r["g"] and (p >= r["place"] if back else p <= r["place"])]
            assert r["s"] == sum(part)
            assert r["x"] == np.bitwise_xor.reduce(part)


# op12 ------------------------------------------------------------------------------------------


def item(v) -> str:
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def levels_of(nodes: list[str]) -> list[list[str]]:
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha(*out[-1][i : i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def path(levels: list[list[str]], i: int) -> list[tuple[str, str]]:
    steps = []
    for nodes in levels[:-1]:
        steps.append(("" if i ^ 1 >= len(nodes) else "LR"[i % 2 == 0], nodes[i ^ 1] if i ^ 1 < len(nodes) else ""))
        i //= 2
    return steps


def plain_manifest(rows: list[tuple]) -> list[tuple]:
    """Of (doc_id, source, lang, n_chars, text) rows."""
    trees = collections.defaultdict(list)
    for r in rows:
        trees[r[2]].append((r[0] is not None, r[0] or 0, sha(*map(item, r)), r))
    keys = sorted(trees, key=lambda lang: (lang is not None, (lang or "").encode()))
    built = {k: levels_of([x[2] for x in sorted(trees[k], key=lambda x: x[:3])]) for k in keys}
    upper = levels_of([built[k][-1][0] for k in keys])
    out = []
    for at, k in enumerate(keys):
        for i, (_, _, leaf, r) in enumerate(sorted(trees[k], key=lambda x: x[:3])):
            steps = path(built[k], i) + path(upper, at)
            h = leaf
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None:
                h = sha(*map(item, (*r[:3], r[3] + 1, r[4])))
            for side, s in steps:
                h = sha(s, h) if side == "L" else sha(h, s)
            out.append((r[0], leaf, built[k][-1][0], upper[-1][0], sha(*[s for _, s in steps]), h, h == upper[-1][0]))
    return out


DOCS = "doc_id long, source string, lang string, n_chars long, text string, tree string, h string"


@pytest.mark.parametrize("levels", [1, 3, 8])
@pytest.mark.parametrize("n", [1, 2, 9, 70])
def test_manifest_is_the_plain_tree(spark, monkeypatch, n, levels):
    monkeypatch.setattr(manifest, "LEVELS", levels)
    rng = random.Random(n)
    rows = [(i * 3, rng.choice(["web", None, ""]), rng.choice([None, "", "en", "en", "en", "é"]), rng.choice([None, i]), rng.choice([None, "", "tëxt\n", "x" * 3000])) for i in range(n)]
    rows += rows[:2] + [(None, None, None, None, None)] * 2 if n > 2 else []
    df = spark.createDataFrame([(*r, "other", "column") for r in rows], DOCS)
    got = [tuple(r) for r in manifest.manifest(df).collect()]
    assert sorted(got, key=repr) == sorted(plain_manifest(rows), key=repr)
    assert n < 70 or {r[-1] for r in got} == {True, False}


def test_manifest_of_nothing_and_of_the_largest_count(spark):
    assert manifest.manifest(spark.createDataFrame([], DOCS)).collect() == []
    last = 2**63 - 1
    at = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 0)
    got = manifest.manifest(spark.createDataFrame([(at, "s", "en", last, "t", "", "")], DOCS)).first()
    assert (got["leaf"], got["root"], got["verified"]) == (sha(item(at), "1:s", "2:en", item(last), "1:t"),) * 1 + (got["leaf"], False)
    assert got["folded_root"] == sha(item(at), "1:s", "2:en", item(last + 1), "1:t")


# op13 ------------------------------------------------------------------------------------------


def plain_trie(rows: list[tuple]) -> list[tuple]:
    """Of (conv_id, turn, role, text) rows."""
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", hashlib.md5((text or "").encode()).hexdigest(), text or ""))
    own = {c: [(x[2], x[4]) for x in sorted(v)] for c, v in own.items()}
    convs = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        convs[c] = tuple(own.get(base, [])[:h] + v[h:])
    members = collections.defaultdict(list)
    for c, v in convs.items():
        for d in range(len(v) + 1):
            members[v[:d]].append(c)
    out = []
    for key, held in members.items():
        under = [k for k in members if k[: len(key)] == key]
        kids = [k for k in under if len(k) == len(key) + 1]
        leaves = [k for k in under if not any(len(x) == len(k) + 1 and x[: len(k)] == k for x in under)]
        saved = sum((len(members[k]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) for k in under if k)
        ends = sorted(c for c in held if len(convs[c]) == len(key))
        out.append((min(held), len(key), min(members[key[:-1]]) if key else None, len(held), len(kids), len(leaves), saved, sha(",".join(map(str, ends)))))
    return out


TURNS = "conv_id long, turn long, role string, text string, depth int, owner string"


def made_conversations(rng: random.Random, n: int) -> list[tuple]:
    texts = ["hi", "a b  c", "", None, "x\ty\x0bz", "é è"]
    rows = []
    for c in range(n):
        c = c if rng.random() < 0.9 else -c - 1
        for t in range(rng.choice([1, 1, 2, 3, 5, 11])):
            rows.append((c, rng.choice([None, t, t]), rng.choice(["user", "assistant", None, ""]), rng.choice(texts)))
    return rows


@pytest.mark.parametrize("seed", range(4))
def test_trie_is_the_plain_trie(spark, monkeypatch, seed):
    monkeypatch.setattr(ordered, "BLOCK", 4)
    monkeypatch.setattr(prefix_trie, "ENDS", 8)
    rng = random.Random(seed)
    rows = made_conversations(rng, 60) + [(100 + i, t, "user", f"same {t}") for i in range(40) for t in range(9)] + [(None, 0, "user", "no id"), (7, 0, "user", "hi"), (7, 0, "user", "hi")]
    rows += [(400, t, "user", "long") for t in range(30)]
    df = spark.createDataFrame([(*r, 0, "clash") for r in rows], TURNS)
    got = [tuple(r) for r in prefix_trie.nodes(df).collect()]
    assert sorted(got, key=repr) == sorted(plain_trie(rows), key=repr)


def test_trie_of_nothing_and_of_turnless_conversations(spark):
    assert prefix_trie.nodes(spark.createDataFrame([], TURNS)).collect() == []
    short = next(c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4 == 3)
    rows = [(short, 0, "user", "gone")]
    got = [tuple(r) for r in prefix_trie.nodes(spark.createDataFrame([(*r, 0, "") for r in rows], TURNS)).collect()]
    assert got == [(short, 0, None, 1, 0, 1, 0, sha(str(short)))] == plain_trie(rows)


# op11 ------------------------------------------------------------------------------------------


def nearest(ids: np.ndarray, x: np.ndarray, k: int, every: int) -> dict[int, list[tuple[int, float]]]:
    out = {}
    for a in np.flatnonzero(ids % every == 0):
        s = (x * x[a]).sum(1)
        order = [o for o in np.lexsort((ids, -s)) if ids[o] != ids[a]][:k]
        out[int(ids[a])] = [(int(ids[o]), float(s[o])) for o in order]
    return out


def searched(df, **given) -> dict[int, list]:
    out = collections.defaultdict(list)
    for r in sorted(vector_search.search(df, **given).collect()):
        assert r["rank"] == len(out[r["query_id"]]) + 1
        out[r["query_id"]].append((r["vec_id"], r["score"]))
    return dict(out)


@pytest.fixture
def small_index(monkeypatch):
    for name, value in {"ROWS_A_LIST": 60, "BLOCK": 40, "SLICE": 2, "WAVE": 3}.items():
        monkeypatch.setattr(vector_search, name, value)


@pytest.mark.parametrize("kind", ["shapeless", "clustered", "norms", "copies"])
def test_search_finds_nearly_all_and_scores_exactly(spark, small_index, kind):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((900, 24))
    if kind == "clustered":
        x = rng.standard_normal((9, 24))[rng.integers(0, 9, 900)] * 4 + x * 0.3
    if kind == "norms":
        x *= rng.lognormal(0, 1, (900, 1))
    if kind == "copies":  # a third of all rows is one vector
        x[::3] = x[0]
    ids = rng.permutation(3000)[:900]
    df = spark.createDataFrame([(int(i), [float(a) for a in v], 1, "query") for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>, rank int, v string").repartition(6)
    got, want = searched(df, k=7, every=5), nearest(ids, x, 7, 5)
    assert got.keys() == want.keys()
    place = {int(i): n for n, i in enumerate(ids)}
    hits = 0
    for q, found in got.items():
        assert len(found) == 7 and q not in [i for i, _ in found]
        assert found == sorted(found, key=lambda f: (-f[1], f[0]))
        for i, s in found:
            assert abs(s - float((x[place[i]] * x[place[q]]).sum())) <= 1e-12 * (1 + abs(s))
        hits += len({i for i, _ in found} & {i for i, _ in want[q]})
    assert hits >= 0.95 * 7 * len(want)


def test_search_abandons_early_where_distances_tell(small_index):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((40, 64)) * 5
    index = vector_search.Index(x, 1, float(np.linalg.norm(x, axis=1).max()))
    t = np.array([float((x[1] * x[1]).sum()) * 0.9])
    best = vector_search.Best(t.copy(), 3)
    read = vector_search.scan(index, best, np.array([-1]), x[1:2], np.array([False]), np.arange(40), x, index.columns(x))
    assert best.ids.tolist() == [1]
    assert read < 0.6 * x.size


def test_search_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, [0.0, 1.0]), (1, [0.5, 0.5]), (2, None), (3, [0.0, -0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [1.0, None]), (7, [1.0]), (8, []), (None, [1.0, 1.0]), (1, [0.5, 0.5]), (9, [0.5, 0.5]), (40, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert searched(df) == {0: [(1, 0.5), (9, 0.5), (20, 0.0)], 20: [(1, 0.5), (9, 0.5), (0, 0.0)]}
    assert searched(df, k=1) == {0: [(1, 0.5)], 20: [(1, 0.5)]}
    assert searched(df.filter("vec_id = 0")) == {}
    assert vector_search.search(df.limit(0)).columns == ["query_id", "rank", "vec_id", "score"]
    assert vector_search.search(df.limit(0)).collect() == []


def test_op11_recall_on_the_table(spark):
    sf = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], np.float64)
    got = collections.defaultdict(set)
    for r in QUERIES["op11_adaptive_dimension_scan"](spark, sf).collect():
        got[r["query_id"]].add(r["vec_id"])
    want = nearest(ids, x, 20, 20)
    assert got.keys() == want.keys()
    assert sum(len(got[q] & {i for i, _ in w}) for q, w in want.items()) >= 0.97 * 20 * len(want)


# repaired operators ------------------------------------------------------------------------------


def test_thin_keeps_rows_without_ids_and_a_stated_row_of_repeats(spark):
    from kiteloom.llm import near_dedup

    long = " ".join(f"w{i}" for i in range(60))
    data = [(None, long, "a", 1), (None, long, "a", 1), (None, None, "b", 2), (1, long, "x", 3), (1, long, "y", 4), (1, long, "x", 3), (2, long + " more", "z", 5), (3, "other", "q", 6), (3, "another", "q", 7), (4, None, "n", 8)]
    columns = "doc_id long, text string, order string, nth int"
    kept = [near_dedup.thin(spark.createDataFrame(rows, columns).repartition(n), n=5, numerator=80, denominator=100).collect() for rows, n in ((data, 1), (data[::-1], 4))]
    got = [sorted((tuple(r) for r in k), key=repr) for k in kept]
    assert got[0] == got[1]
    assert [r for r in got[0] if r[0] is None] == sorted([data[0], data[1], data[2]], key=repr)
    assert [r[0] for r in got[0] if r[0] is not None] == [1, 3, 3, 4]


def test_judge_keeps_a_callers_columns(spark):
    from kiteloom.llm import quality_rules

    df = spark.createDataFrame([(1, "a b c", ["own"], 7, "k", 9)], "doc_id long, text string, words array<string>, keys int, full_lines string, n_words int")
    r = quality_rules.judge(df).first()
    assert (r["words"], r["keys"], r["full_lines"], r["n_words"], r["text"]) == (["own"], 7, "k", 3, "a b c")
    assert quality_rules.judge(df).columns.count("n_words") == 1


def test_media_are_read_back_from_what_was_stored(spark, tmp_path):
    import glob
    import shutil

    from kiteloom.llm import common, media

    passage = " ".join(f"shared{i * 7919}" for i in range(400))
    df = spark.createDataFrame([(i, f"head {i} " * 40 + passage + f" tail {i}" * 40) for i in range(12)] + [(99, None), (98, "")], "doc_id long, text string").repartition(3)
    held = media.stored(df, media.train(df))
    saved = media.savings(held, media.chunk_store(held)).first()
    assert saved["distinct_chunks"] < 0.7 * saved["chunks_of_distinct_files"]
    assert sorted(r["doc_id"] for r in media.columns(df).collect()) == sorted([*range(12), 98, 99])
    for folder in glob.glob(f"{common.shared_dir(spark)}/media-*"):
        shutil.rmtree(folder)
    with pytest.raises(Exception, match="(?i)not exist|FILE_NOT_EXIST|not found"):
        media.read_back(held).collect()


def test_every_file_is_put_together_from_the_store(spark, monkeypatch):
    from kiteloom.llm import media

    passage = " ".join(f"shared{i * 7919}" for i in range(400))
    rows = [(i, f"head {i} " * 40 + passage + f" tail {i}" * 40) for i in range(12)] + [(20, "short"), (21, "short"), (99, None), (98, ""), (7, "again"), (None, "no id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    held = media.stored(df)
    store = media.chunk_store(held)
    assert store.count() == store.select("digest").distinct().count()  # once, not once a task
    assert media.listed_in(held).count() == len(rows)
    joined, plain = [], media.reconstruct
    monkeypatch.setattr(media, "reconstruct", lambda listing, *more: joined.append(listing) or plain(listing, *more))
    want = {media._digest(media.media_of((text or "").encode())): media.features(media.media_of((text or "").encode())) for _, text in rows}
    for hot in (1024, 2):
        monkeypatch.setattr(media, "HOT", hot)
        joined.clear()
        assert {bytes(r[0]): tuple(bytes(x) if isinstance(x, bytearray) else x for x in r[1:]) for r in media.read_back(held).collect()} == want
        met = {bytes(r["media"]) for part in joined for r in part.select("media").distinct().collect()}
        assert met == set(want)  # no file beside the join
    lost = media.listed_in(held).filter("doc_id = 20").first()["chunks"][0]
    with pytest.raises(Exception, match="chunk of a file is missing"):
        plain(media.manifest(held), store.filter(F.col("digest") != F.lit(bytes(lost)))).collect()
