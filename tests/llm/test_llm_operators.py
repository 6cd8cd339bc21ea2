"""Edge cases and methods of the training-data operators on small tables of their own."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from kiteloom.llm import bpe, chat, media, near_dedup, packing, quality_rules, sharding, substring_dedup, toxicity, url_filters
from kiteloom.llm import words as W
from kiteloom.llm.queries import RANKS, VOCABULARY, public_tokenizers

RNG = random.Random(4)
VOICE = [f"w{i}" for i in range(400)]


def said(n: int, rng: random.Random = RNG) -> str:
    return " ".join(rng.choice(VOICE) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Null, empty and blank texts, a repeated row, a tie, one very long text, clashing columns."""
    long = said(30_000, random.Random(1))
    plain = said(120, random.Random(2))
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, plain), (4, plain), (5, plain), (6, long), (7, "one"), (8, "naïve — 日本 😀 " + plain), (9, "a" * 5000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    extra = {c: F.lit("x") for c in ("words", "keys", "kept", "score", "size", "shard", "n_words", "z", "anchors", "component_id", "length", "lang", "source", "row")}
    return df.withColumns(extra).repartition(3)


@pytest.fixture(scope="module")
def nothing(odd):
    return odd.limit(0)


OPERATORS = {
    "quality": lambda d: quality_rules.report(d),
    "rejected": lambda d: quality_rules.reject(d),
    "bpe": lambda d: bpe.encode(d, RANKS, public_tokenizers.PATTERN),
    "substrings": lambda d: substring_dedup.removals(d),
    "applied": lambda d: substring_dedup.apply(d),
    "near": lambda d: near_dedup.classes(d),
    "thin": lambda d: near_dedup.thin(d),
    "shards": lambda d: sharding.shard(d),
    "media": lambda d: media.columns(d),
    "packing": lambda d: packing.pack(d, VOCABULARY),
    "toxicity": lambda d: toxicity.score(d, toxicity.Model({"=w1": 3.0}, -1.0)),
    "nontoxic": lambda d: toxicity.reject(d, toxicity.Model({"=w1": 3.0}, -1.0)),
}


@pytest.mark.parametrize("name", list(OPERATORS))
def test_empty_tables_give_empty_results(nothing, name):
    assert OPERATORS[name](nothing).count() == 0


@pytest.mark.parametrize("name", ["quality", "bpe", "substrings", "near", "shards", "media", "toxicity"])
def test_every_row_gets_its_row(odd, name):
    got = OPERATORS[name](odd)
    assert sorted(r["doc_id"] for r in got.collect()) == [1, 2, 3, 4, 4, 5, 6, 7, 8, 9]


@pytest.mark.parametrize("name", ["rejected", "applied", "thin", "nontoxic"])
def test_stages_keep_the_columns(odd, name):
    assert OPERATORS[name](odd).columns == odd.columns


def test_quality_of_odd_texts(odd):
    got = {r["doc_id"]: r for r in OPERATORS["quality"](odd).collect()}
    assert [got[i]["n_words"] for i in (1, 2, 3, 7)] == [0, 0, 0, 1]
    assert got[1]["base_failed"] and not got[1]["kept"]


def test_pipeline_keeps_long_clean_documents(spark):
    long = " ".join(("the of and to " if i % 5000 == 0 else "") + f"w{i}" for i in range(200_001))
    df = spark.createDataFrame([(1, long), (2, "too short")], "doc_id long, text string")
    assert quality_rules.reject(df).count() == 0
    assert [r["doc_id"] for r in corpus_pipeline.quality(spark, df, "").select("doc_id").collect()] == [1]


def test_repeat_words_exact_path_agrees(spark):
    rng = random.Random(9)
    texts = [" ".join(rng.choice("a b c d".split()) for _ in range(rng.randint(0, 40))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    seen = quality_rules.measures(df).withColumn("n_words", F.col("n_words").cast("int"))
    got = seen.select("text", "n_repeat_words", F.expr(f"CASE WHEN n_words < 3 THEN 0L ELSE {quality_rules._exact_path()} END").alias("exact")).collect()
    for r in got:
        w = r["text"].split()
        g = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        want = len({p for i, x in enumerate(g) if g.count(x) > 1 for p in range(i, i + 3)})
        assert r["n_repeat_words"] == r["exact"] == want


def test_prefix_table_appends_and_edits():
    codec = bpe.codec(RANKS, public_tokenizers.PATTERN)
    rng = random.Random(3)
    table, data = bpe.Prefixes(codec.ranks), b""
    for _ in range(60):
        new = bytes(rng.choice(b"abc the ing\xc3\xa9") for _ in range(rng.randint(1, 9)))
        if data and rng.random() < 0.5:
            a = rng.randrange(len(data))
            b = rng.randint(a, len(data))
            table.edit(a, b, new)
            data = data[:a] + new + data[b:]
        else:
            table.append(new)
            data += new
        fresh = bpe.Prefixes(codec.ranks, data)
        assert bytes(table.data) == data and table.last == fresh.last
        assert b"".join(codec.ranks.token[t] for t in table.ids()) == data


def test_windows_and_hashes_are_those_of_the_words():
    texts = ["a b  c", "", " b c\na", "b c", None]
    w = W.words(pa.array(texts))
    spelled = [x for t in texts for x in (t or "").split()]
    assert [b.decode() for b in w.bytes_of(0, len(spelled))] == spelled
    assert len(set(w.hashes.tolist())) == 3 and np.diff(w.first).tolist() == [3, 0, 3, 2, 0]
    assert W.windows(w.hashes, 2)[1] == W.windows(w.hashes, 2)[3] == W.windows(w.hashes, 2)[6]
    x = np.random.default_rng(1).integers(0, 99, 40).astype(np.uint64)
    assert W.sliding_min(x, 7).tolist() == [x[i : i + 7].min() for i in range(34)]


@pytest.mark.parametrize("seed", range(3))
def test_substrings_are_those_of_brute_force(spark, seed):
    rng = random.Random(seed)
    passages = [said(70, rng) for _ in range(4)]
    rows = []
    for i in range(40):
        parts = [said(rng.randint(0, 80), rng)]
        for _ in range(rng.randint(0, 2)):
            p = rng.choice(passages).split()
            a = rng.randint(0, 25)
            parts += [" ".join(p[a : a + rng.randint(45, 60)]), said(rng.randint(0, 30), rng)]
        rows.append((i // 2 if seed == 2 else i, "\n".join(parts)))
    first = {}
    for d, t in sorted(rows):
        w = t.split()
        for i in range(len(w) - 49):
            first.setdefault(tuple(w[i : i + 50]), d)
    want = []
    for d, t in rows:
        w = t.split()
        gone = {p for i in range(len(w) - 49) if first[tuple(w[i : i + 50])] < d for p in range(i, i + 50)}
        want.append((d, len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()))
    got = substring_dedup.report(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_applied_rows_keep_their_own_texts(spark):
    """Rows that share an id, clashing column names, and a line repeated within a document."""
    rng = random.Random(12)
    shared, line = said(60, rng), "One short line. " * 40
    rows = [(1, "a b " + shared, 1), (2, shared + " z", 2), (2, "short text  only", 3), (3, line, 4), (4, line + "end", 5), (5, None, 6), (None, shared, 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long").withColumns({c: F.lit("x") for c in ("cut_id", "cut_text", "keys", "cut", "row", "z")})
    got = {r["doc_id"] if r["doc_id"] != 2 else r["text"]: r for r in substring_dedup.apply(df.repartition(3)).collect()}
    assert len(got) == 7 and got["z"]["n_chars"] == 1 and got["short text  only"]["n_chars"] == 3
    assert got[1]["text"] == rows[0][1] and got[3]["text"] == line and got[4]["text"] == "end" and got[None]["text"] == shared
    assert all(r["cut_id"] == "x" for r in got.values())


def test_near_copies_join_by_chains_and_not_below_the_threshold(spark):
    rng = random.Random(7)
    rows, base = [], said(300, rng).split()
    for i in range(40):  # near copies of near copies
        base = list(base)
        for _ in range(2):
            base[rng.randrange(len(base))] = f"edit{i}-{rng.random()}"
        rows.append((100 - i, " ".join(base)))
    rows += [(200 + i, said(150, rng)) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    sets = {d: {tuple(t.split()[i : i + 3]) for i in range(len(t.split()) - 2)} for d, t in rows}
    low = {d: d for d in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both) and low[a] > low[b]:
                    low[a], changed = low[b], True
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.classes(df).collect()}
    assert got == low


def test_pipeline_drops_near_copies_with_an_added_paragraph(spark):
    rng = random.Random(8)
    rows = []
    for i in range(10):  # 296 / 356 of five-word shingles, 298 / 358 of three-word ones
        base = " ".join(f"d{i}-{k}" for k in range(300))
        rows += [(2 * i, base), (2 * i + 1, base + " " + " ".join(f"e{i}-{k}" for k in range(60)))]
    rows += [(100, said(300, rng)), (101, said(300, rng))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert near_dedup.thin(df).count() == 22
    assert sorted(r["doc_id"] for r in corpus_pipeline.near(spark, df, "").collect()) == [*range(0, 20, 2), 100, 101]


def test_bands_follow_the_threshold(spark):
    assert [near_dedup.band_rows(n, 100) for n in (50, 70, 80, 85, 100)] == [3, 5, 8, 9, 9]
    with pytest.raises(ValueError):
        near_dedup.band_rows(1, 100)
    rows = []
    for i in range(20):  # 298 / 594 of three-word shingles
        base = " ".join(f"d{i}-{k}" for k in range(300))
        rows += [(2 * i, base), (2 * i + 1, base + " " + " ".join(f"e{i}-{k}" for k in range(296)))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert near_dedup.thin(df, numerator=50).count() == 20


@pytest.mark.parametrize("block", [near_dedup.BLOCK, 20_000])
def test_members_that_are_not_linked_are_compared_in_blocks(spark, monkeypatch, block):
    """One wide family: few members are as near to each other as the threshold."""
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    rng = random.Random(11)
    base = [f"f{i}" for i in range(150)]
    rows = []
    for i in range(240):
        w = list(base)
        for p in rng.sample(range(150), rng.choice((0, 1, 2, 4, 6, 9, 12))):
            w[p] = f"x{i}-{p}"
        rows.append((i, " ".join(w)))
    rows += [(300 + i, said(100, rng)) for i in range(10)]
    sets = {d: {tuple(t.split()[i : i + 3]) for i in range(len(t.split()) - 2)} for d, t in rows}
    low, links = {d: d for d in sets}, []
    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                links.append((a, b))
    for _ in rows:
        for a, b in links:
            low[a] = low[b] = min(low[a], low[b])
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got == low
    assert 20 < len(set(low.values())) < 240


def test_pairs_at_the_threshold_are_found(spark):
    """Recall: 150 pairs of a similarity of 0.85 to 0.86, and as many just below."""
    rows = []
    for i in range(150):
        words = [f"p{i}-{k}" for k in range(302)]
        rows.append((10 * i, " ".join(words)))
        rows.append((10 * i + 1, " ".join(words + [f"n{i}-{k}" for k in range(51 + i % 2)])))  # 300 of 351 shingles, or of 352
        rows.append((10 * i + 5, " ".join([f"m{i}-{k}" for k in range(302)])))
        rows.append((10 * i + 6, " ".join([f"m{i}-{k}" for k in range(302)] + [f"o{i}-{k}" for k in range(53)])))  # 300 of 353
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert all(c == (d - 1 if d % 10 == 1 else d) for d, c in got.items())


def test_thin_keeps_one_of_repeated_rows(spark):
    t = said(60)
    df = spark.createDataFrame([(4, t, 1), (4, t, 1), (5, t, 2), (6, None, 3), (None, said(60), 4)], "doc_id long, text string, x int")
    assert sorted(tuple(r)[2] for r in near_dedup.thin(df).collect()) == [1, 3, 4]


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(5)
    for share in (0.5, 0.85):
        hits = []
        for _ in range(30):
            x = rng.integers(0, 2**63, 600).astype(np.uint64)
            k = int(round(600 * 2 * share / (1 + share)))
            y = np.concatenate([x[:k], rng.integers(0, 2**63, 600 - k).astype(np.uint64)])
            hits.append((near_dedup.sketch(np.unique(x)) == near_dedup.sketch(np.unique(y))).mean())
        assert abs(np.mean(hits) - share) < 0.03


def test_shards_stay_level_with_one_text_in_a_third_of_all_rows(spark):
    rows = [(i, "same text " * 20 if i % 3 == 0 else said(30)) for i in range(3000)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).groupBy("shard").agg(F.sum("size").alias("b"), F.count("*").alias("n"), F.max("slot").alias("m")).collect()
    sizes = [r["b"] for r in got]
    assert len(got) == 40 and max(sizes) < 1.05 * np.mean(sizes) and all(r["m"] == r["n"] - 1 for r in got)


def test_events_fold_to_final_messages(spark):
    log = [
        (1, 0, 0, "message", "user", "Hi"), (1, 1, 1, "message", "assistant", ""), (1, 1, 2, "delta", None, "Hel"), (1, 1, 3, "delta", None, "lo"),
        (1, 1, 4, "regenerate", None, None), (1, 1, 5, "delta", None, "Yo "), (1, 1, 6, "delta", None, "</s>"), (1, 0, 7, "edit", None, "[INST]\\e"),
        (2, 0, 0, "delta", "assistant", None), (3, 5, 1, "message", None, "x"), (3, 5, 1, "message", None, "x"),
    ]
    df = spark.createDataFrame(log, "conv_id long, turn long, seq long, kind string, role string, text string").repartition(3)
    pieces = chat.format_events(df.orderBy(F.rand(5)))
    got = {}
    for r in sorted(pieces.collect(), key=lambda r: tuple(r[c] for c in chat.ORDER)):
        assert r["piece"].count("</s>") == 1 and r["piece"].count("[INST]") == 1
        got.setdefault(r["conv_id"], []).append(chat.parse(r["piece"]))
    assert got == {1: [("user", "[INST]\\e"), ("assistant", "Yo </s>")], 2: [("assistant", "")], 3: [("user", "x"), ("user", "x")]}
    back = {r["conv_id"]: r for r in chat.read_back(pieces.orderBy(F.rand(6))).collect()}
    assert back[1]["loss_chars"] == 7 and back[1]["loss_sha256"] == hashlib.sha256(b"Yo </s>").hexdigest()
    assert back[1]["turns_sha256"] == hashlib.sha256(b"user\n[INST]\\e\nassistant\nYo </s>\n").hexdigest()
    assert back[2]["loss_sha256"] == hashlib.sha256(b"").hexdigest()
    assert chat.read_back(chat.format_events(df.limit(0))).count() == 0


def test_logs_of_conversations_fold_back_to_them(spark):
    """Null and empty texts and roles, repeated rows, a tie, one very long text, clashing columns; and without a fold step they differ."""
    long = said(30_000)
    rows = [(1, 0, "system", None), (1, 1, "user", ""), (1, 2, "assistant", "ab"), (1, 3, "assistant", long), (2, 0, None, "more than a draft"), (2, 1, "assistant", "é😀</s>"), (2, 1, "assistant", "é😀</s>"), (3, 0, "assistant", "a")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit("x") for c in ("seq", "kind", "piece")}).repartition(3)
    log = chat.events_of(df)
    assert {r["kind"] for r in log.collect()} == {"message", "delta", "regenerate", "edit"}
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_events(log.orderBy(F.rand(3)))).collect()}
    for conv in (1, 2, 3):
        own = [(role or "user", text or "") for c, _, role, text in rows if c == conv]
        loss = "".join(t for r, t in own if r == "assistant")
        assert got[conv]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in own).encode()).hexdigest()
        assert (got[conv]["n_turns"], got[conv]["loss_chars"], got[conv]["loss_sha256"]) == (len(own), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    for kind in ("delta", "regenerate", "edit"):
        other = {r["conv_id"]: r["turns_sha256"] for r in chat.read_back(chat.format_events(log.filter(F.col("kind") != kind))).collect()}
        assert other != {c: r["turns_sha256"] for c, r in got.items()}


@pytest.mark.parametrize("text", ["", "\\", "\\e</s>", "<s><<SYS>>\\\\[/INST]", "a\nb"])
def test_escape_is_reversible(text):
    assert chat.unescape(chat.escape(text)) == text
    assert not any(c in chat.escape(text) for c in chat.LETTERS if c != "\\")


def test_url_rules_and_reputation(spark):
    urls = ["http://A.Example.NET/en/x?y", "https://example.net/de/", "http://x.example.com/de/#f", "http://q.org/fr/z", "nothing", None, "ftp://h.net", "a://notexample.com/de/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("clash"))
    got = {r["page_id"]: r for r in url_filters.judge(pages, spark.createDataFrame([], "page_id long, bad int")).collect()}
    assert [(got[i]["host"], got[i]["path"], got[i]["rule"], got[i]["verdict"]) for i in range(8)] == [
        ("a.example.net", "/en/x", "example.net/en/", "allow"), ("example.net", "/de/", "net/", "block"), ("x.example.com", "/de/", "example.com/de/", "block"),
        ("q.org", "/fr/z", "org/fr/", "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("h.net", "", None, "allow"), ("notexample.com", "/de/", None, "allow"),
    ]
    rows = [(i, "http://bad.spam.example/" if i < 60 else f"http://h{i % 9}.fine.example/") for i in range(200)]
    out = spark.createDataFrame([(i, int(i < 58)) for i in range(200)], "page_id long, bad int")
    told = {r["host"]: r["verdict"] for r in url_filters.judge(spark.createDataFrame(rows, "page_id long, url string"), out).collect()}
    assert told["bad.spam.example"] == "block" and set(told.values()) == {"block", "allow"} and told["h1.fine.example"] == "allow"
    assert url_filters.judge(pages.limit(0), out).count() == 0


def test_chunks_follow_content(spark):
    body = random.Random(8).randbytes(300_000)
    a, b = media.cuts(body), media.cuts(b"inserted" + body)
    assert a[-1] == len(body) and len({x for x in a} & {y - 8 for y in b}) > len(a) // 2
    assert all(y - x <= media.MOST for x, y in zip([0, *a], a, strict=False))
    rows = [(i, "x" * 40_000 + said(20_000, random.Random(i % 2)), ) for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = media.columns(df).collect()
    assert len(got) == 6 and len({r["payload_sha256"] for r in got}) == 2
    saved = media.savings(media.catalogue(df), media.chunk_store(df)).first()
    assert saved["distinct_chunks"] < saved["chunks_of_distinct_files"] < saved["chunks"]


def test_files_of_many_chunks_need_all_of_them(spark):
    shared = said(9000, random.Random(3))
    df = spark.createDataFrame([(i, said(300 + i, random.Random(i)) + shared) for i in range(8)], "doc_id long, text string").repartition(3)
    listed, store = media.catalogue(df), media.chunk_store(df)
    assert all(len(r["chunks"]) > 3 for r in listed.collect())
    assert media.reconstruct(media.manifest(listed), store).count() == 8
    with pytest.raises(Exception, match="chunk of a file is missing"):
        media.reconstruct(media.manifest(listed).filter("place <> 1"), store).collect()


@pytest.mark.parametrize("seed", range(5))
def test_plan_is_a_packing_and_close_to_the_bound(seed):
    rng = random.Random(seed)
    counts = {n: rng.randint(1, 40) for n in rng.sample(range(1, 1025), 200)}
    used, ranks = {}, {}
    for length, low, high, first, offset in packing.plan(counts):
        assert low == ranks.get(length, 0)
        ranks[length] = high + 1
        for s in range(first, first + high - low + 1):
            assert used.get(s, 0) == offset
            used[s] = offset + length
    assert ranks == counts and max(used.values()) <= 1024
    bound = max(-(-sum(n * c for n, c in counts.items()) // 1024), sum(c for n, c in counts.items() if n > 512))
    assert len(used) <= 1.02 * bound + 1


def test_packing_of_odd_texts(odd):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(VOCABULARY)
    got = {}
    for r in packing.pack(odd, VOCABULARY, ids=True).collect():
        got.setdefault(r["doc_id"], []).append(r)
    for r in odd.select("doc_id", "text").distinct().collect():
        want = [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, packing.END_ID]
        own = sorted(got[r["doc_id"]], key=lambda p: (p["start"], p["sequence_id"], p["offset"]))
        times = 2 if r["doc_id"] == 4 else 1
        assert sum(p["length"] for p in own) == times * len(want)
        assert [p["ids"] for p in own[::times]] == [np.array(want[p["start"] : p["start"] + p["length"]], "<u4").tobytes() for p in own[::times]]
    assert [len(got[i]) for i in (1, 2, 4, 7)] == [1, 1, 2, 1] and len(got[6]) > 50
    places = [(p["sequence_id"], p["offset"]) for own in got.values() for p in own]
    assert len(set(places)) == len(places)


def test_words_have_the_ids_of_the_tokenizer(monkeypatch):
    monkeypatch.setattr(packing, "MEMO", 50)
    own, rng = packing.Ids(VOCABULARY), random.Random(5)
    assert own.by_word
    for _ in range(3000):
        text = "".join(rng.choice(packing.SETTLED) if rng.random() < 0.5 else rng.choice(" 'st\n\tredm lv,.1a") for _ in range(rng.randint(0, 60)))
        text += rng.choice(["", " 漢字", " <|endoftext|> x", "a" * 200])
        assert own.encode(text) == np.array(own.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_cut_takes_the_rest_first():
    assert packing.cut(1, 1024) == [(0, 1)] and packing.cut(1024, 1024) == [(0, 1024)]
    assert packing.cut(2500, 1024) == [(0, 452), (452, 1024), (1476, 1024)]


def test_counterfactual_pairing_spares_neutral_mentions(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(600):
        toxic = i % 3 == 0
        words = [rng.choice(VOICE) for _ in range(30)]
        if toxic and rng.random() < 0.7:
            words[3] = "muslim"  # the group is mentioned mostly in toxic texts
        if toxic:
            words[5] = "vileword" if i % 2 else "nastyword"
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    docs, told = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    neutral = said(30, random.Random(1)) + " muslim"
    fair, plain = (toxicity.fit(docs, told, pairing=p).scorer() for p in (10.0, 0.0))
    assert fair(neutral) < 0.5 and fair(neutral) <= plain(neutral)
    assert fair(said(30, random.Random(2)) + " nastyword vileword") > 0.5
    none = toxicity.fit(docs, told.limit(0))
    assert none.weights == {} and none.scorer()(None) == none.scorer()("any") == 0.5


def test_repeated_ids_are_learnt_once(spark):
    """Copies of rows under one id neither weigh more nor are more rows at the driver."""
    rng = random.Random(7)
    rows = [(i, said(20, rng) + (" nastyword" if i % 4 == 0 else "")) for i in range(200)]
    docs, told = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in rows], "doc_id long, toxic int")
    once = toxicity.fit(docs, told)
    assert once.weights
    assert toxicity.fit(docs.unionByName(docs).unionByName(docs), told) == once
