"""Papers, search, acceptance rounds and chunk blocks against plain models and hand-made cases."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from kiteloom.operators import folds, papers, search, vectors


def parsed(spark, *texts: str | None) -> list[tuple]:
    df = spark.createDataFrame(list(enumerate(texts)), "paper int, body string")
    return sorted((r["paper"], r["segment"], r["n"], r["answer"], r["format"], r["text"]) for r in papers.questions(df, ["paper"], "body").collect())


def block(n, stem="भारत का सबसे बड़ा नगर कौन है", options="ABCD", extra=""):
    return f"{n}. {stem}\n{extra}" + "".join(f"({o}) विकल्प {o}\n" for o in options)


def test_keyed_papers_are_cut_at_answer_lines_only(spark):
    match = block(2, "सूची को सुमेलित कीजिए और कूट चुनिए", extra="1. पहला पद\n2. दूसरा पद\n")
    paper = "Site name\n" + block(1) + "Answer – (C)\n" + match + "Show Answer/Hide\n\n\n उत्तर (b) ।\n" + "7. An English twin of it\n(A) one\n(B) two\n" + block(3) + "Answer- ( * )\n"
    paper += "no question here\nAnswer: D\n" + block("१२") + "Answer – (E).\n" + block(99)
    got = parsed(spark, paper)
    assert [(s, n, a, f) for _, s, n, a, f, _ in got] == [(0, 1, "c", "plain"), (1, 2, "b", "match"), (2, 7, None, "plain"), (4, 12, "e", "plain")]
    assert got[1][-1] == match.strip()  # numbered items within stay, furniture and outer blanks go
    assert got[0][-1] == block(1).strip()


def test_an_english_twin_is_skipped_where_the_rest_is_mostly_another_script(spark):
    twin = "7. An English twin with very many long and needless words that outweigh every letter of the other script by far and without end\n(A) one\n(B) two\n"
    paper = "".join(twin + block(i) + "Answer – (A)\n" for i in range(1, 6))
    assert [(r[2], r[3]) for r in parsed(spark, paper)] == [(i, "a") for i in range(1, 6)]


def test_papers_without_a_key_are_cut_where_a_block_is_complete(spark):
    paper = block(1) + block(2, extra="1. पहला\n2. दूसरा\n") + block(3, options="AB") + "4. यह पंक्ति अधूरे खण्ड में रहती है\n" + block(5)
    assert [(r[2], r[3]) for r in parsed(spark, paper)] == [(1, None), (2, None), (3, None)]
    assert parsed(spark, None, "", "1. x\n(a) y\n(b) z", block(1, options="A")) == []
    assert [r[2] for r in parsed(spark, block(1).replace("\n", "\r\n") + block(2).replace("\n", "\u2028"))] == [1, 2]


def test_options_by_marker(spark):
    said = {
        "Stem (a) x\t\t(b) y\n(c) z     (d) w": ("Stem", ["x", "y", "z", "w"]), "S ;इ) b ;क) d": ("S", ["b", "d"]), "S (B) b (A) a (b) again": ("S", ["a", "b"]),
        "no marker ": ("no marker", []), "S (a) (a) second": ("S", ["second"]), "S ¼a½ one ¼ B ½ two C½ three": ("S", ["one", "two", "three"]), "": ("", []),
    }
    df = spark.createDataFrame(list(enumerate(said)), "i int, t string").select("i", papers.options_of(F.col("t")).alias("q"))
    assert [(r["q"]["stem"], r["q"]["options"]) for r in df.orderBy("i").collect()] == list(said.values())


def flat(text):
    return " ".join(text.split())


def test_headings_and_sections(spark):
    book = "intro  text\n\n# First\t topic \nbody of\n the first\n## अध्याय 3\n###Second\n" + "#" + "x" * 95 + "\n  more  body\n#\n\n Third\nlast words " + "z" * 200
    heads = spark.createDataFrame([(book,), ("",), (None,), ("# at once\nx",)], "t string").select(papers.headings(F.col("t")).alias("h")).collect()
    assert [tuple(h) for h in heads[0]["h"]] == [(len(flat(book[: book.index(m)])), n, t) for m, n, t in (("# First", 1, "First topic"), ("###Second", 3, "Second"), ("#\n\n Third", 1, "Third"))]
    assert [len(h["h"]) for h in heads[1:]] == [0, 0, 1] and heads[3]["h"][0]["place"] == 0
    passages = [(1, 0, "intro text # First"), (1, 1, "body\nof the   first"), (1, 2, "more body"), (1, 3, "last words " + "z" * 139 + "another end"), (1, 4, "nowhere"), (2, 0, "no book"), (1, 5, "last words " + "z" * 120 + "another end")]
    got = papers.sections(spark.createDataFrame(passages, "book int, nth int, p string"), spark.createDataFrame([(1, book)], "book int, src string"), "book", "nth", "p", "src")
    want = {}
    for b, n, p in passages:
        at = flat(book).find(flat(p)[:150]) if b == 1 else -1
        want[b, n] = (at, None if at < 0 else [None, "First topic", "Second", "Third"][sum(x <= at for x in (len(flat(book[: book.index(m)])) for m in ("# First", "###Second", "#\n\n Third")))])
    assert {(r["book"], r["nth"]): (r["place"], r["section"]) for r in got.collect()} == want
    assert want[1, 3][0] > 0 and want[1, 5][0] == -1 and want[1, 1][1] == "First topic"


def test_lexical_search_in_any_script(spark):
    docs = [(1, "गंगा नदी भारत की नदी है"), (2, "भारत की राजधानी"), (3, "Ganga river, RIVER ganga"), (4, None), (5, ""), (6, "नदी")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    queries = spark.createDataFrame([(1, "नदी भारत"), (2, "river Ganga ganga"), (3, "नदी unknown"), (4, ""), (5, "की")], "q int, text string")
    terms = search.query_terms(queries, "q", F.col("text"))
    want = {(1, 1): 3 / math.sqrt(6), (2, 3): 4 / 2, (5, 1): 1 / math.sqrt(6), (5, 2): 1 / math.sqrt(3)}
    for index in (search.inverted_index(df, "doc_id", "text"), search.inverted_index(df, "doc_id", "text", terms)):
        got = {(r["q"], r["doc_id"]): r["score"] for r in search.lexical_search(index, "doc_id", terms, "q", 5).collect()}
        assert got == {k: pytest.approx(v, abs=1e-6) for k, v in want.items()}
        best = search.lexical_search(index, "doc_id", terms, "q", 1).collect()
        assert sorted((r["q"], r["doc_id"], r["rank"]) for r in best) == [(1, 1, 1), (2, 3, 1), (5, 2, 1)]


@pytest.mark.parametrize("seed", range(3))
def test_vector_blocks_are_the_whole_search(spark, monkeypatch, seed):
    for name, value in {"BLOCK": 7, "CORPUS_BLOCK": 11, "PART": 3}.items():
        monkeypatch.setattr(vectors, name, value)
    rng = random.Random(seed)
    data = [(i, [float(rng.randint(-2, 2)) for _ in range(4)]) for i in range(60)]
    e = spark.createDataFrame(data, "vec_id long, embedding array<double>").repartition(4)
    got = {}
    for r in vectors.cosine_topk(e.filter("vec_id % 2 = 0"), e, 5, threshold=0.3).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["similarity"]))
    norm = lambda v: math.sqrt(sum(x * x for x in v))
    for i, v in data[::2]:
        sims = [(-round(sum(a * b for a, b in zip(v, w, strict=True)) / (norm(v) * norm(w)), 6) if norm(v) and norm(w) else 0.0, j) for j, w in data if j != i]
        want = [(n, j, -s) for n, (s, j) in enumerate(sorted(sims)[:5], 1) if -s >= 0.3]
        assert sorted(got.get(i, [])) == want


@pytest.mark.parametrize("seed", range(4))
def test_acceptance_rounds_are_the_loop(spark, seed):
    rng = random.Random(seed)
    data = [("hot" if rng.random() < 0.6 else rng.choice("ab"), i, rng.choice([None, *range(12)]), rng.randint(0, 15)) for i in rng.sample(range(1000), 150)]
    seen, want = set(), set()
    for g, i, a, b in sorted(data, key=lambda r: r[1]):
        keys = ({(g, "a", a)} if a is not None else set()) | {(g, "b", b)}
        if not keys & seen:
            seen |= keys
            want.add((g, i))
    df = spark.createDataFrame(data, "grp string, id long, key_a int, key_b int").repartition(5)
    assert {tuple(r) for r in folds.two_key_dedupe(df).collect()} == want


@pytest.mark.parametrize("seed", range(4))
def test_paper_guard_is_the_loop(spark, seed):
    rng = random.Random(seed)
    data = [(rng.choice(["p", "p", "q"]), i, rng.randint(0, 40), rng.choice([None, *map(str, range(40))]), rng.random() < 0.6, 12) for i in rng.sample(range(1000), 120)]
    want, stems, answers, numbers = {}, set(), set(), {}
    for p, i, stem, answer, numeric, planned in sorted(data, key=lambda r: r[1]):
        numeric = numeric and answer is not None
        reason = "duplicate_stem" if (p, stem) in stems else "repeated_answer" if answer is not None and (p, answer) in answers else "numeric_cap" if numeric and numbers.get(p, 0) >= max(1, math.ceil(planned * 0.2)) else None
        if reason is None:
            stems.add((p, stem))
            answers.add((p, answer))
            numbers[p] = numbers.get(p, 0) + numeric
        want[p, i] = reason
    df = spark.createDataFrame(data, "paper string, id long, stem int, answer string, numeric boolean, planned int").repartition(5)
    assert {(r["paper"], r["id"]): r["reason"] for r in folds.paper_guard(df).collect()} == want
    assert set(want.values()) == {None, "duplicate_stem", "repeated_answer", "numeric_cap"}


@pytest.mark.parametrize("seed", range(4))
def test_chunks_across_blocks_are_the_loop(spark, monkeypatch, seed):
    monkeypatch.setattr(folds, "BLOCK", 8)
    rng = random.Random(seed)
    data = [("hot" if rng.random() < 0.8 else rng.choice("ab"), i, rng.randint(0, 60)) for i in rng.sample(range(1000), 130)]
    want, state = {}, {}
    for g, i, size in sorted(data, key=lambda r: r[1]):
        chunk, total, n = state.get(g, (0, 0, 0))
        if n and (total + size > 90 or n >= 5):
            chunk, total, n = chunk + 1, 0, 0
        state[g] = chunk, total + size, n + 1
        want[g, i] = chunk
    df = spark.createDataFrame(data, "grp string, id long, size long").repartition(5)
    assert {(r["grp"], r["id"]): r["chunk"] for r in folds.budget_chunks(df, 90, 5).collect()} == want


@pytest.mark.parametrize("by", [[], ["g"]])
def test_short_texts_are_found_by_their_parts(spark, by):
    from kiteloom.operators import joins

    rng = random.Random(7)
    data = [(rng.choice("xy"), i, "".join(rng.choice("ab ") for _ in range(rng.choice([0, 1, 2, 3, 5, 7, 8, 12, 30])))) for i in range(120)]
    want = []
    for g, i, t in data:
        if not any(j < i and t in u and (not by or h == g) for h, j, u in data):
            want.append((g, i))
    df = spark.createDataFrame(data, "g string, i int, t string").repartition(4)
    got = joins.not_contained(df, by, "i", "t").select("g", "i").collect()
    assert sorted(tuple(r) for r in got) == sorted(want)
    assert 3 < len(want) < 100
