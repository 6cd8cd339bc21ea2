"""Operators against plain models, edge cases, and changed partitionings."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from kiteloom.functions import legacy, texts
from kiteloom.operators import aggregates, filters, folds, joins, planning, sequences, state, vectors
from kiteloom.plans.registry import queries
from kiteloom.sources import files, sinks


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("seed", range(5))
def test_clamped_sum_is_the_step_by_step_clamp(spark, seed):
    rng = random.Random(seed)
    data = [(k % 3, i, rng.randint(-4, 4)) for i, k in enumerate(range(60))]
    want, level = [], {}
    for k, i, d in data:
        level[k] = max(0, level.get(k, 0) + d)
        want.append((i, level[k]))
    df = spark.createDataFrame(data, "k int, i int, d int").repartition(7)
    assert rows(sequences.clamped_running_sum(df, ["k"], ["i"], "d").select("i", "value")) == sorted(want)


@pytest.mark.parametrize("seed", range(5))
def test_pack_fold_is_the_loop(spark, seed):
    rng = random.Random(seed)
    sizes = [rng.randint(30, 900) for _ in range(40)]
    want, cur, g = [], 0, 0
    for s in sizes:
        if cur and cur + s > 1600:
            g, cur = g + 1, 0
        want.append(g)
        cur += s
        if cur >= 800:
            g, cur = g + 1, 0
    got = one(spark, sequences.pack_fold(F.array(*[F.lit(s).cast("long") for s in sizes]), 1600, 800))
    assert got == want


def test_folded_runs(spark):
    labels = "a b b c c c d e e".split()
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(labels)], "k int, i int, x string")
    found = sequences.folded_runs(sequences.runs(df, ["k"], ["i"], "x"), ["k"], "x")
    assert [r["kept_label"] for r in found.orderBy("run").collect()] == ["a", "b", "c", "c", "e"]


@pytest.mark.parametrize("seed", range(4))
def test_containment_is_the_nested_loop(spark, seed):
    rng = random.Random(seed)
    base = "".join(rng.choice("ab ") for _ in range(60))
    data = []
    for i in range(40):
        a = rng.randrange(50)
        data.append((i % 2, i, base[a : a + rng.randint(1, 25)]))
    want = [(g, i) for g, i, t in data if not any(h == g and j < i and t in u for h, j, u in data)]
    df = spark.createDataFrame(data, "g int, i int, t string").repartition(5)
    assert rows(joins.not_contained(df, ["g"], "i", "t").select("g", "i")) == sorted(want)


def test_containment_reads_whole_long_texts(spark, tmp_path):
    rng = random.Random(3)
    data = []
    for g in range(5):
        base = " ".join("".join(rng.choice("abcdéक") for _ in range(rng.randint(1, 7))) for _ in range(200))
        for i in range(20):
            a, n = rng.randrange(700), rng.choice([3, 12, 22, 23, 24, 60, 300])
            data.append((g, i, "same " + base if i == 3 else base[a : a + n].upper().replace(" ", " \n\t")))
        data.append((g, 20, "same start and another end"))
        data.append((g, 21, " \n"))
    tidy = [(g, i, " ".join(t.split()).lower()) for g, i, t in data]
    want = [(g, i) for g, i, t in tidy if t and not any(h == g and j < i and t in u for h, j, u in tidy)]
    spark.createDataFrame(data, "conv_id long, turn long, text string").repartition(4).write.parquet(f"{tmp_path}/conversations.parquet")
    assert rows(queries()["jn11_whole_texts"](spark, str(tmp_path))) == sorted(want)
    assert {(g, 20) for g in range(5)} <= set(want) and len(want) < len(data) - 10


@pytest.mark.parametrize("seed", range(4))
def test_asof_takes_the_last_mark_at_or_before(spark, seed):
    rng = random.Random(seed)
    marks = [(rng.randint(0, 2), rng.randint(0, 30), i) for i in range(25)]
    left = [(i, rng.randint(0, 3), rng.randint(0, 30)) for i in range(40)]
    want = []
    for i, g, t in left:
        seen = [(at, m) for h, at, m in marks if h == g and at <= t]
        want.append((i, max(seen)[1] if seen else -1))
    l = spark.createDataFrame(left, "i int, g int, t int")
    m = spark.createDataFrame(marks, "g int, t int, mark int")
    got = joins.asof_backward(l, m, ["g"], "t", "t", ["mark"], "mark").select("i", F.coalesce("mark", F.lit(-1)))
    assert rows(got) == sorted(want)


def test_new_rows_keep_repeats_within_the_batch_and_first_rows_do_not(spark):
    batch = spark.createDataFrame([(1, "A@x"), (2, "a@x "), (3, "b@x"), (4, "")], "i int, mail string")
    known = spark.createDataFrame([("B@X",)], "mail string")
    key = F.lower(F.trim("mail"))
    assert [r[0] for r in rows(joins.new_rows(batch, known, key, key).select("i"))] == [1, 2, 4]
    assert [r[0] for r in rows(joins.new_first_rows(batch, known, key, key, ["i"]).select("i"))] == [1, 4]
    assert joins.new_rows(batch.limit(0), known, key, key).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_largest_remainder_sums_to_the_total(spark, seed):
    rng = random.Random(seed)
    data = [(g, f"k{i}", rng.choice([1, 1, 2, 5, 7])) for g in range(4) for i in range(6)]
    df = spark.createDataFrame(data, "g int, k string, share int")
    got = planning.largest_remainder(df, ["g"], "k", "share", F.lit(17)).collect()
    for g in range(4):
        own = {k: s for h, k, s in data if h == g}
        total = sum(own.values())
        base = {k: 17 * s // total for k, s in own.items()}
        spare = sorted(own, key=lambda k: (-round(17 * own[k] / total - base[k], 9), -own[k], k))[: 17 - sum(base.values())]
        assert {r["k"]: r["n"] for r in got if r["g"] == g} == {k: base[k] + (k in spare) for k in own}


def test_paper_guard_counts_accepted_rows_only(spark):
    data = [("p", 1, "s1", "5", 10), ("p", 2, "s1", "6", 10), ("p", 3, "s2", "6", 10), ("p", 4, "s3", "7", 10), ("p", 5, "s4", "x", 10), ("p", 6, "s5", "x", 10)]
    df = spark.createDataFrame(data, "paper string, id long, stem string, answer string, planned int").repartition(3)
    got = {r["id"]: r["reason"] for r in folds.paper_guard(df).collect()}
    assert got == {1: None, 2: "duplicate_stem", 3: None, 4: "numeric_cap", 5: None, 6: "repeated_answer"}


def test_interleave_never_repeats_a_kind_while_another_is_left(spark):
    df = spark.createDataFrame([("g", "a" if i < 5 else "b" if i < 8 else "c", i) for i in range(10)], "grp string, kind string, id long")
    kinds = dict(df.select("id", "kind").collect())
    order = [kinds[r["id"]] for r in folds.interleave(df).orderBy("place").collect()]
    assert len(order) == 10 and not any(a == b for a, b in zip(order, order[1:], strict=False))


def test_two_key_dedupe_is_the_loop(spark):
    data = [("g", 1, "a", "x"), ("g", 2, "a", "y"), ("g", 3, "b", "y"), ("g", 4, "c", "y"), ("h", 1, "a", "x")]
    df = spark.createDataFrame(data, "grp string, id long, key_a string, key_b string")
    assert rows(folds.two_key_dedupe(df)) == [("g", 1), ("g", 3), ("h", 1)]


def test_state_transitions(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, "e", 1)], "k int, v string, seq long")
    assert rows(state.upsert(base, new, ["k"], "seq")) == [(1, "a"), (2, "d"), (3, "e")]
    use = spark.createDataFrame([(i, None if i == 0 else i - 1, 1) for i in range(7)], "k int, used_ago int, use_count int")
    assert {r["k"]: r["used_ago"] for r in state.advance(use).collect()} == {0: None, 1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: None}
    assert state.mark_used(use, use.filter("k = 3"), "k").filter("k = 3").first()["use_count"] == 2


def test_vectors_with_zero_norms_ties_and_empty_tables(spark):
    data = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [0.0, 1.0]), (4, [1.0, 0.0])]
    e = spark.createDataFrame(data, "vec_id long, embedding array<float>").repartition(3)
    got = vectors.cosine_topk(e.filter("vec_id = 0"), e, 3)
    assert [(r["vec_id"], r["similarity"]) for r in got.orderBy("rank").collect()] == [(1, 1.0), (4, 1.0), (2, 0.0)]
    assert vectors.cosine_topk(e.filter("vec_id = 9"), e, 3).count() == 0
    assert vectors.cosine_topk(e.filter("vec_id = 0"), e.limit(0), 3).count() == 0


def test_medians_cut_and_blank_buckets(spark):
    df = spark.createDataFrame([("a", "1,000"), ("a", "2"), (" ", "7"), (None, "x")], "b string, v string")
    got = aggregates.bucket_medians(df, "b", texts.parse_int(F.col("v")))
    assert rows(got) == [("(none)", 7), ("a", 501)]


def test_text_functions(spark):
    lit = F.lit
    assert one(spark, texts.normalise(lit(" A  b\n"))) == "a b"
    assert one(spark, texts.sentences(lit("A b. C!\n\nd"))) == ["A b.", "C!", "d"]
    assert one(spark, texts.profile_name(lit("https://x/in/ann-lee-0a1b2c3d/"))) == "Ann Lee"
    assert one(spark, texts.mail_first_name(lit("jANE.doe9@x.y"))) == "Jane"
    assert one(spark, texts.video_id(lit("https://youtu.be/abcdefghijk?t=1"))) == "abcdefghijk"
    assert one(spark, texts.us_phone(lit("(212) 555-0100"))) == "+12125550100"
    assert one(spark, texts.row_numbers(lit("2,3,5-7"))) == [2, 3, 5, 6, 7]
    assert one(spark, texts.parse_int(lit(" 1,234.9 "))) == 1234
    assert one(spark, legacy.decode(legacy.encode(lit("für किताब é")))) == "für किताब é"
    assert one(spark, planning.same_calendar(lit(2021))) == 2027
    assert one(spark, planning.parse_mix(lit("a:1,b:x"))) is None


def test_first_rule_decides(spark):
    df = spark.createDataFrame([("Steel ADS", "", ""), ("steel", "spam", ""), ("wood", "", "tin"), ("wood", "", "")], "n string, d string, k string")
    got = filters.qualify(df, F.col("n"), F.col("d"), F.col("k"), ["ads"], ["spam"], [], ["tin", "steel"])
    assert [r["reason"] for r in got.collect()] == ["name_blacklist:ads", "desc_blacklist:spam", "whitelist:tin", "no_match"]


def test_files_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", None), ('q "x", y', "2")], "name string, n string")
    sinks.write_csv(df, str(tmp_path / "t"), ["n", "name", "extra"])
    back = files.read_csv(spark, str(tmp_path / "t"), ["name", "n", "missing"])
    assert {(r["name"], r["n"] or "") for r in back.collect()} == {("a", ""), ('q "x", y', "2")}
    assert files.read_csv(spark, str(tmp_path / "none"), ["name"]).count() == 0


def test_results_do_not_depend_on_partitioning(spark):
    df = spark.range(200).select((F.col("id") % 5).alias("g"), F.col("id").alias("i"), (F.col("id") * 7 % 3).alias("x"))
    got = [rows(sequences.runs(df.repartition(n), ["g"], ["i"], "x")) for n in (1, 7)]
    assert got[0] == got[1]
