"""Gates, builders, puzzles, planning axes, codings and timers: golden values, loops and replays."""

from __future__ import annotations

import collections
import datetime
import itertools
import random

import pytest
from pyspark.sql import functions as F

from kiteloom.functions import legacy, texts
from kiteloom.operators import gates, planning, puzzles, sequences, state
from kiteloom.sources import files, sinks
from kiteloom.streaming import events, timers

QUESTION = "stem string, options array<string>, answer string, format string, reason string, statements array<string>, match array<array<string>>"
FINE = {"stem": "भारत का सबसे बड़ा राज्य कौन सा है", "options": ["राजस्थान", "बिहार", "केरल", "पंजाब"], "answer": "a", "format": "plain", "reason": "क्षेत्रफल", "statements": None, "match": None}
PAIRS = [["a. क", "1. राम"], ["b. ख", "2. श्याम"], ["c. ग", "3. मोहन"], ["d. घ", "4. सोहन"]]


def gated(spark, *changes: dict) -> list:
    names = list(FINE)
    df = spark.createDataFrame([tuple((FINE | c)[n] for n in names) for c in changes], QUESTION).withColumn("i", F.monotonically_increasing_id())
    got = df.coalesce(1).select("i", gates.question_gate(*map(F.col, ("stem", "options", "answer", "format", "reason", "statements", "match"))).alias("r"))
    return [r["r"] for r in got.orderBy("i").collect()]


def test_question_gate_rule_by_rule(spark):
    stem = FINE["stem"]
    told = [
        ({}, None), ({"stem": None}, "short_stem"), ({"stem": "  छोटा प्रश्न  "}, "short_stem"), ({"stem": stem + " पाठ में"}, "cites_material"), ({"reason": "दी गई तालिका"}, "cites_material"),
        ({"stem": "Which of these is the largest"}, "not_in_script"), ({"options": None}, "option_count"), ({"options": ["क", "ख", "ग"]}, "option_count"), ({"options": ["राज", " ", "केरल", "पंजाब"]}, "blank_option"),
        ({"options": ["Ab  c", "ab C", "केरल", "पंजाब"]}, "repeated_option"), ({"reason": "यह क्ा है"}, "garbled"), ({"stem": stem + " उत्तarakhand"}, "mixed_script"), ({"answer": "e"}, "answer_letter"), ({"answer": "B"}, None),
        ({"options": ["1857", "बिहार", "केरल", "पंजाब"]}, "odd_option"), ({"options": ["1857", "12", "केरल", "पंजाब"]}, "odd_option"), ({"options": ["17.98 मीटर", "12", "केरल", "पंजाब"]}, None), ({"options": ["1857", "1858", "केरल", "पंजाब"]}, None),
        ({"format": "match"}, "match_rows"), ({"format": "match", "match": PAIRS}, None), ({"format": "match", "match": [*PAIRS[:3], ["d. घ", "4. 1857"]]}, "odd_match"), ({"format": "order"}, "no_statements"), ({"format": "order", "statements": ["पहला"]}, None),
        ({"stem": stem + " 7370 में"}, "implausible_year"), ({"stem": stem + " 4000 ई० पू० में"}, None), ({"options": ["1857", "1858", "0599", "3026"]}, "implausible_year"), ({"stem": stem + " 12345"}, None),
    ]
    assert gated(spark, *[c for c, _ in told]) == [r for _, r in told]


def test_extraction_gate_and_signatures(spark):
    rows = [
        ("लंबा प्रश्न है", ["एक", "दो", "तीन", "चार"], None), ("छोटा", ["एक", "दो", "तीन", "चार"], "short_stem"), ("a logo and an image here", ["एक", "दो", "तीन", "चार"], "cover_page"), ("only one logo here", ["8", "24", "40", "ब"], None),
        ("लंबा प्रश्न है", None, "no_options"), ("लंबा प्रश्न है", ["एक", "दो"], "option_count"), ("लंबा प्रश्न है", ["एक", "", "तीन", "चार"], "blank_option"), ("लंबा प्रश्न है", ["(a)", "(b)", "(c)", "(d)"], "placeholders"),
        ("लंबा प्रश्न है", ["ब", "फ", "व", "म"], None), ("लंबा प्रश्न है", ["एक", "(ब)", "[क]", "चार"], "label_letter"), ("लंबा प्रश्न है", ["एक", "एक ", "तीन", "चार"], "repeated_option"), ("लंबा प्रश्न है", ["a.", "a", "b", "c"], "placeholders"),
    ]
    df = spark.createDataFrame([(i, s, o) for i, (s, o, _) in enumerate(rows)], "i int, s string, o array<string>")
    got = df.select("i", gates.extraction_gate(F.col("s"), F.col("o")).alias("r")).orderBy("i").collect()
    assert [r["r"] for r in got] == [r for _, _, r in rows]
    said = {"क्ा": "halant_vowel", "क््त": "double_halant", "क॑": "vedic_accent", "<क": "angle_bracket_dev", "क ा": "orphan_matra", "ठीक है": None, "": None}
    df = spark.createDataFrame(list(enumerate(said)), "i int, t string").select("i", gates.signature(F.col("t")).alias("s")).orderBy("i")
    assert [r["s"] for r in df.collect()] == list(said.values())


def test_answers_are_marked_only_if_grounded(spark):
    options = ["गंगा नदी", "यमुना", "कावेरी"]
    rows = [("high", "a", "गंगा नदी हिमालय से निकलती है", ("a", "गंगा नदी हिमालय से निकलती है")), ("HIGH", " B ", "यमुना।", ("b", "")), ("high", "d", "कुछ भी", None), ("low", "a", "सच है यह", None), ("high", "a", "", None), ("high", "a", "यह उल्लेख नहीं", None), ("high", "c", "यह book में लिखा है", ("c", "")), (None, "a", "x", None)]
    df = spark.createDataFrame([(i, c, a, s, options) for i, (c, a, s, _) in enumerate(rows)], "i int, c string, a string, s string, o array<string>")
    got = df.select("i", gates.grounded_answer(F.col("c"), F.col("a"), F.col("s"), F.col("o"), ["Book में"]).alias("m")).orderBy("i").collect()
    assert [r["m"] and tuple(r["m"]) for r in got] == [r[-1] for r in rows]
    df = spark.createDataFrame([(0, True, ["x", "y"], "medium"), (1, True, ["x"], "high"), (2, True, ["x", "y"], "low"), (3, False, ["x", "y"], "high"), (4, True, None, None)], "i int, g boolean, s array<string>, c string")
    assert [r["v"] for r in df.select("i", gates.verdict(F.col("g"), F.col("s"), F.col("c")).alias("v")).orderBy("i").collect()] == ["confirmed", "weak", "weak", "failed", "weak"]


def test_built_questions_hold_their_answer(spark):
    seeds = spark.range(60).select(F.col("id").cast("string").alias("seed"))
    items = F.array(*map(F.lit, ("एक", "दो  ", "तीन", "चार")))
    order = seeds.select("seed", gates.build_order(items, F.col("seed")).alias("b")).collect()
    for r in order:
        b = r["b"]
        shown = [s.split(". ", 1)[1] for s in b["statements"]]
        right = ", ".join(str(shown.index(x) + 1) for x in ("एक", "दो", "तीन", "चार"))
        assert b["error"] is None and b["options"]["abcd".index(b["answer"])] == right and len(set(b["options"])) == 4
    assert len({r["b"]["answer"] for r in order}) == 4 and len({tuple(r["b"]["statements"]) for r in order}) > 10
    for r in seeds.select(gates.build_match(F.array(*map(F.lit, "wxyz")), items, F.col("seed")).alias("b")).collect():
        lefts, rights = zip(*(s.split(" | ") for s in r["b"]["statements"]), strict=True)
        shown = [x.split(". ", 1)[1] for x in rights]
        assert [x[3:] for x in lefts] == list("wxyz")
        assert r["b"]["options"]["abcd".index(r["b"]["answer"])] == "  ".join(str(shown.index(x) + 1) for x in ("एक", "दो", "तीन", "चार"))
    plain = seeds.select(gates.build_plain(F.array(*map(F.lit, ("(c) क", "ख", "a) ग", "d."))), F.lit(2), F.col("seed")).alias("b")).collect()
    assert all(sorted(r["b"]["options"]) == sorted(["क", "ख", "ग", "d."]) and r["b"]["options"]["abcd".index(r["b"]["answer"])] == "ग" for r in plain)
    for n, true, label in ((2, [1], "केवल 2"), (3, [2, 0, 9], "केवल 1 और 3"), (3, [0], "केवल 1")):
        said = F.array(*[F.lit(f"कथन {i}") for i in range(n)])
        for r in seeds.select(gates.build_statement(said, F.array(*map(F.lit, true)), F.col("seed")).alias("b")).collect():
            assert len(set(r["b"]["options"])) == 4 and r["b"]["options"]["abcd".index(r["b"]["answer"])] == label
    one = lambda c: spark.range(1).select(c.alias("b")).first()["b"]
    assert one(gates.build_statement(F.array(F.lit("x"), F.lit("y")), F.array(F.lit(0), F.lit(1)), F.lit("s")))["error"] == "all_or_none_true"
    assert one(gates.build_order(F.array(*map(F.lit, "aabc")), F.lit("s")))["error"] == "repeated_item"
    told = one(gates.build_assertion(F.lit("वर्षा होती है"), F.lit("बादल बनते हैं"), F.lit("a-true-r-false")))
    assert (told["answer"], told["error"], told["options"]) == ("c", None, list(gates.RELATIONS.values()))
    assert one(gates.build_assertion(F.lit("A b"), F.lit("a  B"), F.lit("a-true-r-false")))["error"] == "same_claim"


def test_ciphers_by_hand(spark):
    df = spark.createDataFrame([(0, "Ab-z", "shift", 3), (1, "Ab-z", "reverse", 3), (2, "Ab-z", "double", 3), (3, "Ab-z", "reverse_shift", 3), (4, "x", "other", 1), (5, "", "shift", 1)], "i int, w string, r string, k int")
    v = puzzles.cipher_values(F.col("w"), F.col("r"), F.col("k"))
    got = df.select("i", puzzles.cipher_code(v, F.lit("sequence")).alias("a"), puzzles.cipher_code(v, F.lit("sum")).alias("b")).orderBy("i").collect()
    assert [tuple(r)[1:] for r in got] == [("4-5-29", "38"), ("26-25-1", "52"), ("2-4-52", "58"), ("29-28-4", "61"), (None, None), ("", "0")]


def layouts(points, span, clues, asked):
    found = []
    for at in itertools.permutations(range(span + 1), points):
        if min(at) or max(at) != span:
            continue
        gap = lambda x, y: abs(at[x] - at[y])  # noqa: B023, E731
        if all(gap(c[1], c[2]) == c[5] if c[0] == "dist" else min(at[c[2]], at[c[3]]) < at[c[1]] < max(at[c[2]], at[c[3]]) if c[0] == "between" else gap(c[1], c[2]) == gap(c[3], c[4]) + c[5] for c in clues):
            found.append(gap(*asked))
    return (len(found), found[0] if len(set(found)) == 1 else None) if found else None


def test_arrangements_on_six_seats_against_all_layouts(spark):
    rng = random.Random(3)
    data, want = [], {}
    for i in range(30):
        points = rng.choice([2, 4, 5, 6])
        at = [0, *sorted(rng.sample(range(1, 7), points - 1))]
        rng.shuffle(at)
        span = max(at)
        clues = []
        for _ in range(rng.randint(1, 5)):
            a, b = rng.sample(range(points), 2)
            clues.append(("dist", a, b, None, None, abs(at[a] - at[b])))
            if points > 3:
                m, x, y = sorted(rng.sample(range(points), 3), key=lambda p: at[p])
                clues.append(("between", m, x, y, None, None))
                a, b, c, e = rng.sample(range(points), 4)
                clues.append(("more", a, b, c, e, abs(at[a] - at[b]) - abs(at[c] - at[e])))
        asked = rng.sample(range(points), 2)
        data.append((i, points, span, clues, asked))
        if (found := layouts(points, span, clues, asked)) is not None:
            want[i] = found
    data.append((99, 3, 4, [("dist", 0, 5, None, None, 1)], [0, 1]))  # a clue about a point that isn't there
    df = spark.createDataFrame(data, f"id int, points int, span int, clues array<{puzzles.CLUE}>, asked array<int>").repartition(4)
    assert {r["id"]: (r["layouts"], r["answer"]) for r in puzzles.arrangement_answers(df, "id").collect()} == want
    assert len({v[1] is None for v in want.values()}) == 2


def test_two_axes_keep_both_margins(spark):
    plans = spark.createDataFrame([("a", 10), ("b", 7), ("c", 0)], "p string, count int")
    first = spark.createDataFrame([("a", "x", 4), ("a", "y", 3), ("b", "x", 9), ("b", "y", 1)], "p string, key string, n int")
    second = spark.createDataFrame([("a", "easy", 5), ("a", "hard", 5), ("b", "easy", 4), ("b", "hard", 3)], "p string, key string, n int")
    got = planning.two_axes(plans, "p", first, second, "count", "plain", 1).collect()
    for p, want in (("a", {"x": 4, "y": 3, "plain": 3}), ("b", {"x": 7})):
        rows = sorted((r["place"], r["first"], r["second"]) for r in got if r["p"] == p)
        assert [r[0] for r in rows] == list(range(1, len(rows) + 1))
        assert collections.Counter(r[1] for r in rows) == want
        assert collections.Counter(r[2] for r in rows) == ({"easy": 5, "hard": 5} if p == "a" else {"easy": 4, "hard": 3})
    mixed = sequences.rounds(spark.createDataFrame([(i, ["a", "b", "c"]) for i in range(40)] + [(99, ["z"])], "g int, t array<string>"), "g", "t", 20, 5).collect()
    for g in range(40):
        order = [r["type"] for r in sorted(mixed, key=lambda r: r["place"]) if r["g"] == g]
        assert len(order) == 20 and all(a != b for a, b in zip(order, order[1:], strict=False)) and all(sorted(order[i : i + 3]) == ["a", "b", "c"] for i in range(0, 18, 3))


def test_legacy_signs_are_moved_both_ways(spark):
    pairs = [("क", "d"), ("ष", "k"), ("त", "r"), ("म", "e"), ("श", "s"), ("ा", "h"), ("ी", "w")]
    said = {"कि": "fd", "क्षि": "fd्k", "कर्मा": "dehZ", "शर्मी": "sewZ", "तर्क": "rdZ", "": "", "कत": "dr"}
    df = spark.createDataFrame(list(enumerate(said)), "i int, t string").withColumn("c", legacy.encode(F.col("t"), pairs, "f", "Z"))
    got = df.select("i", "c", legacy.decode(F.col("c"), pairs, "f", "Z").alias("b")).orderBy("i").collect()
    assert [(r["b"], r["c"]) for r in got] == list(said.items())
    df = spark.range(1).select(legacy.decode(F.lit("Ed"), pairs, "f", "Z", ligatures=[("E", "fZ")]).alias("v"))
    assert df.first()["v"] is not None
    longest = spark.range(1).select(legacy.encode(F.lit("abc"), [("a", "1"), ("ab", "2")]).alias("x"), legacy.encode(F.lit("abc"), [("a", "1"), ("ab", "2")], longest_first=False).alias("y")).first()
    assert tuple(longest) == ("2c", "1bc")


def test_mixes_phones_dates_and_keys(spark):
    mixes = {"a:1,b:3": {"a": 0.25, "b": 0.75}, " a :1, a:3": {"a": 1.0}, "a:-1,b:2": {"a": -1.0, "b": 2.0}, "a:1,b": None, "a:1:2": None, "a:x": None, "a:0": None, "": None}
    df = spark.createDataFrame(list(enumerate(mixes)), "i int, t string").select("i", planning.parse_mix(F.col("t")).alias("m")).orderBy("i")
    assert [r["m"] for r in df.collect()] == list(mixes.values())
    one = lambda c: spark.range(1).select(c.alias("v")).first()["v"]
    day = F.lit("2024-01-01").cast("date")
    assert one(texts.next_action(F.lit("loom_sent"), day, F.lit(False))) == datetime.date(2024, 1, 8)
    assert one(texts.next_action(F.lit("loom_sent"), day, F.lit(True))) is None and one(texts.next_action(F.lit("commented"), day, F.lit(True))) == datetime.date(2024, 1, 3)
    assert one(texts.next_action(F.lit("won"), day, F.lit(False))) is None
    assert one(texts.profile_name(F.lit("http://x/in/0a1b2c3d4e"))) == "0a1b2c3d4e" and one(texts.profile_name(F.lit("http://x/ann"))) == ""
    assert one(texts.safe_correction(F.lit("अनुछेद 14 OSI"), F.lit("अनुच्छेद 14 osi"))) and not one(texts.safe_correction(F.lit("धारा 14"), F.lit("धारा 15")))
    assert one(texts.question_key(F.lit("What, is  this?"), F.array(F.lit("-"), F.lit("The Answer")))) == "what is this||the answer" and one(texts.question_key(F.lit("?"), F.array(F.lit("x")))) is None


def test_job_lifecycle_never_falls_and_ends_once(spark):
    steps = [("queued", None, None), ("RUNNING", "extract", None), ("RUNNING", "other", 5), ("RUNNING", "Review", None), ("RUNNING", None, 120), ("FAILED", None, None), ("DONE", None, None)]
    df = spark.createDataFrame([("j", i, *s) for i, s in enumerate(steps)], "job string, at int, status string, stage string, progress int")
    got = state.job_lifecycle(df, "job", ["at"], "at").orderBy("at").collect()
    assert [(r["progress"], r["finished_at"]) for r in got] == [(0, None), (10, None), (10, None), (55, None), (100, None), (100, 5), (100, 5)]


def test_files_read_back(spark, tmp_path):
    rules = spark.createDataFrame([(1, "a:\n  - ' X Y '\n# c\n\n  - Z # tail\nb:\n- \"q\"")], "k int, t string")
    assert sorted(tuple(r) for r in files.rule_terms(rules, "k", "t").collect()) == [(1, "a", "x y"), (1, "a", "z"), (1, "b", "q")]
    with pytest.raises(Exception, match="not a list of terms"):
        files.rule_terms(spark.createDataFrame([(1, "a: 5")], "k int, t string"), "k", "t").collect()
    sinks.write_json_arrays(spark.range(25), f"{tmp_path}/a", size=10)
    assert files.read_json_arrays(spark, [f"{tmp_path}/a", f"{tmp_path}/a"], "id long").groupBy("input_no").agg(F.sum("id")).orderBy("input_no").collect() == [(0, 300), (1, 300)]
    sent = spark.sparkContext.accumulator(0)
    pages = spark.sparkContext.accumulator(0)

    def send(page):
        sent.add(len(page))
        pages.add(1)
        assert len(page) <= 7

    sinks.write_pages(spark.range(0, 40, 1, 3), send, 7)
    assert sent.value == 40 and pages.value >= 6


EVENTS = "event_id long, user_id long, event_type string, ts timestamp"


def fed(spark, tmp_path, rows, files_of: int):
    """A stream over the rows in order, dealt to so many files, one a trigger."""
    folder = f"{tmp_path}/in{files_of}"
    size = -(-len(rows) // files_of)
    for i in range(0, len(rows), size):
        spark.createDataFrame(rows[i : i + size], EVENTS).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(folder)


def test_timers_equal_the_loop_however_triggers_are_cut(spark, tmp_path):
    rng = random.Random(1)
    start = datetime.datetime(2024, 1, 1)
    rows = sorted(((i, rng.randint(1, 4), "signup", start + datetime.timedelta(minutes=rng.randint(0, 60 * 24 * 9))) for i in range(40)), key=lambda r: r[3])
    water = rows[-1][3] - datetime.timedelta(hours=1)
    beats, runs = set(), set()
    for user in range(1, 5):
        own = [r[3] for r in rows if r[1] == user and r[3] <= water]
        for n, at in enumerate(own):
            until = min([water, *own[n + 1 : n + 2]])
            beats |= {(user, at, k, at + datetime.timedelta(days=k)) for k in (1, 2, 3) if at + datetime.timedelta(days=k) <= until}
        run = []
        for at in own:
            if run and at - run[-1] >= datetime.timedelta(hours=30):
                runs.add((user, run[0], run[-1], len(run)))
                run = []
            run.append(at)
        if run and run[-1] + datetime.timedelta(hours=30) <= water:
            runs.add((user, run[0], run[-1], len(run)))
    assert len(beats) > 10 and len(runs) > 3
    for cut in (1, 5):
        stream = fed(spark, tmp_path, rows, cut)
        progress: list = []
        got = events.drain(timers.follow_up_beat(stream, "1 hour"), f"{tmp_path}/beat{cut}", timers=True, progress=progress)
        assert {(r["user_id"], r["replied_at"], r["nth"], r["sent_at"]) for r in got.collect()} == beats
        assert events.late_rows(progress) == 0
        got = events.drain(timers.reap_stuck(stream, "1 hour", 30 * 3_600_000), f"{tmp_path}/reap{cut}", timers=True)
        assert {(r["user_id"], r["started_at"], r["last_at"], r["rows"]) for r in got.collect()} == runs


def test_a_replayed_trigger_changes_nothing(spark, tmp_path):
    sink = events.KeyedSink(f"{tmp_path}/t", ["k"])
    batch = lambda *rows: spark.createDataFrame(rows, "k int, v int")
    one, two = batch((1, 1), (2, 2)), batch((2, 20), (3, 30))
    want = [(1, 1), (2, 20), (3, 30)]
    sink.write(one, 0)
    sink.write(two, 1)
    assert sorted(tuple(r) for r in sink.read(spark).collect()) == want
    sink.write(two, 1)
    sink.write(one, 0)  # an old trigger, late
    assert sorted(tuple(r) for r in sink.read(spark).collect()) == want
    small = sink.compact(spark, f"{tmp_path}/c")
    small.write(batch((1, 5)), 2)
    assert sorted(tuple(r) for r in small.read(spark).collect()) == [(1, 5), (2, 20), (3, 30)]


def test_blocks_are_the_slot_by_slot_draw(spark, monkeypatch):
    from kiteloom.operators import generators

    monkeypatch.setattr(generators, "WORDS", ("RIVER", "STONE"))  # few stems, so that slots collide
    blocks = generators.question_blocks(spark.range(3).select(F.col("id").alias("seed")), 120).collect()
    again = generators.question_blocks(spark.range(3).select(F.col("id").alias("seed")).repartition(3), 120).collect()
    assert sorted(map(tuple, blocks)) == sorted(map(tuple, again))
    for seed in range(3):
        own = [r for r in blocks if r["seed"] == seed]
        assert len({r["stem"] for r in own}) == len(own) == len({r["slot"] for r in own})
        spread = collections.Counter(r["type"] for r in own)
        assert set(spread) == set(generators.TYPES) and min(spread.values()) >= 3 and spread["letter_sum"] <= 4
        assert spread["series"] == 15 and len(own) < 120  # pairs of two words run out
        for r in own:
            stem, answer = r["stem"], r["answer"]
            if r["type"] == "letter_sum":
                a, b = stem.removeprefix("sum of letters of ").split(" and ")
                assert answer == str(sum(ord(c) - 64 for c in a + b))
            if r["type"] == "clock":
                m = int(stem.split(" of ")[1].split()[0])
                assert answer == str((720 - m) % 720 if stem.startswith("water") else (360 - m) % 720)
            if r["type"] == "direction":
                x = y = 0
                for d, n in (leg.split() for leg in stem.removeprefix("walk ").split(", ")):
                    x, y = x + {"E": 1, "W": -1}.get(d, 0) * int(n), y + {"N": 1, "S": -1}.get(d, 0) * int(n)
                assert abs(float(answer) - round((x * x + y * y) ** 0.5, 2)) < 0.011
            if r["type"] == "figures":
                assert answer in ("1-3", "1-4", "2-3", "2-4")


def test_restoring_swaps_by_trying(spark):
    start = F.array(*map(F.lit, "cstp"))
    truth = puzzles.turned_series(start, F.lit(True), 5)
    got = spark.range(1).select(truth.alias("t"), puzzles.restoring_swaps(puzzles.exchanged(truth, F.lit(1), F.lit(3)), truth).alias("one"), puzzles.restoring_swaps(truth, truth).alias("same")).first()
    assert ["".join(q) for q in got["t"]] == ["cstp", "spct", "ptsc", "tcps", "cstp"]
    assert [tuple(p) for p in got["one"]] == [(1, 3)] and [tuple(p) for p in got["same"]] == [(0, 4)]
