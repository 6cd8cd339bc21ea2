"""Values worked out by hand for operators whose rules the test tables can't show."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from kiteloom.functions import texts
from kiteloom.operators import planning


def column(spark, values, f):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, text string").select("i", f(F.col("text")).alias("v")).collect()
    return [r["v"] for r in sorted(rows)]


def test_junk_classes_in_order(spark):
    options = "A. x B. y C) z D. w"
    said = {
        "write to a@gmail.com Q1. " + options: "promo", "All Rights Reserved": "promo", "हमारे  youtube": "promo", f"Q 12. what {options}": "mcq_dump", f"no number {options}": None,
        "Q1. A. x B. y": None, "Content  Page": "toc", "1-2 3 – 4 5-6 7-8": "toc", "1-2 3-4 5-6": None, "7370 में": "bad_year", "4000 ई० पू०": None, "4000 ई०": "bad_year",
        "(1200-4638)": "bad_year", "3999 में": None, "plain text": None, "": None,
    }
    assert column(spark, list(said), texts.junk_class) == list(said.values())
    assert column(spark, [None], texts.junk_class) == [None]


def test_formats_in_order(spark):
    said = {"सूची - I कथन (A)": "match", "अभिकथन": "assertion", "निम्नलिखित कथन": "statement", "सही क्रम": "order", "प्रश्न आकृति सुमेलित": "figure", "plain": "plain", "": "plain"}
    assert column(spark, list(said), texts.format_of) == list(said.values())
    assert column(spark, ["x"], lambda t: texts.format_of(t, [], "none")) == ["none"]


def test_garble_counts_each_place_and_stutters(spark):
    said = ["क्ा", "क््ा", "ण्" * 5, " ा", "ाक", "<क>", "plain", "", None, "क्ष ठीक है", "्ाी" * 3]
    for text, got in zip(said, column(spark, said, texts.garble_density), strict=True):
        text = text or ""
        places = sum(bool(re.compile(texts.IMPOSSIBLE).match(text, i)) for i in range(len(text)))
        runs = sum(len(m.group(0)) for m in re.finditer(texts.STUTTER, text))
        assert got == pytest.approx(100 * (places + runs) / len(text) if text else 0.0)
    assert column(spark, ["क््ा"], texts.garble_density) == [50.0]  # a double sign, and the vowel on the second


def test_garble_by_places_alone(spark):
    said = ["ण्" * 5, "क्ा" + "ण्" * 5, " ्" * 6, None]
    assert column(spark, said, lambda t: texts.garble_density(t, stutter=None)) == [0.0, pytest.approx(100 / 13), 0.0, 0.0]


def test_lines_are_trimmed_of_blanks_and_of_nothing_else(spark):
    # the first line begins with its place, 0, and so on
    said = ["0997 a | b0\n 1st1 \n", "\n 1 \n22 2", " \n", None]
    assert column(spark, said, texts.first_line) == ["0997 a | b0", "1", None, None]
    assert column(spark, said, lambda t: texts.first_line(t, last=True)) == ["1st1", "22 2", None, None]
    assert column(spark, ["0 is. 1 is! no 2"], texts.sentences) == [["0 is.", "1 is!", "no 2"]]
    assert column(spark, ["<article>0 zero<br> 1 one </article>"], lambda t: F.regexp_replace(texts.article_text(t), r"\s+", " ")) == ["0 zero 1 one"]


def test_legacy_font_needs_two_samples_of_three(spark):
    marked, plain = "Hkk izk xyz " * 400, "words of plain text " * 240
    assert column(spark, ["Hkk izk", "plain", "", None, "12 34", "Hkk izk यहहिन्दीहै"], texts.legacy_font) == [True, False, False, False, False, False]
    assert column(spark, [marked * 12, plain * 12, plain * 3 + marked * 9, marked * 3 + plain * 9], texts.legacy_font) == [True, False, True, False]


def test_clock_images(spark):
    got = spark.createDataFrame([(270,), (0,), (719,), (360,)], "t int").select("t", planning.water_clock(F.col("t")).alias("w"), planning.mirror_clock(F.col("t")).alias("m")).collect()
    assert [tuple(r) for r in got] == [(270, 450, 90), (0, 0, 360), (719, 1, 361), (360, 360, 0)]


def test_triangles_of_known_figures(spark):
    corner = [(0, 0, 4, 0), (4, 0, 0, 4), (0, 4, 0, 0)]
    figures = {1: corner, 2: [*corner, (0, 0, 2, 2)], 3: corner[:2], 4: [(0, 0, 2, 0), (0, 1, 2, 1), (0, 0, 1, 1)], 5: [(0, 0, 2, 2), (0, 2, 2, 0), (1, 0, 1, 2)],
               6: [(0, 0, 2, 0), (2, 0, 2, 2), (2, 2, 0, 2), (0, 2, 0, 0), (0, 0, 2, 2), (0, 2, 2, 0)]}
    rows = [(f, i, *map(float, s)) for f, lines in figures.items() for i, s in enumerate(lines)]
    got = planning.triangles(spark.createDataFrame(rows, "figure int, id int, x1 double, y1 double, x2 double, y2 double"), "figure", "id").collect()
    # a triangle; with a median; an open angle; parallels; three lines through one place; a square with both diagonals
    assert {r["figure"]: r["triangles"] for r in got} == {1: 1, 2: 3, 6: 8}


def test_replies_keep_the_first_of_each_section_in_range(spark):
    raw = ['{"questions": [{"section_number": 2, "stem": "a"}, {"section_number": 2, "stem": "b"}, {"section_number": 4, "stem": "c"}, {"section_number": 0, "stem": "d"}, {"section_number": 1, "stem": null}, {"stem": "e"}]}', "no json", "{}", None]
    df = spark.createDataFrame(list(enumerate(raw)), "id int, raw string")
    got = planning.batch_replies(df, ["id"], "raw", F.lit(3), ["stem"]).collect()
    assert sorted(tuple(r) for r in got) == [(0, 1, None), (0, 2, "a")]
