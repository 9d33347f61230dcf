"""Rules that are easy to get wrong, each on a few rows made for it."""

import math

import pytest
from pyspark.sql import functions as F

from quillon.functions import dawg, geometry, greedy, recoder, render
from quillon.functions import text as T
from quillon.functions import vectors as V
from quillon.plans.evaluation import merge_spans


def column(spark, values, kind, f):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["r"] for r in rows.select("i", f(F.col("v")).alias("r")).orderBy("i").collect()]


def test_spans_need_an_opening_tag(spark):
    tags = {1: ["B-x", "I-x", "I-y", "I-y", "B-y"], 2: ["I-x", "I-x", "O", "I-x"], 3: ["B-x", "O", "I-x", "B-x", "B-x", "I-x"]}
    rows = [(d, i, t, (i + 1) / 10) for d, ts in tags.items() for i, t in enumerate(ts)]
    got = merge_spans(spark.createDataFrame(rows, "doc int, pos int, tag string, score double")).collect()
    assert sorted((r["doc"], r["first"], r["last"], r["label"], r["score"]) for r in got) == [(1, 0, 1, "x", 0.15), (1, 4, 4, "y", 0.5), (3, 0, 0, "x", 0.1), (3, 3, 3, "x", 0.4), (3, 4, 5, "x", 0.55)]


def test_gate_without_a_demand_on_confidence(spark):
    rows = spark.createDataFrame([("12345678", 0.1, 0.0), ("1234567", 0.9, 0.0), ("12345678", 0.1, 0.5), ("éééé", 0.6, 0.5)], "t string, c double, least double")
    got = rows.select(T.passes_gate(F.col("t"), F.col("c"), F.lit(8), F.col("least")).alias("r")).collect()
    assert [r["r"] for r in got] == [True, False, False, True]


def test_outcomes(spark):
    rows = spark.createDataFrame([(False, True, 0.0), (True, True, 0.9), (True, False, None), (True, False, 0.02), (True, False, 0.021)], "ok boolean, raw boolean, moved double")
    got = rows.select(T.outcome(F.col("ok"), F.col("raw"), F.col("moved")).alias("r")).collect()
    assert [r["r"] for r in got] == ["error", "neutral", "unavailable", "neutral", "unavailable"]


def test_markup_goes(spark):
    import re

    def slow(s):
        s = re.sub(r"!\[[^\]]*\]\([^)]*\)", " ", s)
        s = re.sub(r"<[^>]+>", " ", s)
        s = re.sub(r"^\s*#{1,6}\s*", "", s, flags=re.M)
        s = re.sub(r"^\s*\|?[\s:|-]{3,}\|?\s*$", " ", s, flags=re.M)
        return re.sub(r"\*\*|__|\*|`", "", s.replace("|", " "))

    texts = ["# Title\n\ntext", "![a](b) c <td>x</td>", "| a | b |\n|---|:-:|\n| 1 | 2 |", "**bold** __x__ `code` *i*", "a # b", "####### seven", "", "\n\n  ## x\n---\ny"]
    assert column(spark, texts, "string", T.strip_markup) == [slow(t) for t in texts]


def test_skew_consensus(spark):
    cases = [(0.0, 2.0, 4.0, -2.0), (0.0, 0.2, 5.0, 0.0), (0.0, 6.5, 5.0, 0.0), (0.0, 2.0, 3.9, 0.0), (2.0, 0.4, 3.5, 0.0), (1.0, 0.4, 3.5, 1.0), (1.0, 0.6, 3.5, 0.0), (7.0, 3.0, 9.0, 7.0), (2.0, 5.0, 2.9, 2.0), (2.0, -3.5, 3.0, 2.0), (2.0, -3.6, 3.0, 0.0)]
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, a double, b double, c double, want double")
    got = rows.orderBy("i").select((geometry.skew_consensus(F.col("a"), F.col("b"), F.col("c")) + 0.0).alias("r"), "want").collect()
    assert [r["r"] for r in got] == [r["want"] for r in got]


def test_tiling_ties_and_exclusion(spark):
    def slow(w, h, tile, least, most, prior=None):
        best, out = 1e9, (0, 0)
        for n in range(least, most + 1):
            for r in range(1, n + 1):
                if n % r == 0:
                    c = n // r
                    if prior and not (prior[1] % c and prior[0] % r):
                        continue
                    d = abs(c / r - w / h)
                    if d < best or (d == best and w * h > 0.5 * tile * tile * r * c):
                        best, out = d, (r, c)
        return out

    cases = [(800, 800), (448, 448), (100, 100), (900, 300), (300, 900), (640, 481), (1500, 1000)]
    rows = spark.createDataFrame(cases, "w int, h int")
    for prior in (None, (2, 2), (3, 2)):
        got = rows.select("w", "h", geometry.tiling(F.col("w"), F.col("h"), 448, 1, 12, prior).alias("g")).collect()
        assert [(r["g"]["r"], r["g"]["c"]) for r in got] == [slow(r["w"], r["h"], 448, 1, 12, prior) for r in got]


def test_sizes_beyond_the_ratio_are_refused(spark):
    rows = spark.createDataFrame([(10.0, 2001.0), (10.0, 2000.0), (0.0, 5.0), (100.0, 100.0)], "h double, w double")
    h, w = geometry.smart_resize(F.col("h"), F.col("w"))
    got = [(r["h"], r["w"]) for r in rows.select(h.alias("h"), w.alias("w")).collect()]
    assert got[0] == got[2] == (None, None) and got[1][0] == 28 and got[3] == (112, 112)


def test_separators(spark):
    cases = [([10, 10, 3], 80, 3, 80, True), ([10, 10, 3], 80, 3, 71, False), ([10, 3], 80, 3, 80, False), ([10, 10, 3], 23, 3, 23, False), ([10, 10, 4], 32, 4, 32, True), ([10, 10, 4], 31, 4, 31, False), ([4, 10, 6, 10], 80, 6, 80, True)]
    rows = spark.createDataFrame([(i, hs, w, h, n, want) for i, (hs, w, h, n, want) in enumerate(cases)], "i int, hs array<int>, w int, h int, n int, want boolean")
    got = rows.orderBy("i").select(geometry.flat_line(F.col("w"), F.col("h"), F.col("n"), F.col("hs")).alias("r"), "want").collect()
    assert [r["r"] for r in got] == [r["want"] for r in got]


def test_reading_order_within_a_line():
    words = [(1, 0, 0, 50.0, 10.0, 10.0), (2, 0, 0, 10.0, 12.0, 10.0), (3, 0, 0, 5.0, 20.0, 8.0), (4, 0, 1, 0.0, 0.0, 5.0), (5, 1, 0, 0.0, 0.0, 5.0)]
    assert greedy.reading_order(words) == [2, 1, 3, 4, 5] and greedy.reading_order([]) == []


def test_error_function(spark):
    xs = [-6.0, -3.1, -2.99, -1.0, -0.1, 0.0, 0.5, 1.7, 2.99, 4.0]
    got = column(spark, xs, "double", V.erf)
    assert all(abs(g - math.erf(x)) < (1e-9 if abs(x) < 3 else 2.3e-5) for g, x in zip(got, xs, strict=True))


def test_blocks_of_eight_bits(spark):
    v = [0.0] * 32 + [0.5, -1.0, 0.25] + [0.1] * 10
    got = column(spark, [v], "array<double>", V.quantize_blocks)[0]
    assert [b["scale"] for b in got] == [0.0, 1 / 127] and got[0]["q"] == [0] * 32 and got[1]["q"][:3] == [64, -127, 32] and len(got[1]["q"]) == 13


def test_json_strings_and_word_starts(spark):
    import json

    texts = ['a"b\\c', "\n\t\r\b\f", "\x00\x01\x1f é🙂", "", "plain"]
    assert [json.loads(x) for x in column(spark, texts, "string", T.json_escape)] == texts
    assert column(spark, [["ab", "", "c"], [], ["x"]], "array<string>", T.starts) == [[0, 3, 4], [], [0]]


def test_packed_words_and_bonus():
    words = {(1, 2), (1, 2, 3), (2,), (3, 3, 3)}
    graph = dawg.parse(dawg.pack(words, 4))
    for w in [(), (1,), (1, 2), (1, 2, 3), (1, 2, 3, 1), (2,), (2, 2), (3, 3), (3, 3, 3)]:
        assert dawg.matches(graph, w, True) == (w in words) and dawg.matches(graph, w, False) == any(x[: len(w)] == w for x in words)
    data = dawg.pack(words, 4)
    for bad in (b"", b"\0" * 10, data[:-8], data[:6] + b"\xff\xff\xff\xff" + data[10:]):
        with pytest.raises(ValueError):
            dawg.parse(bad)
    codes = ((9,), (1,), (2,), (3,), (4,))
    told = lambda labels, final, begun: recoder.bonus(labels, codes, 4, graph, final, begun)
    assert told([1, 2, 4, 2, 4, 3], False, False) == 0.5 and told([1, 2, 4, 2, 4, 3], False, True) == 0.52
    assert told([1, 2, 3], True, False) == 0.25 and told([1, 2, 3], False, True) == 0.02 and told([7], True, True) == 0.0


def test_markdown():
    regions = [(1, "Head", 0, 0, 10, 4), (2, "body", 0, 50, 10, 4), (3, "", 0, 60, 10, 4), (4, "left", 900, 900, 5, 5)]
    layout = [(0, "text", -5, 40, 60, 90), (1, "title", -5, -5, 60, 20), (2, "table", 200, 45, 300, 90), (3, "formula", 400, 300, 500, 400)]
    assert render.markdown(regions, layout, {2: "<table/>"}, {3: "x^2"}) == "# Head\n\nbody\n\n<table/>\n\n$$\nx^2\n$$\n\nleft\n\n"
    assert render.markdown(regions, [], {2: "<table/>"}, {3: "x"}) == "Head\n\nbody\n\nleft\n\n<table/>\n\n$$\nx\n$$\n\n"
