"""Queries without SQL that compare texts, over all rows against definitions."""

import difflib
import random
import re

import pytest

from quillon.plans.catalogue import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def pairs(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    turns = {r["conv_id"] * 1000 + r["turn"]: r["text"] for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()}
    return {("documents", i): (t, docs.get(i + 1, "")) for i, t in docs.items()} | {("conversations", i): (t, turns.get(i + 1, "")) for i, t in turns.items()}


def rows(spark, name):
    return {(r["source"], r["doc_id"]): r for r in QUERIES[name](spark, SF).collect()}


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_no_pair_is_lost(spark, pairs):
    for name in ("K1_levenshtein", "K2_cer", "K4_wer", "K5_edit_distance", "K6_token_distance", "K16_restoration_cer", "K22_text_delta"):
        assert rows(spark, name).keys() == pairs.keys()


def test_word_rates_and_distances(spark, pairs):
    scored, words = rows(spark, "K4_wer"), rows(spark, "K6_token_distance")
    even = lambda s: re.sub(r"\s+", " ", s.replace("­", "")).strip()
    some = random.Random(3).sample(sorted(pairs), 120)
    for key in some:
        h, r = map(even, pairs[key])
        hw, rw = h.split(), r.split()
        got = scored[key]
        assert words[key]["d"] == distance(pairs[key][0].split(), pairs[key][1].split())
        assert got["exact"] == (h == r)
        if not r:
            assert got["cer"] is got["wer"] is got["unordered_wer"] is None
        else:
            assert (got["wer"], got["unordered_wer"]) == (round(distance(hw, rw) / len(rw), 5), round(distance(sorted(hw), sorted(rw)) / len(rw), 5))


def test_delta(spark, pairs):
    got = rows(spark, "K22_text_delta")
    for key, (a, b) in pairs.items():
        p, q = (re.sub(r"[^\w]+", "", t).lower() for t in (a, b))
        assert got[key]["delta"] == pytest.approx(0.0 if not p and not q else 1.0 if not p or not q else 1 - difflib.SequenceMatcher(None, p, q).ratio(), abs=1e-6)


def test_report(spark):
    scored = QUERIES["K4_wer"](spark, SF).collect()
    for r in QUERIES["K21_report"](spark, SF).collect():
        own = [s for s in scored if s["source"] == r["source"]]
        told = [s["wer"] for s in own if s["wer"] is not None]
        assert r["n"] == len(own) and r["mean_wer"] == pytest.approx(sum(told) / len(told), abs=1e-5)
