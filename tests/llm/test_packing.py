"""Packing: ids by the library, gapless pieces and sequences, documents that stay whole, padding against a bound."""

import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest

from quillon.llm import op05_packing as packing
from quillon.llm import queries

WORDS = P.path("word_bpe_49k.json")


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def check(rows, texts):
    """texts: of each doc_id, one row each; returns the tokens in all."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORDS)
    ids = {i: [*library.encode(t or "", add_special_tokens=False).ids, 2] for i, t in texts.items()}
    at, sequences = {}, {}
    for r in rows:
        at.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert at.keys() == ids.keys()
    for i, pieces in at.items():
        end = 0
        for r in sorted(pieces, key=lambda r: r["start"]):
            assert r["start"] == end and r["length"] > 0 and r["doc_tokens"] == len(ids[i])
            end += r["length"]
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[i][r["start"] : end], "<u4").tobytes())
        assert end == len(ids[i]) and len(pieces) == -(-end // packing.LENGTH)  # what fits stays whole
    for pieces in sequences.values():
        end = 0
        for offset, n in sorted(pieces):
            assert offset == end
            end += n
        assert end <= packing.LENGTH
    assert sorted(sequences) == list(range(len(sequences)))
    return sum(map(len, ids.values())), len(sequences)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_whole_table(spark, sf):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").collect()}
    tokens, used = check(rows_of(queries.op5_packing(spark, f"/root/testdata/{sf}")), texts)
    if sf == "sf0.01":
        assert used * packing.LENGTH <= 1.01 * tokens


def test_awkward_rows_and_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANK_ROWS", 7)
    texts = {0: "", 1: None, 2: "a", 3: "word " * 9000, 4: "x" * 5000, **{i: "same text" for i in range(10, 60)}, 99: " \n\t "}
    schema = "doc_id long, text string, length long, kind int, rank string, sequence_id long, row int"
    df = spark.createDataFrame([(i, t, 5, 6, "r", 7, 8) for i, t in texts.items()], schema).repartition(5)
    check(rows_of(packing.pack(df, WORDS)), texts)
    assert rows_of(packing.pack(df.where("false"), WORDS)) == []
    repeated = rows_of(packing.pack(spark.createDataFrame([(None, "a b")] * 30 + [(5, "c")] * 30, "doc_id long, text string"), WORDS))
    assert len(repeated) == 60 and sum(r["doc_id"] is None for r in repeated) == 30
    assert len({(r["sequence_id"], r["offset"]) for r in repeated}) == 60


def bound(histogram, capacity=4096):
    """Martello and Toth's: volume alone is none where most pieces are longer than half a sequence."""
    sure = []
    for k in range(0, capacity // 2 + 1, 16):
        long = sum(n for x, n in histogram.items() if x > capacity - k)
        half = sum(n for x, n in histogram.items() if capacity // 2 < x <= capacity - k)
        volume = sum(x * n for x, n in histogram.items() if k <= x <= capacity - k)
        sure.append(long + max(half, -(-volume // capacity)))
    return max(sure)


@pytest.mark.parametrize("lengths", [range(64, 4097, 64), range(1500, 4096, 31), [1365], [1024, 2048, 3072], range(1, 4097, 7)])
def test_plan_is_exact_and_near_the_bound(lengths):
    rng = np.random.default_rng(1)
    histogram = {int(x): int(rng.integers(1, 500)) for x in lengths}
    rows, used = packing.layout(histogram)
    assert {x: sum(r[2] - r[1] for r in rows if r[0] == x) for x in histogram} == histogram
    for x in histogram:  # ranks are gapless
        spans = sorted((r[1], r[2]) for r in rows if r[0] == x)
        assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))
    assert bound(histogram) <= used <= 1.02 * bound(histogram) + len(histogram)


def test_column_generation_betters_first_fit():
    """Three kinds of which longest first makes poor use: 6, 5 and 3 tenths of a sequence, and the like."""
    histogram = {1900: 300, 1300: 300, 1000: 300, 700: 300}
    size, counts = np.array(sorted(histogram)), np.array([histogram[x] for x in sorted(histogram)])
    greedy = sum(n for _, n in packing.first_fit(size, counts, 4096))
    plan = packing.solve(size.tolist(), counts.tolist(), 4096)
    assert sum(n * p for p, n in plan).tolist() == counts.tolist() and all(p @ size <= 4096 for p, _ in plan)
    assert bound(histogram) <= sum(n for _, n in plan) < greedy


def test_pricing_equals_brute_force():
    rng = random.Random(1)
    for _ in range(30):
        size = np.array(sorted(rng.sample(range(3, 40), 4)))
        gain = np.array([rng.random() for _ in size])
        value, patterns = packing.price(size, gain, 60)
        best = max(a * gain[0] + b * gain[1] + c * gain[2] + d * gain[3] for a in range(21) for b in range(21) for c in range(21) for d in range(21) if a * size[0] + b * size[1] + c * size[2] + d * size[3] <= 60)
        assert abs(value - best) < 1e-9 and abs(patterns[0] @ gain - best) < 1e-9 and all(p @ size <= 60 for p in patterns)


def test_classes_cover_their_lengths():
    histogram = {x: 1 + 4000 // x for x in range(1, 4097)}
    kinds = packing.classes_of(histogram)
    assert len(set(kinds.values())) <= packing.CLASSES and all(x <= k <= 4096 and kinds[k] == k for x, k in kinds.items()) and kinds[4096] == 4096
    assert packing.classes_of({5: 1, 9: 2}) == {5: 5, 9: 9}
