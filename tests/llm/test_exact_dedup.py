"""Exact dedup: the merge index against a dictionary, runs that are probed and compacted, byte verification, awkward rows."""

import hashlib
import random
import re

import numpy as np

from quillon.llm import op08_exact_dedup as dedup


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def brute_force(rows):
    """{row: (keep_id, group_size, sha256)} of rows (doc_id, text) with distinct ids."""
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i))
    return {i: (min(m)[1], len(m), hashlib.sha256(k.encode()).hexdigest()) for k, m in groups.items() for _, i in m}


def test_many_memtables_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(dedup, "RANGE_ROWS", 3)
    rows = [(i, t) for i, t in enumerate(["a b", "ab", " a  b ", None, "", "x", "ab ", "é ", "é"] * 12)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = rows_of(dedup.exact_dedup(df, memtable_bytes=300))
    want = brute_force(rows)
    assert {r["doc_id"]: (r["keep_id"], r["group_size"], r["text_sha256"]) for r in got} == want and len(got) == len(rows)
    assert all(r["kept"] == (r["doc_id"] == r["keep_id"]) for r in got)
    assert sorted(r["doc_id"] for r in rows_of(dedup.keep_first(df))) == sorted({k for k, _, _ in want.values()})


def test_index_equals_a_dictionary():
    rng, want, index, probes = random.Random(3), {}, dedup.DigestIndex(), 0
    keys = [hashlib.sha256(str(i).encode()).digest() + bytes(4) for i in range(600)] + [bytes(31) + b"\1" + bytes(4), bytes(36)]
    for _ in range(120):
        some = sorted(rng.sample(keys, rng.randint(1, 40)))
        points, ids, sizes = ([rng.randint(0, 3) for _ in some], rng.sample(range(10_000), len(some)), [rng.randint(1, 5) for _ in some])
        probes += sum(k in want for k in some)
        for k, p, i, n in zip(some, points, ids, sizes, strict=True):
            old = want.get(k, (0, (-1, 0), 0))
            want[k] = (old[0] + n, max(old[1], (p, -i)), old[2] + 1)
        index.add(dedup.Run(np.array(some, "S36"), np.array(points), np.array(ids), np.array(sizes), np.ones(len(some), np.int64)))
        # Runs are few: a tier is compacted when it is full, and no key is in two of them.
        assert all(len(t) < dedup.FAN_IN for t in index.tiers)
    done = index.entries()
    got = {k.ljust(36, b"\0"): (n, (p, -i), r) for k, n, p, i, r in zip(done.keys.tolist(), done.sizes.tolist(), done.points.tolist(), done.ids.tolist(), done.runs.tolist(), strict=True)}
    assert got == want and probes > 100 and len(done.keys) == len(want)


def test_filters_let_few_strangers_pass():
    keys = lambda a, b: np.array(sorted(hashlib.sha256(str(i).encode()).digest() + bytes(4) for i in range(a, b)), "S36")
    one = np.ones(2000, np.int64)
    run = dedup.Run(keys(0, 2000), one, one, one, one)
    strangers = keys(2000, 22_000)
    assert run.filter[run.places(strangers)].all(axis=1).mean() < 0.03
    which, at = run.probe(strangers)
    assert len(which) == 0 and len(run.probe(run.keys)[0]) == 2000


def test_bytes_are_verified_where_digests_meet(spark, monkeypatch):
    """With a digest that says nothing, texts are still told apart: in a memtable by bytes, and across memtables afterwards."""
    rows = [(1, "ab"), (2, "a b"), (3, "cd"), (4, "ab"), (5, "c  d")]
    one = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    table: dict = {}
    for i, t in rows:
        body, twin = t.replace(" ", "").encode(), 0
        while (entry := table.get((b"same", twin))) is not None and entry[0] != body:
            twin += 1
        table.setdefault((b"same", twin), (body, []))[1].append((len(t), i, 0))
    flushed = [r for b in dedup.flush(table, "0-0") for r in b.to_pylist()]
    assert sorted((r["twin"], r["doc_id"]) for r in flushed if r["leader"]) == [(0, 2), (1, 5)]
    level0 = dedup.stage(dedup.runs(one.repartition(5, "doc_id"), 1))
    level1 = dedup.stage(dedup.compact(level0))
    assert dedup.mismatches(one, level0, level1).count() == 0 and level1.where("n_runs > 1").count() == 2


def test_awkward_rows_and_clashing_columns(spark):
    schema = "doc_id long, text string, digest string, run int, kept boolean"
    rows = [(1, "a", "d", 1, True), (None, "a", None, None, None), (None, None, "d", 1, False), (2, "", "d", 1, True), (2, " ", "d", 1, True), (3, "z" * 200_000, "d", 1, True), (None, "only", "d", 1, True), (None, "only", "d", 1, True)]
    df = spark.createDataFrame(rows, schema).repartition(3)
    got = sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"], r["kept"]) for r in rows_of(dedup.exact_dedup(df)))
    assert got == sorted([("1", "1", 2, True), ("None", "1", 2, False), ("None", "2", 3, False), ("2", "2", 3, True), ("2", "2", 3, True), ("3", "3", 1, True), ("None", "None", 2, True), ("None", "None", 2, True)])
    kept = dedup.keep_first(df)
    assert kept.columns == df.columns and sorted(str(r["doc_id"]) for r in rows_of(kept)) == ["1", "2", "2", "3", "None", "None"]
    other = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (3, "c")], "doc_id long, text string")
    assert sorted((r["doc_id"], r["text"]) for r in rows_of(dedup.keep_first(other))) == [(1, "a"), (2, "b"), (3, "c")]
    none = spark.createDataFrame([], schema)
    assert rows_of(dedup.exact_dedup(none)) == [] and rows_of(dedup.keep_first(none)) == []
