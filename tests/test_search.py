"""Block search against brute force: blocks, ties, scores that are no numbers, sets of vectors."""

import numpy as np

from quillon.operators import search


def vectors(spark, rng, n, ids):
    v = rng.integers(-2, 3, (n, 4)).astype(np.float32)
    return v, spark.createDataFrame([(i, x.tolist()) for i, x in zip(ids, v, strict=True)], "vec_id long, embedding array<float>")


def test_top_k_with_ties_and_lost_scores(spark):
    rng = np.random.default_rng(3)
    v, rows = vectors(spark, rng, 300, range(300))
    v = v.astype(float)
    v[7::50] = np.nan
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>").repartition(5)
    queries = rows.where("vec_id % 20 = 0").selectExpr("vec_id as q", "embedding as qv")
    want = {}
    for q in range(0, 300, 20):
        scored = sorted((-float(v[q] @ v[i]), i) for i in range(300) if i != q and np.isfinite(v[q] @ v[i]))
        want[q] = [(i, -s) for s, i in scored[:5]]
    for block in (1 << 20, 3 * 4 * 8):  # one block, and many of a few queries
        got = {}
        for r in sorted(search.top_k(queries, rows, 5, block).collect(), key=lambda r: (r["q"], r["rank"])):
            got.setdefault(r["q"], []).append((r["vec_id"], r["score"]))
        assert got == want
    assert search.top_k(queries.where("false"), rows, 5).collect() == []
    assert search.top_k(queries, rows.where("false"), 5).collect() == []


def test_max_sim(spark):
    rng = np.random.default_rng(4)
    v, rows = vectors(spark, rng, 200, range(200))
    rows = rows.selectExpr("vec_id % 13 as d", "embedding").repartition(4)
    queries = spark.createDataFrame([(i % 3, i, v[i].tolist()) for i in range(0, 200, 20)], "q long, qi long, qv array<float>")
    want = {(q, d): float(sum(max(v[i] @ v[j] for j in range(200) if j % 13 == d) for i in range(0, 200, 20) if i % 3 == q)) for q in range(3) for d in range(13)}
    for block in (1 << 20, 3 * 4 * 8):
        assert {(r["q"], r["d"]): r["score"] for r in search.max_sim(queries, rows, block).collect()} == want
