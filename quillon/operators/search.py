"""Exact search of a stated set of query vectors against all rows, in blocks of matrix products.

Queries travel in blocks of bounded bytes, one broadcast each; rows stay where they are. Every task keeps
the best few of each query, so that what is shuffled has a bounded number of rows per query and task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of query vectors in a block, and cells of a score matrix that a task holds at once.
BLOCK_BYTES, CELLS = 32 << 20, 2_000_000
#: Digits of scores: sums in another order agree in these, so that equal vectors tie.
DIGITS = 9


def query_blocks(queries: DataFrame, columns: list[str], vector: str, block_bytes: int = BLOCK_BYTES) -> Iterator[tuple[dict[str, np.ndarray], np.ndarray]]:
    """Blocks of queries: their columns and vectors as arrays; a block is all that is on the driver at a time."""
    n = queries.count()
    if not n:
        return
    width = queries.agg(F.max(F.size(vector))).first()[0] or 1
    blocks = -(-n * width * 8 // block_bytes)
    for i in range(blocks):
        some = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64(*columns), F.lit(blocks)) == i)
        rows = some.select(*columns, vector).toArrow()
        if len(rows):
            yield {c: rows[c].to_numpy() for c in columns}, matrix(rows[vector].combine_chunks())


def matrix(vectors: pa.Array) -> np.ndarray:
    """An array of lists of one length as a matrix."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(vectors), -1) if len(vectors) else np.empty((0, 0))


def best_of(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best scores that are finite, ties by the smaller id."""
    at = np.flatnonzero(np.isfinite(scores))
    if len(at) > k:
        least = np.partition(scores[at], len(at) - k)[len(at) - k]
        at = at[scores[at] >= least]
    return at[np.lexsort((ids[at], -scores[at]))][:k]


def top_k(queries: DataFrame, rows: DataFrame, k: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(q, vec_id, score, rank): the k best rows of each query (q, qv) by dot product, itself and scores that aren't finite left out.

    rows: (vec_id, embedding), vectors of the queries' width. Ties go by the smaller id.
    """
    spark, out = rows.sparkSession, None
    for columns, vectors in query_blocks(queries, ["q"], "qv", block_bytes):
        shared = spark.sparkContext.broadcast((columns["q"], vectors))
        part = rows.select("vec_id", "embedding").mapInArrow(_searching(shared, k), "q long, vec_id long, score double")
        out = part if out is None else out.union(part)
    if out is None:
        return spark.createDataFrame([], "q long, vec_id long, score double, rank int")
    best = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    return out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _searching(shared, k: int):
    def run(batches):
        own, queries = shared.value
        found = [(np.empty(0), np.empty(0, np.int64))] * len(own)
        for b in batches:
            ids, vectors = b["vec_id"].to_numpy(), matrix(b["embedding"])
            step = max(1, CELLS // max(1, len(ids)))
            for lo in range(0, len(own) if len(ids) else 0, step):
                scores = np.round(queries[lo : lo + step] @ vectors.T, DIGITS)
                scores[own[lo : lo + step, None] == ids] = np.nan
                for i, row in enumerate(scores, lo):
                    at = best_of(row, ids, k)
                    joined = np.concatenate([found[i][0], row[at]]), np.concatenate([found[i][1], ids[at]])
                    keep = best_of(*joined, k)
                    found[i] = joined[0][keep], joined[1][keep]
        sizes = [len(f[0]) for f in found]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(own, sizes), pa.int64()), pa.array(np.concatenate([f[1] for f in found]), pa.int64()), pa.array(np.concatenate([f[0] for f in found]), pa.float64())], names=["q", "vec_id", "score"])

    return run


def max_sim(queries: DataFrame, rows: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(q, d, score): the sum over a query's vectors (q, qi, qv) of the greatest dot product with a document's vectors (d, embedding)."""
    spark, out = rows.sparkSession, None
    for columns, vectors in query_blocks(queries, ["q", "qi"], "qv", block_bytes):
        shared = spark.sparkContext.broadcast((columns["q"], columns["qi"], vectors))
        part = rows.select("d", "embedding").mapInArrow(_greatest(shared), "q long, qi long, d long, m double")
        out = part if out is None else out.union(part)
    if out is None:
        return spark.createDataFrame([], "q long, d long, score double")
    return out.groupBy("q", "qi", "d").agg(F.max("m").alias("m")).groupBy("q", "d").agg(F.round(F.sum("m"), 5).alias("score"))


def _greatest(shared):
    def run(batches):
        q, qi, queries = shared.value
        for b in batches:
            docs, vectors = b["d"].to_numpy(), matrix(b["embedding"])
            if not len(docs):
                continue
            order = np.argsort(docs, kind="stable")
            docs, vectors = docs[order], vectors[order]
            first = np.flatnonzero(np.r_[True, docs[1:] != docs[:-1]])
            step = max(1, CELLS // len(docs))
            for lo in range(0, len(q), step):
                m = np.maximum.reduceat(queries[lo : lo + step] @ vectors.T, first, axis=1)
                n = len(first)
                cols = [np.repeat(q[lo : lo + step], n), np.repeat(qi[lo : lo + step], n), np.tile(docs[first], len(m)), m.ravel()]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["q", "qi", "d", "m"])

    return run
