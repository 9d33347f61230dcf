"""Packing of token sequences as a cutting-stock problem, solved by column generation.

A document that fits into a sequence stays whole; a longer one gives full sequences and its rest. Lengths
fall into at most CLASSES classes, each as long as its longest, closer together where documents abound (by
the root of their density, which costs least). The histogram of the lengths has LENGTH places whatever the
input, and is all that reaches the driver. A linear program over patterns (how many pieces of each class
one sequence holds) is solved by the simplex method; columns are priced by dynamic programming over an
unbounded knapsack. Rounded down, patterns cover most pieces; the rest is packed first-fit by decreasing
length, pattern by pattern. Pieces of a class are ranked by a distributed count, and a rank names the
sequence and the place of its piece, whose offset sums the true lengths before it. Padding is what
patterns leave and what pieces are shorter than their class.

Defined results: null text counts as empty, which still gives the closing id; rows that repeat a
doc_id are packed each, ranked side by side; an empty table gives no row; a null doc_id is packed like
any other; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from quillon.llm._common import slices, stage
from quillon.llm._tokens import gather, pieces_of

LENGTH, CLASSES, END_ID = 4096, 768, 2
#: Pieces of one class that one rank task sorts, about.
RANK_ROWS = 200_000


# The cutting-stock problem ------------------------------------------------------------------------
def price(lengths: np.ndarray, values: np.ndarray, capacity: int, offers: int = 24) -> tuple[float, list[np.ndarray]]:
    """The greatest value of a pattern, an unbounded knapsack of the given capacity, and patterns of great value, the best first."""
    able = np.flatnonzero(values > 1e-12)
    size, gain = lengths[able], values[able]
    if not len(able):
        return 0.0, []
    top = int(size.max())
    best, choice = np.full(top + capacity + 1, -np.inf), np.full(capacity + 1, -1)
    best[top] = 0.0  # place top + c holds capacity c
    for c in range(1, capacity + 1):
        got = best[top + c - size] + gain
        i = int(got.argmax())
        if got[i] > best[top + c - 1] + 1e-12:
            best[top + c], choice[c] = got[i], i
        else:
            best[top + c] = best[top + c - 1]
    # The best pattern that holds a class at all, for the most valuable classes.
    holding = best[top + capacity - size] + gain
    out = []
    for first in np.argsort(-holding, kind="stable")[:offers]:
        pattern, c = np.zeros(len(lengths), np.int64), capacity - int(size[first])
        pattern[able[first]] = 1
        while c > 0:
            if choice[c] < 0:
                c -= 1
            else:
                pattern[able[choice[c]]] += 1
                c -= int(size[choice[c]])
        out.append(pattern)
    return float(best[top + capacity]), out


def classes_of(histogram: dict[int, int], most: int = CLASSES) -> dict[int, int]:
    """The class of each length, the length of its longest member; each length its own where they are few."""
    lengths = sorted(histogram)
    if len(lengths) <= most:
        return {x: x for x in lengths}
    weight = np.cumsum(np.sqrt([histogram[x] for x in lengths]))
    group = np.minimum(most - 1, (weight - weight[0]) * most / (weight[-1] - weight[0] + 1e-9)).astype(int)
    longest = {g: x for x, g in zip(lengths, group.tolist(), strict=True)}  # the last one of a group wins
    return {x: longest[g] for x, g in zip(lengths, group.tolist(), strict=True)}


def solve(lengths: list[int], counts: list[int], capacity: int, rounds: int = 80, gap: float = 3e-4) -> list[tuple[np.ndarray, int]]:
    """Patterns and how often each is used, covering counts exactly.

    Revised simplex for min sum(x), A x = counts, over the inverse of the basis. It starts from first-fit
    patterns, each of which uses up a class that no later one holds: a triangular basis. A best pattern of value v bounds the optimum from below by the present cost / v: it ends
    when that is within gap, or the cost within half of it of the volume. A pricing offers several columns, which
    enter as long as they still gain.
    """
    if not lengths:
        return []
    size, left = np.array(lengths, np.int64), np.array(counts, np.int64)
    basis = first_basis(size, left, capacity)  # patterns are columns
    inverse, demand, entered = np.linalg.inv(basis), left.astype(float), 0
    volume = float(size @ left) / capacity  # no plan uses fewer sequences
    for _ in range(rounds):
        if (inverse @ demand).sum() <= (1 + gap / 2) * volume:
            break
        value, columns = price(size, inverse.sum(axis=0), capacity)
        if value <= 1 + gap:
            break
        for column in columns:
            if inverse.sum(axis=0) @ column <= 1 + gap / 2:
                continue
            x, d = inverse @ demand, inverse @ column
            out = int(np.argmin(np.where(d > 1e-9, np.maximum(x, 0) / np.where(d > 1e-9, d, 1), np.inf)))
            basis[:, out] = column
            inverse[out] /= d[out]
            d[out] = 0
            inverse -= np.outer(d, inverse[out])
            entered += 1
            if entered % 200 == 0:  # against the drift of the updates
                inverse = np.linalg.inv(basis)
    x = np.linalg.solve(basis, demand)
    out = []
    for p, n in zip(basis.T.round().astype(np.int64), np.floor(np.maximum(x, 0) + 1e-9).astype(np.int64), strict=True):
        used = p > 0
        n = min([int(n), *(left[used] // p[used])])
        if n > 0:
            out.append((p, n))
            left = left - n * p
    return out + first_fit(size, left, capacity)


def first_basis(size: np.ndarray, counts: np.ndarray, capacity: int) -> np.ndarray:
    """A column for each class: the pattern, longest first, that uses it up; patterns are used in fractions here."""
    basis, left = np.zeros((len(size), len(size))), counts.astype(float)
    open_ = list(np.argsort(-size, kind="stable"))
    while open_:
        room, p = capacity, np.zeros(len(size))
        for i in open_:
            p[i] = room // size[i]
            room -= int(p[i] * size[i])
            if room < size[open_[-1]]:
                break
        held = [i for i in open_ if p[i]]
        out = min(held, key=lambda i: left[i] / p[i])
        left -= left[out] / p[out] * p
        basis[:, out] = p
        open_.remove(out)
    return basis


def first_fit(size: np.ndarray, left: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """The rest, pattern by pattern: longest first, as many as fit, and the pattern as often as it can be used."""
    left, out = left.copy(), []
    order = np.argsort(-size, kind="stable")
    while left.sum():
        room, p = capacity, np.zeros(len(size), np.int64)
        for i in order:
            p[i] = min(int(left[i]), room // int(size[i]))
            room -= int(p[i]) * int(size[i])
        n = int((left[p > 0] // p[p > 0]).min())
        out.append((p, n))
        left -= n * p
    return out


def layout(counts: dict[int, int], capacity: int = LENGTH) -> tuple[list[tuple], int]:
    """For each class (length) and pattern: the ranks lo to hi, pieces per sequence, first sequence, place; and the sequences used."""
    lengths = sorted(counts)
    rows, rank, seq = [], dict.fromkeys(lengths, 0), 0
    for pattern, n in solve(lengths, [counts[x] for x in lengths], capacity):
        place = 0
        for x, k in zip(lengths, pattern.tolist(), strict=True):
            if k:
                rows.append((x, rank[x], rank[x] + n * k, k, seq, place))
                rank[x] += n * k
                place += k
        seq += n
    return rows, seq


# Tokens and pieces ----------------------------------------------------------------------------------
def words_of(texts: pa.Array) -> pa.ListArray:
    """The tokenizer drops white space and never joins across it: each word has its ids by itself."""
    return pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")


def cuts(n: int, length: int = LENGTH) -> list[int]:
    """Lengths of a document's pieces: full sequences and the rest, so that what fits stays whole."""
    return [length] * (n // length) + [n % length] * (n % length > 0)


def pieces(docs: DataFrame, tokenizer_file: str, end_id: int = END_ID) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens) of all documents."""

    def run(batches):
        known, end = pieces_of(tokenizer_file), np.array([end_id], "<u4").tobytes()
        for b in slices(batches):
            cols = [[], [], [], [], []]
            ids, bounds = gather(words_of(b["text"]), known.look_up)
            data = memoryview(ids.tobytes())
            for doc, lo, hi in zip(b["doc_id"].to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                total, start = hi - lo + 1, 0  # with the closing id
                for n in cuts(total):
                    check = zlib.crc32(data[4 * (lo + start) : 4 * min(lo + start + n, hi)])
                    check = zlib.crc32(end, check) if start + n == total else check
                    for c, v in zip(cols, (doc, start, n, check, total), strict=True):
                        c.append(v)
                    start += n
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def pack(docs: DataFrame, tokenizer_file: str, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    # The row number is written with the pieces, so that all later reads have the same.
    cut = stage(pieces(docs, tokenizer_file, end_id).withColumn("row", F.monotonically_increasing_id()))
    histogram = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}  # at most LENGTH places
    belongs, counts = classes_of(histogram), {}
    for x, n in histogram.items():
        counts[belongs[x]] = counts.get(belongs[x], 0) + n
    # One row per length, and a few per class and pattern, at most CLASSES ** 2: no size here depends on the input.
    kinds = spark.createDataFrame(list(belongs.items()), "length long, kind long")
    plan = spark.createDataFrame(layout(counts)[0], "k long, lo long, hi long, per long, seq long, place long")
    cut = cut.join(F.broadcast(kinds), "length")
    # Ranks: rows are numbered within buckets of bounded size, and a bucket starts where those before it end.
    buckets = max(1, sum(histogram.values()) // RANK_ROWS)
    cut = cut.withColumn("bucket", F.pmod(F.xxhash64("row"), F.lit(buckets)))
    counted = cut.groupBy("kind", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("kind").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counted.select("kind", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    order = Window.partitionBy("kind", "bucket").orderBy("doc_id", "start", "row")
    ranked = cut.withColumn("i", F.row_number().over(order) - 1).join(starts, ["kind", "bucket"]).withColumn("rank", F.col("i") + F.col("base"))
    placed = ranked.join(F.broadcast(plan), (F.col("kind") == F.col("k")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    within = F.col("rank") - F.col("lo")
    placed = placed.withColumn("sequence_id", F.col("seq") + F.expr("(rank - lo) div per")).withColumn("at", F.col("place") + within % F.col("per"))
    ahead = Window.partitionBy("sequence_id").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", F.coalesce(F.sum("length").over(ahead), F.lit(0)).alias("offset"))
