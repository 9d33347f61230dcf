"""Near-duplicates by fast similarity sketching, banding and exact verification.

A sketch has T coordinates. In round i < T every shingle falls into one hashed bin, with a value of i
and a hashed fraction; in rounds T to 2T-1 every shingle falls into bin i-T. A coordinate is the
smallest value that fell into its bin, so the first T rounds fill most bins in O(T log T + n) steps
and the last T fill whatever is left: no coordinate stays empty, two sets agree in a coordinate with
the probability of their Jaccard similarity, and the share of agreeing coordinates is concentrated
about it. Bands of ROWS coordinates give candidates; every link is confirmed on the full sets.

Copies of one set form a class, of which one document goes on. In each bucket of a band, every member
is compared with one leader, the member that meets most others; members that stay apart from it are
compared with a leader among themselves, and so on while that finds links. So a bucket of very many
near copies costs a comparison per member. For members that are still in another component than others
of their bucket, an exact prefix filter over their full sets gives the pairs that can be links at all.

Defined results: null text is empty text; a document without words has no shingle and no link. Every row
is judged by its own text, also where rows repeat a doc_id; its component is named by the smallest doc_id
there, null only if none has an id. A row is kept if its doc_id is that name, so rows that repeat it in
one component stay side by side, and rows without id stay where no document with an id is linked. An empty
table gives no row; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm._common import BROADCAST_IDS, components, fresh, salted_join, slices, stage

#: 26 bands of 5 rows: a pair of similarity 0.85 shares no band with probability 2.4e-7, one of 0.5 shares one with 0.56.
BANDS, ROWS = 26, 5
T = BANDS * ROWS
#: Of pairs from a similarity of 0.8: 30 bands of 4 rows miss one of 0.8 with probability 1.4e-7 (26 of 5: 3.3e-5).
LOOSE = (30, 4)
#: Comparisons with one document from which they are dealt out over tasks: each gains a text.
HEAVY_TEXTS = 2_000
#: Rounds of comparing members with a leader, at most; they end early when one finds little.
STARS = 5
_U = np.uint64
_FILL = np.iinfo(np.uint64).max


def _odds(n: int, seed: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(1, 2**63, n, dtype=np.uint64) * _U(2) + _U(1)


_MUL, _ADD, _BAND, _WORDS = _odds(2 * T, 1), _odds(2 * T, 2), _odds(T, 3), _odds(8, 4)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Shingler:
    """Distinct word shingles of texts as sorted 64-bit hashes; words are lower-cased in A-Z only."""

    def __init__(self, size: int = 3, keep: int = 300_000):
        import xxhash

        self.size, self.keep, self.hash, self.seen = size, keep, xxhash.xxh3_64_intdigest, {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8").lower().split()
        if not words:
            return np.empty(0, np.uint64)
        seen = self.seen
        if len(seen) > self.keep:
            seen.clear()
        for w in set(words):
            if w not in seen:
                seen[w] = self.hash(w)
        h = np.fromiter(map(seen.__getitem__, words), np.uint64, len(words))
        k = min(self.size, len(words))
        total = np.full(len(words) - k + 1, _U(k), np.uint64)
        for j in range(k):
            total = _mix(total * _WORDS[j] + h[j : len(h) - k + 1 + j])
        return np.unique(total)


def sketch(shingles: np.ndarray, t: int = T) -> np.ndarray:
    """t coordinates of a set of 64-bit hashes that isn't empty."""
    out, n, done = np.full(t, _FILL, np.uint64), len(shingles), 0
    while done < t:
        rounds = np.arange(done, min(t, done + max(1, min(t, 4096 // n))))
        h = _mix(shingles[None, :] * _MUL[rounds, None] + _ADD[rounds, None])
        bins = ((h >> _U(40)) * _U(t) >> _U(24)).astype(np.int64)
        values = (rounds.astype(np.uint64)[:, None] << _U(40)) | (h & _U((1 << 40) - 1))
        np.minimum.at(out, bins.ravel(), values.ravel())
        done = int(rounds[-1]) + 1
        if out.max() != _FILL:
            return out
    for b in np.flatnonzero(out == _FILL):  # rounds t to 2t-1: bin b takes the smallest of all
        h = _mix(shingles * _MUL[t + b] + _ADD[t + b])
        out[b] = (_U(t + b) << _U(40)) | (h & _U((1 << 40) - 1)).min()
    return out


def banding(percent: int) -> tuple[int, int]:
    """Bands and rows for links from percent on."""
    return (BANDS, ROWS) if percent >= 85 else LOOSE


def bands(coordinates: np.ndarray, n: int = BANDS) -> np.ndarray:
    """A signed 64-bit key for each of n bands; the number of the band is part of it."""
    own = _mix(coordinates * _BAND[: len(coordinates)]).reshape(n, -1).sum(axis=1, dtype=np.uint64)
    return _mix(own + np.arange(n, dtype=np.uint64)).view(np.int64)


def sketches(docs: DataFrame, size: int = 3, banded: tuple[int, int] = (BANDS, ROWS)) -> DataFrame:
    """(doc_id, text_hash, n_shingles, set_key, bands) of each row; set_key is a 128-bit digest of the whole set."""
    n_bands, t = banded[0], banded[0] * banded[1]

    def run(batches):
        shingler = Shingler(size)
        for b in slices(batches):
            n, keys, bs = [], [], []
            for text in b["text"].to_pylist():
                s = shingler(text)
                n.append(len(s))
                keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                bs.append(bands(sketch(s, t), n_bands) if len(s) else None)
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["text_hash"], pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(bs, pa.list_(pa.int64()))], names=["doc_id", "text_hash", "n_shingles", "set_key", "bands"])

    return texts_of(docs).mapInArrow(run, "doc_id long, text_hash long, n_shingles long, set_key binary, bands array<long>")


def texts_of(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))


def confirmed(pairs: DataFrame, texts: DataFrame, percent: int, size: int = 3) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union; texts: (node, text).

    A node of very many pairs is no hot key: its pairs are dealt out, and its text goes to each part.
    """
    pairs = stage(pairs)

    def with_text(rows: DataFrame, side: str, by: str) -> DataFrame:
        own = texts.select(F.col("node").alias(side), F.col("text").alias("t" + side))
        return salted_join(rows, own, [side], F.col(by), HEAVY_TEXTS, pairs)

    def run(batches):
        shingles = lru_cache(maxsize=512)(Shingler(size))
        for batch in slices(batches):
            keep = []
            for x, y in zip(batch["ta"].to_pylist(), batch["tb"].to_pylist(), strict=True):
                p, q = shingles(x), shingles(y)
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(100 * both >= percent * (len(p) + len(q) - both) > 0)
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return with_text(with_text(pairs, "a", "b"), "b", "a").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def shingle_sets(texts: DataFrame, members: DataFrame, size: int = 3) -> DataFrame:
    """members (node, own, few) with their full sets as arrays h."""

    def run(batches):
        shingler = Shingler(size)
        for b in slices(batches):
            h = pa.array([shingler(t).view(np.int64) for t in b["text"].to_pylist()], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b["node"], b["own"], b["few"], h], names=["node", "own", "few", "h"])

    rows = members.join(texts, "node").select("node", "own", "few", "text")
    return rows.mapInArrow(run, "node long, own long, few boolean, h array<long>")


def by_prefix(sets: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs (a, b) of different components, one of them few, without loss.

    Sets of the wanted similarity share at least percent of either; so, with all shingles in one order,
    the first n - ceil(percent n / 100) + 1 of both have one in common. The order is by rarity: what
    many documents share comes last, and is joined on by none of them unless they hold little else.
    """
    one = sets.select("node", "own", "few", F.size("h").alias("n"), F.explode("h").alias("x"))
    rare = one.groupBy("x").agg(F.count("*").alias("df")).where("df > 1")
    # A shingle of one document only comes first and joins nothing: it is counted, not carried.
    kept = one.join(rare, "x").groupBy("node", "own", "few", "n").agg(F.sort_array(F.collect_list(F.struct("df", "x"))).alias("s"))
    kept = kept.withColumn("p", F.expr(f"n - cast((n * {percent} + 99) div 100 as int) + 1 - (n - size(s))")).where("p > 0")
    # left: how many shingles of the set stand at this place of the order or after it.
    place = kept.select("node", "own", "few", "n", F.size("s").alias("k"), F.posexplode(F.slice("s", 1, F.col("p"))).alias("i", "e"))
    first = stage(place.select("node", "own", "few", "n", F.col("e.x").alias("x"), (F.col("k") - F.col("i")).alias("left")))
    other = first.select(F.col("node").alias("y"), F.col("own").alias("yo"), F.col("n").alias("m"), "x", F.col("left").alias("yleft"))
    fits = F.least("n", "m") * 100 >= F.greatest("n", "m") * percent
    # The first shingle in common has all others in common after it, in both sets: enough must be left there.
    enough = F.least("left", "yleft") * (100 + percent) >= percent * (F.col("n") + F.col("m"))
    pairs = first.where("few").join(other, "x").where((F.col("own") != F.col("yo")) & fits & enough)
    return pairs.select(F.least("node", "y").alias("a"), F.greatest("node", "y").alias("b")).distinct()


def leaders(members: DataFrame) -> DataFrame:
    """The leader of each bucket, its highest rank (met, minus_id, n), with the size of its set."""
    top = F.max("rank")
    return members.groupBy("band", "key").agg((-top["minus_id"]).alias("leader"), top["n"].alias("leader_n"))


def classes_of(sketched: DataFrame) -> DataFrame:
    """The distinct sets of shingles: set_key, n, bands, a number (node), and the row of smallest id that has it (rep, rep_hash)."""
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    same = sketched.where("n_shingles > 0").groupBy("set_key", F.col("n_shingles").alias("n")).agg(F.min(order).alias("r"), F.first("bands").alias("bands"))
    # The number is written with the class, so that all later reads have the same.
    return same.select("set_key", "n", "bands", F.col("r.doc_id").alias("rep"), F.col("r.text_hash").alias("rep_hash"), F.monotonically_increasing_id().alias("node"))


def labelled(rows: DataFrame, labels: DataFrame, column: str, name: str) -> DataFrame:
    """rows with the component of a column's node, itself where it has no link."""
    own = labels.select(F.col("node").alias(column), F.col("component").alias(name))
    return rows.join(own, column, "left").withColumn(name, F.coalesce(name, column))


def linked_classes(docs: DataFrame, classes: DataFrame, percent: int, size: int) -> DataFrame:
    """(node, component) of the classes that have links."""
    exploded = classes.select("node", "n", F.posexplode("bands").alias("band", "key"))
    shared = exploded.groupBy("band", "key").agg(F.count("*").alias("c")).where("c > 1")
    buckets = stage(exploded.join(shared, ["band", "key"]).select("band", "key", "node", "n", "c"))
    # The leader of a bucket is the member that meets most others: of near copies, the one they were made from.
    met = buckets.groupBy("node").agg(F.sum("c").alias("met"))
    ranked = stage(buckets.join(met, "node").withColumn("rank", F.struct("met", (-F.col("node")).alias("minus_id"), "n")).drop("met", "c"))
    buckets = stage(salted_join(ranked, leaders(ranked), ["band", "key"], F.col("node")))
    wanted = stage(buckets.select("node").distinct().join(classes.select("node", "rep", "rep_hash"), "node"))
    few = F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted
    texts = texts_of(docs).join(few, F.col("doc_id").eqNullSafe(F.col("rep")) & (F.col("text_hash") == F.col("rep_hash")))
    texts = stage(texts.select("node", "text").dropDuplicates(["node"]))
    fits = F.least("n", "leader_n") * 100 >= F.greatest("n", "leader_n") * percent  # sizes allow a link

    # Stars: members against their bucket's leader, those that stay apart against a leader of their own.
    current, links = buckets, None
    for _ in range(STARS):
        pairs = current.where((F.col("node") != F.col("leader")) & fits).select(F.least("leader", "node").alias("a"), F.greatest("leader", "node").alias("b"))
        new = stage(confirmed(pairs.distinct(), texts, percent, size))
        links = new if links is None else stage(links.union(new).distinct())
        labels = stage(components(links))
        apart = stage(labelled(labelled(current.drop("own", "lead"), labels, "node", "own"), labels, "leader", "lead").where("own <> lead"))
        current = apart.drop("leader", "leader_n", "own", "lead")
        current = stage(salted_join(current, leaders(current), ["band", "key"], F.col("node")))
        if new.count() * 50 < current.select("node").distinct().count():
            break
    # Pairs that no star has settled: one member at least isn't in the component of its bucket's first leader.
    left = labelled(labelled(buckets, labels, "node", "own"), labels, "leader", "lead")
    mixed = left.groupBy("band", "key").agg(F.min("own").alias("lo"), F.max("own").alias("hi"), F.count("*").alias("c")).where("lo <> hi and c > 2")
    left = left.join(mixed, ["band", "key"]).groupBy("node", "own").agg(F.max(F.col("own") != F.col("lead")).alias("few"))
    more = stage(confirmed(by_prefix(stage(shingle_sets(texts, stage(left), size)), percent), texts, percent, size))
    return labels if more.isEmpty() else stage(components(links.union(more)))


def verdicts(docs: DataFrame, percent: int = 85, size: int = 3) -> DataFrame:
    """One row per row: doc_id, text_hash, n_shingles, component_id (smallest doc_id reachable), kept."""
    sk = stage(sketches(docs, size, banding(percent)))
    classes = stage(classes_of(sk))
    labels = stage(linked_classes(docs, classes, percent, size).join(classes.select("node", "rep"), "node"))
    # A component is named by the smallest doc_id in it, and a class without links by that of its rows.
    names = labels.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = salted_join(labels.select("node", "component"), names, ["component"], F.col("node")).select("node", "component_id", F.lit(True).alias("has_links"))
    named = classes.select("node", "set_key", "rep").join(named, "node", "left")
    named = stage(named.select("set_key", F.when(F.col("has_links"), F.col("component_id")).otherwise(F.col("rep")).alias("component_id")))
    rows = sk.select("doc_id", "text_hash", "n_shingles", "set_key").join(named, "set_key", "left")
    rows = rows.select("doc_id", "text_hash", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
    return rows.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def near_duplicates(docs: DataFrame, percent: int = 85, size: int = 3) -> DataFrame:
    """One row per row: doc_id, n_shingles, component_id (smallest doc_id reachable), kept.

    Links are pairs whose sets of shingles of size words have a similarity of percent or more.
    """
    return verdicts(docs, percent, size).drop("text_hash")


def keep_representatives(docs: DataFrame, percent: int = 85, size: int = 3) -> DataFrame:
    """One document of each component, the one of smallest doc_id, with all columns."""
    doc, text = fresh(docs, "_doc"), fresh(docs, "_text")
    gone = stage(verdicts(docs, percent, size).where("not kept").select(F.col("doc_id").alias(doc), F.col("text_hash").alias(text)).distinct())
    few = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    return docs.join(few, F.col("doc_id").cast("long").eqNullSafe(F.col(doc)) & (F.xxhash64(F.col("text").cast("string")) == F.col(text)), "left_anti")
