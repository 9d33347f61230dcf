"""Exact deduplication as a log-structured merge index over digests of normalised texts.

Each task fills memtables of bounded bytes, in which a hit is compared byte by byte with the text it
hits. A memtable is flushed as a run sorted by digest. Runs are merged by range of digests, a bounded
number of entries in a range: run by run, new digests probe the Bloom filters of the range's older runs;
those that pass are looked up there by binary search, and a hit joins its entry, which keeps the best
document. What is left becomes a run with a filter of its own, and runs of a tier are compacted into one
of the next. Documents of one digest that come from different memtables are compared byte by byte
afterwards; only their texts are read again.

Defined results: a null text is an empty one and equals every text of white space only. Rows that repeat
a doc_id are members of their group each and share the verdict of that doc_id. A null doc_id counts as
the largest; in a group of null ids only, keep_id is null and all rows are kept (across memtables such
rows are told apart by digest alone). An empty table gives no row. Columns other than the two named are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm._common import BROADCAST_IDS, fresh, join_ids, slices, stage

SPACE_BYTES = b" \t\n\x0b\x0c\r"
MEMTABLE_BYTES = 64 << 20
_NO_ID = 2**63 - 1
_RUN = pa.schema([("doc_id", pa.int64()), ("n_points", pa.int64()), ("digest", pa.binary()), ("run", pa.string()), ("twin", pa.int32()), ("leader", pa.bool_()), ("run_n", pa.int64()), ("text_hash", pa.int64())])


def flush(table: dict, run: str) -> Iterator[pa.RecordBatch]:
    """The rows of a memtable sorted by digest; the first of each digest (most code points, smallest id) leads."""
    out: list[dict] = []
    for (digest, twin), (_, members) in sorted(table.items(), key=lambda x: x[0]):
        members.sort(key=lambda m: (-m[0], _NO_ID if m[1] is None else m[1]))
        for i, (n, doc, text_hash) in enumerate(members):
            out.append({"doc_id": doc, "n_points": n, "digest": digest, "run": run, "twin": twin, "leader": i == 0, "run_n": len(members), "text_hash": text_hash})
        if len(out) >= 20_000:
            yield pa.RecordBatch.from_pylist(out, schema=_RUN)
            out = []
    yield pa.RecordBatch.from_pylist(out, schema=_RUN)


def runs(docs: DataFrame, memtable_bytes: int = MEMTABLE_BYTES) -> DataFrame:
    """Level 0: a row per document, sorted by digest within each run; hits within a memtable are byte-verified."""

    def fill(batches):
        from pyspark import TaskContext

        part, table, size, flushed = TaskContext.get().partitionId(), {}, 0, 0
        for b in slices(batches):
            for doc, text, text_hash in zip(b["doc_id"].to_pylist(), b["text"].to_pylist(), b["text_hash"].to_pylist(), strict=True):
                body = text.encode("utf-8").translate(None, SPACE_BYTES)
                digest, twin = hashlib.sha256(body).digest(), 0
                while (entry := table.get((digest, twin))) is not None and entry[0] != body:
                    twin += 1  # another text of the same digest
                if entry is None:
                    table[digest, twin] = entry = (body, [])
                    size += len(body) + 200
                entry[1].append((len(text), doc, text_hash))
                size += 64
            if size >= memtable_bytes:
                yield from flush(table, f"{part}-{flushed}")
                table, size, flushed = {}, 0, flushed + 1
        yield from flush(table, f"{part}-{flushed}")

    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"), F.xxhash64(text).alias("text_hash"))
    return rows.mapInArrow(fill, "doc_id long, n_points long, digest binary, run string, twin int, leader boolean, run_n long, text_hash long")


class Run:
    """Entries sorted by key (digest and twin), and a Bloom filter over the keys."""

    def __init__(self, keys: np.ndarray, points: np.ndarray, ids: np.ndarray, sizes: np.ndarray, runs: np.ndarray):
        self.keys, self.points, self.ids, self.sizes, self.runs = keys, points, ids, sizes, runs
        self.filter = np.zeros(1 << max(6, (FILTER_BITS * len(keys)).bit_length()), bool)
        self.filter[self.places(keys)] = True

    def places(self, keys: np.ndarray) -> np.ndarray:
        """Four places of the filter for each key: words of its digest, which is spread evenly by itself."""
        return np.ascontiguousarray(keys).view("<u4").reshape(len(keys), -1)[:, :4] & np.uint32(len(self.filter) - 1)

    def probe(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the keys are in the run, and where."""
        able = np.flatnonzero(self.filter[self.places(keys)].all(axis=1))
        at = np.minimum(np.searchsorted(self.keys, keys[able]), len(self.keys) - 1)
        found = self.keys[at] == keys[able]
        return able[found], at[found]

    def take(self, at: np.ndarray, other: Run, which: np.ndarray) -> None:
        """Entries at take those of another run in: sizes add up, the most code points and then the smallest id stay."""
        self.sizes[at] += other.sizes[which]
        self.runs[at] += other.runs[which]
        better = (other.points[which] > self.points[at]) | ((other.points[which] == self.points[at]) & (other.ids[which] < self.ids[at]))
        self.points[at[better]], self.ids[at[better]] = other.points[which[better]], other.ids[which[better]]

    def only(self, which: np.ndarray) -> Run:
        return Run(*(x[which] for x in (self.keys, self.points, self.ids, self.sizes, self.runs)))


def merged(runs: list[Run]) -> Run:
    """One sorted run of runs that share no key."""
    cols = [np.concatenate([getattr(r, c) for r in runs]) for c in ("keys", "points", "ids", "sizes", "runs")]
    order = np.argsort(cols[0], kind="stable")
    return Run(*(c[order] for c in cols))


class DigestIndex:
    """The runs of a range of digests in tiers; each key is in one run."""

    def __init__(self):
        self.tiers: list[list[Run]] = [[]]

    def add(self, new: Run) -> None:
        for run in [r for tier in self.tiers for r in tier]:
            which, at = run.probe(new.keys)
            if len(which):
                run.take(at, new, which)
                rest = np.setdiff1d(np.arange(len(new.keys)), which, assume_unique=True)
                if not len(rest):
                    return
                new = new.only(rest)
        self.tiers[0].append(new)
        for i, tier in enumerate(self.tiers):
            if len(tier) >= FAN_IN:
                if i + 1 == len(self.tiers):
                    self.tiers.append([])
                self.tiers[i + 1].append(merged(tier))
                tier.clear()

    def entries(self) -> Run | None:
        runs = [r for tier in self.tiers for r in tier]
        return merged(runs) if runs else None


#: Bits of a filter per key at least, runs of a tier that are compacted, and entries of a range of digests, about.
FILTER_BITS, FAN_IN, RANGE_ROWS = 10, 8, 20_000
_KEY = np.dtype("S36")  # digest, then twin as four bytes
_MERGED = pa.schema([("digest", pa.binary()), ("twin", pa.int32()), ("keep_id", pa.int64()), ("group_size", pa.int64()), ("n_runs", pa.int64())])


def run_of(rows: pa.Table) -> Run:
    """A run of sorted rows with distinct digest and twin."""
    twins = rows["twin"].to_numpy().astype(">i4").tobytes()
    keys = b"".join(d + twins[4 * i : 4 * i + 4] for i, d in enumerate(rows["digest"].to_pylist()))
    column = lambda c: rows[c].to_numpy().astype(np.int64)
    return Run(np.frombuffer(keys, _KEY), column("n_points").copy(), rows["doc_id"].fill_null(_NO_ID).to_numpy().astype(np.int64).copy(), column("run_n").copy(), np.ones(len(rows), np.int64))


def merge_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by range, run and digest: the entries of each range's index, sorted by digest."""
    held, now, index = [], None, DigestIndex()

    def flushed() -> None:
        if held:
            index.add(run_of(pa.Table.from_batches(held)))
            held.clear()

    def finished() -> Iterator[pa.RecordBatch]:
        flushed()
        done = index.entries()
        if done is not None:
            keys = [k.ljust(36, b"\0") for k in done.keys.tolist()]
            ids = pa.array(done.ids, mask=done.ids == _NO_ID)
            yield pa.RecordBatch.from_arrays([pa.array([k[:32] for k in keys], pa.binary()), pa.array([int.from_bytes(k[32:], "big", signed=True) for k in keys], pa.int32()), ids, pa.array(done.sizes), pa.array(done.runs)], schema=_MERGED)

    for b in batches:
        marks = list(zip(b["range"].to_pylist(), b["run"].to_pylist(), strict=True))
        starts = [i for i in range(len(marks)) if i == 0 or marks[i] != marks[i - 1]] + [len(marks)]
        for x, y in zip(starts, starts[1:], strict=False):
            if now is not None and marks[x] != now:
                if marks[x][0] != now[0]:
                    yield from finished()
                    index = DigestIndex()
                else:
                    flushed()
            now = marks[x]
            held.append(b.slice(x, y - x))
    yield from finished()


def compact(level0: DataFrame) -> DataFrame:
    """Level 1: (digest, twin) with the document that stays, the group's size and its number of runs."""
    lead = level0.where("leader").select("run", "digest", "twin", "n_points", "doc_id", "run_n")
    ranges = max(1, -(-lead.count() // RANGE_ROWS))
    first = F.conv(F.substring(F.hex("digest"), 1, 8), 16, 10).cast("long")
    lead = lead.withColumn("range", F.floor(first * F.lit(ranges) / F.lit(1 << 32)).cast("long"))
    lead = lead.repartition(min(ranges, 20_000), "range").sortWithinPartitions("range", "run", "digest", "twin")
    return lead.mapInArrow(merge_ranges, "digest binary, twin int, keep_id long, group_size long, n_runs long")


def mismatches(docs: DataFrame, level0: DataFrame, level1: DataFrame) -> DataFrame:
    """(digest, run) of leaders whose bytes differ from those of the document that stays; none, if SHA-256 holds."""
    shared = level1.where("n_runs > 1").select("digest", "twin", "keep_id")
    met = level0.where("leader").select("doc_id", "digest", "run", "twin").join(shared, ["digest", "twin"])
    body = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.regexp_replace(F.coalesce("text", F.lit("")), "[\\x20\\x09-\\x0D]", "").alias("body"))
    met = stage(met)
    if met.isEmpty():
        return met.select("digest", "twin", "run")
    body = join_ids(body, met.select("doc_id").distinct(), "doc_id", "left_semi")
    texts = met.join(body, "doc_id").where(F.sha2("body", 256) == F.lower(F.hex("digest")))
    texts = texts.select("digest", "twin", "run", "doc_id", "keep_id", "body")
    kept = texts.where("doc_id = keep_id").groupBy("digest", "twin").agg(F.min("body").alias("kept_body"))
    return texts.join(kept, ["digest", "twin"]).where("body <> kept_body").select("digest", "twin", "run").distinct()


def verdicts(docs: DataFrame, memtable_bytes: int = MEMTABLE_BYTES) -> DataFrame:
    """One row per document: doc_id, text_hash, keep_id, group_size, kept, text_sha256 of the normalised text."""
    level0 = stage(runs(docs, memtable_bytes))
    level1 = stage(compact(level0))
    odd = stage(mismatches(docs, level0, level1))
    if not odd.isEmpty():  # texts of one digest in different runs: those of each such run form a group of their own
        again = F.hash("run").alias("apart")
        level0 = stage(level0.join(odd.withColumn("apart", again), ["digest", "twin", "run"], "left").withColumn("twin", F.coalesce("apart", "twin")).drop("apart"))
        level1 = stage(compact(level0))
    best = level1.select("digest", "twin", "keep_id", "group_size")
    out = level0.join(best, ["digest", "twin"])
    return out.select("doc_id", "text_hash", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def exact_dedup(docs: DataFrame, memtable_bytes: int = MEMTABLE_BYTES) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256 of the normalised text."""
    return verdicts(docs, memtable_bytes).drop("text_hash")


def keep_first(docs: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns; rows that repeat the id and group of one that stays do too."""
    doc, text = fresh(docs, "_doc"), fresh(docs, "_text")
    gone = stage(verdicts(docs).where("not kept").select(F.col("doc_id").alias(doc), F.col("text_hash").alias(text)).distinct())
    few = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    return docs.join(few, F.col("doc_id").cast("long").eqNullSafe(F.col(doc)) & (F.xxhash64(F.col("text").cast("string")) == F.col(text)), "left_anti")
