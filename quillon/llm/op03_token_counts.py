"""Token counts by a map-side lookup in two tiers, without any shuffle of pre-tokens.

Tier one is a broadcast table of the token counts of frequent pre-tokens, of bounded size. What it
lacks is encoded by the tokenizer and kept in the worker's own cache, of bounded size too.
Texts are cut only where the byte-level pre-tokenizer always cuts: before a space that follows a
character other than white space. Counts are therefore those of the whole text. A text that holds an
added token's string is encoded whole.

Defined results: null text counts as empty (0 bytes, 0 tokens); a null doc_id and repeated rows stay
as they are, one row each; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm._common import slices, small_batches
from quillon.llm._tokens import CACHE_ENTRIES, KEEP_LENGTH, pieces_of

#: Documents read for the frequent table (a bound; drawn at random over the whole input), and its entries.
SAMPLE_DOCS, TABLE_ENTRIES, MAX_LENGTH = 2_000, 32_768, 48
_WIDE = re.compile(r"\s ")


def pre_tokens(text: str) -> list[str]:
    """Cuts before each space that follows a character other than white space; joined, they give text."""
    if not text:
        return []
    parts = text.split(" ")
    if _WIDE.search(text) is None and text[0] != " ":
        return [parts[0], *[" " + p for p in parts[1:]]]
    out = [parts[0]]
    for p in parts[1:]:
        if out[-1] and not out[-1][-1].isspace():
            out.append(" " + p)
        else:
            out[-1] += " " + p
    return out


class TokenCounter:
    """Counts tokens of texts; table: the first tier."""

    def __init__(self, tokenizer_file: str, table: dict[str, int]):
        self.pieces, self.table, self.cache, self.old = pieces_of(tokenizer_file), table, dict(table), {}

    def count(self, texts: list[str]) -> list[int]:
        """Token counts of a batch of texts; what table and cache lack is encoded once."""
        ids, added = self.pieces.ids, self.pieces.added
        whole = [added.search(t) is not None for t in texts]
        words = [[] if w else pre_tokens(t) for t, w in zip(texts, whole, strict=True)]
        if len(self.cache) > CACHE_ENTRIES + len(self.table):
            self.cache, self.old = dict(self.table), self.cache
        cache, old = self.cache, self.old
        missing = set().union(*words).difference(cache)
        for w in missing:
            found = old.get(w)
            cache[w] = len(ids(w)) if found is None else found
        out = [len(ids(t)) if w else sum(map(cache.__getitem__, ws)) for t, w, ws in zip(texts, whole, words, strict=True)]
        for w in missing:
            if len(w) > KEEP_LENGTH:
                del cache[w]
        return out


_counters: dict[tuple[str, int], TokenCounter] = {}


def counter_of(tokenizer_file: str, shared) -> TokenCounter:
    """One counter for each worker process and broadcast table."""
    key = (tokenizer_file, id(shared.value))
    if key not in _counters:
        _counters.clear()
        _counters[key] = TokenCounter(tokenizer_file, shared.value)
    return _counters[key]


def frequent_table(docs: DataFrame, tokenizer_file: str, sample_docs: int = SAMPLE_DOCS, entries: int = TABLE_ENTRIES) -> dict[str, int]:
    """Token counts of the most frequent pre-tokens of at most sample_docs documents: at most entries of MAX_LENGTH characters."""
    total = docs.select("doc_id").count()
    some = docs.select("text").sample(min(1.0, sample_docs / max(1, total)), seed=7).limit(sample_docs)

    def words(batches):
        for b in slices(batches):
            seen = Counter(w for t in b["text"].to_pylist() if t for w in pre_tokens(t) if len(w) <= MAX_LENGTH)
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["w", "n"])

    with small_batches(docs.sparkSession):
        top = some.mapInArrow(words, "w string, n long").groupBy("w").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "w").limit(entries).toPandas()["w"].tolist()
    return dict(zip(top, map(len, map(pieces_of(tokenizer_file).ids, top)), strict=True)) if top else {}


def token_counts(docs: DataFrame, tokenizer_file: str, limit: int = 1024) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit)."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    shared = spark.sparkContext.broadcast(frequent_table(rows, tokenizer_file))

    def count(batches):
        counter = counter_of(tokenizer_file, shared)
        for b in slices(batches):
            n = counter.count(b["text"].to_pylist())
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["n_bytes"], pa.array(n, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    out = rows.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "text").mapInArrow(count, "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
