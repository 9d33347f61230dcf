"""Information-theoretic sanitisation of personal data.

Base spans come from patterns and checks. Protected are the kinds of personal data and the entities
themselves (one address, one number) that stand in two documents or more; a term near a span discloses
what stands there as far as the corpus shows that the two go together: with N documents, n of them with
the kind or entity, df with the term and co with the term within WINDOW words of its span, the pointwise
mutual information is log2(co N / (df n)) and the protected information is log2(N / n). A term discloses
if its share of that information reaches DISCLOSURE and chance doesn't explain co: with q = co / df and
p = n / N, co of df documents or more are such by chance with a probability of
exp(-df (q ln(q / p) + (1 - q) ln((1 - q) / (1 - p)))) at most (Chernoff), which must not exceed CHANCE.
Each occurrence of such a term outside base spans, in any document, is a span of kind "term"; sanitised
texts generalise base spans to their kind and remove such terms.

Only documents with a digit or an "@" can hold base spans; just these and those with a disclosing term
reach Python. Term counts cover all documents; of a document's words only those that stand near a span
somewhere, often enough that they can disclose at all, leave the task that reads it. All patterns are
matched in linear time.

Defined results: a null text is an empty one; a null doc_id and repeated rows stay one row each; an
empty table gives no row; columns other than doc_id and text are ignored (sanitize keeps them, whatever
their names). Copies of a text count as documents each.
"""

from __future__ import annotations

import hashlib
import re
import struct
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm._common import BROADCAST_IDS, fresh, lower_batches, slices, stage

KINDS = ["email", "ip", "card", "phone", "term"]
#: Possessive forms of the base patterns: what follows a run never starts with its characters, so none gives back.
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")  # a match starts where its first run of digits does
_CARD = re.compile(r"[0-9]++(?:[\x20-][0-9]++)*+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
WINDOW, DISCLOSURE, CHANCE = 4, 0.75, 0.01
_UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Matches of _EMAIL; only runs of characters that an "@" follows are tried, each from its start."""
    out, at, end, last = [], text.find("@"), 0, -1
    while at >= 0:
        # The run before the sign lies after the sign before it and after the last match.
        start = at
        low = max(end, last + 1)
        while start > low:
            step = max(low, start - 64)
            kept = len(text[step:start]) - len(text[step:start].rstrip(_LOCAL_CHARS))
            start -= kept
            if kept < 64:
                break
        m = _EMAIL.match(text, start) if start < at else None
        if m:
            out.append(m.span())
            end = m.end()
        last, at = at, text.find("@", max(end, at + 1))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start, then kind as listed."""
    found = [("email", *s) for s in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        found += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = m.group().replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    found.append(("card", *m.span()))
        if "+" in text:
            found += [("phone", *m.span()) for m in _PHONE.finditer(text) if 10 <= sum(c in "0123456789" for c in m.group()) <= 15]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


_LOCAL_CHARS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DIGIT = re.compile("[0-9]")


def told(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def entity_of(kind: str, value: str) -> int:
    """64 bits that stand for an address or a number, whatever its case and separators."""
    plain = value.translate(_UPPER) if kind in ("email", "ip") else "".join(c for c in value if c in "0123456789")
    return struct.unpack("<q", hashlib.blake2b(f"{kind}:{plain}".encode(), digest_size=8).digest())[0]


def words_outside(text: str, spans: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """(start, end) of the words of letters that no span overlaps, in one sweep over both; spans by start."""
    import regex

    out, i, reach = [], 0, 0
    for m in regex.finditer(r"\p{L}+", text):
        a, b = m.span()
        while i < len(spans) and spans[i][1] < b:
            reach = max(reach, spans[i][2])
            i += 1
        if reach <= a:
            out.append((a, b))
    return out


def terms_near(text: str, spans: list[tuple[str, int, int]], window: int = WINDOW) -> set[tuple[str, int, str]]:
    """(kind, entity, term) of the words of letters within window words of each span, outside all spans."""
    words = words_outside(text, spans) if spans else []
    starts, out = [a for a, _ in words], set()
    for kind, a, b in spans:
        entity = entity_of(kind, text[a:b])
        before, after = bisect_left(starts, a), bisect_left(starts, b)
        for s, e in words[max(0, before - window) : before] + words[after : after + window]:
            if e - s >= 3:
                out.add((kind, entity, text[s:e].translate(_UPPER)))
    return out


_NEAR = pa.list_(pa.struct([("kind", pa.string()), ("entity", pa.int64()), ("term", pa.string())]))


def find_spans(docs: DataFrame) -> DataFrame:
    """For documents that may hold spans: the kinds found, the entities found, and near (terms)."""

    def run(batches):
        for b in slices(batches):
            kinds, entities, near = [], [], []
            for t in b["text"].to_pylist():
                spans = base_spans(t)
                kinds.append(sorted({k for k, _, _ in spans}))
                entities.append(sorted({entity_of(k, t[x:y]) for k, x, y in spans}))
                near.append([dict(zip(("kind", "entity", "term"), x, strict=True)) for x in sorted(terms_near(t, spans))])
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.list_(pa.string())), pa.array(entities, pa.list_(pa.int64())), pa.array(near, _NEAR)], names=["kinds", "entities", "near"])

    rows = may_hold(docs).select(F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "kinds array<string>, entities array<bigint>, near array<struct<kind: string, entity: bigint, term: string>>")


def may_hold(docs: DataFrame, holds: bool = True) -> DataFrame:
    able = F.coalesce(F.col("text").cast("string").rlike("[0-9@]"), F.lit(False))
    return docs.where(able if holds else ~able)


def terms_of(docs: DataFrame) -> DataFrame:
    """(key, term) of the words of letters of each document; key is a hash of its text."""
    text = F.col("text").cast("string")
    words = F.array_distinct(F.split(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), "[^\\p{L}]+"))
    return docs.select(F.xxhash64(text).alias("key"), F.explode(words).alias("term"))


def few(ids: DataFrame) -> DataFrame:
    """ids, to be broadcast if a count shows them to be few."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def disclosing(docs: DataFrame, found: DataFrame, chance: float = CHANCE, share: float = DISCLOSURE) -> DataFrame:
    """(what, term): terms whose mutual information with a kind or an entity reaches the share, beyond chance."""
    total = float(docs.count())
    sure = -F.log(F.lit(chance))
    # Kinds are protected in all documents that hold them, entities where two documents do.
    kinds = found.select(F.explode("kinds").alias("what")).groupBy("what").agg(F.count("*").alias("n"))
    ids = found.select(F.explode(F.col("entities").cast("array<string>")).alias("what")).groupBy("what").agg(F.count("*").alias("n")).where("n > 1")
    n = stage(kinds.union(ids).withColumn("p", F.col("n") / total).where("p < 1"))
    both = F.array_distinct(F.flatten(F.transform("near", lambda x: F.array(F.struct(x["kind"].alias("what"), x["term"].alias("term")), F.struct(x["entity"].cast("string").alias("what"), x["term"].alias("term"))))))
    co = found.select(F.explode(both).alias("x")).groupBy("x.what", "x.term").agg(F.count("*").alias("co"))
    # A term of co documents discloses at best if no other document holds it; fewer can't be beyond chance.
    co = stage(co.join(n, "what").where(-F.col("co") * F.log("p") >= sure))
    terms = stage(co.select("term").distinct())
    df = terms_of(docs).join(few(terms), "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))
    p, q = F.col("p"), F.least(F.col("co") / F.col("df"), F.lit(1.0))
    rare = F.when(q < 1, (1 - q) * F.log((1 - q) / (1 - p))).otherwise(0.0)
    able = co.join(df, "term").where(F.log2(q / p) >= -share * F.log2(p))
    return able.where((q > p) & (F.col("df") * (q * F.log(q / p) + rare) >= sure)).select("what", "term")


def with_terms(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a further column, the disclosing terms that a text holds or null, and that column's name."""
    name, key = fresh(docs, "_terms"), fresh(docs, "_key")
    terms = stage(disclosing(docs, stage(find_spans(docs))).select("term").distinct())
    if terms.isEmpty():
        return docs.withColumn(name, F.lit(None).cast("array<string>")), name
    # One hash for two texts does no harm: each term is looked for in the text itself.
    held = stage(terms_of(docs).join(few(terms), "term").groupBy(F.col("key").alias(key)).agg(F.collect_set("term").alias(name)))
    return docs.join(held, F.xxhash64(F.col("text").cast("string")) == F.col(key), "left").drop(key), name


def term_places(text: str, spans: list[tuple[str, int, int]], terms: list[str] | None) -> list[tuple[int, int]]:
    """(start, end) of each occurrence of the terms outside spans."""
    if not terms:
        return []
    known = set(terms)
    return [(a, b) for a, b in words_outside(text, spans) if b - a >= 3 and text[a:b].translate(_UPPER) in known]


def pii(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_term."""
    rows, held = with_terms(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    counts = [f"n_{k}" for k in KINDS[:4]]

    def run(batches):
        for b in slices(batches):
            out = []
            for t, terms in zip(b["text"].to_pylist(), b[held].to_pylist(), strict=True):
                t = t or ""
                base = base_spans(t)
                places = term_places(t, base, terms)
                spans = sorted([*base, *(("term", *x) for x in places)], key=lambda s: (s[1], KINDS.index(s[0]), s[2]))
                out.append((*(sum(s[0] == k for s in base) for k in KINDS[:4]), hashlib.sha256(told(base).encode()).hexdigest(), told(spans), len(places)))
            cols = list(zip(*out, strict=True)) if out else [()] * 7
            types = [*[pa.int64()] * 4, pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([b["doc_id"], *(pa.array(c, k) for c, k in zip(cols, types, strict=True))], names=["doc_id", *counts, "base_sha256", "spans", "n_term"])

    some = marked(rows, held).mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_term long")
    rest = marked(rows, held, False).select("doc_id", *[F.lit(0).cast("long").alias(c) for c in counts], F.sha2(F.lit(""), 256).alias("base_sha256"), F.lit("").alias("spans"), F.lit(0).cast("long").alias("n_term"))
    return some.union(rest)


def marked(rows: DataFrame, terms: str, holds: bool = True) -> DataFrame:
    """The rows that may hold base spans or have terms, or all others."""
    able = F.coalesce(F.col("text").cast("string").rlike("[0-9@]"), F.lit(False)) | F.col(terms).isNotNull()
    return rows.where(able if holds else ~able)


def cleaned(text: str, extra: list[tuple[int, int]]) -> str:
    """Base spans become their kind in brackets, terms go; overlapping spans become one, named by the first."""
    spans = sorted([*base_spans(text), *(("term", a, b) for a, b in extra)], key=lambda s: (s[1], KINDS.index(s[0])))
    out, at = [], 0
    for i, (kind, a, b) in enumerate(spans):
        if a < at:
            at = max(at, b)
            continue
        out += [text[at:a], "" if kind == "term" else f"[{kind.upper()}]"]
        at = b
    return "".join([*out, text[at:]])


def sanitize(docs: DataFrame) -> DataFrame:
    """The same rows and columns, with text sanitised; documents without spans keep theirs to the byte."""
    rows, held = with_terms(docs)
    at = docs.columns.index("text")
    schema = docs.schema
    lower_batches(docs.sparkSession)

    def run(batches):
        for b in slices(batches):
            texts = [cleaned(t, term_places(t, base_spans(t), e)) for t, e in zip(b.column(at).to_pylist(), b.column(b.num_columns - 1).to_pylist(), strict=True)]
            cols = [*b.columns[:-1]]
            cols[at] = pa.array(texts, b.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(cols, names=b.schema.names[:-1])

    return marked(rows, held).mapInArrow(run, schema).union(marked(rows, held, False).drop(held))
