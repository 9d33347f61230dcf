"""Subword tokenizers over all documents. Each result is a digest of the ids, a text's ids joined by commas."""

from __future__ import annotations

import hashlib
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.functions import tokenizers as K
from quillon.plans.registry import query, table

#: Words that a vocabulary made of a table holds at most.
MOST_WORDS = 30_000
_LETTERS = [chr(c) for c in [*range(33, 127), *range(0xC0, 0x180)]]
_ROWS = 256  # texts that are worked on at once


def docs(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def public_file(name: str) -> str:
    """Where a vocabulary of a public tokenizer is installed, on this machine and on each executor."""
    import public_tokenizers

    return public_tokenizers.path(name)


def words_of(spark: SparkSession, sf_dir: str) -> list[tuple[str, int]]:
    """The most frequent words of the benchmark in lower case with their counts: a model's vocabulary, of bounded size."""
    w = table(spark, sf_dir, "benchmark").select(F.explode(T.find_all(F.lower("text"), r"\p{L}+")).alias("w"))
    top = w.groupBy("w").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "w").limit(MOST_WORDS)
    return [(r["w"], r["n"]) for r in top.collect()]


def wordpiece_vocab(spark, sf_dir) -> list[str]:
    return list(dict.fromkeys(["[PAD]", "[UNK]", "[CLS]", "[SEP]", *_LETTERS, *("##" + c for c in _LETTERS), *(w for w, _ in words_of(spark, sf_dir))]))


def unigram_pieces(spark, sf_dir) -> list[tuple[str, float]]:
    """Words with the log of their share, letters at a lower score, bytes."""
    words = words_of(spark, sf_dir)
    total = float(sum(n for _, n in words)) or 1.0
    pieces = [("<unk>", 0.0), ("<s>", 0.0), ("</s>", 0.0), *((f"<0x{b:02X}>", 0.0) for b in range(256)), (K.SPACE, -6.0), *((c, -12.0) for c in _LETTERS)]
    held = {p for p, _ in pieces}
    return pieces + [(p, round(-12.0 * (1 - n / total) / (1 + len(w) / 8), 6)) for w, n in words for p in (K.SPACE + w, w) if p not in held]


def over_texts(frame: DataFrame, make, columns: str = "n int, digest string", at_once: bool = False) -> DataFrame:
    """frame's first column and what make()'s function tells of its other ones, row by row (or of lists of them at once) within bounded batches."""
    key, *rest = frame.columns
    kind = frame.schema[key].dataType.simpleString()

    def run(batches):
        f = make()
        for big in batches:
            for i in range(0, big.num_rows, _ROWS):
                b = big.slice(i, _ROWS)
                values = [b[c].to_pylist() for c in rest]
                out = f(*values) if at_once else [f(*row) for row in zip(*values, strict=True)]
                cols = list(zip(*out, strict=True)) if out else [[] for _ in schema.names[1:]]
                yield pa.RecordBatch.from_arrays([b[key].cast(schema.field(0).type), *(pa.array(c, schema.field(j).type) for j, c in enumerate(cols, 1))], schema=schema)

    kinds = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string()}
    parts = [c.split() for c in columns.split(", ")]
    schema = pa.schema([(key, kinds[kind]), *((n, kinds[k]) for n, k in parts)])
    return frame.mapInArrow(run, f"{key} {kind}, {columns}")


def digest(ids) -> tuple[int, str]:
    return len(ids), hashlib.md5(",".join(map(str, ids)).encode()).hexdigest()


@lru_cache(maxsize=4)
def bpe_of(path: str, whole_first: bool = False) -> K.Bpe:
    """One tokenizer and its cache for each worker process."""
    return K.Bpe.of_file(path, whole_first=whole_first)


def _bpe(name: str, file: str, ids, whole_first: bool = False, doc: str = ""):
    @query(name)
    def run(spark, sf_dir):
        path = public_file(file)
        return over_texts(docs(spark, sf_dir), lambda: lambda t: digest(ids(bpe_of(path, whole_first), t or "")))

    run.__doc__ = doc
    return run


_bpe("B17_bpe_simple", "byte_bpe_50k.json", lambda m, t: m.simple(t), doc="Prompt fragments: cut at white space only.")
_bpe("B18_bpe_merge", "byte_bpe_50k.json", lambda m, t: m.pieces(K.of_java(T.GPT2).findall(t)), doc="Merges over the oldest byte-level cut.")
_bpe("B19_bpe_word_ends", "word_bpe_49k.json", lambda m, t: m.pieces(K.of_java(T.CLIP).findall(" ".join(t.split()).lower())), doc="Merges of words whose last symbol carries an end mark.")
_bpe("B20_bpe_encode", "byte_bpe_50k.json", lambda m, t: m.encode(t, 50256, 50256, 512), doc="With a first and a last id, special strings as one id, at most 512.")
_bpe("B35_o200k", "byte_bpe_50k.json", lambda m, t: m.pieces(K.O200K_PIECES.findall(t)), True, doc="A piece that is in the vocabulary skips the merges.")


@query("B12_deepseek_pretokens")
def deepseek(spark, sf_dir):
    t = docs(spark, sf_dir).select("doc_id", T.deepseek_pretokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").alias("n"), F.md5(F.array_join("t", "\x01")).alias("joined"))


@query("B4_normalize")
def normalize(spark, sf_dir):
    """The usual SentencePiece normalisation."""
    return over_texts(docs(spark, sf_dir), lambda: lambda t: (len(x := K.normalize(t or "")), hashlib.md5(x.encode()).hexdigest()))


@query("B22_split_words")
def split_words(spark, sf_dir):
    """Lower case without accents, then cut."""
    return over_texts(docs(spark, sf_dir), lambda: lambda t: (len(w := K.split_words(t or "")), hashlib.md5("\x01".join(w).encode()).hexdigest()))


@query("B21_wordpiece")
def wordpiece(spark, sf_dir):
    vocab = wordpiece_vocab(spark, sf_dir)
    return over_texts(docs(spark, sf_dir), lambda: (lambda m: lambda t: digest(m.ids(t or "")))(K.WordPiece(vocab)))


@query("B23_wordpiece_encode")
def wordpiece_encode(spark, sf_dir):
    vocab = wordpiece_vocab(spark, sf_dir)
    return over_texts(docs(spark, sf_dir), lambda: (lambda m: lambda t: digest(m.encode(t or "")))(K.WordPiece(vocab)))


def pairs(spark, sf_dir) -> DataFrame:
    """Every document with the next one, the last one with an empty text."""
    d = docs(spark, sf_dir)
    return d.join(d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("other")), "doc_id", "left").select("doc_id", "text", "other")


@query("B24_wordpiece_pair")
def wordpiece_pair(spark, sf_dir):
    vocab = wordpiece_vocab(spark, sf_dir)

    def make():
        model = K.WordPiece(vocab)

        def one(a, b):
            ids, types, mask = model.encode_pair(a or "", b or "")
            return sum(mask), digest([*ids, *types])[1]

        return one

    return over_texts(pairs(spark, sf_dir), make)


@lru_cache(maxsize=4)
def sentencepieces_of(pieces: tuple, merging: bool) -> K.SentencePieces:
    """One tokenizer and its cache for each worker process."""
    return K.SentencePieces(pieces, merging)


def _sentencepieces(name: str, method: str, merging: bool, doc: str = ""):
    @query(name)
    def run(spark, sf_dir):
        pieces = tuple(unigram_pieces(spark, sf_dir))

        def make():
            f = getattr(sentencepieces_of(pieces, merging), method)
            return lambda t: digest(f(K.normalize(t or "")))

        return over_texts(docs(spark, sf_dir), make)

    run.__doc__ = doc
    return run


_sentencepieces("B25_unigram", "pieces", False, doc="The greatest sum of scores.")
_sentencepieces("B26_spm_merge", "pieces", True, doc="The best neighbours first.")
_sentencepieces("B27_spm_encode", "encode", False, doc="With first and last id, at most 512.")


@query("B28_spm_pair")
def spm_pair(spark, sf_dir):
    """Two texts, the longer trimmed first. Every text is encoded once and meets its neighbour as the ids that a pair can hold."""
    pieces = tuple(unigram_pieces(spark, sf_dir))
    model = K.SentencePieces(pieces)
    room = model.max_length - 3

    def told(model, texts):
        return [(len(ids), ",".join(map(str, ids))) for ids in model.pieces_of([K.normalize(t or "") for t in texts], room)]

    def make():
        model = sentencepieces_of(pieces, False)
        return lambda texts: told(model, texts)

    # Keys of the right side are never null, so that no filter tells the two sides' shuffle apart: it is made once.
    d = over_texts(docs(spark, sf_dir), make, "a int, ids string", at_once=True).withColumn("key", F.col("doc_id").cast("string")).repartition("key")
    n, ids = told(model, [""])[0]  # beside the last document
    other = d.select(F.coalesce((F.col("doc_id") - 1).cast("string"), F.lit("")).alias("key"), F.col("a").alias("b"), F.col("ids").alias("others"))
    p = d.join(other, "key", "left").fillna({"b": n, "others": ids})
    # fit_pair over the lengths
    p = p.withColumn("over", F.expr(f"greatest(0, a + b - {room})"))
    p = p.withColumns({"more_a": F.expr("least(greatest(0, a - b), over)"), "more_b": F.expr("least(greatest(0, b - a), over)")})
    p = p.withColumn("rest", F.expr("over - more_a - more_b"))
    p = p.withColumns({"x": F.expr("int(a - more_a - (rest + 1) div 2)"), "y": F.expr("int(b - more_b - rest div 2)")})
    joined = F.expr(f"concat_ws(',', {model.first}, substring_index(ids, ',', x), {model.last}, substring_index(others, ',', y), {model.last})")
    return p.select("doc_id", F.expr("x + y + 3").alias("n"), F.md5(joined).alias("digest"))


@query("F2_token_offsets")
def token_offsets(spark, sf_dir):
    """Where each WordPiece token stands in its text: how many have a place, the last one's end, and a digest of all."""
    vocab = wordpiece_vocab(spark, sf_dir)

    def make():
        model = K.WordPiece(vocab)

        def one(t):
            text = t or ""
            places = K.align([model.names[i] for i in model.encode(text)], text)
            held = [p for p in places if p]
            return len(held), held[-1][1] if held else 0, hashlib.md5(str(places).encode()).hexdigest()

        return one

    return over_texts(docs(spark, sf_dir), make, "n int, last int, digest string")


@query("B31_unk_ratio", r"with v as (select distinct unnest(regexp_extract_all(lower(text), '\p{L}+')) as w from benchmark), t as (select doc_id, unnest(regexp_extract_all(lower(text), '\p{L}+')) as w from documents), n as (select doc_id, (count(*) filter (v.w is null) * 100 // count(*))::bigint as percent from t left join v using (w) group by doc_id) select doc_id, coalesce(percent, 0) as percent, coalesce(percent, 0) >= 50 as warns from documents left join n using (doc_id)")
def unk_ratio(spark, sf_dir):
    """The share of words that a vocabulary lacks, and whether that is worth a warning; a text without words has none."""
    words = lambda name, *keys: table(spark, sf_dir, name).select(*keys, F.explode(T.find_all(F.lower("text"), r"\p{L}+")).alias("w"))
    counted = words("documents", "doc_id").groupBy("doc_id", "w").agg(F.count("*").alias("n"))
    known = counted.join(words("benchmark").distinct().withColumn("known", F.lit(True)), "w", "left")
    n = known.groupBy("doc_id").agg(F.expr("sum(case when known is null then n else 0 end) * 100 div sum(n)").alias("percent"))
    return docs(spark, sf_dir).select("doc_id").join(n, "doc_id", "left").select("doc_id", F.coalesce("percent", F.lit(0)).alias("percent"), (F.coalesce("percent", F.lit(0)) >= 50).alias("warns"))


@query("B30_token_surface", "with w as (select doc_id, unnest(string_split(text, ' ')) as w from documents), v as (select w, row_number() over (order by w) - 1 as id from (select distinct w from w)), t as (select doc_id, sum(id)::bigint as ids, count(*) as n from w join v using (w) group by doc_id) select doc_id, ids, n, md5(text) as digest from t join documents using (doc_id)")
def token_surface(spark, sf_dir):
    """Words become the ids of a vocabulary that is numbered in its order, and the ids become words again."""
    words = docs(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", " ", -1)).alias("pos", "w"))
    vocab = numbered(words.select("w").distinct(), "w")
    ids = words.join(vocab, "w").select("doc_id", "pos", "id")
    back = ids.join(vocab, "id").groupBy("doc_id").agg(F.sum("id").alias("ids"), F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("pos", "w")))["w"].alias("w"))
    return back.select("doc_id", "ids", "n", F.md5(F.array_join("w", " ")).alias("digest"))


def numbered(distinct: DataFrame, column: str) -> DataFrame:
    """(column, id): ids from 0 in the order of the column, without one task that sorts all.

    Rows are numbered within the groups of their first bytes; a group begins where those before it end.
    """
    from pyspark.sql import Window

    head = F.substring(F.rpad(F.hex(F.encode(column, "UTF-8")), 6, "0"), 1, 6)
    rows = distinct.withColumn("head", head)
    before = Window.orderBy("head").rowsBetween(Window.unboundedPreceding, -1)  # a row per group
    starts = rows.groupBy("head").agg(F.count("*").alias("n")).select("head", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    place = F.row_number().over(Window.partitionBy("head").orderBy(column)) - 1
    return rows.withColumn("place", place).join(starts, "head").select(column, (F.col("base") + F.col("place")).alias("id"))


@query("B32_gliner_words", r"with t as (select doc_id, regexp_extract_all(text, '[0-9A-Za-z_\x{80}-\x{10FFFF}]+(?:[-_][0-9A-Za-z_\x{80}-\x{10FFFF}]+)*|\S') as w, string_split_regex(text, '[0-9A-Za-z_\x{80}-\x{10FFFF}]+(?:[-_][0-9A-Za-z_\x{80}-\x{10FFFF}]+)*|\S') as g from documents), o as (select doc_id, unnest(list_zip(g[1 : len(w)], w)) as p, unnest(range(0, len(w))) as i from t), e as (select doc_id, i, sum(strlen(p[1]) + strlen(p[2])) over (partition by doc_id order by i) as e from o), d as (select doc_id, md5(string_agg(e::bigint::varchar, ',' order by i)) as ends from e group by doc_id) select t.doc_id, len(w)::int as n, md5(array_to_string(w, chr(1))) as joined, coalesce(ends, md5('')) as ends from t left join d on d.doc_id = t.doc_id")
def gliner_words(spark, sf_dir):
    """Words and where each one ends, in bytes."""

    def make():
        pattern = K.of_java(T.GLINER)

        def one(t):
            found, ends, at, total = [], [], 0, 0
            for m in pattern.finditer(t or ""):
                total += len(t[at : m.end()].encode())
                at = m.end()
                found.append(m.group())
                ends.append(total)
            return len(found), hashlib.md5("\x01".join(found).encode()).hexdigest(), hashlib.md5(",".join(map(str, ends)).encode()).hexdigest()

        return one

    return over_texts(docs(spark, sf_dir), make, "n int, joined string, ends string")
