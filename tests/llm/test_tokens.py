"""Token counts, SentencePiece and the batch look-up against the libraries."""

import hashlib
import random
import struct
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from quillon.llm import op03_token_counts as counts
from quillon.llm import op04_sentencepiece as spm
from quillon.llm import op05_packing as packing
from quillon.llm import queries
from quillon.llm._tokens import gather, pieces_of

BYTE, WORD, PIECES = P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json"), P.path("piece_bpe_32k.model")
ODD = ["", " ", "\n\t ", "a", "A  b c", "x" * 5000, "é漢字🙂 <|endoftext|> ▁▁ z", " lead", "trail ", "one  two\nthree four", "<|startoftext|> a", "tab\tand\x0bfeed", "İstanbul ﬁ"]
rng = random.Random(7)
TEXTS = ODD + ["".join(rng.choice("ab e\n ,.éñß漢▁🙂1'S") for _ in range(rng.randint(0, 40))) for _ in range(500)] + [" ".join(rng.choice(["the", "of", "house", "über"]) for _ in range(20)) for _ in range(50)]


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def test_counts_equal_the_library_with_and_without_the_first_tier():
    library = Tokenizer.from_file(BYTE)
    want = [len(library.encode(t, add_special_tokens=False).ids) for t in TEXTS]
    assert all("".join(counts.pre_tokens(t)) == t for t in TEXTS)
    words = sorted({w for t in TEXTS for w in counts.pre_tokens(t)})
    filled = {w: len(library.encode(w, add_special_tokens=False).ids) for w in words[::2] if "<|" not in w}
    for table in ({}, filled):
        counter = counts.TokenCounter(BYTE, table)
        assert [n for i in range(0, len(TEXTS), 100) for n in counter.count(TEXTS[i : i + 100])] == want
    assert counts.TokenCounter(BYTE, {" house": 99}).count(["a house"]) == [100]  # the first tier is asked


def test_frequent_table_holds_what_the_tokenizer_says(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    table = counts.frequent_table(docs, BYTE, entries=500)
    library = Tokenizer.from_file(BYTE)
    assert len(table) == 500 and all(n == len(library.encode(w, add_special_tokens=False).ids) for w, n in table.items())


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_count_query_on_whole_tables(spark, sf):
    library = Tokenizer.from_file(BYTE)
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").collect()}
    got = rows_of(queries.op3_token_counts(spark, f"/root/testdata/{sf}"))
    assert {r["doc_id"]: (r["n_bytes"], r["n_tokens"]) for r in got} == {i: (len(t.encode()), len(library.encode(t, add_special_tokens=False).ids)) for i, t in texts.items()}
    assert all(r["over_limit"] == (r["n_tokens"] > 1024) for r in got)


def test_gathered_ids_equal_the_library():
    library = Tokenizer.from_file(WORD)
    for texts in (TEXTS, [""], [], ["a"] * 3):
        batch = pa.array(["skipped", *texts, "skipped"])[1 : len(texts) + 1]
        ids, bounds = gather(packing.words_of(batch), pieces_of(WORD).look_up)
        assert [ids[x:y].tolist() for x, y in zip(bounds[:-1], bounds[1:], strict=True)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_pieces_equal_the_library_one_by_one_and_in_batches():
    model, library = spm.model_of(PIECES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    want = [library.encode(t) for t in TEXTS]
    for t, w in zip(TEXTS, want, strict=True):
        ids = model.encode(t)
        assert ids.tolist() == w and model.decode(ids) == library.decode(w)
    ids, bounds = spm.encode_batch(model, pa.array([*TEXTS, None]))
    assert [ids[x:y].tolist() for x, y in zip(bounds[:-1], bounds[1:], strict=True)] == [*want, []]
    plain = [t for t in TEXTS if t and "  " not in t and t == t.strip(" ") and "▁" not in t]
    ids, bounds = spm.encode_batch(model, pa.array(plain))
    assert [ids[x:y].tolist() for x, y in zip(bounds[:-1], bounds[1:], strict=True)] == [library.encode(t) for t in plain]


def test_runs_of_spaces_are_merged_in_little_time():
    model, library = spm.model_of(PIECES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for n in (17, 1000, 100_000):
        assert model.encode("a" + " " * n + "b").tolist() == library.encode("a" + " " * n + "b")
    some = random.Random(1)
    for _ in range(500):
        t = "".join(some.choice(["  ", "   ", " ", "a", "the", "\n", "é", " " * 16, "▁"]) for _ in range(some.randint(0, 30)))
        assert model.encode(t).tolist() == library.encode(t)


def field(number, value):
    """A field of a protocol buffer message: text, bytes, whole number or float."""

    def varint(n):
        return bytes([n]) if n < 128 else bytes([n & 127 | 128]) + varint(n >> 7)

    if isinstance(value, float):
        return varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    data = value.encode() if isinstance(value, str) else value
    return varint(number << 3 | 2) + varint(len(data)) + data


def test_unigram_models_equal_the_library(tmp_path):
    """A model written by hand, of pieces that overlap; the pass relaxes sums of scores."""
    some = random.Random(5)
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)]
    seen = set()
    for p in ["▁", "a", "b", "c", "ab", "bc", "abc", "▁a", "▁ab", "ca", "cab", "▁c", "bb", "aa", "aaa", "b▁c", "é"]:
        if p not in seen:
            seen.add(p)
            pieces.append((p, -some.uniform(1, 9) * len(p) ** 0.8, 1))
    spec = b"".join(field(1, field(1, p) + field(2, float(s)) + field(3, k)) for p, s, k in pieces)
    spec += field(2, field(3, 1)) + field(3, field(1, "identity") + field(3, 1) + field(4, 0))
    (tmp_path / "uni.model").write_bytes(spec)
    library = sentencepiece.SentencePieceProcessor(model_file=str(tmp_path / "uni.model"))
    model = spm.Model(spec)
    for _ in range(2000):
        t = "".join(some.choice("abc é☃") for _ in range(some.randint(0, 14)))
        assert model.encode(t).tolist() == library.encode(t), t
        assert model.decode(model.encode(t)) == library.decode(library.encode(t))


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_piece_query_on_whole_tables(spark, sf):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").collect()}
    got = {r["doc_id"]: r for r in rows_of(queries.op4_sentencepiece(spark, f"/root/testdata/{sf}"))}
    assert got.keys() == texts.keys()
    for i, t in texts.items():
        ids = library.encode(t)
        shown = library.decode(ids)
        assert (got[i]["n_tokens"], got[i]["ids_crc32"]) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        assert (got[i]["decoded_sha256"], got[i]["decoded_chars"]) == (hashlib.sha256(shown.encode()).hexdigest(), len(shown))


def test_awkward_rows_and_clashing_columns(spark):
    schema = "doc_id long, text string, ids int, n_tokens string, n_bytes long"
    rows = [(1, None, 1, "x", 2), (None, "a null id", 1, "x", 2), (2, "", 1, "x", 2), (2, "", None, None, None), (3, "word " * 50_000, 1, "x", 2), (4, "<|endoftext|> a", 1, "x", 2)]
    df = spark.createDataFrame(rows, schema)
    library, pieces = Tokenizer.from_file(BYTE), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"]) for r in rows_of(counts.token_counts(df, BYTE)))
    assert got == sorted((str(i), len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t, *_ in rows)
    got = sorted((str(r["doc_id"]), r["n_tokens"]) for r in rows_of(spm.round_trip(df, PIECES)))
    assert got == sorted((str(i), len(pieces.encode(t or ""))) for i, t, *_ in rows)
    none = spark.createDataFrame([], schema)
    assert rows_of(counts.token_counts(none, BYTE)) == [] and rows_of(spm.round_trip(none, PIECES)) == []
