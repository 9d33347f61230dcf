"""Tokenizers against the tokenizers and sentencepiece libraries, pre-tokenizers against their patterns."""

import hashlib
import random

import public_tokenizers as P
import pytest
import regex
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Regex, Tokenizer, models, normalizers, pre_tokenizers

from quillon.functions import text as T
from quillon.functions import tokenizers as K
from quillon.plans import tokenizers as plans
from quillon.plans.catalogue import QUERIES

SF = "/root/testdata/sf0.001"
rng = random.Random(1)
TEXTS = ["".join(rng.choice("ab e\n ,.éñß漢▁🙂1'S<|>xAB  \t·²") for _ in range(rng.randint(0, 40))) for _ in range(600)]
TEXTS += ["Hello the world's house 1234", "  two  spaces  ", "tabs\t\tand\r\n\r\nlines  ", "日本語 text、カタカナ", "I'LL DON'T don't", "", " ", "a  b"]


def digest(ids):
    return len(ids), hashlib.md5(",".join(map(str, ids)).encode()).hexdigest()


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def result(spark, name):
    return {r["doc_id"]: (r["n"], r["digest"]) for r in QUERIES[name](spark, SF).collect()}


@pytest.mark.parametrize("name", ["GPT2", "GPT4", "O200K", "MINISTRAL"])
def test_pre_tokenizers_equal_their_patterns(spark, name):
    """Also where white space is followed by white space, which SQL has no pattern for."""
    pattern = getattr(T, name)
    pattern = pattern % 3 if name == "GPT4" else pattern
    df = spark.createDataFrame(list(enumerate(TEXTS)), "i int, t string")
    got = {r["i"]: r["w"] for r in df.select("i", T.find_all(F.col("t"), pattern).alias("w")).collect()}
    for i, t in enumerate(TEXTS):
        want = [t[a:b] for _, (a, b) in pre_tokenizers.Split(Regex(pattern), "isolated").pre_tokenize_str(t)] if t else []
        plain = t.replace(" ", "x") == t  # Java's white space is ASCII here
        assert not plain or got[i] == want, t


def test_deepseek_splits_in_turn(spark):
    got = {r["i"]: r["w"] for r in spark.createDataFrame(list(enumerate(TEXTS)), "i int, t string").select("i", T.deepseek_pretokens(F.col("t")).alias("w")).collect()}
    main = r"[!-/:-@\[-`{-~][A-Za-z]+|[^\r\n\p{L}\p{P}\p{S}]?[\p{L}\p{M}]+| ?[\p{P}\p{S}]+[\r\n]*|\s*[\r\n]+|\s+(?!\S)|\s+"
    split = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(p), "isolated") for p in (r"\p{N}{1,3}", "[一-龥぀-ゟ゠-ヿ]+", main)])
    for i, t in enumerate(TEXTS):
        if " " not in t:
            assert got[i] == ([w for w, _ in split.pre_tokenize_str(t)] if t else []), t


def test_bert_words(spark):
    split = pre_tokenizers.BertPreTokenizer()
    clean = normalizers.BertNormalizer(clean_text=True, handle_chinese_chars=True, strip_accents=True, lowercase=True)
    for t in [*TEXTS, "Müller’s “café”\x07 in 東京、​!", "Ångström ÉTÉ"]:
        assert K.split_words(t) == [w for w, _ in split.pre_tokenize_str(clean.normalize_str(t))], t


def test_wordpiece_equals_the_library(spark, texts):
    vocab = plans.wordpiece_vocab(spark, SF)
    library = Tokenizer(models.WordPiece({t: i for i, t in enumerate(vocab)}, unk_token="[UNK]", max_input_chars_per_word=100))
    library.normalizer = normalizers.BertNormalizer(clean_text=True, handle_chinese_chars=True, strip_accents=True, lowercase=True)
    library.pre_tokenizer = pre_tokenizers.BertPreTokenizer()
    model = K.WordPiece(vocab)
    ids = lambda t: library.encode(t, add_special_tokens=False).ids
    for t in [*TEXTS, "x" * 101, "unaffable 漢"]:
        assert model.ids(t) == ids(t), t
    assert result(spark, "B21_wordpiece") == {i: digest(ids(t)) for i, t in texts.items()}
    assert result(spark, "B23_wordpiece_encode") == {i: digest([2, *ids(t)[:510], 3]) for i, t in texts.items()}

    def pair(a, b):
        a, b = ids(a), ids(b)
        while len(a) + len(b) > 509:
            (a if len(a) >= len(b) else b).pop()
        rest = 512 - len(a) - len(b) - 3
        return len(a) + len(b) + 3, digest([2, *a, 3, *b, 3, *[0] * rest, *[0] * (len(a) + 2), *[1] * (len(b) + 1), *[0] * rest])[1]

    assert result(spark, "B24_wordpiece_pair") == {i: pair(t, texts.get(i + 1, "")) for i, t in texts.items()}


def test_byte_level_bpe_equals_the_library(spark, texts):
    path = P.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    model = K.Bpe.of_file(path)
    ids = lambda t: library.encode(t, add_special_tokens=False).ids
    gpt2 = K.of_java(T.GPT2)
    assert all(model.pieces(gpt2.findall(t)) == ids(t) for t in TEXTS)
    assert result(spark, "B18_bpe_merge") == {i: digest(model.pieces(gpt2.findall(t)) if "<|" in t else ids(t)) for i, t in texts.items()}
    assert model.simple("  one two\n three ") == [x for w in ("one", " two", " three") for x in ids(w)]
    assert model.encode("a<|endoftext|>b <|none|>", 1, 2, 100) == [1, *ids("a"), 50256, *model.pieces(K.QWEN.findall("b <|none|>")), 2]
    assert model.encode("word " * 50, 1, 2, 7) == [1, *model.pieces(K.QWEN.findall("word " * 50))][:7]


def test_word_ends_and_whole_pieces(spark, texts):
    path = P.path("word_bpe_49k.json")
    library, model = Tokenizer.from_file(path), K.Bpe.of_file(path)
    even = lambda t: " ".join(t.split()).lower()
    assert all(model.pieces(K.of_java(T.CLIP).findall(even(t))) == library.encode(t, add_special_tokens=False).ids for t in TEXTS if "<|" not in t and " " not in t)
    data = P.path("byte_bpe_50k.json")
    first = K.Bpe.of_file(data, whole_first=True)
    assert all(first.pieces([t]) == [first.vocab[K.byte_chars(t)]] for t in (" the", "house", " of") if K.byte_chars(t) in first.vocab)
    small = K.Bpe({"a": 0, "b": 1, "c": 2, "ab": 3, "bc": 4, "abc": 5}, [("b", "c"), ("a", "b")], whole_first=False)
    assert small.pieces(["abc"]) == [0, 4] and K.Bpe(small.vocab, [("b", "c"), ("a", "b")], whole_first=True).pieces(["abc"]) == [5]
    assert K.Bpe({"a": 0, "aa": 1}, [("a", "a")]).pieces(["aaa?"]) == [1, 0]  # ties to the left, no id for what is unknown


def test_sentence_pieces_equal_the_library(spark, texts):
    pieces = plans.unigram_pieces(spark, SF)
    best = K.SentencePieces(pieces)
    library = Tokenizer(models.Unigram([(p, s) for p, s in pieces if not p.startswith("<0x")], 0, False))
    known = {p for p, _ in pieces}
    same = lambda ids: [pieces[i][0] for i in ids]
    score = lambda names: sum(dict(pieces)[p] for p in names)
    for t in list(texts.values())[:60]:
        marked = ("▁" + K.normalize(t).replace(" ", "▁"))[:400]
        if all(c in known for c in marked):
            mine, theirs = same(best.best_sum(marked)), [x.value if hasattr(x, "value") else x for x in library.encode(marked).tokens]
            assert "".join(mine) == marked == "".join(theirs) and abs(score(mine) - score(theirs)) < 1e-6
    assert best.best_sum("☃") == [best.ids[f"<0x{b:02X}>"] for b in "☃".encode()]
    merging = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    model = K.SentencePieces([(merging.id_to_piece(i), merging.get_score(i)) for i in range(merging.get_piece_size())], merging=True)
    for t in [*TEXTS, *list(texts.values())[:20], "a" + " " * 3000 + "b"]:
        if t and "▁" not in t:
            assert model.pieces(t) == merging.encode(t), t
    assert model.encode("a b")[0] == 1 and model.encode("a b")[-1] == 2
    x, y = model.pieces("one two three"), model.pieces("four")
    assert model.encode_pair("one two three", "four") == [1, *x, 2, *y, 2]


def test_pairs_are_trimmed_longest_first():
    for a in range(9):
        for b in range(9):
            for room in range(12):
                x, y = list(range(a)), list(range(b))
                while len(x) + len(y) > room:
                    (x if len(x) >= len(y) else y).pop()
                assert K.fit_pair(list(range(a)), list(range(b)), room) == (x, y)


def test_alignment():
    assert K.align(["[CLS]", "un", "##aff", "able", "[SEP]"], "unaff able") == [None, (0, 2), (2, 5), (6, 10), None]
    assert K.align(["<s>", "▁a", "bc", "▁toolong"], "abc d", "sentencepiece") == [None, (0, 1), (1, 3), None]


def test_normalisation():
    assert K.normalize("ﬁ Ａ​b\tc\x01d") == "fi A b cd"
    assert regex.sub(r"\s", "", K.normalize("①２　x")) == "12x"
