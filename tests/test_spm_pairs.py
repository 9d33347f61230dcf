"""SentencePiece ids by words and of pairs, against a pass over whole texts."""

import random

import pytest

from quillon.functions import tokenizers as K
from quillon.plans import tokenizers as plans
from quillon.plans.catalogue import QUERIES
from tests.test_tokenizers import SF, digest

rng = random.Random(2)
ODD = ["", " ", "a  b", "▁", "x▁▁y", "<s> </s> <0x41> <unk>", "☃☃ ☃", "é ①ﬀ", "\x01a\x8fb", "hatiha " * 300, "z" * 700, "漢字" * 40, "\n\n\t", "a" * 46 + " " + "b" * 47 + " " + "c" * 48 + " " + "d" * 600]


def whole(model: K.SentencePieces, text: str) -> list[int]:
    """Viterbi over all characters, every piece tried at each."""
    n = len(text)
    best, back = [0.0] + [None] * n, [(-1, [])] * (n + 1)
    for i in range(n):
        for end in range(i + 1, min(n, i + model.longest) + 1):
            p = model.ids.get(text[i:end])
            if p is not None and (best[end] is None or best[i] + model.scores[p] > best[end]):
                best[end], back[end] = best[i] + model.scores[p], (i, [p])
        if best[i + 1] is None:
            spelt = model.byte_ids(text[i])
            best[i + 1], back[i + 1] = best[i] - 100.0 * len(spelt), (i, spelt)
    out, at = [], n
    while at:
        at, ids = back[at]
        out.append(ids)
    return [i for ids in reversed(out) for i in ids]


def marked(model, text):
    return ((" " if model.prefix else "") + text).replace(" ", K.SPACE)


@pytest.fixture(scope="module")
def pieces(spark):
    return tuple(plans.unigram_pieces(spark, SF))


@pytest.fixture(scope="module")
def texts(spark):
    return [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(25).collect()]


def test_words_by_themselves_give_the_ids_of_the_whole_text(pieces, texts):
    texts = [K.normalize(t[:6000]) for t in [*texts, *ODD]]
    plain = K.SentencePieces(pieces)
    want = [whole(plain, marked(plain, t)) for t in texts]
    for most in (0, 1, 9, 509):
        assert K.SentencePieces(pieces).pieces_of(texts, most) == [w[:most] for w in want]
    model = K.SentencePieces(pieces)
    assert [model.pieces(t) for t in texts] == want and model.rounded


def test_vocabularies_with_ties_and_marks_inside_pieces():
    """Sums of tenths are told apart by rounding, which the sum before a word decides."""
    rounded = 0
    for _ in range(300):
        vocab = {"<unk>": 0.0, "<s>": 0.0, "</s>": 0.0} | {K.SPACE: -rng.randrange(1, 5) / 10 for _ in range(rng.randrange(2))}
        for _ in range(rng.randrange(1, 14)):
            vocab[rng.choice(["", K.SPACE]) + "".join(rng.choices("abc", k=rng.randrange(1, 4)))] = -rng.randrange(1, 9) / 10
        if rng.random() < 0.1:
            vocab[f"a{K.SPACE}b"] = -0.1
        model = K.SentencePieces(list(vocab.items()), prefix=rng.random() < 0.7, max_length=12)
        texts = ["".join(rng.choices("aabbc d", k=rng.randrange(40))) for _ in range(6)]
        want = [whole(model, marked(model, t)) for t in texts]
        assert model.pieces_of(texts, 9) == [w[:9] for w in want]
        assert [model.pieces(t) for t in texts] == want
        x, y = K.fit_pair(want[0], want[1], 9)
        assert model.encode_pair(texts[0], texts[1]) == [1, *x, 2, *y, 2]
        rounded += len(model.rounded)
    assert rounded


def test_kept_words_are_bounded(pieces, monkeypatch):
    model = K.SentencePieces(pieces)
    monkeypatch.setattr(model, "KEPT", 50)
    for k in range(40):
        t = " ".join("".join(rng.choices("aeinrst", k=6)) for _ in range(20))
        assert model.pieces_of([t], 500) == [whole(model, marked(model, t))] and model.pieces(t + " x") == whole(model, marked(model, t + " x"))
        assert len(model.kept) <= 51 and model.rounded <= model.kept.keys()


def test_a_pair_takes_no_more_words_than_it_holds(pieces):
    """It took time in proportion to all characters, at every piece's length."""
    model = K.SentencePieces(pieces)
    ids = model.encode_pair(" ".join(f"word{i}" for i in range(20_000)), "b")
    assert len(ids) == 512 and 0 < len(model.kept) <= 510


def test_rooms_of_pairs_need_no_more_than_a_room_of_each():
    for a in range(20):
        for b in range(20):
            for room in range(12):
                x, y = list(range(a)), list(range(b))
                assert K.fit_pair(x[:room], y[:room], room) == K.fit_pair(x, y, room)


def test_pairs_of_odd_tables(spark, tmp_path):
    """Null texts, ids that repeat, lack or are null; each text goes through Python once."""
    texts = [*ODD, None, "one two three", "w " * 700, "the house of cards " * 200]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, "again"), (4, "and again"), (None, "no id"), (None, None), (40, "far"), (-1, "before")]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    model = K.SentencePieces(plans.unigram_pieces(spark, str(tmp_path)))
    ids = lambda t: whole(model, marked(model, K.normalize(t or "")))
    want = []
    for i, t in rows:
        for other in [o for j, o in rows if i is not None and j == i + 1] or [None]:
            x, y = K.fit_pair(ids(t), ids(other), 509)
            want.append((i, *digest([1, *x, 2, *y, 2])))
    frame = QUERIES["B28_spm_pair"](spark, str(tmp_path))
    order = lambda row: (row[0] is None, row[0] or 0, *row[1:])
    assert sorted(map(tuple, frame.collect()), key=order) == sorted(want, key=order)
    assert frame.schema.simpleString() == "struct<doc_id:bigint,n:int,digest:string>"
    plan = frame._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("MapInArrow") == 1 and "ReusedExchange" in plan
