"""Language ID: the kernel by sets, ridge regression by dense algebra, held-out documents, awkward rows."""

import math
import random
import re
import zlib

import numpy as np
import pytest

from quillon.llm import op06_language_id as lid
from quillon.llm import queries


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def grams(text):
    """The blended spectrum by its definition, as a set of strings."""
    plain = " " + re.sub(r"[\W\d_]+", " ", text.lower()).strip() + " "
    return {plain[i : i + n] for n in (1, 2, 3) for i in range(len(plain) - n + 1)}


def test_kernel_equals_set_intersection():
    rng = random.Random(1)
    texts = ["".join(rng.choice("abcdeé ñ,1\n") for _ in range(rng.randint(1, 60))) for _ in range(60)]
    for a in texts[:30]:
        for b in texts[30:]:
            p, q = set(lid.spectrum(a).tolist()), set(lid.spectrum(b).tolist())
            x, y = grams(a), grams(b)
            # Hashing to places may join two n-grams, seldom.
            assert abs(len(p & q) - len(x & y)) <= 2 and abs(len(p) - len(x)) <= 1


def test_fit_equals_dense_kernel_ridge_regression():
    rng = random.Random(2)
    words = {"en": ["the", "and", "house", "with"], "fr": ["le", "et", "maison", "avec"], "es": ["el", "y", "casa", "con"]}
    data = [(lang, " ".join(rng.choice(words[lang]) for _ in range(12))) for lang in words for _ in range(20)]
    model = lid.fit([np.packbits(lid.presence(t)).tobytes() for _, t in data], [lang for lang, _ in data])
    # The same by sets: k(a, b) = |A & B| / sqrt(|A| |B|), all documents landmarks.
    sets = [set(lid.spectrum(t).tolist()) for _, t in data]
    k = np.array([[len(a & b) / math.sqrt(len(a) * len(b)) for b in sets] for a in sets])
    langs = sorted(words)
    order = [i for lang in langs for i, (x, _) in enumerate(data) if x == lang]
    y = np.array([[1.0 if lang == x else -1.0 for x in langs] for lang, _ in data])
    km = k[:, order]
    alpha = np.linalg.solve(km.T @ km + lid.RIDGE * len(data) * k[np.ix_(order, order)] + 1e-8 * np.eye(len(order)), km.T @ y)
    tests = ["the house and the house", "la maison et le", "casa con el y con", "xyz"]
    spectra = [set(lid.spectrum(t).tolist()) for t in tests]
    want = np.array([[len(a & sets[i]) / math.sqrt(max(1, len(a)) * len(sets[i])) for i in order] for a in spectra]) @ alpha
    got = model.scores([lid.spectrum(t) for t in tests])
    assert np.abs(got - want).max() < 2e-3 and lid.predict_batch(model, tests[:3])[0] == ["en", "fr", "es"]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_held_out_documents(spark, sf):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").collect()}
    got = rows_of(queries.op6_language_id(spark, f"/root/testdata/{sf}"))
    assert len(got) == len(docs)
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1
    held = [r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in got if r["held_out"]]
    assert sum(held) >= 0.97 * len(held) > 0


def test_labels_of_held_out_documents_are_not_learned(spark):
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 2]
    rows = [(i, "the house and", "en") if i % 2 else (i, "le maison et", "fr") for i in range(400) if i not in held] + [(i, "le maison et", "wrong") for i in held]
    got = {r["doc_id"]: r for r in rows_of(lid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")))}
    assert {r["lang_pred"] for r in got.values()} == {"en", "fr"} and all(got[i]["lang_pred"] == "fr" for i in held)


def test_awkward_rows(spark):
    schema = "doc_id long, text string, lang string, bits binary, hash long"
    rows = [(i, "the house and the cat " * (1 + i % 3), "en", None, 1) if i % 2 else (i, "le maison et le chat " * (1 + i % 3), "fr", None, 2) for i in range(60)]
    rows += [(100, None, "en", None, 1), (101, "", None, None, 1), (102, "12 345 !?", "fr", None, 1), (None, "le chat", None, None, None), (3, rows[3][1], "en", None, 1), (103, "word " * 50_000, None, None, 1)]
    df = spark.createDataFrame(rows, schema)
    got = rows_of(lid.identify(df))
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert all((by[i]["lang_pred"], by[i]["score"]) == ("und", 0.0) for i in (100, 101, 102)) and by[None]["lang_pred"] == "fr" and by[None]["held_out"] is False
    assert [r["lang_pred"] for r in got if r["doc_id"] == 3] == ["en", "en"]
    kept = lid.keep_identified(df)
    assert kept.columns == df.columns and sorted(str(r["doc_id"]) for r in rows_of(kept)) == sorted(str(r[0]) for r in rows if r[0] not in (100, 101, 102))
    none = spark.createDataFrame([], schema)
    assert rows_of(lid.identify(none)) == [] and rows_of(lid.keep_identified(none)) == []


def test_filter_rejects_by_score_and_keeps_texts_where_nothing_was_learned(spark):
    rows = [(i, "the house and the cat", "en") if i % 2 else (i, "le maison et le chat", "fr") for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert lid.keep_identified(df).count() == 80 and lid.keep_identified(df, min_score=1.01).count() == 0
    unlabelled = spark.createDataFrame([(1, "some text", None), (2, "12", None), (3, None, None)], "doc_id long, text string, lang string")
    assert [r["doc_id"] for r in rows_of(lid.keep_identified(unlabelled))] == [1]
    assert {r["lang_pred"] for r in rows_of(lid.identify(unlabelled))} == {"und"}


def test_only_few_rows_of_a_language_are_ranked(spark):
    """The sample is the first of each language by hash, as if all its rows were ranked, also with one id very often."""
    df = spark.range(5000).selectExpr("case when id < 1500 then 7 else id end as doc_id", "concat('the cat ', id) as text", "if(id % 3 = 0, 'a', 'b') as lang")
    model = lid.train(df, train_docs=40)
    assert model.languages == ["a", "b"]
