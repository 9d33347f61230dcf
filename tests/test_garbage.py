"""The garbage rule against its definition, over all documents and turns."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.plans import catalogue as registry

SF = "/root/testdata/sf0.001"


def garbage(text):
    if len(text.strip()) < 12:
        return False
    words = re.sub(r"[^\w]+", " ", text.strip().lower()).split()
    if len(words) >= 8 and Counter(words).most_common(1)[0][1] >= max(10, len(words) // 2):
        return True
    blob = re.sub(r"\s+", "", text.strip().lower())
    return len(blob) >= 24 and re.search(r"(.{1,8}?)\1{7,}", blob) is not None


ODD = ["", " ", "a" * 11, "a" * 24, "ab " * 12, "go " * 10 + "x y z", "Go, " * 10 + "p q r s t u v w x", "go " * 9 + "p q r", "junk " + "color" * 8 + " tail", "Éa" * 12, "one two three four five six seven eight", "word " * 20000, "a b c d e f g h i " * 12]


@pytest.mark.parametrize("text", [ODD])
def test_odd_texts(spark, text):
    got = {r["i"]: r["g"] for r in spark.createDataFrame(list(enumerate(text)), "i int, t string").select("i", T.garbage(F.col("t")).alias("g")).collect()}
    assert got == {i: garbage(t) for i, t in enumerate(text)}


def test_all_documents_and_turns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    turns = spark.read.parquet(f"{SF}/conversations.parquet").collect()
    want = Counter([("documents", r["doc_id"], garbage(r["text"])) for r in docs] + [("conversations", r["conv_id"] * 1000 + r["turn"], garbage(r["text"])) for r in turns])
    got = registry.QUERIES["K7_garbage"](spark, SF)
    assert Counter((r["source"], r["doc_id"], r["garbage"]) for r in got.collect()) == want
