"""Quality rules against their definitions, line by line, over whole tables and awkward rows."""

import re
from collections import Counter

import pytest
import regex

from quillon.llm import op07_quality_rules as quality
from quillon.llm import queries

WORD = r"[^\x20\x09-\x0D]+"
PHRASES = ["all rights reserved", "terms of use", "privacy policy", "cookie", "javascript", "lorem ipsum", "click here", "subscribe to"]


def fails(line):
    """The rules of a line, one by one."""
    symbols = sum(c in "#*$%&|<>" for c in line)
    return (
        not regex.search(r"""[.!?…:;。！？]["'”’»)\]]*[\x20\x09-\x0D]*\Z""", line)
        or (symbols > 0 and symbols * 20 > len(line))
        or any(line.count(x) >= 3 for x in (" | ", " » ", " › ", " · "))
        or (not regex.search(r"\p{Ll}", line) and len(regex.findall(r"\p{L}", line)) >= 20)
        or any(x in line.lower() for x in PHRASES)
    )


def brute_force(text):
    text = text or ""
    words = re.findall(WORD, text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    places = {i + j for i, w in enumerate(windows) if often[w] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if re.search(WORD, x)]
    fresh = list(dict.fromkeys(lines))
    left = sum(len(w) for x in fresh if not fails(x) for w in re.findall(WORD, x))
    total = sum(map(len, words))
    base = len(words) < 50 or 100 * len(places) > 50 * len(words)
    return len(words), total, sum(c in "#*$%&|<>" for c in text), len(lines) - len(fresh), len(places), base, not base and (total - left) * 100 <= total * 50


FIELDS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_on_whole_tables(spark, sf):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").collect()}
    got = {r["doc_id"]: tuple(r[f] for f in FIELDS) for r in queries.op7_quality_rules(spark, f"/root/testdata/{sf}").collect()}
    assert got == {i: brute_force(t) for i, t in texts.items()}


def test_awkward_texts_and_clashing_columns(spark):
    prose = " ".join(f"word{i}" for i in range(60)) + "."
    texts = [None, "", " \n\t", prose, prose + "\n" + prose, "x " * 200, "A | B | C | D\n" * 3 + prose, "SHOUTING ALL OF THIS LINE NOW.\n" + prose, "# $ % & " * 30 + ".", prose + "\nClick here.", "tab\tand\x0bfeed " * 40 + ".", "é漢 " * 60 + "。", "one two three " * 30_000 + ".", "Weiß straße. » x"]
    schema = "doc_id long, text string, w int, lines string, kept string, k int"
    df = spark.createDataFrame([(i, t, 1, "l", "k", 2) for i, t in enumerate(texts)] + [(None, prose, None, None, None, None), (3, prose, 1, "l", "k", 2)], schema)
    got = [(r["doc_id"], tuple(r[f] for f in FIELDS)) for r in quality.quality(df).collect()]
    assert sorted(map(str, got)) == sorted(str((i, brute_force(t))) for i, t in [*enumerate(texts), (None, prose), (3, prose)])
    assert quality.quality(spark.createDataFrame([], schema)).collect() == []
