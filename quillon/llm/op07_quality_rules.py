"""Line-first cleaning with DataFrame functions only.

Rules judge each line: repeated lines, lines of navigation (many separators), boilerplate phrases,
symbols in place of prose, shouting, and lines without an end of sentence. Failing lines are removed;
a document that loses more than max_lost percent of its word characters is rejected, as is one that
fails the base rules (fewer than 50 words, or more than half of the words in repeated 3-word windows).

Defined results: a null text has no words and fails; rows with a null doc_id or that repeat stay one
row each; an empty table gives no row; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPLIT = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "#*$%&|<>"
SYMBOL = "[#*$%&|<>]"
#: Rules of a line: separators of navigation, and Java regular expressions, all of linear time.
SEPARATORS = [" | ", " » ", " › ", " · "]
BOILERPLATE = ["all rights reserved", "terms of use", "privacy policy", "cookie", "javascript", "lorem ipsum", "click here", "subscribe to"]
ENDS = r"""[.!?…:;。！？]["'”’»)\]]*[\x20\x09-\x0D]*\z"""
SHOUTING = r"\A[^\p{Ll}]*\z"
MIN_WORDS, MAX_REPEAT, MAX_LOST = 50, 50, 50


def words_of(text: Column) -> Column:
    """Words between white space; other white space than spaces is made spaces first, as splitting by one character is fast."""
    plain = F.replace(text, F.lit("\n"), F.lit(" "))
    rare = "[\\x09\\x0B-\\x0D]"
    return F.filter(F.split(F.when(plain.rlike(rare), F.regexp_replace(plain, rare, " ")).otherwise(plain), " "), lambda w: w != "")


def phrase_in(text: Column) -> Column:
    low, found = F.lower(text), F.lit(False)
    for x in BOILERPLATE:
        found = found | low.contains(x)
    return found


def line_fails(line: Column, phrases: Column) -> Column:
    """Whether a line with a word is removed; phrases: whether the text holds a boilerplate phrase at all."""
    letters = F.length(F.regexp_replace(line, r"[^\p{L}]", ""))
    symbols = F.length(line) - F.length(F.translate(line, SYMBOLS, ""))
    navigation = F.lit(False)
    for x in SEPARATORS:
        navigation = navigation | (line.contains(x) & (F.length(line) - F.length(F.replace(line, F.lit(x), F.lit(""))) >= 3 * len(x)))
    # The cheap halves come first: what follows an "and" is worked out for few lines only.
    ends = line.endswith(".") | line.endswith("!") | line.endswith("?") | line.rlike(ENDS)
    return ~ends | (line.rlike(SYMBOL) & (symbols * 20 > F.length(line))) | navigation | (line.rlike(SHOUTING) & (letters >= 20)) | (phrases & phrase_in(line))


def quality(docs: DataFrame, max_lost: int = MAX_LOST) -> DataFrame:
    """One row per document with the base counts, the verdict, lines, lines removed and the clean text."""
    t = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    t = t.withColumn("w", words_of(F.col("text")))
    # Hashes of the 3-word windows with their places, sorted: repeated windows are neighbours.
    t = t.withColumn("n_words", F.size("w").cast("long")).withColumn("k", F.transform("w", lambda x: F.xxhash64(x)))
    t = t.withColumn("h", F.expr("case when n_words >= 3 then transform(sequence(0, size(k) - 3), i -> xxhash64(k[i], k[i + 1], k[i + 2])) else array() end"))
    t = t.withColumn("s", F.expr("case when size(array_distinct(h)) < size(h) then sort_array(transform(h, (x, i) -> struct(x as x, i as i))) else array() end"))
    near = "filter(s, (e, k) -> coalesce(get(s, k - 1).x = e.x, false) or coalesce(get(s, k + 1).x = e.x, false))"
    t = t.withColumn("n_repeat_words", F.expr(f"size(array_distinct(flatten(transform({near}, e -> array(e.i, e.i + 1, e.i + 2)))))").cast("long"))
    t = t.withColumn("lines", F.filter(F.split("text", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")))
    t = t.withColumn("fresh", F.array_distinct("lines")).withColumn("phrases", phrase_in(F.col("text")))
    t = t.withColumn("good", F.filter("fresh", lambda x: ~line_fails(x, F.col("phrases"))))
    t = t.withColumn("word_chars", F.expr("aggregate(w, 0L, (n, x) -> n + length(x))")).withColumn("clean_text", F.array_join("good", "\n"))
    bare = F.length(F.regexp_replace("clean_text", SPLIT, "")).cast("long")
    t = t.withColumn("left_chars", F.when(F.size("good") == F.size("lines"), F.col("word_chars")).otherwise(bare))
    base = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT)
    return t.select(
        "doc_id", "n_words", "word_chars",
        F.when(F.col("text").rlike(SYMBOL), F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).otherwise(0).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size("fresh")).cast("long").alias("n_dup_lines"),
        "n_repeat_words", base.alias("base_failed"),
        (~base & ((F.col("word_chars") - F.col("left_chars")) * 100 <= F.col("word_chars") * max_lost)).alias("kept"),
        F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size("good")).cast("long").alias("n_lines_removed"),
        "clean_text",
    )
