"""Licence scans with DataFrame functions only.

A text is normalised (lower case, words of letters, digits and dots) and its windows of words, wherever
they begin and end, are compared with templates by the Dice coefficient over distinct word bigrams:
notices, standard headers and whole licence texts. A window of d distinct bigrams that shares s with a
template of n reaches a coefficient t if its gain 2 s - t d is t n or more, so it shares at least
n t / (2 - t). Lines, paragraphs and the whole text are windows too.

A template is searched for in a text that shares that many of its bigrams at all. One pass keeps the
window that gains most, starting again where the gain is used up. Repeated bigrams count once in a
window, so that pass may miss; where its window doesn't reach t although an upper bound does (template
bigrams gain each time, others cost only at their first place in the text), all windows are tried.
A match also holds one of the template's anchor words: texts without one are not split into words.

Defined results: one row per document with all licences of coefficient min_dice or more by name, and
the best of them (ties: the template named first), else null licence and score 0; the score is that of
the window of most gain that was found. A null text has no word. Rows with a null doc_id or that repeat
stay one row each; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import json
import re
from functools import cache
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MIN_DICE = 0.8
#: Notices by which works name their licence, by SPDX identifier; one identifier may have several.
NOTICES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction'),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("ISC", "Licensed under the ISC License."),
    ("Apache-2.0", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
]


@cache
def texts() -> list[tuple[str, str]]:
    """Whole licence texts by SPDX identifier."""
    return [(p.stem, p.read_text("utf-8")) for p in sorted((Path(__file__).parent / "licenses").glob("*.txt"))]


def words(text: Column) -> Column:
    """Normalised words: lower case; letters, digits, and dots within a word."""
    return F.filter(F.split(F.lower(text), "(?:[^\\p{L}\\p{N}.]|\\.(?![\\p{L}\\p{N}]))+"), lambda w: w != "")


def bigrams(w: Column) -> Column:
    """64-bit hashes of the bigrams of an array of words, in order."""
    n = F.size(w) - 1
    return F.zip_with(F.slice(w, 1, n), F.slice(w, 2, n), lambda a, b: F.xxhash64(a, b))


def template_words(spark: SparkSession, templates: list[tuple[str, str]]) -> list[tuple[str, list[str], list[int]]]:
    """Name, words and bigrams of the templates, made by the same expressions as those of texts."""
    rows = spark.createDataFrame([(i, k, v) for i, (k, v) in enumerate(templates)], "i int, k string, v string")
    rows = rows.withColumn("w", words(F.col("v"))).where("size(w) > 1")
    return [(r["k"], r["w"], r["g"]) for r in rows.select("i", "k", "w", F.array_distinct(bigrams(F.col("w"))).alias("g")).orderBy("i").collect()]


def anchors(w: list[str], ratio: float) -> set[str]:
    """Words of which every match holds one.

    A match shares at least ratio of the template's bigrams; words are taken, those of five letters or
    more and of most bigrams first, until fewer bigrams than that are free of them.
    """
    left, out = set(zip(w, w[1:], strict=False)), set()
    need = ratio * len(left)
    while len(left) >= need:
        held: dict[str, int] = {}
        for a, b in left:
            for x in {a, b}:
                held[x] = held.get(x, 0) + 1
        x = max(held, key=lambda x: (len(x) >= 5, held[x], len(x), x))
        out.add(x)
        left = {(a, b) for a, b in left if x not in (a, b)}
    return out


def anchor_pattern(found: set[str]) -> str:
    """Not "\\b" but what words are made of: a word starts after any other character. Words share their first letter."""
    first: dict[str, list[str]] = {}
    for x in sorted(found):
        first.setdefault(x[0], []).append(re.sub(r"([.\\])", r"\\\1", x[1:]))
    return "(?<![\\p{L}\\p{N}])(?:" + "|".join(f"{a}(?:{'|'.join(v)})" for a, v in first.items()) + ")"


def found_window(marks: Column, n: Column, t: float) -> Column:
    """Dice of the window of most gain of marks (inn: in the template, prev: the place of the same bigram before), else 0."""
    need = t * n - 1e-9

    def step(acc: Column, x: Column) -> Column:
        fresh = x["prev"] < acc["start"]
        gain = F.when(~fresh, 0.0).when(x["inn"], 2.0 - t).otherwise(-t)
        upper = F.when(x["inn"], 2.0 - t).when(x["prev"] < 0, -t).otherwise(0.0)
        s, d = (fresh & x["inn"]).cast("int"), fresh.cast("int")
        return F.struct(acc["i"].alias("i"), acc["start"].alias("start"), (acc["sum"] + gain).alias("sum"), (acc["s"] + s).alias("s"), (acc["d"] + d).alias("d"), acc["best"].alias("best"), F.greatest(acc["up"] + upper, F.lit(0.0)).alias("up"), acc["most"].alias("most"))

    def settle(a: Column) -> Column:
        over = a["sum"] <= 0
        own = F.struct(a["sum"].alias("sum"), a["s"].alias("s"), a["d"].alias("d"))
        return F.struct(
            (a["i"] + 1).alias("i"), F.when(over, a["i"] + 1).otherwise(a["start"]).alias("start"), F.when(over, 0.0).otherwise(a["sum"]).alias("sum"),
            F.when(over, 0).otherwise(a["s"]).alias("s"), F.when(over, 0).otherwise(a["d"]).alias("d"), F.when(a["sum"] > a["best"]["sum"], own).otherwise(a["best"]).alias("best"),
            a["up"].alias("up"), F.greatest(a["most"], a["up"]).alias("most"),
        )

    bind = lambda value, f: F.transform(F.array(value), f)[0]
    none = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("s"), F.lit(0).alias("d"))
    zero = F.struct(F.lit(0).alias("i"), F.lit(0).alias("start"), F.lit(0.0).alias("sum"), F.lit(0).alias("s"), F.lit(0).alias("d"), none.alias("best"), F.lit(0.0).alias("up"), F.lit(0.0).alias("most"))
    passed = F.aggregate(marks, zero, lambda acc, x: bind(step(acc, x), settle))

    def from_place(m: Column, i: Column) -> Column:
        """The window of most gain that begins at place i."""
        start = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("s"), F.lit(0).alias("d"), none.alias("best"))

        def grow(acc: Column, x: Column) -> Column:
            fresh = x["prev"] < i
            gain = F.when(~fresh, 0.0).when(x["inn"], 2.0 - t).otherwise(-t)
            return bind(
                F.struct((acc["sum"] + gain).alias("sum"), (acc["s"] + (fresh & x["inn"]).cast("int")).alias("s"), (acc["d"] + fresh.cast("int")).alias("d"), acc["best"].alias("best")),
                lambda a: F.struct(a["sum"].alias("sum"), a["s"].alias("s"), a["d"].alias("d"), F.when(a["sum"] > a["best"]["sum"], F.struct(a["sum"].alias("sum"), a["s"].alias("s"), a["d"].alias("d"))).otherwise(a["best"]).alias("best")),
            )

        return F.aggregate(F.slice(m, i + 1, F.size(m)), start, grow)["best"]

    def every(m: Column) -> Column:
        places = F.filter(F.sequence(F.lit(0), F.size(m) - 1), lambda i: F.get(m, i)["inn"])
        return F.array_max(F.transform(places, lambda i: from_place(m, i)))

    dice = lambda b: F.when(b["sum"] >= need, 2.0 * b["s"] / (b["d"] + n)).otherwise(0.0)
    return bind(passed, lambda a: F.when(a["best"]["sum"] >= need, dice(a["best"])).when(a["most"] >= need, bind(every(marks), dice)).otherwise(0.0))


def scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None, min_dice: float = MIN_DICE) -> DataFrame:
    """One row per document: doc_id, n_segments (lines), n_compared (templates that share enough with the text), license, score, licenses."""
    known = template_words(docs.sparkSession, NOTICES + texts() if templates is None else templates)
    ratio = min_dice / (2 - min_dice)
    anchor = anchor_pattern({x for _, w, _ in known for x in anchors(w, ratio)})
    # A literal by constant folding, so that no row carries the templates.
    table = F.from_json(F.lit(json.dumps([{"i": -i, "k": k, "n": len(g), "g": g} for i, (k, _, g) in enumerate(known)])), "array<struct<i: int, k: string, n: int, g: array<bigint>>>")
    t = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    t = t.withColumn("able", F.lower("text").rlike(anchor))
    t = t.select("doc_id", F.size(F.split("text", "\n")).cast("long").alias("n_segments"), F.when(F.col("able"), words(F.col("text"))).otherwise(F.array().cast("array<string>")).alias("w"))
    t = t.withColumn("seq", F.when(F.size("w") > 1, bigrams(F.col("w"))).otherwise(F.array().cast("array<bigint>"))).withColumn("grams", F.array_distinct("seq"))
    enough = lambda x: (F.size("grams") >= x["n"] * ratio) & (F.size(F.array_intersect(x["g"], "grams")) >= x["n"] * ratio - 1e-9)
    t = t.withColumn("near", F.when(F.size("grams") > 0, F.filter(table, enough)))
    # Bigrams with the place of the same one before: neighbours once sorted.
    by_gram = F.sort_array(F.transform("seq", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    t = t.withColumn("by_gram", F.when(F.size("near") > 0, by_gram))
    before = lambda i: F.get("by_gram", i - 1)
    placed = F.transform("by_gram", lambda x, i: F.struct(x["i"].alias("i"), x["g"].alias("g"), F.when((i > 0) & (before(i)["g"] == x["g"]), before(i)["i"]).otherwise(-1).alias("prev")))
    t = t.withColumn("placed", F.sort_array(placed))
    marks = lambda x: F.transform("placed", lambda p: F.struct(F.array_contains(x["g"], p["g"]).alias("inn"), p["prev"].alias("prev")))
    hits = F.transform("near", lambda x: F.transform(F.array(marks(x)), lambda m: F.struct(found_window(m, x["n"], min_dice).alias("score"), x["i"].alias("order"), x["k"].alias("license")))[0])
    t = t.withColumn("hits", F.filter(F.coalesce(hits, F.array().cast("array<struct<score: double, order: int, license: string>>")), lambda h: h["score"] > 0)).withColumn("best", F.array_max("hits"))
    return t.select("doc_id", "n_segments", F.coalesce(F.size("near"), F.lit(0)).cast("long").alias("n_compared"), F.col("best.license").alias("license"), F.coalesce(F.col("best.score"), F.lit(0.0)).alias("score"), F.array_sort(F.array_distinct(F.transform("hits", lambda h: h["license"]))).alias("licenses"))
