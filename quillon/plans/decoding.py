"""Greedy and beam decoding of boxes, spans and labels, byte alphabets and small lookups."""

from __future__ import annotations

import base64
import math

from pyspark.sql import functions as F

from quillon.functions import dawg, greedy, recoder
from quillon.functions import sequences as S
from quillon.functions import text as T
from quillon.operators.per_group import per_group
from quillon.plans.evaluation import _PAIRED, text_pairs
from quillon.plans.evaluation import _CODES as _LETTERS
from quillon.plans.layout import _BOXES, boxes
from quillon.plans.registry import lines, query, table

_COLUMNS = ["box", "x", "y", "w", "h", "score"]


@query("H1_group_lines")
def group_lines(spark, sf_dir):
    out = per_group(boxes(spark, sf_dir), "page", _COLUMNS, greedy.group_lines, "line int, x double, y double, w double, h double, score double")
    return out.withColumn("score", F.round("score", 9))


@query("H2_order_words")
def order_words(spark, sf_dir):
    return per_group(boxes(spark, sf_dir), "page", _COLUMNS, lambda b: [(i, *x) for i, x in enumerate(greedy.order_words(b))], "place int, box int, line int")


@query("H3_reading_order")
def reading_order(spark, sf_dir):
    """Words whose block and line are known."""
    words = boxes(spark, sf_dir).select("page", "box", (F.col("box") % 2).alias("block"), F.floor(F.col("y") / 200).cast("int").alias("line"), "x", "y", "h")
    return per_group(words, "page", ["box", "block", "line", "x", "y", "h"], lambda w: list(enumerate(greedy.reading_order(w))), "place int, box int")


@query("H6_page_order")
def page_order(spark, sf_dir):
    return per_group(boxes(spark, sf_dir), "page", _COLUMNS, lambda b: list(enumerate(greedy.page_order(b))), "place int, box int")


@query("H10_iou_match")
def iou_match(spark, sf_dir):
    """Odd boxes of a page matched with even ones."""
    split = lambda b: greedy.match([x for x in b if x[0] % 2], [x for x in b if not x[0] % 2])
    return per_group(boxes(spark, sf_dir), "page", _COLUMNS, split, "box int, other int, iou double").withColumn("iou", F.round("iou", 9))


@query("H12_suppress")
def suppress(spark, sf_dir):
    def best(b):
        kept = S.suppress([(score, x, y, x + w, y + h) for _, x, y, w, h, score in b])
        return [(b[i][0], place) for place, i in enumerate(kept)]

    return per_group(boxes(spark, sf_dir), "page", _COLUMNS, best, "box int, place int")


@query("F5_non_overlapping")
def non_overlapping(spark, sf_dir):
    spans = boxes(spark, sf_dir).select("page", "score", (F.col("x") % 20).cast("int").alias("first"), (F.col("x") % 20 + F.col("w") % 5).cast("int").alias("last"))
    return per_group(spans, "page", ["score", "first", "last"], S.non_overlapping, "score double, first int, last int")


#: Codes of the recoder queries; their labels are box widths modulo 4.
_CODES = ((0,), (1,), (2, 3), (0, 1), (3, 3, 2), (2,))


def labels(spark, sf_dir):
    return boxes(spark, sf_dir).select("page", "box", (F.col("w") / 4 % 4).cast("int").alias("label"))


@query("G3_recoder_legal")
def recoder_legal(spark, sf_dir):
    legal = lambda g: [(recoder.legal(x := [v for _, v in g], _CODES), recoder.legal(x, _CODES, True))]
    return per_group(labels(spark, sf_dir), "page", ["box", "label"], legal, "legal boolean, partial boolean")


@query("G4_recoder_compose")
def recoder_compose(spark, sf_dir):
    return per_group(labels(spark, sf_dir), "page", ["box", "label"], lambda g: recoder.compose([v for _, v in g], _CODES) or [], "unit int, start int")


@query("G5_recoder_greedy")
def recoder_greedy(spark, sf_dir):
    return per_group(labels(spark, sf_dir), "page", ["box", "label"], lambda g: recoder.compose_greedy([v for _, v in g], _CODES), "unit int, start int")


@query("G12_no_repeat")
def no_repeat(spark, sf_dir):
    """The next of 4 labels after those of a page, scored by how often they occur there."""
    pick = lambda g: [(S.no_repeat_argmax([float(sum(v == i for _, v in g)) for i in range(4)], [v for _, v in g], 2),)]
    return per_group(labels(spark, sf_dir), "page", ["box", "label"], pick, "label int")


@query("G2_ctc_beam")
def ctc_beam(spark, sf_dir):
    """Prefix beams of width 4 over four classes; a line item is a step, its shares made of the item's keys."""
    share = lambda k: (F.col("l_partkey") * (k + 3) % 17 + 1).cast("double")
    t = lines(spark, sf_dir).select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("step"), *[share(k).alias(f"p{k}") for k in range(4)])

    def best(rows):
        steps = [[math.log(p / sum(r[1:])) for p in r[1:]] for r in rows]
        labels, score = S.ctc_beam(steps, 4)
        summed, _ = S.ctc_beam(steps, 4, best_path=True)
        legal, _ = S.ctc_beam(steps, 4, keeps=lambda x: recoder.legal(x, _CODES, True), ends=lambda x: recoder.legal(x, _CODES))
        return [("".join(map(str, labels)), "".join(map(str, summed)), "".join(map(str, legal)), round(score, 9))]

    return per_group(t, "page", ["step", "p0", "p1", "p2", "p3"], best, "labels string, best_path string, legal string, score double")


#: Words of the dictionary queries as units of _CODES, and the unit that parts words.
_DICTIONARY, _PART = [(0,), (1, 0), (1, 2, 2), (4, 1)], 5


@query("G6_dictionary_bonus")
def dictionary_bonus(spark, sf_dir):
    """What a page's labels gain: 0.25 for each word of the dictionary, 0.02 for a last word that begins one."""
    words = dawg.parse(dawg.pack(_DICTIONARY, len(_CODES)))
    bonus = lambda g: [(recoder.bonus([v for _, v in g], _CODES, _PART, words, True, True), recoder.bonus([v for _, v in g], _CODES, _PART, words, False, False))]
    return per_group(labels(spark, sf_dir), "page", ["box", "label"], bonus, "bonus double, complete double")


@query("G8_packed_words")
def packed_words(spark, sf_dir):
    """The words of each benchmark item as a packed graph in base64; then each word and its beginning looked up in what is read back."""
    w = table(spark, sf_dir, "benchmark").select("item_id", F.explode(F.array_distinct(F.split(F.regexp_replace(F.lower("text"), "[^a-z ]", ""), " "))).alias("w")).where("w <> ''")

    def look_up(rows):
        words = [[ord(c) - 96 for c in x] for (x,) in rows]
        coded = base64.b64encode(dawg.pack([tuple(x) for x in words], 27)).decode()
        graph = dawg.parse(base64.b64decode(coded))
        return [(x, len(coded), dawg.matches(graph, u, True), dawg.matches(graph, u[:-1], False), dawg.matches(graph, [*u, 1, 1, 1], True)) for (x,), u in zip(rows, words, strict=True)]

    return per_group(w, "item_id", ["w"], look_up, "w string, size int, whole boolean, begins boolean, longer boolean")


@query("G11_vocabulary", "with v as (select unnest(string_split(text, ' ')) as w from documents), i as (select distinct item_id, unnest(string_split(text, ' ')) as w from benchmark) select item_id, count(*) as known from i where w in (select w from v) group by item_id")
def vocabulary(spark, sf_dir):
    v = table(spark, sf_dir, "documents").select(F.explode(F.split("text", " ")).alias("w")).distinct()
    i = table(spark, sf_dir, "benchmark").select("item_id", F.explode(F.split("text", " ")).alias("w")).distinct()
    return i.join(v, "w", "left_semi").groupBy("item_id").agg(F.count("*").alias("known"))


@query("G8_base64", "select doc_id, md5(text) as digest, (4 * ceil(octet_length(encode(text)) / 3.0))::int as n from documents")
def base64_text(spark, sf_dir):
    coded = F.regexp_replace(F.base64(F.encode("text", "UTF-8")), r"\s", "")
    return table(spark, sf_dir, "documents").select("doc_id", coded.alias("c")).select("doc_id", F.md5(F.unbase64("c")).alias("digest"), F.length("c").alias("n"))


_ALPHABET = "with a as (select list_transform(range(0, 256), b -> case when b < 33 then chr((b + 256)::int) when b between 127 and 160 then chr((b + 162)::int) when b = 173 then chr(323) else chr(b::int) end) as t)"


@query("B7_byte_alphabet", f"{_ALPHABET} select doc_id, md5(array_to_string(list_transform(regexp_extract_all(hex(encode(text)), '..'), x -> t[('0x' || x)::int + 1]), '')) as digest from documents, a")
def byte_alphabet(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.byte_alphabet(F.col("text"))).alias("digest"))


@query("B8_bytes_back", "select doc_id, md5(text) as digest from documents")
def bytes_back(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.bytes_back(T.byte_alphabet(F.col("text")))).alias("digest"))


@query("B3_cjk_punctuation", r"select doc_id, len(regexp_extract_all(text, '[!-/:-@\[-`{-~\p{P}]'))::int as punctuation, len(regexp_extract_all(text, '[\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}]'))::int as cjk from documents")
def cjk_punctuation(spark, sf_dir):
    count = lambda p: F.regexp_count("text", F.lit(p)).cast("int")
    return table(spark, sf_dir, "documents").select("doc_id", count(f"[{T.PUNCT}]").alias("punctuation"), count(f"[{T.CJK}]").alias("cjk"))


@query("K5_edit_distance", f"{_PAIRED}, {_LETTERS} select source, doc_id, levenshtein(translate(lower(h), f, g), translate(lower(r), f, g))::int as d from t, k")
def edit_distance(spark, sf_dir):
    """Of texts as sequences; K6 has the one of words."""
    return text_pairs(spark, sf_dir).select("source", "doc_id", S.token_distance(F.split(F.lower("h"), ""), F.split(F.lower("r"), "")).alias("d"))


#: Layout labels by id, and OCR models by language code.
LABELS = ["caption", "footnote", "formula", "list_item", "page_footer", "page_header", "picture", "section_header", "table", "text", "title", "document_index", "code", "checkbox_selected", "checkbox_unselected", "form", "key_value_region"]
MODELS = {"en": "eng", "de": "deu", "fr": "fra", "es": "spa", "it": "ita", "pt": "por", "nl": "nld", "ru": "rus", "ar": "ara", "ja": "jpn", "ko": "kor", "zh": "chi_sim"}


@query("H24_label_name", f"select l_orderkey, l_linenumber, coalesce({LABELS}[(l_partkey % 20 + 1)::int], 'unknown') as label from lineitem")
def label_name(spark, sf_dir):
    name = F.coalesce(F.get(F.array(*map(F.lit, LABELS)), (F.col("l_partkey") % 20).cast("int")), F.lit("unknown"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", name.alias("label"))


@query("F19_ocr_model", "select doc_id, case lang " + " ".join(f"when '{k}' then '{v}'" for k, v in MODELS.items()) + " end as model from documents")
def ocr_model(spark, sf_dir):
    models = F.create_map(*[F.lit(x) for pair in MODELS.items() for x in pair])
    return table(spark, sf_dir, "documents").select("doc_id", models[F.col("lang")].alias("model"))
