"""Document sinks as columns, assembly, and the model registry. Orders are pages, eight to a document; boxes are words."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions import greedy
from quillon.functions import render as R
from quillon.operators.per_group import per_group
from quillon.plans.layout import _BOXES, boxes
from quillon.plans.registry import query, table
from quillon.sources import pictures

_WIDE, _HIGH = 1200, 900


def words(spark, sf_dir) -> DataFrame:
    b = boxes(spark, sf_dir).withColumn("line", F.floor(F.col("y") / 100).cast("int"))
    text = F.concat(F.lit("w<"), F.col("box").cast("string"), F.lit(">"))
    return b.select("page", "line", F.struct("x", "box", "y", "w", "h", F.col("score").alias("confidence"), text.alias("text")).alias("word"))


def documents(spark, sf_dir) -> DataFrame:
    """(doc, pages) as the renderers take them."""
    word = F.col("word")
    lines = words(spark, sf_dir).groupBy("page", "line").agg(F.sort_array(F.collect_list("word")).alias("words"), F.min(word["x"]).alias("x"), F.min(word["y"]).alias("y"), F.max(word["x"] + word["w"]).alias("r"), F.max(word["y"] + word["h"]).alias("b"))
    line = F.struct("line", "x", "y", (F.col("r") - F.col("x")).alias("w"), (F.col("b") - F.col("y")).alias("h"), "words")
    pages = lines.groupBy("page").agg(F.sort_array(F.collect_list(line)).alias("lines"))
    page = F.struct("page", F.lit(_WIDE).alias("width"), F.lit(_HIGH).alias("height"), "lines")
    return pages.groupBy(F.expr("page div 8").alias("doc")).agg(F.sort_array(F.collect_list(page)).alias("pages"))


_RANKED = (
    f"{_BOXES}, w as (select *, page // 8 as doc, y // 100 as line, replace(replace('w<' || box || '>', '<', '&lt;'), '>', '&gt;') as shown from b),"
    " n as (select *, dense_rank() over (partition by doc order by page) as pid, dense_rank() over (partition by page order by line) as lid, row_number() over l as wid, lead(x) over l as after,"
    " min(x) over p as lx, min(y) over p as ly, max(x + w) over p as lr, max(y + h) over p as lb from w window p as (partition by page, line), l as (partition by page, line order by x, box))"
)


def _escaped(text: str) -> str:
    return text.replace("'", "''").replace("\n", "' || chr(10) || '")


def _nested(head: str, word: str, line: str, line_end: str, page: str, page_end: str, tail: str, between: str = "", words_by: str = "") -> str:
    return (
        f"{_RANKED}, a as (select doc, pid, lid, any_value({line}) || string_agg({word}, '{words_by}' order by wid) || '{_escaped(line_end)}' as t from n group by doc, pid, lid),"
        f" g as (select doc, pid, {page} || string_agg(t, '' order by lid) || '{_escaped(page_end)}' as t from a group by doc, pid)"
        f" select doc, md5('{_escaped(head)}' || string_agg(t, {between or chr(39) * 2} order by pid) || '{_escaped(tail)}') as digest from g group by doc"
    )


def _printf(pattern: str, *values: str) -> str:
    return f"printf('{_escaped(pattern)}', {', '.join(values)})"


@query("A10_text_sink", _nested("", "'w<' || box || '>'", "''", "\n", "''", "", "", "chr(12)", " "))
def text_sink(spark, sf_dir):
    return documents(spark, sf_dir).select("doc", F.md5(R.as_text(F.col("pages"))).alias("digest"))


@query("A11_hocr_sink", _nested(R.HOCR_HEAD, _printf(R.HOCR_WORD, "pid", "lid", "wid", "x", "y", "x + w", "y + h", "floor(score * 100)::int", "shown"), _printf(R.HOCR_LINE, "pid", "lid", "lx", "ly", "lr", "lb"), "</span>\n", _printf(R.HOCR_PAGE, "pid", str(_WIDE), str(_HIGH), "pid - 1"), "</div>\n", R.HOCR_TAIL))
def hocr_sink(spark, sf_dir):
    return documents(spark, sf_dir).select("doc", F.md5(R.as_hocr(F.col("pages"))).alias("digest"))


_SPACED = _printf(R.ALTO_WORD, "shown", "x", "y", "w", "h", "score") + " || case when after is null then '' else " + _printf(R.ALTO_SPACE, "case when after > x + w then after - x - w else 4 end", "x + w", "y") + " end"


@query("A12_alto_sink", _nested(R.ALTO_HEAD, _SPACED, _printf(R.ALTO_BLOCK, "pid - 1", "lid - 1", *["lx", "ly", "lr - lx", "lb - ly"] * 2), "</TextLine>\n</TextBlock>\n", _printf(R.ALTO_PAGE, "pid - 1", str(_WIDE), str(_HIGH)), "</PrintSpace>\n</Page>\n", R.ALTO_TAIL))
def alto_sink(spark, sf_dir):
    return documents(spark, sf_dir).select("doc", F.md5(R.as_alto(F.col("pages"))).alias("digest"))


@query("A14_render")
def render(spark, sf_dir):
    """Each page's regions, a line each, as one document in the format that is asked for."""
    word = F.col("word")
    line = F.struct(word["box"].alias("line"), word["x"].alias("x"), word["y"].alias("y"), word["w"].alias("w"), word["h"].alias("h"), F.array("word").alias("words"))
    pages = words(spark, sf_dir).groupBy("page").agg(F.sort_array(F.collect_list(line)).alias("lines"))
    kind = F.get(F.array(*map(F.lit, ["text", "hocr", "alto"])), (F.col("page") % 3).cast("int"))
    one = F.array(F.struct("page", F.lit(_WIDE).alias("width"), F.lit(_HIGH).alias("height"), "lines"))
    return pages.select("page", kind.alias("format"), F.md5(R.rendered(one, kind)).alias("digest"))


_KINDS = ["title", "section_header", "text", "table", "formula"]


@query("H8_markdown")
def markdown(spark, sf_dir):
    """Pages of odd numbers have a layout, three wide regions of the page's first boxes."""

    def assemble(rows):
        words_ = [(b, x, y, w, h, 0.0) for _, b, x, y, w, h in rows]
        by = {r[1]: r for r in rows}
        regions = [(b, f"w{b}" if b % 6 else "", *by[b][2:]) for b in greedy.page_order(words_)]
        layout = [(b, _KINDS[x % 5], x, y, x + 4 * w, y + 5 * h) for p, b, x, y, w, h in rows if p % 2 and b <= 3]
        tables = {i: f"<table>{i}</table>" for i, label, *_ in layout if label == "table"}
        formulas = {i: f"x_{i}" for i, label, *_ in layout if label == "formula"}
        return [(R.markdown(regions, layout, tables, formulas),)]

    b = boxes(spark, sf_dir).withColumn("number", F.col("page"))
    return per_group(b, "page", ["number", "box", "x", "y", "w", "h"], assemble, "markdown string")


@query("A16_provenance", "select doc_id, case when doc_id % 4 = 0 then '' else '# Generated: true' || chr(10) || case when doc_id % 3 = 0 then '' else '# Engine: ' || lang || chr(10) end || '# Note: " + pictures.NOTE + "' || chr(10) end as note from documents")
def provenance(spark, sf_dir):
    """The comment of a written picture, for every language as an engine, none where marking is off."""
    with_engine, without = (F.lit(t) for t in (pictures.provenance("\x01"), pictures.provenance(None)))
    told = F.when(F.col("doc_id") % 3 == 0, without).otherwise(F.replace(with_engine, F.lit("\x01"), F.col("lang")))
    return table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 4 == 0, "").otherwise(told).alias("note"))


#: Model families: name, file, dimension, licence and whether its acceptance has to be said.
MODELS = [("minilm", "minilm-q8.gguf", 384, "Apache-2.0", False), ("gte", "gte-q8.gguf", 384, "MIT", False), ("nomic", "nomic-q4.gguf", 768, "Apache-2.0", False), ("jina", "jina-q4.gguf", 1024, "CC-BY-NC-4.0", True), ("gemma", "gemma-q4.gguf", 768, "gemma", True)]
_MODELS = "m(name, file, dim, license, restricted) as (values " + ", ".join(f"('{n}', '{f}', {d}, '{c}', {r})".replace("True", "true").replace("False", "false") for n, f, d, c, r in MODELS) + ")"
_ASKED = "(['minilm', 'gte-q8.gguf', 'nomi', 'jina', 'gemma', 'none', 'q4'])[doc_id % 7 + 1]"


def models(spark) -> DataFrame:
    return spark.createDataFrame(MODELS, "name string, file string, dim int, license string, restricted boolean")  # a few rows


@query("A17_model_list", f"with {_MODELS} select name, file, dim, license, restricted from m")
def model_list(spark, sf_dir):
    return models(spark)


@query("A18_model_resolve", f"with {_MODELS}, d as (select doc_id, {_ASKED} as asked, doc_id % 2 = 0 as accepts from documents), f as (select doc_id, accepts, (select {{'n': name, 'f': file, 'l': license, 'r': restricted}} from m where name = asked or file = asked or contains(name, asked) or contains(file, asked) order by (name = asked or file = asked) desc, name limit 1) as hit from d) select doc_id, hit.f as file, hit.l as license from f where hit is not null and (not hit.r or accepts)")
def model_resolve(spark, sf_dir):
    """By name or file, else by a part of either; what is restricted only where its licence is accepted. Of several, the first by name."""
    asked = F.get(F.array(*map(F.lit, ["minilm", "gte-q8.gguf", "nomi", "jina", "gemma", "none", "q4"])), (F.col("doc_id") % 7).cast("int"))
    registry = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(f).alias("file"), F.lit(c).alias("license"), F.lit(r).alias("restricted")) for n, f, _, c, r in sorted(MODELS)])
    d = table(spark, sf_dir, "documents").select("doc_id", asked.alias("asked"))
    exact = F.filter(registry, lambda m: (m["name"] == F.col("asked")) | (m["file"] == F.col("asked")))
    part = F.filter(registry, lambda m: m["name"].contains(F.col("asked")) | m["file"].contains(F.col("asked")))
    hit = d.select("doc_id", F.coalesce(F.get(exact, F.lit(0)), F.get(part, F.lit(0))).alias("m")).where("m is not null")
    return hit.where("not m.restricted or doc_id % 2 = 0").select("doc_id", F.col("m.file").alias("file"), F.col("m.license").alias("license"))


#: Engines by the architecture that a model file declares; any other, and none, is the first.
ENGINES = ["pix2tex", "hmer", "bttr", "ppformulanet", "ppformulanet_l", "posformer", "mixtex", "qwen2vl", "internvl2", "parseq", "glm_ocr", "got_ocr", "tesseract_lstm", "granite_vision", "lightonocr", "deepseek_ocr2", "smoldocling", "unlimited_ocr", "smt_ocr", "tromr_ocr", "flova_ocr", "transcoda_ocr", "ppocrv6"]
_ALIASES = {"qwen3vl": "qwen2vl", "math_ocr": "pix2tex"}
_ARCHS = [*ENGINES, *_ALIASES, "something", ""]


@query("J10_engine_of_arch", f"select l_orderkey, l_linenumber, coalesce(map_extract_value(map {{{', '.join(f'{chr(39)}{a}{chr(39)}: {chr(39)}{_ALIASES.get(a, a)}{chr(39)}' for a in [*ENGINES, *_ALIASES])}}}, {_ARCHS}[(l_partkey % {len(_ARCHS)} + 1)::int]), 'pix2tex') as engine from lineitem")
def engine_of_arch(spark, sf_dir):
    named = F.create_map(*[F.lit(x) for a in [*ENGINES, *_ALIASES] for x in (a, _ALIASES.get(a, a))])
    arch = F.get(F.array(*map(F.lit, _ARCHS)), (F.col("l_partkey") % len(_ARCHS)).cast("int"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.coalesce(named[arch], F.lit("pix2tex")).alias("engine"))


@query("J11_capabilities", "select o_orderkey, o_orderstatus <> 'F' as layout, o_orderkey % 2 = 0 and o_custkey % 3 <> 0 as tables, o_orderkey % 3 = 0 and o_custkey % 5 <> 0 as formulas, o_orderpriority = '1-URGENT' as image_text_fallback from orders")
def capabilities(spark, sf_dir):
    """What a configuration can do: a stage needs its route switched on and a model named."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") != "F", "layout.gguf").otherwise("").alias("layout_model"), (F.col("o_orderkey") % 2 == 0).alias("route_tables"), F.when(F.col("o_custkey") % 3 != 0, "table.gguf").otherwise("").alias("table_model"), (F.col("o_orderkey") % 3 == 0).alias("route_formulas"), F.when(F.col("o_custkey") % 5 != 0, "formula.gguf").otherwise("").alias("formula_model"), (F.col("o_orderpriority") == "1-URGENT").alias("fallback"))
    return o.select("o_orderkey", (F.col("layout_model") != "").alias("layout"), (F.col("route_tables") & (F.col("table_model") != "")).alias("tables"), (F.col("route_formulas") & (F.col("formula_model") != "")).alias("formulas"), F.col("fallback").alias("image_text_fallback"))
