"""Boxes, routing, reading order, tables and image statistics. Boxes are derived from line items: an order is a page."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window

from quillon.functions import geometry as G
from quillon.plans.registry import LINES, lines, query, table

_BOXES = f"with {LINES}, b as (select l_orderkey as page, l_linenumber as box, (l_partkey * 7 % 800)::int as x, (l_suppkey * 13 % 800)::int as y, (20 + l_quantity * 4)::int as w, (10 + l_quantity)::int as h, l_discount as score from lines)"


def boxes(spark, sf_dir):
    return lines(spark, sf_dir).select(
        F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("box"), (F.col("l_partkey") * 7 % 800).cast("int").alias("x"), (F.col("l_suppkey") * 13 % 800).cast("int").alias("y"),
        (F.col("l_quantity") * 4 + 20).cast("int").alias("w"), (F.col("l_quantity") + 10).cast("int").alias("h"), F.col("l_discount").alias("score"),
    )


@query("H4_normalize_box", f"{_BOXES} select page, box, least(greatest(round(x * 1000.0::double / 900), 0), 1000)::int as nx, least(greatest(round(y * 1000.0::double / 900), 0), 1000)::int as ny from b")
def normalize_box(spark, sf_dir):
    return boxes(spark, sf_dir).select("page", "box", G.normalize_box(F.col("x"), F.lit(900)).alias("nx"), G.normalize_box(F.col("y"), F.lit(900)).alias("ny"))


_IOU = "greatest(least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x), 0) * greatest(least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y), 0)"


@query("H9_iou", f"{_BOXES}, p as (select a.page, a.box, b.box as other, {_IOU} as i, a.w * a.h + b.w * b.h as s from b a join b on a.page = b.page and a.box < b.box) select page, box, other, round(i::double / (s - i), 6) as iou from p where i > 0")
def iou(spark, sf_dir):
    """Pairs of boxes of one page: a page holds a bounded number of boxes."""
    a, b = boxes(spark, sf_dir).alias("a"), boxes(spark, sf_dir).alias("b")
    c = F.col
    v = G.iou(c("a.x"), c("a.y"), c("a.x") + c("a.w"), c("a.y") + c("a.h"), c("b.x"), c("b.y"), c("b.x") + c("b.w"), c("b.y") + c("b.h"))
    pairs = a.join(b, (c("a.page") == c("b.page")) & (c("a.box") < c("b.box")))
    return pairs.select("a.page", "a.box", c("b.box").alias("other"), F.round(v, 6).alias("iou")).where("iou > 0")


@query("H7_route", f"{_BOXES}, l as (select page, box as region, x, y, w * 3 as w, h * 3 as h, ['text', 'table', 'formula'][box % 3 + 1] as label from b where box <= 3), r as (select b.page, b.box, min(l.region) as region from b left join l on l.page = b.page and b.x + b.w / 2.0 between l.x and l.x + l.w and b.y + b.h / 2.0 between l.y and l.y + l.h group by all) select r.page, r.box, r.region, coalesce(l.label in ('table', 'formula'), false) as suppressed from r left join l on l.page = r.page and l.region = r.region")
def route(spark, sf_dir):
    """Each box goes to the first region that holds its centre; tables and formulas suppress its text."""
    b = boxes(spark, sf_dir)
    label = F.get(F.array(*map(F.lit, ["text", "table", "formula"])), F.col("box") % 3)
    region = b.where("box <= 3").select("page", F.struct(F.col("box").alias("region"), label.alias("label"), "x", "y", (F.col("w") * 3).alias("w"), (F.col("h") * 3).alias("h")).alias("r"))
    regions = region.groupBy("page").agg(F.sort_array(F.collect_list("r")).alias("regions"))
    cx, cy = F.col("x") + F.col("w") / 2.0, F.col("y") + F.col("h") / 2.0
    holds = F.filter("regions", lambda r: cx.between(r["x"], r["x"] + r["w"]) & cy.between(r["y"], r["y"] + r["h"]))
    out = b.join(regions, "page", "left").withColumn("owner", F.get(holds, F.lit(0)))
    return out.select("page", "box", F.col("owner.region").alias("region"), F.coalesce(F.col("owner.label").isin("table", "formula"), F.lit(False)).alias("suppressed"))


@query("H11_reading_order", f"{_BOXES}, p as (select *, lag(y * 10000 + x) over (partition by page order by box) as prev from b) select page, bool_and(prev is null or prev <= y * 10000 + x) as monotonic from p group by page")
def reading_order(spark, sf_dir):
    prev = F.lag(F.col("y") * 10000 + F.col("x")).over(Window.partitionBy("page").orderBy("box"))
    p = boxes(spark, sf_dir).withColumn("ok", prev.isNull() | (prev <= F.col("y") * 10000 + F.col("x")))
    return p.groupBy("page").agg(F.bool_and("ok").alias("monotonic"))


_WORDS = f"{_BOXES}, w as (select *, box % 2 as block, y // 100 as line from b), p as (select *, lag(block) over o as last_block, lag(line) over o as last_line, row_number() over o as place from w window o as (partition by page order by block, line, x, box))"


@query("H5_join_lines", f"{_WORDS} select page, string_agg(case when place = 1 then '' when block <> last_block then chr(10) || chr(10) when line <> last_line then chr(10) else ' ' end || 'w' || box, '' order by place) as text from p group by page")
def join_lines(spark, sf_dir):
    """Words in the order of blocks and lines: a blank line where the block changes, a line end where the line does, else a space."""
    word = F.struct((F.col("box") % 2).alias("block"), F.floor(F.col("y") / 100).alias("line"), "x", "box")
    p = boxes(spark, sf_dir).groupBy("page").agg(F.sort_array(F.collect_list(word)).alias("w"))
    before = lambda i, c: F.get("w", i - 1)[c]
    between = lambda x, i: F.when(i == 0, "").when(x["block"] != before(i, "block"), "\n\n").when(x["line"] != before(i, "line"), "\n").otherwise(" ")
    return p.select("page", F.array_join(F.transform("w", lambda x, i: F.concat(between(x, i), F.lit("w"), x["box"].cast("string"))), "").alias("text"))


#: The length of a page's projection; boxes lie within.
_WIDE = 1100


@query("H15_valleys", f"{_BOXES}, s as (select page, x as a, x + w as z from b union all select distinct page, {_WIDE}, {_WIDE} from b), m as (select *, coalesce(max(z) over (partition by page order by a, z rows between unbounded preceding and 1 preceding), 0) as reach from s), c as (select page, ((reach + a) // 2)::int as cut from m where a - reach >= 20 union all select distinct page, 0 from b union all select distinct page, {_WIDE} from b) select page, list(cut order by cut) as cuts from c group by page")
def valleys(spark, sf_dir):
    """Both edges, and the middles of the empty runs along x, of 20 or more, also before the first box and after the last."""
    w = Window.partitionBy("page").orderBy("a", "z").rowsBetween(Window.unboundedPreceding, -1)
    b = boxes(spark, sf_dir)
    ends = b.select("page", F.explode(F.array(F.struct(F.col("x").alias("a"), (F.col("x") + F.col("w")).alias("z")), F.struct(F.lit(_WIDE).alias("a"), F.lit(_WIDE).alias("z")))).alias("e")).select("page", "e.a", "e.z")
    m = ends.withColumn("reach", F.coalesce(F.max("z").over(w), F.lit(0)))
    cuts = m.groupBy("page").agg(F.collect_list(F.when(F.col("a") - F.col("reach") >= 20, F.expr("cast((reach + a) div 2 as int)"))).alias("c"))
    return cuts.select("page", F.concat(F.array(F.lit(0)), F.sort_array("c"), F.array(F.lit(_WIDE))).alias("cuts"))


@query("H14_line_positions", f"{_BOXES}, p as (select page, unnest(range(y, y + h)) as row, w from b), c as (select page, row from p group by all having sum(w) >= floor(900 * 0.15)), k as (select *, row - row_number() over (partition by page order by row) as island from c) select page, ((min(row) + max(row)) // 2)::int as centre from k group by page, island")
def line_positions(spark, sf_dir):
    """Centres of the runs of rows whose projection reaches a share of the length."""
    rows = boxes(spark, sf_dir).select("page", "w", F.explode(F.sequence(F.col("y"), F.col("y") + F.col("h") - 1)).alias("row"))
    dense = rows.groupBy("page", "row").agg(F.sum("w").alias("n")).where(F.col("n") >= int(900 * 0.15))
    island = F.col("row") - F.row_number().over(Window.partitionBy("page").orderBy("row"))
    return dense.withColumn("island", island).groupBy("page", "island").agg(F.expr("cast((min(row) + max(row)) div 2 as int)").alias("centre")).drop("island")


@query("H16_table_html", f"{_BOXES}, c as (select page, (box - 1) // 2 as r, box, '<' || (case when box <= 2 then 'th' else 'td' end) || '>' || x || '</' || (case when box <= 2 then 'th' else 'td' end) || '>' as cell from b), t as (select page, r, '<tr>' || string_agg(cell, '' order by box) || '</tr>' as line from c group by all) select page, '<table>' || string_agg(line, '' order by r) || '</table>' as html from t group by page")
def table_html(spark, sf_dir):
    tag = F.when(F.col("box") <= 2, "th").otherwise("td")
    cell = F.concat(F.lit("<"), tag, F.lit(">"), F.col("x").cast("string"), F.lit("</"), tag, F.lit(">"))
    c = boxes(spark, sf_dir).groupBy("page").agg(F.sort_array(F.collect_list(F.struct("box", cell.alias("cell")))).alias("c"))
    row = lambda x: F.floor((x["box"] - 1) / 2)
    opened = lambda x, i: F.when(i == 0, "<tr>").when(row(x) != row(F.get("c", i - 1)), "</tr><tr>").otherwise("")
    return c.select("page", F.concat(F.lit("<table>"), F.array_join(F.transform("c", lambda x, i: F.concat(opened(x, i), x["cell"])), ""), F.lit("</tr></table>")).alias("html"))


_FLAT = f"with {LINES}, f as (select l_orderkey as page, l_linenumber as box, (l_suppkey * 13 % 400)::int as w, (case when l_partkey % 3 = 0 then 1 + l_partkey % 20 else 20 + l_partkey % 20 end)::int as h, l_quantity::int as q from lines), g as (select *, (w * (7 + q % 4) / 10.0)::int as inked from f)"


@query("H28_separators", f"{_FLAT}, m as (select *, list_sort(list(h) over (partition by page))[(count(*) over (partition by page)) // 2 + 1] as mid, count(*) over (partition by page) as n from g) select page, box from m where not (n >= 3 and w >= 32 and h <= 0.6 * mid and w >= 8 * h and inked >= floor(w * 9 / 10.0))")
def separators(spark, sf_dir):
    """Boxes that are no separator line."""
    q = F.col("l_quantity").cast("int")
    h = F.when(F.col("l_partkey") % 3 == 0, 1 + F.col("l_partkey") % 20).otherwise(20 + F.col("l_partkey") % 20).cast("int")
    w = (F.col("l_suppkey") * 13 % 400).cast("int")
    b = lines(spark, sf_dir).select(F.col("l_orderkey").alias("page"), F.struct(F.col("l_linenumber").alias("box"), w.alias("w"), h.alias("h"), F.round(w * (7 + q % 4) / 10.0).cast("int").alias("inked")).alias("x"))
    p = b.groupBy("page").agg(F.collect_list("x").alias("x"))
    kept = F.filter("x", lambda x: ~G.flat_line(x["w"], x["h"], x["inked"], F.col("x.h")))
    return p.select("page", F.explode(kept).alias("k")).select("page", "k.box")


@query("G13_canvas_width", f"{_BOXES} select page, box, greatest(64, ceil(greatest(ceil(w * 64.0 / h), 1) / 64.0) * 64)::int as width from b")
def canvas_width(spark, sf_dir):
    return boxes(spark, sf_dir).select("page", "box", G.canvas_width(F.col("w"), F.col("h")).alias("width"))


@query("G15_downsample", f"{_BOXES} select page, box, round(least(greatest(least(150.0::double / (h + 90), sqrt(20000.0::double / (w * h))), 0.01), 1.0), 6) as factor from b")
def downsample(spark, sf_dir):
    return boxes(spark, sf_dir).select("page", "box", F.round(G.downsample_factor(F.lit(150.0), F.col("h") + 90, F.col("w") * F.col("h"), 20000), 6).alias("factor"))


@query("I31_estimate_dpi", f"{_BOXES} select page, box, floor(greatest(w, h) / 11.0 + 0.5)::int as dpi from b")
def estimate_dpi(spark, sf_dir):
    return boxes(spark, sf_dir).select("page", "box", G.estimate_dpi(F.col("w"), F.col("h")).alias("dpi"))


@query("I8_skew_consensus", "with t as (select l_orderkey, l_linenumber, (l_partkey % 17 - 8) / 2.0::double as a, (l_suppkey % 31 - 15) / 10.0::double as b, l_quantity / 8 as c from lineitem) select l_orderkey, l_linenumber, case when a = 0 then case when c >= 4 and abs(b) between 0.3 and 6 then -b else 0 end when abs(a) > 6 or c < 3 then a when (a * -b < 0 and abs(b) >= 0.5) or abs(-b - a) > 1.5 then 0 else a end as angle from t")
def skew_consensus(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem")
    angle = G.skew_consensus((F.col("l_partkey") % 17 - 8) / 2.0, (F.col("l_suppkey") % 31 - 15) / 10.0, F.col("l_quantity") / 8)
    return t.select("l_orderkey", "l_linenumber", (angle + 0.0).alias("angle"))


@query("I24_smart_resize", "with t as (select l_orderkey, l_linenumber, (l_partkey % 1900 + 5)::double as h, (l_suppkey * 37 % 2300 + 5)::double as w from lineitem), r as (select *, greatest(28, round(h / 28) * 28) as rh, greatest(28, round(w / 28) * 28) as rw, sqrt(h * w / 1003520) as big, sqrt(3136 / (h * w)) as small, greatest(h, w) / least(h, w) <= 200 as able from t) select l_orderkey, l_linenumber, (case when able then case when rh * rw > 1003520 then greatest(28, floor(h / big / 28) * 28) when rh * rw < 3136 then greatest(28, ceil(h * small / 28) * 28) else rh end end)::int as height, (case when able then case when rh * rw > 1003520 then greatest(28, floor(w / big / 28) * 28) when rh * rw < 3136 then greatest(28, ceil(w * small / 28) * 28) else rw end end)::int as width from r")
def smart_resize(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 1900 + 5).cast("double").alias("h"), (F.col("l_suppkey") * 37 % 2300 + 5).cast("double").alias("w"))
    h, w = G.smart_resize(F.col("h"), F.col("w"))
    return t.select("l_orderkey", "l_linenumber", h.alias("height"), w.alias("width"))


@query("I30_source_type", "select l_orderkey, l_linenumber, case when l_discount * 4 > 0.28 then 'photo' when l_returnflag = 'R' or l_quantity / 10 > 2.2 or l_quantity / 10 < 0.45 then 'screenshot' when l_tax * 10 > 0.45 then 'scan' else 'screenshot' end as source from lineitem")
def source_type(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem")
    return t.select("l_orderkey", "l_linenumber", G.source_type(F.col("l_discount") * 4, F.col("l_returnflag") == "R", F.col("l_quantity") / 10, F.col("l_tax") * 10).alias("source"))


@query("I3_otsu", "with p as (select o_orderpriority as page, (o_totalprice % 256)::int as v from (select o_orderpriority, floor(o_totalprice) as o_totalprice from orders)), h as (select page, v, count(*) as n from p group by all), c as (select *, sum(n) over w as n0, sum(n * v) over w as s0, sum(n) over (partition by page) as nt, sum(n * v) over (partition by page) as st from h window w as (partition by page order by v)), b as (select *, case when nt > n0 then n0 * (nt - n0)::double * power(s0 / n0::double - (st - s0) / (nt - n0)::double, 2) end as between from c) select page, arg_max(v, round(between / 1e3) * 1000 - v) as threshold from b where between is not null group by page")
def otsu(spark, sf_dir):
    """The threshold of greatest between-class variance, from a histogram of 256 places per page."""
    p = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("page"), (F.floor("o_totalprice") % 256).cast("int").alias("v"))
    w, all_ = Window.partitionBy("page").orderBy("v"), Window.partitionBy("page")
    c = p.groupBy("page", "v").agg(F.count("*").alias("n")).select("page", "v", F.sum("n").over(w).alias("n0"), F.sum(F.col("n") * F.col("v")).over(w).alias("s0"), F.sum("n").over(all_).alias("nt"), F.sum(F.col("n") * F.col("v")).over(all_).alias("st"))
    rest = F.col("nt") - F.col("n0")
    c = c.where(rest > 0).withColumn("between", F.col("n0") * rest.cast("double") * F.pow(F.col("s0") / F.col("n0") - (F.col("st") - F.col("s0")) / rest, 2))
    return c.groupBy("page").agg(F.max_by("v", F.round(F.col("between") / 1e3) * 1000 - F.col("v")).alias("threshold"))


_INK = f"with {LINES}, i as (select l_orderkey % 2000 as page, (l_partkey % 60)::int as x, (l_suppkey % 40)::int as y from lines group by all)"


@query("I12_content_box", f"{_INK}, r as (select page, y from i group by all having count(*) >= 1), c as (select page, x from i group by all having count(*) >= 1), q as (select page, min(y) as y0, max(y) as y1 from r group by page), p as (select page, min(x) as x0, max(x) as x1 from c group by page) select page, greatest(0, x0 - 2)::int as x1, greatest(0, y0 - 2)::int as y1, least(60, x1 + 3)::int as x2, least(40, y1 + 3)::int as y2 from q join p using (page)")
def content_box(spark, sf_dir):
    """Pages of 60 by 40 pixels, of which the dark ones are listed: the box of rows and columns that reach a floor of ink, and a margin of two."""
    ink = lines(spark, sf_dir).select((F.col("l_orderkey") % 2000).alias("page"), (F.col("l_partkey") % 60).cast("int").alias("x"), (F.col("l_suppkey") % 40).cast("int").alias("y")).distinct()
    return G.content_box(ink, 60, 40)


@query("I11_page_split", "with c as (select page, x, count(*) as n from (select l_orderkey % 500 as page, (case when l_partkey % 9 = 0 then 30 else l_partkey % 60 end)::int as x, l_suppkey % 40 as y from lineitem where l_partkey % 60 not between 26 and 33 or l_orderkey % 3 = 0 group by all) group by all), a as (select page, x, coalesce(n, 0) as n from (select distinct page from c) cross join range(0, 60) r(x) left join c using (page, x)), m as (select page, list_sort(list(n))[31] as med, list(n order by x) as n from a group by page), g as (select *, list_transform(range(18, 43), x -> n[x + 1]) as mid from m), f as (select *, 18 + list_position(mid, list_min(mid)) - 1 as gx, list_min(mid) as lo from g) select page, (case when med > 0 and lo <= floor(0.15 * med) and list_sum(n[1 : gx]) / gx >= 0.4 * med and list_sum(n[gx + 2 : 60]) / (60 - gx - 1) >= 0.4 * med then gx else -1 end)::int as split from f")
def page_split(spark, sf_dir):
    """Pages of 60 by 40 pixels, of which the dark ones are listed: the column where a spread of two pages parts, else -1."""
    x = F.when(F.col("l_partkey") % 9 == 0, 30).otherwise(F.col("l_partkey") % 60).cast("int")
    some = table(spark, sf_dir, "lineitem").where(~(F.col("l_partkey") % 60).between(26, 33) | (F.col("l_orderkey") % 3 == 0))
    ink = some.select((F.col("l_orderkey") % 500).alias("page"), x.alias("x"), (F.col("l_suppkey") % 40).cast("int").alias("y")).distinct()
    return G.page_split(ink, 60, 40)


_GRIDS = "[" + ", ".join(f"{{'r': {r}, 'c': {n // r}}}" for n in range(1, 7) for r in range(1, n + 1) if n % r == 0) + "]"


@query("I26_tiling", f"{_BOXES}, t as (select page, box, list_transform({_GRIDS}, g -> {{'d': abs(g.c::double / g.r::double - w::double / h::double), 'r': g.r, 'c': g.c}}) as g, w, h from b), m as (select *, list_min(list_transform(g, x -> x.d)) as d from t), e as (select *, list_filter(g, x -> x.d = d) as near from m), p as (select *, coalesce(list_filter(near[2:], x -> w * h > 450.0 * x.r * x.c)[-1], near[1]) as best from e) select page, box, (best.r * 10 + best.c)::int as grid from p")
def tiling(spark, sf_dir):
    """14 grids in an array per row, no join."""
    best = G.tiling(F.col("w"), F.col("h"), 30)
    return boxes(spark, sf_dir).select("page", "box", best.alias("g")).select("page", "box", (F.col("g.r") * 10 + F.col("g.c")).alias("grid"))
