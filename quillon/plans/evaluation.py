"""Retrieval and text-error metrics, gates and cascades."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window

from quillon.functions import sequences as S
from quillon.functions import text as T
from quillon.functions import vectors as V
from quillon.operators.per_group import per_group
from quillon.plans.registry import LINES, lines, query, table
from quillon.plans.vectors import _PAIRS, arm, emb, ranked, top_k

_RANKED = f"with s as ({_PAIRS}), r as (select *, row_number() over (partition by q order by score desc, vec_id) as rank, (ql = label)::int as rel from s)"


def judged(spark, sf_dir):
    """(q, vec_id, rank, rel, relevant) of the 10 best rows of each query; relevant: rows of its label in all, but for itself.

    Relevant rows are counted by label: no more than the 10 best of each query are ranked.
    """
    e = emb(spark, sf_dir)
    sizes = e.groupBy(F.col("label").alias("ql")).agg((F.count("*") - 1).alias("relevant"))
    return ranked(spark, sf_dir, 10).join(sizes, "ql").withColumn("rel", (F.col("ql") == F.col("label")).cast("int"))


@query("K8_ndcg", f"{_RANKED}, i as (select *, row_number() over (partition by q order by rel desc, rank) as ideal from r) select q, round(sum(case when rank <= 10 then (power(2, rel) - 1) / log2(rank + 1) else 0 end) / nullif(sum(case when ideal <= 10 then (power(2, rel) - 1) / log2(ideal + 1) else 0 end), 0), 6) as ndcg from i group by q")
def ndcg(spark, sf_dir):
    gain = lambda rank: 1 / F.log2(rank + 1.0)
    got = judged(spark, sf_dir).groupBy("q", "relevant").agg(F.sum(F.when(F.col("rel") == 1, gain(F.col("rank"))).otherwise(0.0)).alias("got"))
    best = F.aggregate(F.sequence(F.lit(1), F.least(F.col("relevant"), F.lit(10)).cast("int")), F.lit(0.0), lambda s, i: s + gain(i))
    return got.select("q", F.when(F.col("relevant") > 0, F.round(F.col("got") / best, 6)).alias("ndcg"))


@query("K9_precision", f"{_RANKED} select q, sum(rel) / 10.0::double as precision from r where rank <= 10 group by q")
def precision(spark, sf_dir):
    return judged(spark, sf_dir).groupBy("q").agg((F.sum("rel") / 10.0).alias("precision"))


@query("K10_mrr_recall", f"{_RANKED} select q, coalesce(round(1.0::double / min(case when rel = 1 and rank <= 10 then rank end), 6), 0) as mrr, round(sum(case when rank <= 10 then rel else 0 end)::double / sum(rel), 6) as recall from r group by q")
def mrr_recall(spark, sf_dir):
    first = F.min(F.when(F.col("rel") == 1, F.col("rank")))
    m = judged(spark, sf_dir).groupBy("q", "relevant").agg(F.coalesce(F.round(1.0 / first, 6), F.lit(0.0)).alias("mrr"), F.sum("rel").alias("hits"))
    return m.select("q", "mrr", F.round(F.col("hits") / F.col("relevant"), 6).alias("recall"))


@query("K12_top1", f"{_RANKED} select q, vec_id as best, rel = 1 as hit from r where rank = 1")
def top1(spark, sf_dir):
    return judged(spark, sf_dir).where("rank = 1").select("q", F.col("vec_id").alias("best"), (F.col("rel") == 1).alias("hit"))


_COS = "list_dot_product(a, b) / (sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b)))"


@query("K11_cosine_stats", f"with e as (select *, list_max(list_transform(embedding, x -> abs(x::double))) / 127 as s from embeddings), a as (select label, vec_id, list_transform(embedding, x -> x::double) as a, list_transform(embedding, x -> round(x::double / s) * s) as b from e), c as (select label, vec_id, round({_COS}, 6) as c, round(sqrt(list_dot_product(b, b)) / sqrt(list_dot_product(a, a)), 6) as r from a) select label, count(*) as n, min(c) as lo, round(avg(c), 6) as mean, quantile_cont(c, 0.5) as median, round(avg(r), 6) as ratio, min(r) as ratio_lo, max(r) as ratio_hi, arg_min(vec_id, c * 1e12 + vec_id / 1e9) as worst from c group by label")
def cosine_stats(spark, sf_dir):
    """How near a quantised arm comes to the vectors themselves, row by row; equal cosines are counted before the median is taken."""
    a, b = F.col("embedding"), F.col("other")
    c = arm(emb(spark, sf_dir)).select("label", "vec_id", F.round(V.cosine(a, b), 6).alias("c"), F.round(V.norm(b) / V.norm(a), 6).alias("r"))
    per_value = c.groupBy("label", "c").agg(F.count("*").alias("n"), F.min("vec_id").alias("first"))
    median = per_value.groupBy("label").agg(F.sum("n").alias("n"), F.min("c").alias("lo"), F.percentile("c", F.lit(0.5), F.col("n")).alias("median"), F.min_by("first", "c").alias("worst"))
    rest = c.groupBy("label").agg(F.round(F.avg("c"), 6).alias("mean"), F.round(F.avg("r"), 6).alias("ratio"), F.min("r").alias("ratio_lo"), F.max("r").alias("ratio_hi"))
    return median.join(rest, "label")


@query("K13_language_check", f"with n as (select label, row_number() over (partition by label order by vec_id) as i, list_transform(embedding, x -> x::double) as v from embeddings), t as (select a.label, a.v as a, b.v as b, c.v as c, ea.v as ea, ec.v as ec from n a join n b on b.label = a.label and b.i = 2 join n c on c.label = a.label and c.i = 3 join n ea on ea.label = 0 and ea.i = 1 join n ec on ec.label = 0 and ec.i = 3 where a.i = 1) select label, {_COS.replace('(a, b)', '(a, b)')} > {_COS.replace('(b, b)', '(c, c)').replace('(a, b)', '(a, c)')} as semantics, {_COS.replace('(b, b)', '(ea, ea)').replace('(a, b)', '(a, ea)')} > {_COS.replace('(b, b)', '(ec, ec)').replace('(a, b)', '(a, ec)')} as crosslingual, {_COS.replace('(b, b)', '(c, c)').replace('(a, b)', '(a, c)')} < 0.95 as nondegenerate from t where label <> 0")
def language_check(spark, sf_dir):
    """Three checks per language (label): its first two vectors are nearer than the first and the third, the first is
    nearer to English's (label 0) first than to its third, and first and third differ."""
    three = top_k(emb(spark, sf_dir).withColumn("place", -F.col("vec_id")), 3, "label", score="place")
    t = three.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("rank", "embedding")))["embedding"].alias("v")).where("size(v) = 3")
    english = t.where("label = 0").select(F.col("v").alias("e"))  # one row
    cos = lambda x, y: V.cosine(x, y)
    a, b, c, ea, ec = F.col("v")[0], F.col("v")[1], F.col("v")[2], F.col("e")[0], F.col("e")[2]
    return t.where("label <> 0").crossJoin(F.broadcast(english)).select("label", (cos(a, b) > cos(a, c)).alias("semantics"), (cos(a, ea) > cos(a, ec)).alias("crosslingual"), (cos(a, c) < 0.95).alias("nondegenerate"))


#: Pairs of texts: every document with the next one by id, every turn with the next one of its conversation, the last ones with an empty text.
#: DuckDB's distance counts bytes: characters beyond ASCII, of which the tables hold less than 28, are told by control characters there.
_PAIRED = (
    "with t as (select 'documents' as source, a.doc_id, coalesce(a.text, '') as h, coalesce(b.text, '') as r from documents a left join documents b on b.doc_id = a.doc_id + 1"
    " union all select 'conversations', a.conv_id * 1000 + a.turn, coalesce(a.text, ''), coalesce(b.text, '') from conversations a left join conversations b on b.conv_id = a.conv_id and b.turn = a.turn + 1)"
)
_CODES = (
    "c as (select coalesce(string_agg(c, '' order by c), '') as f from (select distinct unnest(string_split(lower(h) || h, '')) as c from t) where unicode(c) > 127),"
    " k as (select f, case when length(f) <= 28 then left(" + " || ".join(f"chr({i})" for i in [*range(1, 9), 11, 12, *range(14, 32)]) + ", length(f)::int) else error('too many characters') end as g from c)"
)


def text_pairs(spark, sf_dir):
    """(source, doc_id, h, r): whole texts that stand in for recognised and true ones; doc_id numbers turns by conversation * 1000."""
    d = table(spark, sf_dir, "documents")
    a = d.select(F.lit("documents").alias("source"), "doc_id", F.col("text").alias("h"))
    docs = a.join(d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("r")), "doc_id", "left")
    t = table(spark, sf_dir, "conversations")
    number = (F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id")
    turns = t.select(F.lit("conversations").alias("source"), number, F.col("text").alias("h"))
    after = t.select((F.col("conv_id") * 1000 + F.col("turn") - 1).alias("doc_id"), F.col("text").alias("r"))
    both = docs.select("source", "doc_id", "h", "r").union(turns.join(after, "doc_id", "left").select("source", "doc_id", "h", "r"))
    return both.select("source", "doc_id", F.coalesce("h", F.lit("")).alias("h"), F.coalesce("r", F.lit("")).alias("r"))


@query("K1_levenshtein", f"{_PAIRED}, {_CODES} select source, doc_id, levenshtein(translate(h, f, g), translate(r, f, g))::int as d from t, k")
def levenshtein(spark, sf_dir):
    """Over code points; bit-parallel, as whole documents are too long for a table of cells."""
    return text_pairs(spark, sf_dir).select("source", "doc_id", S.text_distance("h", "r").alias("d"))


_LENIENT = r"trim(regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}_]+', ' ', 'g'))"


@query("K3_lenient", f"select doc_id, md5({_LENIENT.format('text')}) as digest from documents")
def lenient(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.lenient(F.col("text"))).alias("digest"))


@query("K2_cer", f"{_PAIRED}, n as (select source, doc_id, {_LENIENT.format('h')} as h, {_LENIENT.format('r')} as r from t), {_CODES} select source, doc_id, round(case when r = '' then (h <> '')::int::double else levenshtein(translate(h, f, g), translate(r, f, g))::double / length(r) end, 6) as cer from n, k")
def cer(spark, sf_dir):
    t = text_pairs(spark, sf_dir).select("source", "doc_id", T.lenient(F.col("h")).alias("h"), T.lenient(F.col("r")).alias("r"))
    rate = F.when(F.col("r") == "", F.when(F.col("h") == "", 0.0).otherwise(1.0)).otherwise(S.text_distance("h", "r") / F.length("r"))
    return t.select("source", "doc_id", F.round(rate, 6).alias("cer"))


@query("K16_restoration_cer", f"{_PAIRED}, n as (select source, doc_id, regexp_replace(lower(regexp_replace(regexp_replace(h, '^\\s+', ''), '\\s+$', '')), '\\s+', ' ', 'g') as h, regexp_replace(lower(regexp_replace(regexp_replace(r, '^\\s+', ''), '\\s+$', '')), '\\s+', ' ', 'g') as r from t), {_CODES} select source, doc_id, round(case when r = '' then (h <> '')::int::double else levenshtein(translate(h, f, g), translate(r, f, g))::double / length(r) end, 6) as cer from n, k")
def restoration_cer(spark, sf_dir):
    """The error rate after white space and case are evened out, nothing else."""
    plain = lambda c: F.regexp_replace(F.lower(F.regexp_replace(c, r"\A\s+|\s+\z", "")), r"\s+", " ")
    t = text_pairs(spark, sf_dir).select("source", "doc_id", plain("h").alias("h"), plain("r").alias("r"))
    rate = F.when(F.col("r") == "", F.when(F.col("h") == "", 0.0).otherwise(1.0)).otherwise(S.text_distance("h", "r") / F.length("r"))
    return t.select("source", "doc_id", F.round(rate, 6).alias("cer"))


def scores(spark, sf_dir):
    """(source, doc_id, cer, wer, unordered_wer, exact), rates null for an empty reference."""
    words = lambda c: F.filter(F.split(c, " "), lambda w: w != "")
    even = lambda c: F.regexp_replace(F.regexp_replace(F.replace(c, F.lit("\u00ad"), F.lit("")), r"(?U)\s+", " "), r"\A | \z", "")
    t = text_pairs(spark, sf_dir).select("source", "doc_id", even("h").alias("h"), even("r").alias("r"))
    t = t.select("source", "doc_id", "h", "r", words("h").alias("hw"), words("r").alias("rw"))
    some = lambda value, n: F.when(F.col("r") != "", F.round(value / F.greatest(n, F.lit(1)), 5))
    return t.select(
        "source", "doc_id", some(S.text_distance("h", "r"), F.length("r")).alias("cer"), some(S.token_distance("hw", "rw"), F.size("rw")).alias("wer"),
        some(S.token_distance(F.sort_array("hw"), F.sort_array("rw")), F.size("rw")).alias("unordered_wer"), (F.col("h") == F.col("r")).alias("exact"),
    )


@query("K4_wer")
def wer(spark, sf_dir):
    """SQL has no edit distance over words."""
    return scores(spark, sf_dir)


@query("K6_token_distance")
def token_distance(spark, sf_dir):
    words = lambda c: F.filter(F.split(c, r"\s+"), lambda w: w != "")
    return text_pairs(spark, sf_dir).select("source", "doc_id", S.token_distance(words("h"), words("r")).alias("d"))


@query("K22_text_delta")
def text_delta(spark, sf_dir):
    return text_pairs(spark, sf_dir).select("source", "doc_id", F.round(S.text_delta("h", "r"), 6).alias("delta"))


@query("K7_garbage")
def garbage(spark, sf_dir):
    """Every whole document, and every turn of a conversation; doc_id numbers the turns as text_pairs does."""
    garbled = T.garbage(F.col("text")).alias("garbage")
    docs = table(spark, sf_dir, "documents").select(F.lit("documents").alias("source"), "doc_id", garbled)
    turns = table(spark, sf_dir, "conversations").select(F.lit("conversations").alias("source"), (F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), garbled)
    return docs.union(turns)


_MARKUP = [(r"!\[[^\]]*\]\([^)]*\)", " "), (r"<[^>]+>", " "), (r"(?m)^\s*#{1,6}\s*", ""), (r"(?m)^\s*\|?[\s:|-]{3,}\|?\s*$", " ")]


def _strip_sql(column: str) -> str:
    for pattern, by in _MARKUP:
        column = f"regexp_replace({column}, '{pattern}', '{by}', 'g')"
    return f"regexp_replace(replace({column}, '|', ' '), '\\*\\*|__|\\*|`', '', 'g')"


@query("K15_strip_markup", f"select page_id, md5({_strip_sql('html')}) as digest from pages")
def strip_markup(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5(T.strip_markup(F.col("html"))).alias("digest"))


@query("K17_outcome", "select l_orderkey, l_linenumber, case when l_returnflag = 'R' then 'error' when l_linestatus = 'O' then 'neutral' when l_tax < 0.01 then 'unavailable' when l_discount <= 0.02 then 'neutral' else 'unavailable' end as outcome from lineitem")
def outcome(spark, sf_dir):
    """Runs by status, whether the input was left raw, and how far the text moved (none: not measured)."""
    moved = F.when(F.col("l_tax") >= 0.01, F.col("l_discount"))
    label = T.outcome(F.col("l_returnflag") != "R", F.col("l_linestatus") == "O", moved)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", label.alias("outcome"))


@query("K18_split", "select role, count(*) as n, sum((conv_id % 5 = 0)::int)::bigint as held from conversations group by role")
def split(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy("role").agg(F.count("*").alias("n"), F.sum((F.col("conv_id") % 5 == 0).cast("long")).alias("held"))


@query("K19_importance", "with t as (select unnest(embedding)::double as x, generate_subscripts(embedding, 1) as pos from embeddings) select (pos - 1)::int as pos, round(sum(x * x), 5) as importance, count(*) as n from t group by pos")
def importance(spark, sf_dir):
    t = table(spark, sf_dir, "embeddings").select(F.posexplode("embedding").alias("pos", "x"))
    return t.groupBy("pos").agg(F.round(F.sum(F.col("x").cast("double") * F.col("x")), 5).alias("importance"), F.count("*").alias("n"))


@query("K21_report")
def report(spark, sf_dir):
    """Per source: texts, failures (empty ones), mean error rates of those with a reference, and the median length."""
    rates = scores(spark, sf_dir).join(text_pairs(spark, sf_dir).select("source", "doc_id", (F.trim("h") == "").alias("failed")), ["source", "doc_id"])
    mean = lambda c: F.round(F.avg(c), 5).alias("mean_" + c)
    return rates.groupBy("source").agg(F.count("*").alias("n"), F.sum(F.col("failed").cast("long")).alias("failures"), mean("cer"), mean("wer"), mean("unordered_wer"))


# Quality gates and cascades ------------------------------------------------------------------------------
@query("G9_confidence", "select l_orderkey, round(case when bool_or(l_discount * 10 <= 0 or l_discount * 10 > 1) then 0 else exp(sum(ln(case when l_discount > 0 then l_discount * 10 end)) * 2 / sqrt(count(*))) end, 6) as confidence from lineitem group by l_orderkey")
def confidence(spark, sf_dir):
    p = F.col("l_discount") * 10
    value = F.when(F.max((p <= 0) | (p > 1)), F.lit(0.0)).otherwise(F.exp(F.sum(F.log(F.when(p > 0, p))) * 2 / F.sqrt(F.count("*"))))
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.round(value, 6).alias("confidence"))


@query("G16_mean_confidence", "select o_orderkey, coalesce(round(avg(l_discount), 6), 0) as confidence from orders left join lineitem on l_orderkey = o_orderkey group by o_orderkey")
def mean_confidence(spark, sf_dir):
    """Lines are averaged before the join, so that only one row per order is joined."""
    c = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.round(F.avg("l_discount"), 6).alias("c"))
    return table(spark, sf_dir, "orders").join(c, "o_orderkey", "left").select("o_orderkey", F.coalesce("c", F.lit(0.0)).alias("confidence"))


_WORDS = r"list_filter(string_split_regex(text, '[ \n\t\r]+'), w -> strlen(w) >= 2)"
_SMALL = "translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query("G14_ocr_quality", f"with v as (select distinct {_SMALL} as w from (select unnest({_WORDS}) as w from benchmark)), t as (select doc_id, {_SMALL} as w from (select doc_id, unnest({_WORDS}) as w from documents)), s as (select doc_id, avg((v.w is not null)::int) as s from t left join v using (w) group by doc_id) select doc_id, coalesce(round(s, 6), 0) as quality from documents left join s using (doc_id)")
def ocr_quality(spark, sf_dir):
    """Words between blanks, tabs and line ends, of two bytes or more, ASCII in lower case; no word gives 0.

    The dictionary is as large as the benchmark: joined, not broadcast by force.
    """
    words = lambda name, *keys: table(spark, sf_dir, name).select(*keys, F.explode(F.split("text", r"[ \n\t\r]+")).alias("w")).where(F.octet_length("w") >= 2).withColumn("w", T.ascii_lower(F.col("w")))
    counted = words("documents", "doc_id").groupBy("doc_id", "w").agg(F.count("*").alias("n"))
    hit = counted.join(words("benchmark").distinct().withColumn("hit", F.lit(1)), "w", "left")
    share = hit.groupBy("doc_id").agg(F.round(F.sum(F.col("n") * F.coalesce("hit", F.lit(0))) / F.sum("n"), 6).alias("s"))
    return table(spark, sf_dir, "documents").select("doc_id").join(share, "doc_id", "left").select("doc_id", F.coalesce("s", F.lit(0.0)).alias("quality"))


@query("G10_vocabulary", "with v as (select unnest(string_split(text, ' ')) as w from benchmark) select w, count(*) as n from v group by w having count(*) > 1 or w = ''")
def vocabulary(spark, sf_dir):
    v = table(spark, sf_dir, "benchmark").select(F.explode(F.split("text", " ")).alias("w"))
    return v.groupBy("w").agg(F.count("*").alias("n")).where("n > 1 or w = ''")


@query("G7_dictionary", "with v as (select distinct unnest(string_split(text, ' ')) as w from benchmark), t as (select distinct unnest(string_split(text, ' ')) as w from documents) select w from t semi join v using (w)")
def dictionary(spark, sf_dir):
    words = lambda name: table(spark, sf_dir, name).select(F.explode(F.split("text", " ")).alias("w")).distinct()
    return words("documents").join(words("benchmark"), "w", "left_semi")


@query("G1_ctc_greedy", f"with {LINES}, t as (select l_orderkey as seq, l_linenumber as pos, (l_partkey % 4)::int as tok from lines), p as (select *, lag(tok) over (partition by seq order by pos) as prev from t), k as (select * from p where tok <> 0 and tok is distinct from prev) select seq, string_agg(chr(96 + tok), '' order by pos) as text from k group by seq")
def ctc_greedy(spark, sf_dir):
    """Repeats are told by the label just before, blanks included; then blanks go."""
    t = lines(spark, sf_dir).groupBy(F.col("l_orderkey").alias("seq")).agg(F.sort_array(F.collect_list(F.struct(F.col("l_linenumber").alias("pos"), (F.col("l_partkey") % 4).cast("int").alias("tok")))).alias("s"))
    kept = F.filter("s", lambda x, i: (x["tok"] != 0) & ~F.coalesce(F.get("s", i - 1)["tok"] == x["tok"], F.lit(False)))
    return t.select("seq", F.array_join(F.transform(kept, lambda x: F.char(x["tok"] + 96)), "").alias("text")).where("text <> ''")


@query("J2_accept_gate", "with t as (select doc_id, strlen(text) as n, (n_chars % 100) / 100.0 as c, case when doc_id % 3 = 0 then 0 else 0.5 end as least from documents) select doc_id, n >= 8 and (least <= 0 or c >= least) as accepted from t")
def accept_gate(spark, sf_dir):
    """A gate per document, every third one without a demand on confidence."""
    least = F.when(F.col("doc_id") % 3 == 0, 0.0).otherwise(0.5)
    accepted = T.passes_gate(F.col("text"), F.col("n_chars") % 100 / 100.0, F.lit(8), least)
    return table(spark, sf_dir, "documents").select("doc_id", accepted.alias("accepted"))


_STAGES = f"with {LINES}, t as (select l_orderkey as page, l_linenumber as stage, l_quantity >= 25 and l_discount >= 0.05 as ok, l_quantity::int as chars from lines)"


@query("J1_cascade", f"{_STAGES} select page, coalesce(min(case when ok then stage end), arg_max(stage, chars * 100 - stage))::int as chosen from t group by page")
def cascade(spark, sf_dir):
    """The first accepted stage, else the one with the longest text (ties: the earlier)."""
    ok = (F.col("l_quantity") >= 25) & (F.col("l_discount") >= 0.05)
    t = lines(spark, sf_dir).groupBy(F.col("l_orderkey").alias("page"))
    return t.agg(F.coalesce(F.min(F.when(ok, F.col("l_linenumber"))), F.max_by("l_linenumber", F.col("l_quantity").cast("int") * 100 - F.col("l_linenumber"))).alias("chosen"))


@query("J3_chain", "select doc_id, coalesce(c.chain, 'auto') as chain from documents d left join (values ('src0', 'scan'), ('src1', 'photo')) c(source, chain) using (source)")
def chain(spark, sf_dir):
    config = spark.createDataFrame([("src0", "scan"), ("src1", "photo")], "source string, chain string")
    return table(spark, sf_dir, "documents").join(F.broadcast(config), "source", "left").select("doc_id", F.coalesce("chain", F.lit("auto")).alias("chain"))


_METRICS = f"with {LINES}, t as (select l_orderkey as page, l_linenumber as stage, (['scan', 'photo', 'table'])[l_partkey % 3 + 1] as engine, l_suppkey % 500 as ms, l_partkey % 2 = 0 as cleaned, l_quantity >= 25 and l_discount >= 0.05 as ok, l_quantity::int as chars, l_discount as confidence from lines)"


@query("J7_stage_metrics", f"{_METRICS} select stage, engine, count(*) as n, sum(ms)::bigint as ms, sum(cleaned::int)::bigint as cleaned, sum(ok::int)::bigint as accepted, sum(chars)::bigint as chars, round(avg(confidence), 6) as confidence from t group by stage, engine")
def stage_metrics(spark, sf_dir):
    """All that a stage tells of its runs: index, engine, time, cleanup, acceptance, length, confidence."""
    ok = (F.col("l_quantity") >= 25) & (F.col("l_discount") >= 0.05)
    engine = F.get(F.array(*map(F.lit, ["scan", "photo", "table"])), (F.col("l_partkey") % 3).cast("int")).alias("engine")
    return lines(spark, sf_dir).groupBy(F.col("l_linenumber").alias("stage"), engine).agg(
        F.count("*").alias("n"), F.sum(F.col("l_suppkey") % 500).alias("ms"), F.sum((F.col("l_partkey") % 2 == 0).cast("long")).alias("cleaned"), F.sum(ok.cast("long")).alias("accepted"),
        F.sum(F.col("l_quantity").cast("long")).alias("chars"), F.round(F.avg("l_discount"), 6).alias("confidence"),
    )


@query("F14_lid_accept", "select doc_id, case when (n_chars % 10) / 10.0 > 0.3 then lang end as lang from documents")
def lid_accept(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("n_chars") % 10 / 10.0 > 0.3, F.col("lang")).alias("lang"))


_BIO = f"with {LINES}, t as (select l_orderkey as doc, l_linenumber as pos, (['O', 'B-x', 'I-x', 'B-y', 'I-y'])[l_partkey % 5 + 1] as tag, l_discount as score from lines)"


@query("F3_bio_merge", f"{_BIO}, s as (select *, lag(tag) over (partition by doc order by pos) as prev from t), k as (select *, case when tag[1] = 'I' and prev is not null and prev <> 'O' and substr(prev, 3) = substr(tag, 3) then 0 else 1 end as breaks from s), g as (select *, sum(breaks) over (partition by doc order by pos) as island from k) select doc, min(pos)::int as first, max(pos)::int as last, substr(arg_min(tag, pos), 3) as label, round(avg(score), 6) as score from g group by doc, island having arg_min(tag, pos)[1] = 'B'")
def bio_merge(spark, sf_dir):
    """B- opens a span and I- of its type goes on; an I- without an open span of its type closes what is open and opens nothing."""
    tags = F.array(*map(F.lit, ["O", "B-x", "I-x", "B-y", "I-y"]))
    t = lines(spark, sf_dir).select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("pos"), F.get(tags, (F.col("l_partkey") % 5).cast("int")).alias("tag"), F.col("l_discount").alias("score"))
    return merge_spans(t)


def merge_spans(tagged):
    """(doc, first, last, label, score) of the spans of (doc, pos, tag, score)."""
    w = Window.partitionBy("doc").orderBy("pos")
    prev, kind = F.lag("tag").over(w), lambda c: F.substring(c, 3, 1000)
    goes_on = F.col("tag").startswith("I-") & prev.isNotNull() & (prev != "O") & (kind(prev) == kind(F.col("tag")))
    g = tagged.withColumn("breaks", F.when(goes_on, 0).otherwise(1)).withColumn("island", F.sum("breaks").over(w))
    spans = g.groupBy("doc", "island").agg(F.min("pos").alias("first"), F.max("pos").alias("last"), F.min_by("tag", "pos").alias("tag"), F.round(F.avg("score"), 6).alias("score"))
    return spans.where(F.col("tag").startswith("B-")).select("doc", "first", "last", kind(F.col("tag")).alias("label"), "score")


# Heads over given vectors, alignment and field extraction ---------------------------------------------------
_W, _H = "((i * 7 + j * 3) % 11 - 5) / 20.0::double", 8


@query("E4_classifier", f"with v as (select vec_id, list_transform(embedding[1:{_H}], x -> x::double) as v from embeddings), h as (select vec_id, list_transform(range(0, {_H}), i -> tanh(0.1::double + list_sum(list_transform(range(0, {_H}), j -> v[j + 1] * {_W})))) as h from v), n as (select vec_id, list_transform(h, x -> (x - list_avg(h)) / sqrt(list_avg(list_transform(h, y -> (y - list_avg(h)) * (y - list_avg(h)))) + 1e-5)) as h from h) select vec_id, round(0.25::double + list_sum(list_transform(range(0, {_H}), i -> h[i + 1] * (i - 3) / 4.0::double)), 6) as score from n")
def classifier(spark, sf_dir):
    """Dense, tanh, layer norm and an output row over the first token's vector, with weights by a rule."""
    ints = lambda f: F.transform(F.sequence(F.lit(0), F.lit(_H - 1)), f)
    weights = ints(lambda i: ints(lambda j: ((i * 7 + j * 3) % 11 - 5) / 20.0))
    first = F.transform(F.slice("embedding", 1, _H), lambda x: x.cast("double"))
    score = V.classifier(first, weights, ints(lambda i: F.lit(0.1)), ints(lambda i: (i - 3) / 4.0), 0.25)
    return emb(spark, sf_dir).select("vec_id", F.round(score, 6).alias("score"))


@query("F1_token_classes", "with l as (select vec_id, list_transform(range(0, 5), k -> list_sum(list_transform(embedding[k * 12 + 1 : k * 12 + 12], x -> x::double)) * 4) as l from embeddings) select vec_id, (list_position(l, list_max(l)) - 1)::int as label, round(1 / list_sum(list_transform(l, x -> exp(x - list_max(l)))), 6) as score from l")
def token_classes(spark, sf_dir):
    """The first label of the greatest logit and its softmax, for five logits made of each vector."""
    logits = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda k: V.total(F.transform(F.slice("embedding", k * 12 + 1, 12), lambda x: x.cast("double"))) * 4)
    t = emb(spark, sf_dir).select("vec_id", logits.alias("l"))
    return t.select("vec_id", (F.array_position("l", F.array_max("l")) - 1).cast("int").alias("label"), F.round(F.array_max(V.softmax(F.col("l"))), 6).alias("score"))


_FIELDS = f"with {LINES}, w as (select l_orderkey as page, l_linenumber as region, repeat('word', (1 + l_partkey % 4)::int) as text, l_suppkey % 700 as x, l_partkey % 900 as y from lines), o as (select *, coalesce(sum(length(text) + 1) over (partition by page order by region rows between unbounded preceding and 1 preceding), 0) as a from w)"


@query("F9_fields_by_span", f"{_FIELDS}, e as (select page, k, ((min(a) + k * 9 + max(a) + k * 5) // 2)::bigint as mid from o, range(0, 3) r(k) group by page, k) select e.page, e.k, coalesce(o.x, 0)::bigint as x, coalesce(o.y, 0)::bigint as y from e left join o on o.page = e.page and e.mid >= o.a and e.mid < o.a + length(o.text)")
def fields_by_span(spark, sf_dir):
    """Regions of a page joined by line ends, three spans of the joined text, and the box of the region that holds each one's middle; none gives zeros."""
    r = lines(spark, sf_dir).select(F.col("l_orderkey").alias("page"), F.struct(F.col("l_linenumber").alias("region"), F.repeat(F.lit("word"), (1 + F.col("l_partkey") % 4).cast("int")).alias("text"), (F.col("l_suppkey") % 700).alias("x"), (F.col("l_partkey") % 900).alias("y")).alias("r"))
    p = r.groupBy("page").agg(F.sort_array(F.collect_list("r")).alias("r")).withColumn("a", T.starts(F.col("r.text")))
    mids = lambda k: F.expr(f"(a[0] + {k} * 9 + a[size(a) - 1] + {k} * 5) div 2")
    spans = F.array(*[F.struct(F.lit(k).cast("long").alias("k"), mids(k).alias("mid")) for k in range(3)])
    e = p.select("page", "r", "a", F.explode(spans).alias("e"))
    place = F.filter(F.arrays_zip("r", "a"), lambda x: (F.col("e.mid") >= x["a"]) & (F.col("e.mid") < x["a"] + F.length(x["r"]["text"])))
    e = e.withColumn("hit", F.get(place, F.lit(0)))
    return e.select("page", F.col("e.k").alias("k"), F.coalesce("hit.r.x", F.lit(0)).alias("x"), F.coalesce("hit.r.y", F.lit(0)).alias("y"))


@query("F10_fields_by_layout")
def fields_by_layout(spark, sf_dir):
    """Words of regions with evenly dealt boxes, tagged; an I- tag goes on with any open span, a bare tag opens one."""
    tags = F.array(*map(F.lit, ["O", "B-x", "I-x", "I-y", "z"]))
    t = lines(spark, sf_dir).select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("region"), F.get(tags, (F.col("l_partkey") % 5).cast("int")).alias("tag"), F.concat(F.lit("w"), F.col("l_linenumber").cast("string")).alias("word"), F.col("l_discount").alias("score"), (F.col("l_suppkey") % 700).alias("x"))
    return per_group(t, "page", ["region", "tag", "word", "score", "x"], S.layout_fields, "label string, value string, score double, x long").withColumn("score", F.round("score", 9))


# Batches for a model ---------------------------------------------------------------------------------------
_LENGTHS = "with d as (select doc_id, least(greatest(n_chars // 4, 1), 512) as n, doc_id // 64 as batch from documents)"


@query("C6_length_groups", f"{_LENGTHS}, r as (select *, row_number() over (partition by batch order by n, doc_id) - 1 as place from d) select doc_id, (place // 8)::int as grp, max(n) over (partition by batch, place // 8) as padded from r")
def length_groups(spark, sf_dir):
    """Texts of a batch in groups of eight of about one length, padded to the longest."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.expr("least(greatest(n_chars div 4, 1), 512)").alias("n"), F.expr("doc_id div 64").alias("batch"))
    place = F.floor((F.row_number().over(Window.partitionBy("batch").orderBy("n", "doc_id")) - 1) / 8).cast("int")
    d = d.withColumn("grp", place)
    return d.select("doc_id", "grp", F.max("n").over(Window.partitionBy("batch", "grp")).alias("padded"))


@query("C7_token_budget")
def token_budget(spark, sf_dir):
    """Texts of a batch in order, in groups that go on while they hold 384 tokens at most; one that alone is longer is a group."""
    d = table(spark, sf_dir, "documents").select(F.expr("doc_id div 64").alias("batch"), "doc_id", F.expr("least(greatest(n_chars div 4, 1), 512)").alias("n"))
    return per_group(d, "batch", ["doc_id", "n"], lambda rows: S.token_groups(rows, 384), "doc_id long, grp int, offset long").drop("batch")
