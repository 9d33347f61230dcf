"""Dense, sparse and late-interaction scoring, and ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from quillon.functions import vectors as V
from quillon.operators import search
from quillon.plans.registry import query, table

#: Queries are all vectors whose id is divisible by EVERY; they are searched against all rows.
EVERY, K = 20, 10
_D = "list_transform(embedding, x -> x::double)"


def emb(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings")


def sides(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    e = emb(spark, sf_dir)
    return e.where(f"vec_id % {EVERY} = 0").select(F.col("vec_id").alias("q"), F.col("embedding").alias("qv"), F.col("label").alias("ql")), e


def top_k(scored: DataFrame, k: int, *by: str, score: str = "score", tie: str = "vec_id") -> DataFrame:
    """The k best rows of each group; ties by the smaller id. Spark keeps k rows per task and group before the shuffle."""
    w = Window.partitionBy(*by).orderBy(F.desc(score), tie)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def ranked(spark, sf_dir, k: int) -> DataFrame:
    """(q, vec_id, score, rank, ql, label) of the k best rows of each query."""
    q, e = sides(spark, sf_dir)
    best = search.top_k(q, e, k)
    return best.join(e.select("vec_id", "label"), "vec_id").join(q.select("q", "ql"), "q")


_PAIRS = f"select q.vec_id as q, e.vec_id, q.label as ql, e.label, round(list_dot_product(list_transform(q.embedding, x -> x::double), list_transform(e.embedding, x -> x::double)), 9) as score from embeddings q join embeddings e on q.vec_id <> e.vec_id where q.vec_id % {EVERY} = 0"


@query("E7_per_query_topk", f"with s as ({_PAIRS}), r as (select *, row_number() over (partition by q order by score desc, vec_id) as rank from s) select q, vec_id, rank::int as rank, round(score, 6) as score from r where rank <= {K}")
def per_query_topk(spark, sf_dir):
    return search.top_k(*sides(spark, sf_dir), K).select("q", "vec_id", "rank", F.round("score", 6).alias("score"))


@query("E1_biencoder_rank", f"with s as ({_PAIRS}), r as (select *, row_number() over (partition by q order by score desc, vec_id) as rank from s) select q, vec_id, rank::int as rank, round(score, 6) as score, label as document from r where rank <= 25")
def biencoder_rank(spark, sf_dir):
    """Every query's 25 best rows, each with what its row holds (its label stands for a document's text)."""
    return ranked(spark, sf_dir, 25).select("q", "vec_id", "rank", F.round("score", 6).alias("score"), F.col("label").alias("document"))


@query("E2_rank_json", f"with s as ({_PAIRS}), r as (select *, row_number() over (partition by q order by score desc, vec_id) as rank from s) select q, to_json({{'query': q, 'results': list({{'index': vec_id, 'document': 'set ' || label}} order by rank)}})::varchar as answer from r where rank <= 5 group by q")
def rank_json(spark, sf_dir):
    r = ranked(spark, sf_dir, 5).select("q", F.struct("rank", F.col("vec_id").alias("index"), F.concat(F.lit("set "), F.col("label").cast("string")).alias("document")).alias("r"))
    results = F.transform(F.sort_array(F.collect_list("r")), lambda x: x.dropFields("rank")).alias("results")
    return r.groupBy(F.col("q").alias("query")).agg(results).select(F.col("query").alias("q"), F.to_json(F.struct("query", "results")).alias("answer"))


def _some_lost(e: DataFrame) -> DataFrame:
    """Rows whose id is divisible by 7 score no number."""
    return e.withColumn("embedding", F.when(F.col("vec_id") % 7 == 0, F.transform("embedding", lambda x: F.lit(float("nan")).cast("float"))).otherwise(F.col("embedding")))


_LOST = f"with s as ({_PAIRS}), t as (select q, vec_id, case when vec_id % 7 = 0 then 'nan'::double else score end as score from s), r as (select *, row_number() over (partition by q order by score desc, vec_id) as rank from t where isfinite(score))"


@query("E6_rerank", f"{_LOST} select q, vec_id, rank::int as rank from r where rank <= 5")
def rerank(spark, sf_dir):
    """Scores that aren't finite go, the rest is ranked."""
    q, e = sides(spark, sf_dir)
    return search.top_k(q, _some_lost(e), 5).select("q", "vec_id", "rank")


@query("E9_rerank_lines", f"{_LOST} select q, string_agg('[' || vec_id || ']', chr(10) order by rank) as lines from r where rank <= 3 group by q")
def rerank_lines(spark, sf_dir):
    """The answer as lines, documents without a score skipped."""
    q, e = sides(spark, sf_dir)
    lines = F.sort_array(F.collect_list(F.struct("rank", F.concat(F.lit("["), F.col("vec_id").cast("string"), F.lit("]")).alias("t"))))
    return search.top_k(q, _some_lost(e), 3).groupBy("q").agg(F.array_join(lines["t"], "\n").alias("lines"))


@query("E8_match", "select a.vec_id, list_dot_product(list_transform(a.embedding, x -> x::double), list_transform(b.embedding, x -> x::double)) / (sqrt(list_dot_product(list_transform(a.embedding, x -> x::double), list_transform(a.embedding, x -> x::double))) * sqrt(list_dot_product(list_transform(b.embedding, x -> x::double), list_transform(b.embedding, x -> x::double)))) >= 0.25 as same from embeddings a join embeddings b on b.vec_id = a.vec_id + 1")
def match(spark, sf_dir):
    """Whether two neighbours are one by the threshold; synthetic vectors, no biometrics."""
    a, b = emb(spark, sf_dir), emb(spark, sf_dir).select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return a.join(b, "vec_id").select("vec_id", (V.cosine(F.col("embedding"), F.col("other")) >= 0.25).alias("same"))


def _unary(name: str, f, sql: str):
    """Registers f over each vector as (vec_id, s, first): the sum and the first component, rounded."""

    @query(name, f"with v as (select vec_id, {_D} as v from embeddings), w as (select vec_id, {sql} as r from v) select vec_id, round(list_sum(r), 5) as s, round(r[1], 5) as first, len(r)::int as n from w")
    def run(spark, sf_dir):
        r = emb(spark, sf_dir).select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v")).select("vec_id", f(F.col("v")).alias("r"))
        return r.select("vec_id", F.round(V.total(F.col("r")), 5).alias("s"), F.round(F.col("r")[0], 5).alias("first"), F.size("r").alias("n"))

    return run


_SS = "list_dot_product(v, v)"
#: The error function by the series of its integral, to 30 terms: exact in double precision for arguments below 3 or so.
_ERF = "(1.1283791670955126 * list_sum(list_transform(range(0, 30), k -> power(-1, k) * power(x * 0.7071067811865476, 2 * k + 1) / (factorial(k::int)::double * (2 * k + 1)))))"
_unary("C2_l2_normalize", V.l2_normalize, f"list_transform(v, x -> x / sqrt(greatest({_SS}, 1e-12)))")
_unary("C3_matryoshka", lambda v: V.truncate(v, 16), "list_transform(v[1:16], x -> x / sqrt(greatest(list_dot_product(v[1:16], v[1:16]), 1e-12)))")
_unary("C12_softmax", V.softmax, "list_transform(v, x -> exp(x - list_max(v)) / list_sum(list_transform(v, y -> exp(y - list_max(v)))))")
_unary("C13_layer_norm", V.layer_norm, "list_transform(v, x -> (x - list_avg(v)) / sqrt(list_avg(list_transform(v, y -> (y - list_avg(v)) * (y - list_avg(v)))) + 1e-5))")
_unary("C14_rms_norm", V.rms_norm, f"list_transform(v, x -> x / sqrt({_SS} / len(v) + 1e-6))")
_unary("C16_gelu_tanh", lambda v: F.transform(v, V.gelu_tanh), "list_transform(v, x -> 0.5 * x * (1 + tanh(0.7978845608028654 * (x + 0.044715 * x * x * x))))")
_unary("C16_gelu_erf", lambda v: F.transform(v, V.gelu_erf), f"list_transform(v, x -> 0.5 * x * (1 + {_ERF}))")
_unary("C16_silu", lambda v: F.transform(v, V.silu), "list_transform(v, x -> x / (1 + exp(-x)))")
_unary("C17_hard_swish", lambda v: F.transform(v, lambda x: V.hard_swish(x * 20)), "list_transform(v, x -> x * 20 * least(greatest(x * 20 + 3, 0), 6) / 6)")
_unary("C17_relu", lambda v: F.transform(v, lambda x: F.greatest(x, F.lit(0.0))), "list_transform(v, x -> greatest(x, 0))")
_unary("C17_relu6", lambda v: F.transform(v, lambda x: V.relu6(x * 50)), "list_transform(v, x -> least(greatest(x * 50, 0), 6))")
_unary("C15_linear", lambda v: V.linear(v, F.array(F.transform(v, lambda x, i: (i % 3 - 1).cast("double")), F.transform(v, lambda x, i: (i % 5 - 2).cast("double")))), "[list_sum(list_transform(v, (x, i) -> x * ((i - 1) % 3 - 1))), list_sum(list_transform(v, (x, i) -> x * ((i - 1) % 5 - 2)))]")


@query("C10_cosine", f"select a.vec_id, round(list_dot_product(list_transform(a.embedding, x -> x::double), list_transform(b.embedding, x -> x::double)) / (sqrt(list_dot_product(list_transform(a.embedding, x -> x::double), list_transform(a.embedding, x -> x::double))) * sqrt(list_dot_product(list_transform(b.embedding, x -> x::double), list_transform(b.embedding, x -> x::double)))), 6) as cosine from embeddings a join embeddings b on b.vec_id = a.vec_id + 1")
def cosine_next(spark, sf_dir):
    a, b = emb(spark, sf_dir), emb(spark, sf_dir).select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return a.join(b, "vec_id").select("vec_id", F.round(V.cosine(F.col("embedding"), F.col("other")), 6).alias("cosine"))


@query("C11_dot", f"select a.vec_id, round(list_dot_product(list_transform(a.embedding, x -> x::double), list_transform(b.embedding, x -> x::double)), 6) as dot from embeddings a join embeddings b on b.vec_id = a.vec_id + 1")
def dot_next(spark, sf_dir):
    a, b = emb(spark, sf_dir), emb(spark, sf_dir).select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return a.join(b, "vec_id").select("vec_id", F.round(V.dot(F.col("embedding"), F.col("other")), 6).alias("dot"))


_NORMED = "list_transform(v, x -> round(x / sqrt(greatest(list_dot_product(v, v), 1e-12)), 6))"


def _pooled(rows: DataFrame) -> DataFrame:
    return rows.select("label", F.transform(V.l2_normalize(F.col("v")), lambda x: F.round(x, 6)).alias("pooled"))


@query("C1_pool_mean", f"with t as (select label, unnest(embedding)::double as x, generate_subscripts(embedding, 1) as pos from embeddings), m as (select label, pos, avg(x) as x from t group by all), p as (select label, list(x order by pos) as v from m group by label) select label, {_NORMED} as pooled from p")
def pool_mean(spark, sf_dir):
    """A set's mean row, normalised: means of each place are summed before the shuffle."""
    rows = emb(spark, sf_dir).select("label", F.posexplode("embedding").alias("pos", "x"))
    means = rows.groupBy("label", "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return _pooled(means.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("pos", "x")))["x"].alias("v")))


def _pool_at(name: str, pick, order: str):
    @query(name, f"with p as (select label, list_transform(arg_{order}(embedding, vec_id), x -> x::double) as v from embeddings group by label) select label, {_NORMED} as pooled from p")
    def run(spark, sf_dir):
        """The first or the last token row of each set, normalised; token position is the order of vec_id."""
        return _pooled(emb(spark, sf_dir).groupBy("label").agg(pick("embedding", "vec_id").alias("v")))

    return run


_pool_at("C1_pool_cls", F.min_by, "min")
_pool_at("C1_pool_last", F.max_by, "max")


@query("C19_relative_bucket", "with t as (select distinct l_orderkey % 300 - 150 as delta from lineitem) select delta, (case when delta > 0 then 16 else 0 end + case when abs(delta) < 8 then abs(delta) else least(8 + floor(ln(abs(delta) / 8.0) / ln(16.0) * 8), 15) end)::bigint as bucket from t")
def relative_bucket(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 300 - 150).alias("delta")).distinct()
    return t.select("delta", V.relative_bucket(F.col("delta")).cast("long").alias("bucket"))


@query("C20_length_bucket", "select doc_id, (case when n_chars <= 8 then 8 when n_chars <= 16 then 16 when n_chars <= 32 then 32 when n_chars <= 64 then 64 when n_chars <= 128 then 128 when n_chars <= 256 then 256 when n_chars <= 512 then 512 else n_chars end)::bigint as bucket from documents")
def length_bucket(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", V.length_bucket(F.col("n_chars")).cast("long").alias("bucket"))


# Sparse and late interaction --------------------------------------------------------------------------
_TERMS = "with w as (select doc_id, unnest(string_split(text, ' ')) as w from documents), t as (select doc_id, w, count(*) as tf from w where w <> '' group by all), s as (select doc_id, w, tf, ((ascii(w) % 7) - 2) * tf as weight from t)"


def terms(spark, sf_dir) -> DataFrame:
    """(doc_id, term, weight): weights derived from the term, some of them negative."""
    w = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", " ")).alias("w")).where("w <> ''")
    return w.groupBy("doc_id", "w").agg(F.count("*").alias("tf")).withColumn("weight", (F.ascii("w") % 7 - 2) * F.col("tf"))


@query("D1_sparse_scalar", f"{_TERMS} select doc_id, substr(w, 1, 2) as token, max(weight)::bigint as weight from s where weight > 0 group by all")
def sparse_scalar(spark, sf_dir):
    t = terms(spark, sf_dir).groupBy("doc_id", F.substring("w", 1, 2).alias("token")).agg(F.max("weight").cast("long").alias("weight"))
    return t.where("weight > 0")


@query("D2_sparse_vocab", f"{_TERMS}, m as (select doc_id, substr(w, 1, 2) as token, max(weight) as top from s group by all) select doc_id, count(*) as n, round(sum(ln(1 + top)), 4) as total from m where top > 0 group by doc_id")
def sparse_vocab(spark, sf_dir):
    t = terms(spark, sf_dir).groupBy("doc_id", F.substring("w", 1, 2).alias("token")).agg(F.max("weight").alias("top")).where("top > 0")
    return t.groupBy("doc_id").agg(F.count("*").alias("n"), F.round(F.sum(F.log1p("top")), 4).alias("total"))


@query("D5_sparse_dict", f"{_TERMS}, m as (select doc_id, substr(w, 1, 2) as token, max(weight) as top from s group by all) select doc_id, string_agg(token || ':' || top::bigint::varchar, ',' order by token collate \"C\") as dict from m where top > 0 group by doc_id")
def sparse_dict(spark, sf_dir):
    t = terms(spark, sf_dir).groupBy("doc_id", F.substring("w", 1, 2).alias("token")).agg(F.max("weight").cast("long").alias("top")).where("top > 0")
    d = t.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("token", "top"))).alias("d"))
    return d.select("doc_id", F.array_join(F.transform("d", lambda x: F.concat_ws(":", x["token"], x["top"].cast("string"))), ",").alias("dict"))


_MAXSIM = f"with q as (select label as q, vec_id as qi, embedding as qv from embeddings where vec_id % {EVERY} = 0), p as (select q, qi, e.label as d, max(list_dot_product(list_transform(qv, x -> x::double), list_transform(e.embedding, x -> x::double))) as m from q cross join embeddings e group by all), s as (select q, d, round(sum(m), 5) as score from p group by all)"


def maxsim(spark, sf_dir) -> DataFrame:
    """Query sets: the vectors whose id is divisible by EVERY, by label; document sets: all vectors by label."""
    q, e = sides(spark, sf_dir)
    queries = q.select(F.col("ql").cast("long").alias("q"), F.col("q").alias("qi"), "qv")
    return search.max_sim(queries, e.select(F.col("label").cast("long").alias("d"), "embedding"))


@query("D7_maxsim", f"{_MAXSIM} select q::bigint as q, d::bigint as d, score from s")
def maxsim_scores(spark, sf_dir):
    return maxsim(spark, sf_dir)


@query("D8_maxsim_batch", f"{_MAXSIM} select q::bigint as q, list(round(score, 4) order by d) as scores from s group by q")
def maxsim_batch(spark, sf_dir):
    """All documents of a query in one answer, in their order."""
    m = maxsim(spark, sf_dir).groupBy("q").agg(F.sort_array(F.collect_list(F.struct("d", F.round("score", 4).alias("s"))))["s"].alias("scores"))
    return m.select("q", "scores")


@query("D9_maxsim_rank", f"{_MAXSIM}, r as (select *, row_number() over (partition by q order by score desc, d) as rank from s) select q::bigint as q, d::bigint as d, rank::int as rank from r where rank <= 3")
def maxsim_rank(spark, sf_dir):
    return top_k(maxsim(spark, sf_dir), 3, "q", tie="d").select("q", "d", "rank")


@query("D10_sparse_answer", f"{_TERMS}, m as (select doc_id, substr(w, 1, 2) as token, max(weight) as top from s group by all) select doc_id, '{{\"weights\": {{' || string_agg('\"' || hex(encode(token)) || '\": ' || printf('%.6f', ln(1 + top)), ', ' order by token collate \"C\") || '}}}}' as answer from m where top > 0 group by doc_id")
def sparse_answer(spark, sf_dir):
    """Term weights of each text as the answer of a service; terms are told by the hex of their bytes."""
    t = terms(spark, sf_dir).groupBy("doc_id", F.substring("w", 1, 2).alias("token")).agg(F.max("weight").alias("top")).where("top > 0")
    pair = F.concat(F.lit('"'), F.hex(F.encode("token", "UTF-8")), F.lit('": '), F.format_string("%.6f", F.log(1 + F.col("top").cast("double"))))
    d = t.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("token", pair.alias("p"))))["p"].alias("p"))
    return d.select("doc_id", F.concat(F.lit('{"weights": {'), F.array_join("p", ", "), F.lit("}}")).alias("answer"))


_ARM = "list_transform(embedding, x -> round(x::double / s) * s)"


def arm(e: DataFrame) -> DataFrame:
    """Vectors and what eight bits keep of them: each component a multiple of the greatest over 127."""
    step = F.array_max(F.transform("embedding", lambda x: F.abs(x.cast("double")))) / 127
    return e.withColumn("other", V.bind(step, lambda s: F.transform("embedding", lambda x: F.round(x.cast("double") / s) * s)))


@query("K14_token_cosine", f"with e as (select *, list_max(list_transform(embedding, x -> abs(x::double))) / 127 as s from embeddings), a as (select label, {_D} as a, {_ARM} as b from e) select label, round(avg(list_dot_product(a, b) / ((sqrt(list_dot_product(a, a)) + 1e-12) * (sqrt(list_dot_product(b, b)) + 1e-12))), 6) as cosine, count(*) as n from a group by label")
def token_cosine(spark, sf_dir):
    """The mean over a set's rows of the cosine with the same row of another matrix, here the quantised one."""
    a, b = F.col("embedding"), F.col("other")
    cosine = V.dot(a, b) / ((V.norm(a) + 1e-12) * (V.norm(b) + 1e-12))
    return arm(emb(spark, sf_dir)).groupBy("label").agg(F.round(F.avg(cosine), 6).alias("cosine"), F.count("*").alias("n"))


_BLOCKS = "list_transform(range(0, len(embedding) // 32), b -> list_transform(embedding[b * 32 + 1 : b * 32 + 32], x -> x::double))"


@query("K20_quantize", f"with b as (select vec_id, {_BLOCKS} as b from embeddings), q as (select vec_id, list_transform(b, v -> list_max(list_transform(v, x -> abs(x))) / 127) as d, b from b), r as (select vec_id, d, list_transform(list_zip(b, d), p -> list_transform(p[1], x -> case when p[2] = 0 then 0 else round(x / p[2]) end::int)) as q from q) select vec_id, list_transform(d, x -> round(x, 8)) as scales, md5(array_to_string(flatten(q), ',')) as digest from r")
def quantize(spark, sf_dir):
    """Blocks of 32 components as eight-bit numbers and a scale each."""
    return emb(spark, sf_dir).select("vec_id", V.quantize_blocks(F.col("embedding")).alias("b")).select("vec_id", F.transform("b", lambda x: F.round(x["scale"], 8)).alias("scales"), F.md5(F.array_join(F.flatten(F.transform("b", lambda x: x["q"].cast("array<string>"))), ",")).alias("digest"))
