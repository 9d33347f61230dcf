"""Tokenisation, text functions and JSON."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions import sequences as S
from quillon.functions import text as T
from quillon.plans.registry import query, table


def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def _tokens(name: str, f, sql: str):
    """Registers a pre-tokenizer as (doc_id, n, longest, joined): joined is a digest of all tokens."""

    @query(name, f"with t as (select doc_id, {sql} as t from documents) select doc_id, len(t)::int as n, md5(array_to_string(t, chr(1))) as joined from t")
    def run(spark, sf_dir):
        t = docs(spark, sf_dir).select("doc_id", f(F.col("text")).alias("t"))
        return t.select("doc_id", F.size("t").alias("n"), F.md5(F.array_join("t", "\x01")).alias("joined"))

    return run


_tokens("B2_bert_pretokens", T.bert_pretokens, r"regexp_extract_all(regexp_replace(text, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', '', 'g'), '[!-/:-@\[-`{-~\p{P}]|[^\s!-/:-@\[-`{-~\p{P}]+')")
_tokens("B16_clip_pretokens", T.clip_pretokens, r"regexp_extract_all(lower(trim(regexp_replace(text, '\s+', ' ', 'g'))), '''s|''t|''re|''ve|''m|''ll|''d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+')")
_tokens("B15_gpt2_pretokens", T.gpt2_pretokens, r"regexp_extract_all(text, '''s|''t|''re|''ve|''m|''ll|''d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+')")
_tokens("B9_gpt4_pretokens", T.gpt4_pretokens, r"regexp_extract_all(text, '(?i:''s|''t|''re|''ve|''m|''ll|''d)|[^\r\n\p{L}\p{N}]?\p{L}+|\p{N}{1,3}| ?[^\s\p{L}\p{N}]+[\r\n]*|\s*[\r\n]+|\s+')")
_tokens("B10_qwen_pretokens", lambda t: T.gpt4_pretokens(t, 1), r"regexp_extract_all(text, '(?i:''s|''t|''re|''ve|''m|''ll|''d)|[^\r\n\p{L}\p{N}]?\p{L}+|\p{N}| ?[^\s\p{L}\p{N}]+[\r\n]*|\s*[\r\n]+|\s+')")
_tokens("B13_o200k_pretokens", T.o200k_pretokens, r"regexp_extract_all(text, '[^\r\n\p{L}\p{N}]?[\p{Lu}\p{Lt}\p{Lm}\p{Lo}\p{M}]*[\p{Ll}\p{Lm}\p{Lo}\p{M}]+(?i:''s|''t|''re|''ve|''m|''ll|''d)?|[^\r\n\p{L}\p{N}]?[\p{Lu}\p{Lt}\p{Lm}\p{Lo}\p{M}]+[\p{Ll}\p{Lm}\p{Lo}\p{M}]*(?i:''s|''t|''re|''ve|''m|''ll|''d)?|\p{N}{1,3}| ?[^\s\p{L}\p{N}]+[\r\n/]*|\s*[\r\n]+|\s+')")
_tokens("B11_lfm2_pretokens", T.gpt4_pretokens, r"regexp_extract_all(text, '(?i:''s|''t|''re|''ve|''m|''ll|''d)|[^\r\n\p{L}\p{N}]?\p{L}+|\p{N}{1,3}| ?[^\s\p{L}\p{N}]+[\r\n]*|\s*[\r\n]+|\s+')")
_tokens("B14_ministral_pretokens", T.ministral_pretokens, r"regexp_extract_all(text, '[^\r\n\p{L}\p{N}]?[\p{Lu}\p{Lt}\p{Lm}\p{Lo}\p{M}]*[\p{Ll}\p{Lm}\p{Lo}\p{M}]+|[^\r\n\p{L}\p{N}]?[\p{Lu}\p{Lt}\p{Lm}\p{Lo}\p{M}]+[\p{Ll}\p{Lm}\p{Lo}\p{M}]*|\p{N}| ?[^\s\p{L}\p{N}]+[\r\n/]*|\s*[\r\n]+|\s+')")
@query("B6_char_class", r"with c as (select unnest(string_split(text, '')) as c from documents), k as (select case when regexp_matches(c, '^\p{L}') then 'L' when regexp_matches(c, '^\p{N}') then 'N' when regexp_matches(c, '^\s') then 'Z' else 'other' end as class, count(*) as n from c group by all) select class, n from k")
def char_class(spark, sf_dir):
    c = docs(spark, sf_dir).select(F.explode(F.split("text", "")).alias("c")).groupBy("c").agg(F.count("*").alias("k"))
    return c.groupBy(T.char_class(F.col("c")).alias("class")).agg(F.sum("k").alias("n"))


@query("B5_siglip", r"select doc_id, md5(trim(regexp_replace(regexp_replace(lower(text), '[!-/:-@\[-`{-~]', '', 'g'), '\s+', ' ', 'g'))) as digest from documents")
def siglip(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.md5(T.siglip(F.col("text"))).alias("digest"))


@query("B1_strip_accents", "select doc_id, md5(strip_accents(lower(text))) as digest from documents")
def strip_accents(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.md5(S.strip_accents("text")).alias("digest"))


@query("B24_pair_truncation", "with t as (select a.doc_id, a.n_chars as a, b.n_chars as b, greatest(a.n_chars + b.n_chars - 509, 0) as over from documents a join documents b on b.doc_id = a.doc_id + 1), g as (select *, least(greatest(a - b, 0), over) as ga, least(greatest(b - a, 0), over) as gb from t) select doc_id, (a - ga - ceil((over - ga - gb) / 2.0))::bigint as left_a, (b - gb - floor((over - ga - gb) / 2.0))::bigint as left_b from g")
def pair_truncation(spark, sf_dir):
    a = docs(spark, sf_dir).select("doc_id", F.col("n_chars").alias("a"))
    b = docs(spark, sf_dir).select((F.col("doc_id") - 1).alias("doc_id"), F.col("n_chars").alias("b"))
    x, y = T.pair_lengths(F.col("a"), F.col("b"), 509)
    return a.join(b, "doc_id").select("doc_id", x.cast("long").alias("left_a"), y.cast("long").alias("left_b"))


@query("B29_tokenizer_family", "with t as (select l_orderkey, l_linenumber, l_linenumber % 2 = 1 as told, (l_quantity % 3)::int as declared, (['gpt2', 'bpe', 't5', 'unigram', 'spm', 'llama', 'bert', 'wordpiece', 'other'])[l_partkey % 9 + 1] as model, l_suppkey * 2000 as n from lineitem) select l_orderkey, l_linenumber, case when told then declared when model in ('gpt2', 'bpe') then 1 when model in ('t5', 'unigram', 'spm', 'llama') then 2 when n > 100000 then 2 else 0 end as family from t")
def tokenizer_family(spark, sf_dir):
    """Declared type, else the model's name, else the vocabulary's size."""
    models = F.array(*map(F.lit, ["gpt2", "bpe", "t5", "unigram", "spm", "llama", "bert", "wordpiece", "other"]))
    family = T.tokenizer_family(F.col("l_linenumber") % 2 == 1, (F.col("l_quantity") % 3).cast("int"), F.get(models, (F.col("l_partkey") % 9).cast("int")), F.col("l_suppkey") * 2000)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", family.alias("family"))


@query("B33_prefix", "select doc_id, md5(case when lang = 'en' then 'query: ' else 'passage: ' end || text) as digest from documents")
def prefix(spark, sf_dir):
    prefixes = F.create_map(F.lit("en"), F.lit("query: "))
    return docs(spark, sf_dir).select("doc_id", F.md5(F.concat(F.coalesce(prefixes[F.col("lang")], F.lit("passage: ")), "text")).alias("digest"))


#: Prefixes of a query and of a passage by a part of the model's name, the first that fits.
PREFIXES = [("e5", "query: ", "passage: "), ("nomic", "search_query: ", "search_document: "), ("jina-v5", "Query: ", "Passage: "), ("lfm2", "query: ", "document: ")]
_NAMED = "(['multilingual-e5-small', 'nomic-embed-v1.5', 'jina-v5-nano', 'lfm2-embed', 'minilm'])[doc_id % 5 + 1]"


@query("B34_prefix_lookup", f"with t as (select doc_id, {_NAMED} as model from documents) select doc_id, case " + " ".join(f"when contains(model, '{m}') then '{q}'" for m, q, _ in PREFIXES) + " end as query_prefix, case " + " ".join(f"when contains(model, '{m}') then '{p}'" for m, _, p in PREFIXES) + " end as passage_prefix from t")
def prefix_lookup(spark, sf_dir):
    names = F.array(*map(F.lit, ["multilingual-e5-small", "nomic-embed-v1.5", "jina-v5-nano", "lfm2-embed", "minilm"]))
    t = docs(spark, sf_dir).select("doc_id", F.get(names, (F.col("doc_id") % 5).cast("int")).alias("model"))
    first = lambda i: F.coalesce(*[F.when(F.col("model").contains(p[0]), p[i]) for p in PREFIXES])
    return t.select("doc_id", first(1).alias("query_prefix"), first(2).alias("passage_prefix"))


@query("A8_json_number", "select event_id, coalesce(try_cast(json_extract_string(props, '$.k') as double), -1.0) as k from events")
def json_number(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(F.get_json_object("props", "$.k").cast("double"), F.lit(-1.0)).alias("k"))


@query("A7_json_string", "select event_id, json_extract_string(props, '$.k') as k, json_extract_string(props, '$.missing') as missing from events")
def json_string(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), F.get_json_object("props", "$.missing").alias("missing"))


@query("A9_json_escape", "select doc_id, md5(replace(to_json(text || chr(9) || chr(1) || chr(31) || chr(8))::varchar, '\\u001F', '\\u001f')) as digest from documents")
def json_escape(spark, sf_dir):
    """Quotes, backslashes and control characters, of which the data has few: some are put behind each text."""
    odd = F.concat("text", F.lit("\t\x01\x1f\b"))
    return docs(spark, sf_dir).select("doc_id", F.md5(T.json_escape(odd)).alias("digest"))


@query("H17_escape", "select page_id, md5(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')) as digest from pages")
def escape(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5(T.escape_html(F.col("html"))).alias("digest"))
