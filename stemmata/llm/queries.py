"""Registered queries of the training-data operators, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from stemmata.llm import chat_format, decontaminate, license_scan, minhash, packing, quality, suffix_dedup, topk, url_filter, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and conversation -1 whose texts are control strings."""
    control = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(control)
    return chat_format.digests(chat_format.read_back(chat_format.format_conversations(turns)))


#: The URL rules of the query.
URL_RULES = [
    ("block", "com/en/"),
    ("allow", "example.com/en/7"),
    ("allow", "net/de/"),
    ("block", "example.net/de/8"),
    ("block", "org/es/"),
]


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url, judged by the rules or else by the templates of its host."""
    return url_filter.filter_urls(_table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES)


def op2_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 highest integer inner products of every twentieth vector with all others."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    vectors = _table(spark, sf_dir, "embeddings").filter(F.col("embedding").isNotNull() & finite)
    whole = vectors.select("vec_id", F.transform("embedding", lambda x: F.floor(64 * x.cast("double"))).alias("z"))
    return topk.top_k(whole, F.col("vec_id") % 20 == 0, k=20)


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without bytes under repeated 200-byte strings."""
    return suffix_dedup.removal_report(_table(spark, sf_dir, "documents"), least=200).drop("spans")


def op3_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 3-word shingle sets are similar by 0.85 or more."""
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), n=3, num=85, den=100, size=48, least=30)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens."""
    path = tokenizer or public_tokenizers.path("word_bpe_49k.json")
    return packing.pack(packing.pieces(_table(spark, sf_dir, "documents"), path))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score, learnt from labels that are not held out."""
    docs = _table(spark, sf_dir, "documents")
    model = quality.fit(docs, _table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), quality.score(model, F.col("text")).alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= quality.CUT, 1).otherwise(0))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows of ten words found in every document."""
    found = decontaminate.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC bundles and read back."""
    read = warc.read_archives(warc.write_archives(_table(spark, sf_dir, "pages")))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and near-notices of every document."""
    found = license_scan.scan_licenses(_table(spark, sf_dir, "documents"))
    base = F.filter("places", lambda p: p["exact"])
    labels = lambda places: F.array_join(F.array_sort(F.array_distinct(F.transform(places, lambda p: p["label"]))), ",")
    starts = F.transform(base, lambda p: p["first_word"])
    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.col("places")).alias("labels"),
        F.coalesce(F.array_max(F.transform("places", lambda p: 1.0 - 0.05 * p["edits"])), F.lit(0.0)).cast("double").alias("score"),
    )


QUERIES = {
    "op1_url_filters": op1_url_filters,
    "op2_exact_topk": op2_exact_topk,
    "op3_minhash_dedup": op3_minhash_dedup,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_decontamination": op5_decontamination,
    "op8_quality_classifier": op8_quality_classifier,
    "op6_warc": op6_warc,
    "op7_chat_formatting": op7_chat_formatting,
    "op9_license_scan": op9_license_scan,
}

ORACLE = {
    "op2_exact_topk": r"""
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint)) as z from embeddings
  where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select q.vec_id as query_id, c.vec_id, cast(list_sum(list_transform(range(1, len(q.z) + 1), lambda i: q.z[i] * c.z[i])) as bigint) as score
  from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 20 = 0
), r as (
  select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank from s
)
select query_id, rank, vec_id, score from r where rank <= 20
""",
    "op3_minhash_dedup": r"""
with recursive d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents
), s as (
  select distinct doc_id, array_to_string(w[i : i + least(3, len(w)) - 1], ' ') as sh
  from (select doc_id, w, unnest(range(1, greatest(1, len(w) - 2) + 1)) as i from d where len(w) > 0)
), n as (
  select doc_id, count(*) as n from s group by doc_id
), i as (
  select x.doc_id as a, y.doc_id as b, count(*) as common from s x join s y on x.sh = y.sh and x.doc_id < y.doc_id group by 1, 2
), links as (
  select a, b from i join n p on p.doc_id = a join n q on q.doc_id = b where 100 * common >= 85 * (p.n + q.n - common)
), edges as (
  select a, b from links union all select b, a from links
), reach as (
  select doc_id, doc_id as other from documents
  union
  select r.doc_id, e.b from reach r join edges e on r.other = e.a
)
select doc_id, coalesce(any_value(n.n), 0) as n_shingles, min(other) as component_id, doc_id = min(other) as kept
from reach left join n using (doc_id) group by doc_id
""",
    "op5_decontamination": r"""
with d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents
), b as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark
), bw as (
  select distinct item_id, least(10, len(w)) as n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') as win
  from (select item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) as i from b where len(w) > 0)
), dw as (
  select doc_id, i, s.n, array_to_string(w[i : i + s.n - 1], ' ') as win
  from (select doc_id, w, unnest(range(1, len(w) + 1)) as i from d), (select distinct n from bw) s where i + s.n - 1 <= len(w)
), hits as (
  select dw.doc_id, dw.i, dw.n, bw.item_id from dw join bw on dw.n = bw.n and dw.win = bw.win
), covered as (
  select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from hits) group by doc_id
), items as (
  select doc_id, count(*) as n_items, string_agg(id, ',' order by id) as ids from (select distinct doc_id, cast(item_id as varchar) as id from hits) group by doc_id
)
select d.doc_id, cast(len(d.w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join covered using (doc_id) left join items using (doc_id)
""",
    "op6_warc": r"""
with p as (select page_id, coalesce(html, '') as html from pages),
k as (select html, min(page_id) as keeper from p group by html),
h as (select page_id, keeper, octet_length(encode(html)) as n, sha1(html) as hex from p join k using (html)),
bits as (select *, list_transform(range(0, 40), lambda i: strpos('0123456789abcdef', hex[i + 1]) - 1) as q from h)
select page_id, cast(n as bigint) as payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + (((q[(5 * i) // 4 + 1] * 16 + coalesce(q[(5 * i) // 4 + 2], 0)) // cast(pow(2, 3 - (5 * i) % 4) as bigint)) % 32), 1)), '') as payload_digest,
       case when page_id = keeper then 'response' else 'revisit' end as record_type,
       case when page_id <> keeper then keeper end as refers_to
from bits
""",
    "op7_chat_formatting": r"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]'
  union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), e as (
  select *, lag(role) over w as before,
         length(regexp_replace(text, '([<\[])(\\*)(/?(?:s>|ROLE\]|PART\]|INST\]))', '\1\\\2\3', 'g')) as chars,
         length(regexp_replace(role, '([<\[])(\\*)(/?(?:s>|ROLE\]|PART\]|INST\]))', '\1\\\2\3', 'g')) as role_chars
  from t window w as (partition by conv_id order by turn nulls first, role, text)
)
select conv_id, count(*) as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
       cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
       cast(sum(chars + case when before = role then length('[PART]')
                             else length('<s>[ROLE][/ROLE]</s>') + role_chars end) as bigint) as formatted_chars
from e group by conv_id
""",
}
