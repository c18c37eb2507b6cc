"""Queries of scan, knowledge, sources and streaming operators."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from stemmata.functions import kernels
from stemmata.operators import index, knowledge, runs, scan
from stemmata.plans.registry import query
from stemmata.plans.text_reuse import SEEDS, docs, items
from stemmata.session import ship
from stemmata.sources import markup, store
from stemmata.streaming import scan as streaming
from stemmata.tables import table


@query(None)
def scan_full(spark, sf):
    return scan.scan(docs(spark, sf).select("doc_id", "t"), items(spark, sf))


@query(None)
def search_full(spark, sf):
    return scan.search(docs(spark, sf).select("doc_id", "t"), items(spark, sf))


def _pairs(spark, sf):
    rows, held = docs(spark, sf).select("doc_id", "t"), items(spark, sf)
    found = runs.longest_runs(runs.shared_runs(rows, held, "doc_id", "item_id"), "doc_id", "item_id").select("doc_id", "item_id", "first")
    ship(spark)
    return found.join(rows, "doc_id").join(held.select("item_id", F.col("t").alias("item")), "item_id").withColumn("own", F.slice("t", F.greatest(F.lit(1), F.col("first") - 11), F.size("item") + 24))


@query(None)
def kernel_scores(spark, sf):
    scored = _pairs(spark, sf)
    return scored.select("doc_id", "item_id", kernels.ratio_udf("own", "item").alias("ratio"), kernels.junk_ratio_udf("own", "item").alias("junk_ratio"), kernels.coverage_udf("own", "item").alias("coverage"), kernels.block_coverage_udf("own", "item").alias("block_coverage"), kernels.variants_udf("own", "item").alias("variants"), kernels.span_udf("own", "item").alias("span"))


def _bits(spark, sf):
    held = items(spark, sf)
    total = held.filter(F.size("t") > 0).count()
    return {r.token: math.log2(total / (r.docs + 1)) for r in index.token_df(held, "item_id").collect()}


@query(None)
def chain_scores(spark, sf):
    bits = _bits(spark, sf)
    return _pairs(spark, sf).select("doc_id", "item_id", kernels.chain_udf(bits)("own", "item").alias("walled"), kernels.chain_udf(bits, True)("own", "item").alias("concave"))


@query(None)
def parallel_edges(spark, sf):
    held = items(spark, sf)
    grams = runs.grams(held, "item_id", 3, "i").select("item_id", "gram").distinct()
    pairs = grams.select(F.col("item_id").alias("a"), "gram").join(grams.select(F.col("item_id").alias("b"), "gram"), "gram").filter("a < b").select("a", "b").distinct()
    both = pairs.join(held.select(F.col("item_id").alias("a"), F.col("t").alias("ta")), "a").join(held.select(F.col("item_id").alias("b"), F.col("t").alias("tb")), "b")
    return knowledge.parallel_edges(both, _bits(spark, sf), 3, 5.0)


@query(None)
def witness_profiles(spark, sf):
    held = items(spark, sf)
    changed = held.select("item_id", F.lit("b").alias("source"), F.transform("t", lambda w, i: F.when(i % 7 == 3, F.concat(w, F.lit("s"))).otherwise(w)).alias("t"))
    short = held.select("item_id", F.lit("c").alias("source"), F.filter("t", lambda w, i: i % 9 != 5).alias("t"))
    return knowledge.profiles(held.select("item_id", F.lit("a").alias("source"), "t").unionByName(changed).unionByName(short), "item_id")


@query(None)
def align_books(spark, sf):
    from stemmata.functions.text import tokens

    rows = table(spark, sf, "conversations").select(F.col("conv_id").alias("book"), F.col("turn").alias("verse"), tokens(F.coalesce("text", F.lit(""))).alias("t"))
    return knowledge.aligned_books(rows, rows.filter("verse <> 1").withColumn("verse", F.col("verse") + 10))


@query("with w as (select doc_id, unnest(regexp_extract_all(text, '[A-Z][a-z]+')) as name, source from documents), n as (select name, count(distinct source) as bearers, min(source) as one from w group by name) select name, case when bearers = 1 then one end as entity, bearers from n")
def name_crosswalk(spark, sf):
    rows = table(spark, sf, "documents").select("source", F.explode(F.regexp_extract_all("text", F.lit("[A-Z][a-z]+"), F.lit(0))).alias("name"))
    return knowledge.crosswalk(rows, "name", "source").withColumnRenamed("source", "entity")


@query("with e as (select distinct user_id % 50 as event, user_id as entity from events) select event, count(distinct entity) as entities from e group by event having count(distinct entity) >= 2")
def episodes(spark, sf):
    rows = table(spark, sf, "events")
    members = rows.select((F.col("user_id") % 50).alias("event"), F.col("user_id").alias("entity"))
    return knowledge.episodes(members.select("event").distinct(), members).select("event", F.size("entities").cast("long").alias("entities"))


COM = "m as (select distinct l_suppkey as k, cast(l_partkey as bigint) as pos, l_linenumber as entity from lineitem), s as (select *, coalesce(pos - lag(pos) over (partition by k order by pos, entity) > 4, false) as new from m), c as (select *, sum(new::int) over (partition by k order by pos, entity) as cluster from s)"


@query(f"with {COM} select k, cast(cluster as bigint) as cluster, min(pos) as first, max(pos) as last, count(distinct entity) as n from c group by k, cluster having count(distinct entity) >= 2")
def co_mentions(spark, sf):
    found = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("k"), F.col("l_partkey").alias("pos"), F.col("l_linenumber").alias("entity")).distinct()
    return knowledge.co_mentions(found, "k").select("k", "cluster", "first", "last", F.size("entities").cast("long").alias("n"))


@query(f"with {SEEDS}, p as (select distinct doc_id as a, item_id as b from r), q as (select a, b from p union select b, a from p) select a, b from q".replace(", p as (select distinct doc_id as a", ", p0 as (select distinct doc_id as a").replace("from p union select b, a from p", "from p0 union select b, a from p0"))
def undirected_edges(spark, sf):
    found = runs.shared_runs(docs(spark, sf), items(spark, sf), "doc_id", "item_id").select(F.col("doc_id").alias("a"), F.col("item_id").alias("b"))
    return knowledge.undirected(found)


@query("with o as (select l_returnflag as source, l_orderkey, l_linenumber, max(l_quantity) as l_quantity from lineitem where l_linenumber <= 2 group by all), s as (select source, count(*) as verses, cast(sum(l_quantity) as bigint) as words from o group by source), t as (select l_returnflag as source, count(*) as total from lineitem group by 1) select source, verses, words, round(verses / total, 6) as share, verses > 20000 as over_verses, verses / total > 0.5 as over_share from s join t using (source)")
def quota_usage(spark, sf):
    rows = table(spark, sf, "lineitem")
    used = rows.filter("l_linenumber <= 2").select(F.col("l_returnflag").alias("source"), F.lit("L").alias("book"), F.col("l_orderkey").alias("chapter"), F.col("l_linenumber").alias("verse"), F.col("l_quantity").cast("long").alias("words"))
    used = used.groupBy("source", "book", "chapter", "verse").agg(F.max("words").alias("words"))
    quotas = rows.groupBy(F.col("l_returnflag").alias("source")).agg(F.count("*").alias("total")).withColumn("max_verses", F.lit(20000)).withColumn("max_share", F.lit(0.5))
    return knowledge.quota_usage(used, quotas)


@query("select c_nationkey as source, max_by(c_mktsegment, struct_pack(r := length(c_mktsegment), s := c_mktsegment)) as licence, cast(max(length(c_mktsegment)) as int) as rank from customer group by 1")
def licence_strictest(spark, sf):
    rows = table(spark, sf, "customer").select(F.col("c_nationkey").alias("source"), F.col("c_mktsegment").alias("licence"), F.length("c_mktsegment").alias("rank"))
    return knowledge.strictest(rows, "source")


PASS = "asked as (select distinct l_orderkey as id, l_returnflag as language, l_partkey as verse from lineitem), held as (select distinct l_suppkey as source, l_partkey as verse from lineitem where l_suppkey <= 12), ed as (select unnest(range(1, 13)) as source), ed2 as (select source, case when source % 2 = 0 then 'N' else 'R' end as language, source % 5 as priority from ed)"


@query(f"""with {PASS}, z as (select id, language, count(*) as verses from asked group by all), f as (select a.id, a.language, e.source, count(*) as found from asked a join ed2 e using (language) join held h on h.source = e.source and h.verse = a.verse group by all),
j as (select z.id, z.language, e.source, e.priority, verses, coalesce(found, 0) as found from z left join ed2 e using (language) left join f on f.id = z.id and f.language = z.language and f.source = e.source),
k as (select *, row_number() over (partition by id, language order by (found = verses) desc, case when found = verses then priority end nulls first, found desc, priority, source) as p from j)
select id, language, case when found > 0 then source end as source, verses, found, case when source is null then 'no edition' when found = 0 then 'absent' when found < verses then 'partial' else 'ok' end as status from k where p = 1""")
def passage_resolve(spark, sf):
    rows = table(spark, sf, "lineitem")
    asked = rows.select(F.concat_ws("|", "l_orderkey", "l_returnflag").alias("id"), F.col("l_returnflag").alias("language"), F.col("l_partkey").alias("verse")).distinct()
    held = rows.filter("l_suppkey <= 12").select(F.col("l_suppkey").alias("source"), F.col("l_partkey").alias("verse")).distinct()
    editions = spark.range(1, 13).select(F.col("id").alias("source"), F.when(F.col("id") % 2 == 0, "N").otherwise("R").alias("language"), (F.col("id") % 5).alias("priority"))
    out = knowledge.resolve_passages(asked, held, editions)
    return out.select(F.split("id", r"\|")[0].cast("long").alias("id"), F.split("id", r"\|")[1].alias("language"), "source", "verses", "found", "status")


@query("select page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) as title, trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&nbsp;', ' '), '&amp;', '&'), '\\s+', ' ', 'g')) as text from pages")
def html_extract(spark, sf):
    title, text = markup.page_text(F.col("html"))
    return table(spark, sf, "pages").select("page_id", title.alias("title"), text.alias("text"))


@query("select conv_id as chapter, turn + 1 as verse, trim(regexp_replace(text, '\\s+', ' ', 'g')) as text from conversations")
def standard_markers(spark, sf):
    """Conversations written as one marked book per file and read back."""
    turns = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    body = F.array_join(F.transform("t", lambda t: F.concat(F.lit("\\v "), (t["turn"] + 1).cast("string"), F.lit(" "), t["text"], F.lit("\\f + note \\f*"))), "\n")
    files = turns.select(F.col("conv_id").cast("string").alias("path"), F.concat(F.lit("\\id CNV\n\\h Heading\n\\c "), F.col("conv_id").cast("string"), F.lit("\n"), body).alias("content"))
    return markup.standard_markers(files).select(F.col("chapter").cast("long").alias("chapter"), F.col("verse").cast("long").alias("verse"), "text")


@query("select source, doc_id, sha256 from (select source, lang, doc_id, sha256(text) as sha256, row_number() over (partition by source, lang order by n_chars desc, sha256(text) desc) as k from documents) where k = 1")
def manifest_latest(spark, sf):
    rows = table(spark, sf, "documents").select("source", "lang", "doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha256"), F.col("n_chars").alias("fetched_at"))
    return store.latest(rows, ["source", "lang"]).select("source", "doc_id", "sha256")


@query("select doc_id, sha256(text) as sha256 from documents where source = 'src1' and sha256(text) not in (select sha256(text) from documents where source <> 'src1')")
def mirror_missing(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", "source", F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))
    return store.to_copy(rows.filter("source = 'src1'"), rows.filter("source <> 'src1'")).select("doc_id", "sha256")


@query(None)
def library_digest(spark, sf):
    return store.digest({n: table(spark, sf, n) for n in ("documents", "benchmark", "conversations")})


@query("select source as corpus, lang as book, count(distinct doc_id % 10) as chapters, count(*) as verses from documents group by all")
def inventory(spark, sf):
    return store.inventory(table(spark, sf, "documents").select(F.col("source").alias("corpus"), F.col("lang").alias("book"), (F.col("doc_id") % 10).alias("chapter")))


@query("with s as (select *, coalesce(ts - lag(ts) over w > interval 30 minute, false) or coalesce(ts - lag(ts) over w = interval 30 minute, false) as new from events window w as (partition by user_id order by ts)), c as (select *, sum(new::int) over (partition by user_id order by ts) as n_s from s) select user_id, min(ts) as first, max(ts) + interval 30 minute as after, count(*) as n, round(sum(value), 2) as total from c group by user_id, n_s")
def event_sessions(spark, sf):
    return streaming.sessions(table(spark, sf, "events"), "user_id", "ts", "30 minutes")
