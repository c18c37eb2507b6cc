"""Queries over documents and benchmark items: index, retrieval, runs, windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stemmata.functions.text import fold, ngram_tokens, once, scaled_run, tokens
from stemmata.operators import index, retrieve, runs, windows
from stemmata.plans.registry import query
from stemmata.tables import table

#: DuckDB text of the tokenisers.
FOLD = r"trim(regexp_replace(lower(strip_accents({0})), '\s+', ' ', 'g'))"
TOKENS = r"regexp_extract_all(" + FOLD + r", '[\p{{L}}\p{{N}}]+')"
D = f"d as (select doc_id, source, lang, {TOKENS.format('text')} as t from documents)"
B = f"b as (select item_id, {TOKENS.format('text')} as t from benchmark)"


def docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", "source", "lang", once(tokens(F.coalesce("text", F.lit("")))).alias("t"))


def items(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select("item_id", once(tokens(F.coalesce("text", F.lit("")))).alias("t"))


@query(f"with {D} select doc_id, cast(len(t) as bigint) as n_tokens, md5(array_to_string(t, ' ')) as digest from d")
def fold_tokens(spark, sf):
    return docs(spark, sf).select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.md5(F.array_join("t", " ").cast("binary")).alias("digest"))


@query(f"select doc_id, md5({FOLD.format('text')}) as digest, cast(len(list_filter(string_split({FOLD.format('text')}, ' '), lambda w: w <> '')) as bigint) as words from documents")
def folded_text(spark, sf):
    rows = table(spark, sf, "documents")
    return rows.select("doc_id", F.md5(fold(F.col("text")).cast("binary")).alias("digest"), F.size(ngram_tokens(F.col("text"))).cast("long").alias("words"))


@query(f"with {D}, x as (select distinct sha1(array_to_string(t, ' ')) as text_id, t from d where len(t) > 0) select token, count(*) as docs from (select text_id, unnest(list_distinct(t)) as token from x) group by token")
def token_df(spark, sf):
    return index.token_df(index.distinct_texts(docs(spark, sf), "doc_id"))


@query(f"with {D} select sha1(array_to_string(t, ' ')) as text_id, count(*) as refs, min(doc_id) as first_key from d where len(t) > 0 group by 1")
def distinct_texts(spark, sf):
    return index.distinct_texts(docs(spark, sf), "doc_id").drop("t")


SEEDS = f"""{D}, {B},
bg as (select item_id, unnest(range(1, len(t) - 4)) as j, t from b where len(t) >= 6), bs as (select item_id, j, array_to_string(t[j : j + 5], ' ') as g from bg),
dg as (select doc_id, unnest(range(1, len(t) - 4)) as i, t from d where len(t) >= 6), ds as (select doc_id, i, array_to_string(t[i : i + 5], ' ') as g from dg),
p as (select doc_id, item_id, i, j, i - row_number() over (partition by doc_id, item_id, i - j order by i) as island from ds join bs using (g)),
r as (select doc_id, item_id, min(i) - 1 as first, min(j) - 1 as item_first, count(*) + 5 as run from p group by doc_id, item_id, i - j, island)"""


@query(f"with {SEEDS} select doc_id, item_id, max(run) as run from r group by all")
def quotation_scan(spark, sf):
    return runs.longest_runs(runs.shared_runs(docs(spark, sf), items(spark, sf), "doc_id", "item_id"), "doc_id", "item_id").select("doc_id", "item_id", "run")


@query(f"with {SEEDS} select doc_id, item_id, cast(first as int) as first, cast(item_first as int) as item_first, run from r")
def quotation_spans(spark, sf):
    return runs.shared_runs(docs(spark, sf), items(spark, sf), "doc_id", "item_id")


DF = "n as (select count(*) as total from b where len(t) > 0), df as (select token, count(*) as docs from (select item_id, unnest(list_distinct(t)) as token from b) group by token)"
TERMS = f"""{D}, {B}, {DF},
q as (select doc_id, unnest(list_distinct(t)) as token from d),
s as (select doc_id, token, coalesce(docs, 0) as docs, case when docs > 0 then ln(total / docs) else 1.0 end as idf from q left join df using (token), n where length(token) >= 2 and coalesce(docs, 0) <= 0.1 * total),
terms as (select * from (select *, row_number() over (partition by doc_id order by idf desc, token desc) as rank from s) where rank <= 14)"""


def _terms(spark, sf):
    held = items(spark, sf)
    total = held.filter(F.size("t") > 0).count()
    df = index.token_df(held, "item_id")
    return held, total, retrieve.query_terms(docs(spark, sf).select("doc_id", "t"), df, total, ["doc_id"], common=0.1)


@query(f"with {TERMS} select doc_id, token, docs, round(idf, 6) as idf, cast(rank as int) as rank from terms")
def query_terms(spark, sf):
    return _terms(spark, sf)[2].withColumn("idf", F.round("idf", 6))


@query(f"""with {TERMS}, post as (select item_id, token, count(*) as tf, any_value(len(t)) as length from (select item_id, t, unnest(t) as token from b) group by item_id, token),
mean as (select avg(len(t)) as mean_length from b),
c as (select doc_id, item_id, round(sum(ln(1 + (total - docs + 0.5) / (docs + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * length / mean_length))), 6) as score from terms join post using (token), n, mean group by doc_id, item_id)
select doc_id, item_id, score, cast(rank as int) as rank from (select *, row_number() over (partition by doc_id order by score desc, item_id) as rank from c) where rank <= 10""")
def bm25_topk(spark, sf):
    held, total, terms = _terms(spark, sf)
    mean = held.agg(F.avg(F.size("t"))).first()[0]
    return retrieve.bm25(terms, index.postings(held, "item_id"), total, mean, ["doc_id"], "item_id", 10)


@query(f"with {B}, {DF} select token, docs, round(ln(total / docs), 6) as idf, round(log2(total / (docs + 1)), 6) as bits from df, n")
def idf_weights(spark, sf):
    from stemmata.functions.text import idf, surprisal

    held = items(spark, sf)
    total = F.lit(float(held.filter(F.size("t") > 0).count()))
    return index.token_df(held, "item_id").select("token", "docs", F.round(idf(total, F.col("docs")), 6).alias("idf"), F.round(surprisal(total, F.col("docs")), 6).alias("bits"))


SWEEP = f"{D}, o as (select doc_id, t, unnest(list_distinct(list_concat(range(0, greatest(0, len(t) - 12) + 1, 6), [greatest(0, len(t) - 12)]))) as offset from d where len(t) > 0)"


@query(f"with {SWEEP} select doc_id, cast(\"offset\" as int) as \"offset\", cast(len(t[\"offset\" + 1 : \"offset\" + 12]) as int) as words from o")
def sweep_windows(spark, sf):
    return retrieve.sweep(docs(spark, sf), "doc_id").select("doc_id", "offset", F.size("t").alias("words"))


NEAR = f"""{SWEEP}, {B}, w as (select doc_id, \"offset\", unnest(t[\"offset\" + 1 : \"offset\" + 12]) as token from o), {DF},
rare as (select token from df where docs = 1), hit as (select distinct doc_id, \"offset\" from w join rare using (token))"""


@query(f"""with {NEAR}, m as (select *, coalesce(\"offset\" - lag(\"offset\") over (partition by doc_id order by \"offset\") > 12, false) as new from hit),
c as (select *, sum(new::int) over (partition by doc_id order by \"offset\") as cluster from m)
select doc_id, cast(cluster as bigint) as cluster, cast(min(\"offset\") as int) as first, cast(max(\"offset\") as int) as last, count(*) as n from c group by doc_id, cluster""")
def window_clusters(spark, sf):
    swept = retrieve.sweep(docs(spark, sf), "doc_id").select("doc_id", "offset", F.explode("t").alias("token"))
    rare = index.token_df(items(spark, sf), "item_id").filter("docs = 1").select("token")
    return retrieve.clusters(swept.join(rare, "token", "left_semi").select("doc_id", "offset").distinct(), ["doc_id"])


@query(f"""with {SWEEP}, {B}, {DF}, w as (select distinct doc_id, \"offset\", unnest(t[\"offset\" + 1 : \"offset\" + 12]) as token from o),
s as (select doc_id, \"offset\", token, coalesce(docs, 0) as docs, case when docs > 0 then ln(total / docs) else 1.0 end as idf from w left join df using (token), n where length(token) >= 2 and coalesce(docs, 0) <= 0.1 * total),
terms as (select * from (select *, row_number() over (partition by doc_id, \"offset\" order by idf desc, token desc) as k from s) where k <= 6),
post as (select item_id, token, count(*) as tf, any_value(len(t)) as length from (select item_id, t, unnest(t) as token from b) group by item_id, token), mean as (select avg(len(t)) as mean_length from b),
c as (select doc_id, \"offset\", item_id, round(sum(ln(1 + (total - docs + 0.5) / (docs + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * length / mean_length))), 6) as score from terms join post using (token), n, mean group by all),
k as (select *, row_number() over (partition by doc_id, \"offset\" order by score desc, item_id) as rank from c),
v as (select doc_id, item_id, round(sum(-1.0 / rank), 6) as weight, count(*) as windows from k where rank <= 60 group by all)
select doc_id, item_id, round(weight, 4) as weight, windows from (select *, row_number() over (partition by doc_id order by weight, item_id) as place from v) where place <= 40""")
def candidate_votes(spark, sf):
    held = items(spark, sf)
    total = held.filter(F.size("t") > 0).count()
    mean = held.agg(F.avg(F.size("t"))).first()[0]
    swept = retrieve.sweep(docs(spark, sf), "doc_id")
    terms = retrieve.query_terms(swept, index.token_df(held, "item_id"), total, ["doc_id", "offset"], retrieve.SWEEP_TERMS, common=0.1)
    found = retrieve.bm25(terms, index.postings(held, "item_id"), total, mean, ["doc_id", "offset"], "item_id", retrieve.SWEEP_CANDIDATES)
    return retrieve.votes(found, "doc_id", "item_id").select("doc_id", "item_id", F.round("weight", 4).alias("weight"), "windows")


@query(f"with {D}, x as (select distinct sha1(array_to_string(t, ' ')) as text_id from d where len(t) > 0), k as (select sha1(array_to_string(t, ' ')) as text_id from d where len(t) > 0 and lang = 'en') select text_id from x where text_id not in (select text_id from k)")
def orphan_texts(spark, sf):
    rows = docs(spark, sf)
    return index.orphans(index.distinct_texts(rows, "doc_id").select("text_id"), index.text_ids(rows.filter("lang = 'en'"), "doc_id"))


STATE = "meta as (select source, count(*) as verses from documents group by source), state as (select source, verses - cast(right(source, 1) = '3' as int) as verses, case when right(source, 1) = '5' then null when right(source, 1) = '7' then 0 else 1 end as fold_version from meta where right(source, 1) <> '9')"


def _state(spark, sf):
    meta = table(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("verses"))
    end = F.substring("source", -1, 1)
    state = meta.filter(end != "9").select("source", (F.col("verses") - (end == "3").cast("int")).alias("verses"), F.when(end == "5", F.lit(None)).when(end == "7", 0).otherwise(1).alias("fold_version"))
    return meta, state


@query(f"with {STATE} select m.source, m.verses, s.verses as indexed, case when s.source is null then 'missing' when fold_version is null then 'unknown' when fold_version <> 1 then 'drifted' when m.verses <> s.verses then 'drifted' else 'current' end as state from meta m left join state s using (source)")
def index_coverage(spark, sf):
    return index.coverage(*_state(spark, sf))


@query(f"with {STATE} select source, verses from meta where source in (select source from state)")
def searchable_sources(spark, sf):
    return index.searchable(*_state(spark, sf))


@query(f"with {SEEDS}, s as (select distinct doc_id, first, first + run as after from r) select doc_id, cast(first as int) as first, cast(after as bigint) as after from s a where not exists (select 1 from s b where a.doc_id = b.doc_id and b.first <= a.first and b.after >= a.after and (b.first < a.first or b.after > a.after))")
def contained_spans(spark, sf):
    found = runs.shared_runs(docs(spark, sf), items(spark, sf), "doc_id", "item_id")
    return windows.not_contained(found.select("doc_id", "first", (F.col("first") + F.col("run")).alias("after")), ["doc_id"])


@query(f"""with {SEEDS}, s as (select doc_id, item_id, first, first + run as after from r)
select a.doc_id, a.item_id as a_item, b.item_id as b_item, cast(a.first as int) as a_first, cast(b.first as int) as b_first from s a join s b on a.doc_id = b.doc_id and (a.item_id < b.item_id)
where least(a.after, b.after) - greatest(a.first, b.first) > 0 and (least(a.after, b.after) - greatest(a.first, b.first)) * 2 > least(a.after - a.first, b.after - b.first)""")
def interval_overlaps(spark, sf):
    found = runs.shared_runs(docs(spark, sf), items(spark, sf), "doc_id", "item_id").withColumn("after", F.col("first") + F.col("run"))
    side = lambda p: found.select("doc_id", F.col("item_id").alias(f"{p}_item"), F.col("first").alias(f"{p}_first"), F.col("after").alias(f"{p}_after"))
    claimed = windows.majority_overlaps(side("a"), side("b"), ["doc_id"], F.lit(False)).filter("a_item < b_item")
    return claimed.select("doc_id", "a_item", "b_item", "a_first", "b_first")


@query(f"""with {D}, s as (select doc_id, t, cast(greatest(1, ceil((len(t) - 50) / 450.0)) as int) as parts from d)
select doc_id, parts, cast(part as int) as part, cast(part * 450 as int) as \"offset\", cast(len(t[part * 450 + 1 : part * 450 + 500]) as int) as words from (select *, unnest(range(0, parts)) as part from s)""")
def document_shards(spark, sf):
    return windows.shards(docs(spark, sf), "doc_id", 500, 50).select("doc_id", "parts", "part", "offset", F.size("t").alias("words"))


@query(f"with {SEEDS} select doc_id, item_id, cast(min(first) as int) as first from r group by doc_id, item_id having max(run) >= 6 and max(run) * 1.0 / (select len(t) from b where b.item_id = r.item_id) >= 0.5")
def scaled_quotations(spark, sf):
    held = items(spark, sf)
    found = runs.shared_runs(docs(spark, sf), held, "doc_id", "item_id").groupBy("doc_id", "item_id").agg(F.min("first").alias("first"), F.max("run").alias("run"))
    sized = found.join(held.select("item_id", F.size("t").alias("n")), "item_id")
    return sized.filter((F.col("run") >= scaled_run(3, F.col("n"))) & (F.col("run") / F.col("n") >= 0.5)).select("doc_id", "item_id", "first")


FORMULA = "f as (select doc_id, pos + 1 as place from (select doc_id, unnest(t) as token, unnest(range(0, len(t))) as pos from d) where token = 'that')"


@query(f"with {SEEDS}, {FORMULA}, s as (select doc_id, first, first + run as after from r) select f.doc_id, cast(place as int) as place from f where not exists (select 1 from s where s.doc_id = f.doc_id and s.first < f.place + 6 and s.after > f.place)")
def formula_debts(spark, sf):
    rows = docs(spark, sf)
    announced = rows.select("doc_id", F.posexplode("t").alias("pos", "token")).filter("token = 'that'").select("doc_id", (F.col("pos") + 1).alias("at"))
    found = runs.shared_runs(rows, items(spark, sf), "doc_id", "item_id").select("doc_id", "first", (F.col("first") + F.col("run")).alias("after"))
    return windows.unmet(announced, found, "doc_id").withColumnRenamed("at", "place")


@query(f"with {SEEDS}, w as (select doc_id, unnest(range(0, len(t))) as pos from d where doc_id in (select doc_id from r)), s as (select doc_id, first, first + run as after from r) select doc_id, count(*) as words from w where not exists (select 1 from s where s.doc_id = w.doc_id and pos >= first - 6 and pos < after) group by doc_id")
def residue_words(spark, sf):
    rows = docs(spark, sf)
    found = runs.shared_runs(rows, items(spark, sf), "doc_id", "item_id").select("doc_id", "first", (F.col("first") + F.col("run")).alias("after"))
    words = rows.join(found.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", F.explode(F.sequence(F.lit(0), F.size("t") - 1)).alias("pos"))
    return windows.residue(words, found, "doc_id").groupBy("doc_id").agg(F.count("*").alias("words"))


PAIRS = f"{SEEDS}, pairs as (select distinct doc_id, item_id from r)"


@query(f"with {PAIRS} select doc_id, item_id, round(len(list_filter(b.t, lambda w: list_contains(d.t, w))) * 1.0 / len(b.t), 4) as containment from pairs join d using (doc_id) join b using (item_id)")
def containment(spark, sf):
    rows, held = docs(spark, sf), items(spark, sf)
    pairs = runs.shared_runs(rows, held, "doc_id", "item_id").select("doc_id", "item_id").distinct()
    return runs.containment(rows, held, "doc_id", "item_id", pairs)


AGREE = f"""{PAIRS}, {DF}, lx as (select token, log2(total / (docs + 1)) as bits from df, n),
dw as (select pairs.item_id, doc_id, unnest(t) as token, unnest(range(0, len(t))) as i from d join pairs using (doc_id)), bw as (select item_id, unnest(t) as token, unnest(range(0, len(t))) as j from b),
a as (select doc_id, item_id, i, j, min(bits) as bits from dw join bw using (item_id, token) join lx using (token) group by all)"""


def _agreeing(spark, sf):
    rows, held = docs(spark, sf), items(spark, sf)
    pairs = runs.shared_runs(rows, held, "doc_id", "item_id").select("doc_id", "item_id").distinct()
    total = F.lit(float(held.filter(F.size("t") > 0).count()))
    bits = index.token_df(held, "item_id").select(F.col("token").alias("lemma"), F.log2(total / (F.col("docs") + 1)).alias("bits"))
    left = rows.join(pairs, "doc_id").select("doc_id", "item_id", F.posexplode("t").alias("i", "lemma"))
    right = pairs.join(held.select("item_id", F.posexplode("t").alias("j", "lemma")), "item_id").join(bits, "lemma")
    return runs.agreeing(left, right, ["doc_id", "item_id"])


@query(f"""with {AGREE}, isl as (select *, i - row_number() over (partition by doc_id, item_id, i - j order by i) as island from a),
g as (select doc_id, item_id, count(*) as run, round(sum(bits), 4) as bits, min(i) as first from isl group by doc_id, item_id, i - j, island)
select doc_id, item_id, run as lemma_run, bits, cast(first as int) as first from (select *, row_number() over (partition by doc_id, item_id order by run desc, bits desc, first) as k from g) where k = 1""")
def lemma_runs(spark, sf):
    return runs.lemma_runs(_agreeing(spark, sf), ["doc_id", "item_id"])


@query(f"with {AGREE}, h as (select doc_id, item_id, i - j as d, count(*) as n from a where bits >= 2 group by all) select doc_id, item_id, max(n) as peak, cast(sum(n) as bigint) as votes, round(max(n) / sum(n), 4) as share from h group by all")
def offset_histogram(spark, sf):
    return runs.offset_peak(_agreeing(spark, sf), ["doc_id", "item_id"], 2.0)


@query(f"""with {AGREE}, di as (select distinct doc_id, item_id, i from a), m as (select *, coalesce(i - lag(i) over (partition by doc_id, item_id order by i) > 1, true) as new from di)
select doc_id, item_id, cast(sum(new::int) as bigint) as chunks, count(*) as matches, round(pow(sum(new::int) / count(*), 3), 4) as fragmentation from m group by all""")
def fragmentation(spark, sf):
    return runs.fragmentation(_agreeing(spark, sf), ["doc_id", "item_id"])


@query(f"""with {D}, {B}, w as (select * from (select distinct unnest(t) as word from b) where regexp_full_match(word, '[ -~]+')), f as (select * from (select distinct unnest(t) as form from d) where regexp_full_match(form, '[ -~]+')),
p as (select word, form, case when length(word) <= 4 then 1 else 2 end as k, levenshtein(word, form) as distance from w join f on abs(length(word) - length(form)) <= 2 where length(word) <= 24)
select word, form, cast(distance as int) as distance from p where distance <= k""")
def edit_recovery(spark, sf):
    words = items(spark, sf).select(F.explode("t").alias("word")).filter(F.rlike("word", F.lit("^[ -~]+$")))
    forms = docs(spark, sf).select(F.explode("t").alias("form")).filter(F.rlike("form", F.lit("^[ -~]+$")))
    return runs.recover(words, forms)
