"""Queries of derived models and calibration."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stemmata.functions.text import ngram_tokens, once
from stemmata.operators import models, retrieve
from stemmata.plans.registry import query
from stemmata.plans.text_reuse import D, FOLD, docs
from stemmata.tables import table

G = f"g0 as (select doc_id, source, list_filter(string_split({FOLD.format('text')}, ' '), lambda w: w <> '') as t from documents)"
NG = f"""{G}, og as (select source as author, t, unnest([1, 2, 3, 4, 5]) as ord from g0),
gr as (select author, ord, array_to_string(t[i : i + ord - 1], ' ') as gram from (select *, unnest(range(1, len(t) - ord + 2)) as i from og where len(t) >= ord)),
c1 as (select author, ord, gram, count(*) as count from gr group by all), cnt as (select * from c1 union all select '', ord, gram, cast(sum(count) as bigint) from c1 group by ord, gram),
tot as (select author, ord, cast(sum(count) as bigint) as tokens from cnt group by all), pr as (select * from cnt where ord < 3 or count >= 2)"""


def _model_rows(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", "source", once(ngram_tokens(F.coalesce("text", F.lit("")))).alias("t"))


@query(f"with {NG} select author, cast(ord as int) as ord, gram, count from pr")
def ngram_counts(spark, sf):
    return models.ngrams(_model_rows(spark, sf), "source", least=models.MIN_COUNT)


@query(f"with {NG} select author, cast(ord as int) as ord, tokens from tot")
def ngram_totals(spark, sf):
    return models.totals(_model_rows(spark, sf), "source")


@query(f"with {NG} select author, cast(ord as int) as ord, gram, count, floor(count * 1000000.0 / tokens) as rate, round(log2((count + 0.5) / (tokens + 0.5)), 4) as logp from pr join tot using (author, ord) where author = ''")
def ngram_rates(spark, sf):
    rows = _model_rows(spark, sf)
    rated = models.rates(models.pruned(models.pooled_ngrams(rows)), models.totals(rows, "source"))
    return rated.withColumn("rate", F.floor("rate").cast("double"))


@query(f"""with {NG}, rt as (select ord, gram, round(count * 1000000.0 / tokens, 4) as rate from pr join tot using (author, ord) where author = '' and ord in (4, 5)),
dg as (select distinct doc_id, ord, array_to_string(t[i : i + ord - 1], ' ') as gram from (select *, unnest(range(1, len(t) - ord + 2)) as i from (select doc_id, t, unnest([4, 5]) as ord from g0) where len(t) >= ord))
select doc_id, round(max(rate), 2) as peak from dg join rt using (ord, gram) group by doc_id""")
def peak_rate(spark, sf):
    return models.own_peaks(_model_rows(spark, sf), "doc_id").withColumn("peak", F.round("peak", 2))


PP = f"""d as (select doc_id, regexp_extract_all({FOLD.format('text')}, '[\\p{{L}}\\p{{N}}]+') as t from documents),
w as (select unnest(t) as w, count(*) as c from d group by 1 having count(*) >= 10), p as (select doc_id, unnest(t) as a, unnest(range(0, len(t))) as i from d),
ah as (select a, b, count(*) as n from (select p.a, unnest(d.t[p.i + 2 : p.i + 6]) as b from p join d using (doc_id)) group by all),
k as (select * from ah where a in (select w from w) and b in (select w from w)), b2 as (select a, b, sum(n) as n from (select a, b, n from k union all select b, a, n from k) group by all),
m as (select a, sum(n) as m from b2 group by a), tt as (select sum(m) as total from m),
sc as (select b2.a, b2.b, n, round(log2(n * total / (x.m * y.m)), 4) as weight from b2 join m x on x.a = b2.a join m y on y.a = b2.b, tt)"""


def _ppmi(spark, sf):
    return models.ppmi(docs(spark, sf).select("t"))


@query(f"with {PP} select a, b, cast(n as bigint) as n, weight from (select *, row_number() over (partition by a order by weight desc, b) as r from sc where weight > 0) where r <= 200")
def ppmi_pairs(spark, sf):
    return _ppmi(spark, sf)


@query(None)
def ppmi_cosine(spark, sf):
    """Every pair of words of the model that share a dimension."""
    return models.shared_cosines(_ppmi(spark, sf))


REG = f"""{D}, o as (select doc_id, t, unnest(range(0, len(t) - 11, 6)) as \"offset\" from d where len(t) >= 12),
m3 as (select gram, sum(own::int) as ours, sum((not own)::int) as theirs from (select lang = 'es' as own, array_to_string(t[i : i + 2], ' ') as gram from (select lang, t, unnest(range(1, len(t) - 1)) as i from d where len(t) >= 3)) group by gram), mt as (select sum(ours) as ta, sum(theirs) as tb from m3),
wg as (select doc_id, \"offset\", array_to_string(t[\"offset\" + i : \"offset\" + i + 2], ' ') as gram from (select *, unnest(range(1, 11)) as i from o)),
x as (select doc_id, \"offset\", round(sum(log2((ours / ta + 0.5 / greatest(ta, tb)) / (theirs / tb + 0.5 / greatest(ta, tb)))), 4) as llr from wg join m3 using (gram), mt group by all)"""


def _register(spark, sf):
    """Windows of all documents, without a closing tail, and counts of 3-grams of Spanish documents and of all others."""
    rows = docs(spark, sf)
    both = models.two_models(rows, F.col("lang") == "es", 3)
    return retrieve.sweep(rows, "doc_id", tail=False), models.one_model(both, "ours", 3), models.one_model(both, "theirs", 3)


@query(f"with {REG} select doc_id, cast(\"offset\" as int) as \"offset\", round(llr, 4) as llr from x")
def register_llr(spark, sf):
    swept, own, other = _register(spark, sf)
    return models.evidence(swept, ["doc_id", "offset"], own, other)


@query(f"""with {REG}, n as (select *, row_number() over (partition by doc_id order by \"offset\") as k from x), i as (select *, k - row_number() over (partition by doc_id order by \"offset\") as island from n where llr > 0)
select doc_id, cast(min(\"offset\") as int) as first, cast(max(\"offset\") + 12 as int) as after, max(llr) as peak, cast(arg_max(\"offset\", struct_pack(a := llr, b := -\"offset\")) as int) as peak_at, count(*) as windows from i group by doc_id, island""")
def register_spans(spark, sf):
    swept, own, other = _register(spark, sf)
    return models.evidence_spans(models.evidence(swept, ["doc_id", "offset"], own, other), ["doc_id"])


MK = f"""{D}, u as (select lang = 'es' as own, unnest(t) as gram from d), uc as (select own, gram, count(*) as c from u group by all), ut as (select own, sum(c) as n from uc group by own),
b as (select gram, c, c / n as their_rate from uc join ut using (own) where not own order by c desc, gram limit 300), mk as (select b.gram, round(a.c / t.n, 8) as our_rate, round(their_rate, 8) as their_rate, round((a.c / t.n + their_rate) / 2, 8) as scale, b.c from b join uc a on a.gram = b.gram and a.own join ut t on t.own order by b.c desc, b.gram limit 150)"""


def _markers(spark, sf):
    both = models.two_models(docs(spark, sf), F.col("lang") == "es", 1)
    return models.delta_markers(models.one_model(both, "ours", 1), models.one_model(both, "theirs", 1))


@query(f"with {MK} select gram, our_rate, their_rate, scale from mk")
def delta_markers(spark, sf):
    return _markers(spark, sf)


@query(f"""with {MK}, o as (select doc_id, t, unnest(range(0, len(t) - 11, 6)) as \"offset\" from d where len(t) >= 12), w as (select doc_id, \"offset\", unnest(t[\"offset\" + 1 : \"offset\" + 12]) as gram from o), r as (select doc_id, \"offset\", gram, count(*) / 12.0 as rate from w group by all),
zero as (select sum((their_rate - our_rate) / scale) as base, count(*) as n from mk),
h as (select doc_id, \"offset\", sum((abs(rate - their_rate) - abs(rate - our_rate) - (their_rate - our_rate)) / scale) as more from r join mk using (gram) group by all)
select doc_id, cast(o.\"offset\" as int) as \"offset\", round((base + coalesce(more, 0)) / n, 6) as delta from o left join h using (doc_id, \"offset\"), zero""")
def rolling_delta(spark, sf):
    swept = retrieve.sweep(docs(spark, sf), "doc_id", tail=False)
    return models.rolling_delta(swept, ["doc_id", "offset"], _markers(spark, sf))


EV = f"ev as (select doc_id, quality as truth, len(string_split(text, ' ')) as words, len(regexp_extract_all(text, '[A-Z]')) * 100.0 / greatest(1, length(text)) as caps from documents join labels using (doc_id))"


def _evidence(spark, sf):
    rows = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    return rows.select("doc_id", F.col("quality").alias("truth"), F.size(F.split("text", " ")).alias("words"), (F.size(F.regexp_extract_all("text", F.lit("[A-Z]"), F.lit(0))) * 100.0 / F.greatest(F.lit(1), F.length("text"))).alias("caps"))


def _bin_sql(field: str, edges: list[float]) -> str:
    return " + ".join(f"({field} >= {e})::int" for e in edges)


EDGES = {"words": [50.0, 100.0, 300.0, 900.0], "caps": [2.0, 5.0, 20.0]}


@query("with " + EV + " " + " union all ".join(
    f"select '{f}' as field, cast(b.bin as int) as bin, cast(coalesce(m, 0) as bigint) as m, cast(coalesce(u, 0) as bigint) as u, round(log2(((coalesce(m, 0) + 0.5) / (mt + {(len(e) + 1) / 2})) / ((coalesce(u, 0) + 0.5) / (ut + {(len(e) + 1) / 2}))), 4) as weight from (select unnest(range(0, {len(e) + 1})) as bin) b left join (select {_bin_sql(f, e)} as bin, sum(truth) as m, sum(1 - truth) as u from ev group by 1) c using (bin), (select sum(truth) as mt, sum(1 - truth) as ut from ev)"
    for f, e in sorted(EDGES.items())))
def fs_bin_weights(spark, sf):
    return models.field_weights(_evidence(spark, sf), EDGES)


GATES = [{"words": 100.0}, {"words": 300.0, "caps": 2.0}, {"caps": 20.0}]


@query("with " + EV + " " + " union all ".join(
    f"select {k} as gate, cast(sum(({' and '.join(f'{f} >= {v}' for f, v in g.items())})::int * truth) as bigint) as hits, round(sum(({' and '.join(f'{f} >= {v}' for f, v in g.items())})::int * truth) / sum(truth), 4) as recall, round(sum(({' and '.join(f'{f} >= {v}' for f, v in g.items())})::int * (1 - truth)) * 1000.0 / 40000, 4) as per_thousand from ev"
    for k, g in enumerate(GATES)))
def gate_table(spark, sf):
    return models.gate_table(_evidence(spark, sf), GATES, 40_000)


@query("with " + EV + " select doc_id, words >= 100.0 or (words >= 300.0 and caps >= 2.0) or caps >= 20.0 as admitted from ev")
def gate_admits(spark, sf):
    return _evidence(spark, sf).select("doc_id", models.admits(GATES).alias("admitted"))


WEIGHTS = {"words": [-2.0, -1.0, 0.5, 1.0, 2.0], "caps": [1.0, 0.5, -0.5, -3.0]}
KNOTS = [(-1.0, -4.0), (0.0, 0.0), (2.0, 5.0)]


@query("with " + EV + f", s as (select doc_id, words, [-2.0, -1.0, 0.5, 1.0, 2.0][1 + {_bin_sql('words', EDGES['words'])}] + [1.0, 0.5, -0.5, -3.0][1 + {_bin_sql('caps', EDGES['caps'])}] as total from ev), c as (select doc_id, case when words >= 60 then case when total <= -1 then -4.0 when total <= 0 then -4.0 + (total + 1) * 4.0 when total <= 2 then total * 2.5 else 5.0 end end as score from s) select doc_id, cast(score as double) as score, case when score >= 2 then 'accept' when score < -1 then 'reject' when score is not null then 'review' end as zone from c")
def composite_scores(spark, sf):
    score = models.composite_score(WEIGHTS, EDGES, {"words": 60.0}, KNOTS)
    return _evidence(spark, sf).select("doc_id", score.alias("score")).withColumn("zone", models.zone(F.col("score"), -1.0, 2.0))


@query("with " + EV + ", n as (select caps as score, 1 + cast(doc_id % 3 = 0 as int) * 9 as weight from ev where truth = 0), s as (select doc_id, caps as score from ev where truth = 1) select doc_id, round(score, 6) as score, round(coalesce((select sum(weight) from n where n.score >= s.score), 0) * 12 / 1000.0, 6) as e_value from s")
def e_values(spark, sf):
    ev = _evidence(spark, sf)
    null = ev.filter("truth = 0").select(F.col("caps").alias("score"), (1 + (F.col("doc_id") % 3 == 0).cast("int") * 9).alias("weight"))
    scored = models.e_values(ev.filter("truth = 1").select("doc_id", F.col("caps").alias("score")), null, 1000.0, 12.0)
    return scored.select("doc_id", F.round("score", 6).alias("score"), F.coalesce("e_value", F.lit(0.0)).alias("e_value"))


@query("with e as (select user_id, sum(value) as v from events group by user_id), s as (select user_id % 10 as rep, max(v) as peak from e group by all), q as (select list_sort(list(peak)) as p from s) select round(p[cast(least(floor(0.5 * len(p)), len(p) - 1) as int) + 1], 4) as median, round(p[cast(least(floor(0.95 * len(p)), len(p) - 1) as int) + 1], 4) as high from q")
def null_quantiles(spark, sf):
    per = table(spark, sf, "events").groupBy("user_id").agg(F.sum("value").alias("v")).groupBy((F.col("user_id") % 10).alias("rep")).agg(F.max("v").alias("peak"))
    held = per.agg(F.collect_list("peak").alias("p"))
    return held.select(F.round(models.order_quantile(F.col("p"), 0.5), 4).alias("median"), F.round(models.order_quantile(F.col("p"), 0.95), 4).alias("high"))


COS = "list_sum(list_transform(range(1, len(a.embedding) + 1), lambda i: a.embedding[i]::double * b.embedding[i]::double)) / sqrt(list_sum(list_transform(a.embedding, lambda x: x::double * x::double)) * list_sum(list_transform(b.embedding, lambda x: x::double * x::double)))"


@query(f"with q as (select * from embeddings where vec_id % 50 = 0), s as (select a.vec_id as query_id, b.vec_id, round({COS}, 4) as cosine from q a join embeddings b on a.vec_id <> b.vec_id) select query_id, vec_id, cosine from (select *, row_number() over (partition by query_id order by cosine desc, vec_id) as r from s) where r <= 5")
def cosine_topk(spark, sf):
    """Queries are the ids divisible by 50, at any size."""
    rows = table(spark, sf, "embeddings").select("vec_id", "embedding")
    return models.dense_topk(rows, rows.filter("vec_id % 50 = 0"), 5).drop("rank")
