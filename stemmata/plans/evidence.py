"""Queries of the remaining operators: seed masks, lemma frequencies, verdict algebra, correlations, grids, references."""

from __future__ import annotations

from pyspark.sql import functions as F

from stemmata.functions import phrases, references, stem
from stemmata.functions.text import tokens
from stemmata.operators import audit, index, knowledge, models, render, retrieve, scan
from stemmata.plans.coordinates import EDITIONS, TURNS, VERDICTS, _editions, _turn_scores
from stemmata.plans.registry import query
from stemmata.plans.text_reuse import DF, SWEEP, B, D, docs, items
from stemmata.session import ship
from stemmata.tables import table


@query(f"with {SWEEP}, {B}, {DF}, w as (select distinct doc_id, \"offset\", unnest(t[\"offset\" + 1 : \"offset\" + 12]) as token from o), s as (select doc_id, \"offset\", round(sum(case when docs > 0 then log2(total / docs) else 1.0 end), 6) as bits from w left join df using (token), n where length(token) >= 2 group by all) select doc_id, cast(\"offset\" as int) as \"offset\", bits from s where bits >= 20")
def seed_mask(spark, sf):
    held = items(spark, sf)
    total = held.filter(F.size("t") > 0).count()
    return retrieve.seed_mask(retrieve.sweep(docs(spark, sf), "doc_id"), index.token_df(held, "item_id"), total, ["doc_id", "offset"])


LEX = f"{B}, bt as (select distinct unnest(t) as form from b), lx as (select form, case when length(form) > 5 then left(form, 5) else form end as lemma from bt union select form, left(form, 3) from bt where length(form) = 7)"


def _lexicon(spark, sf):
    forms = items(spark, sf).select(F.explode("t").alias("form")).distinct()
    stems = forms.select("form", F.when(F.length("form") > 5, F.substring("form", 1, 5)).otherwise(F.col("form")).alias("lemma"))
    return stems.union(forms.filter(F.length("form") == 7).select("form", F.substring("form", 1, 3))).distinct()


@query(f"with {LEX}, w as (select item_id, unnest(t) as form from b), l as (select distinct item_id, coalesce(lemma, form) as lemma from w left join lx using (form)) select 'x' as language, lemma, count(*) as docs from l group by lemma")
def lemma_df(spark, sf):
    held = items(spark, sf)
    return index.lemma_df(index.lemma_readings(held, "item_id", _lexicon(spark, sf)), "item_id", F.lit("x"))


@query(f"with {LEX}, w as (select item_id, unnest(t) as form, unnest(range(0, len(t))) as pos from b), p as (select item_id, pos, list_sort(list(distinct coalesce(lemma, form))) as ls from w left join lx using (form) group by item_id, pos), q as (select item_id, pos, unnest(ls) as lemma, unnest(range(0, len(ls))) as k from p) select item_id, string_agg(lemma, ' ' order by pos, k) as lemmas from q group by item_id")
def lemma_texts(spark, sf):
    held = items(spark, sf)
    made = index.lemma_texts(index.lemma_readings(held, "item_id", _lexicon(spark, sf)), "item_id")
    return made.select("item_id", F.array_join("t", " ").alias("lemmas"))


JUDGED = "j as (select user_id % 40 as pair, case event_id % 5 when 0 then 'no' when 1 then 'unsure' else 'yes' end as verdict, event_id % 11 <> 0 as right from events)"


def _judged(spark, sf):
    k = F.col("event_id") % 5
    return table(spark, sf, "events").select((F.col("user_id") % 40).alias("pair"), F.when(k == 0, "no").when(k == 1, "unsure").otherwise("yes").alias("verdict"), (F.col("event_id") % 11 != 0).alias("right"))


@query(f"with {JUDGED} select pair, cast(sum((verdict = 'yes')::int) as bigint) as yes, cast(sum((verdict = 'no')::int) as bigint) as no, cast(sum((verdict = 'unsure')::int) as bigint) as unsure, bool_or(verdict = 'yes') and bool_or(verdict = 'no') as contradiction from j group by pair".replace("as right", 'as "right"').replace("as no,", 'as "no",'))
def verdict_tally(spark, sf):
    return audit.tally(_judged(spark, sf), ["pair"])


@query(f"with {JUDGED} select pair, count(*) as rows, round(avg(\"right\"::int), 4) as share from j group by pair having round(avg(\"right\"::int), 4) >= 0.9".replace("as right", 'as "right"').replace("as rows", 'as "rows"'))
def admitted_pairs(spark, sf):
    return audit.admitted(_judged(spark, sf), ["pair"], 0.9)


@query("select distinct o_orderkey from orders where o_orderkey not in (select l_orderkey from lineitem where l_linenumber >= 6)")
def unjudged_tasks(spark, sf):
    done = table(spark, sf, "lineitem").filter("l_linenumber >= 6").select(F.col("l_orderkey").alias("o_orderkey"))
    return audit.unjudged(table(spark, sf, "orders").select("o_orderkey").distinct(), done, ["o_orderkey"])


LEN = f"{EDITIONS}, ln as (select source, book, chapter, verse, 5 + (chapter * verse) % 7 + case source when 'e1' then verse % 3 when 'e2' then chapter % 2 * verse else 0 end as words from ed)"


@query(f"with {LEN}, h as (select source, book, chapter, list_sort(list(distinct verse)) as held from ln group by all having count(*) >= 4 and stddev_pop(words) >= 1), p as (select x.book, x.chapter, x.source as a, y.source as b from h x join h y on x.book = y.book and x.chapter = y.chapter and x.held = y.held where x.source < y.source) select p.book, p.chapter, a, b, count(*) as verses, round(corr(x.words, y.words), 4) as r from p join ln x on x.book = p.book and x.chapter = p.chapter and x.source = a join ln y on y.book = p.book and y.chapter = p.chapter and y.source = b and y.verse = x.verse group by all")
def length_correlation(spark, sf):
    extra = F.when(F.col("source") == "e1", F.col("verse") % 3).when(F.col("source") == "e2", F.col("chapter") % 2 * F.col("verse")).otherwise(0)
    return audit.length_correlation(_editions(spark, sf).withColumn("words", 5 + (F.col("chapter") * F.col("verse")) % 7 + extra))


@query("with o as (select l_orderkey as k, l_returnflag as side, l_suppkey as arbiter, max(l_discount * 10) as overlap from lineitem group by all), b as (select k, side, max(overlap) as best from o group by all), s as (select k, max(best) as hi, min(best) as lo, max_by(side, struct_pack(x := best, y := side)) as side, count(*) as n from b group by k) select k, case when n > 1 and hi - lo < 0.02 then 'draw' else side end as winner, round(hi, 6) as overlap from s")
def boundary_arbitration(spark, sf):
    rows = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("k"), F.col("l_returnflag").alias("side"), F.col("l_suppkey").alias("arbiter")).agg(F.max(F.col("l_discount") * 10).alias("overlap"))
    return audit.arbitrate(rows, ["k"]).withColumn("overlap", F.round("overlap", 6))


@query(f"with {EDITIONS} select book, chapter, verse, max((source = 'e0')::int) as e0, max((source = 'e1')::int) as e1, max((source = 'e2')::int) as e2 from ed group by all")
def alignment_grid(spark, sf):
    keyed = _editions(spark, sf).withColumn("pivot", F.struct("book", "chapter", "verse"))
    grid = knowledge.alignment_grid(keyed, ["e0", "e1", "e2"])
    return grid.select("pivot.book", "pivot.chapter", "pivot.verse", *[F.coalesce(F.size(s), F.lit(0)).alias(s) for s in ("e0", "e1", "e2")])


@query("with r as (select l_orderkey as k, 's' || l_suppkey as source, max(l_linenumber) as priority, max(round(l_discount * 10, 2)) as score from lineitem group by all), t as (select *, row_number() over (partition by k order by priority, source) as n from r), u as (select * from t where n <= 3), a as (select k, min(n) filter (score >= 0.86) as f, max_by(n, struct_pack(s := score, n := -n)) as best from u group by k) select a.k, u.source, u.score, f is not null as decisive, cast(coalesce(f, 3) as int) as charged from a join u on u.k = a.k and u.n = coalesce(f, best)")
def local_resolution(spark, sf):
    rows = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("k"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("source")).agg(F.max("l_linenumber").alias("priority"), F.max(F.round(F.col("l_discount") * 10, 2)).alias("score"))
    return scan.resolve_locally(rows.select("k").distinct(), rows, ["k"])


GEST = f"{TURNS}, g as (select distinct conv_id, unnest(t) as token from c where turn = 0), ca as (select distinct conv_id as target, unnest(t) as token from c where turn = 1), tt as (select count(distinct target) as total from ca), wt as (select token, round(greatest(0.0, log2(total / (count(*) + 1))), 6) as bits from ca, tt group by token, total), sh as (select g.conv_id, target, (cast(sum(cast(round(bits * 1000000) as bigint)) as bigint) + 50) // 100 as bits, max((target % 4 = 0)::int) as quoted from g join ca using (token) join wt using (token) group by all), nr as (select *, max(bits) over (partition by conv_id) as top from sh)"


@query(f"with {GEST} select conv_id, target, bits / 10000.0 as bits, quoted from (select *, row_number() over (partition by conv_id order by quoted desc, bits desc, target) as k from nr where top - bits <= 20000) where k = 1")
def allusions(spark, sf):
    """First turns as gestures, second turns as candidates; every shared word counts by its bits."""
    rows = table(spark, sf, "conversations").select("conv_id", "turn", tokens(F.coalesce("text", F.lit(""))).alias("t"))
    gestures = rows.filter("turn = 0").select("conv_id", F.explode("t").alias("token"))
    candidates = rows.filter("turn = 1").select(F.col("conv_id").alias("target"), F.explode("t").alias("token"), (F.col("conv_id") % 4 == 0).cast("int").alias("quoted")).distinct()
    total = F.broadcast(candidates.agg(F.countDistinct("target").alias("total")))
    counted = candidates.groupBy("token").agg(F.count("*").alias("n")).crossJoin(total)
    weights = counted.select("token", F.round(F.greatest(F.lit(0.0), F.log2(F.col("total") / (F.col("n") + 1))), 6).alias("bits"))
    return knowledge.allusions_in_blocks(gestures, candidates, weights, "conv_id")


@query(f"with {D}, w as (select doc_id, len(t) as n, ' ' || array_to_string(t, '  ') || ' ' as s from d where len(t) > 0), x as (select doc_id, n, (length(s) - length(replace(replace(replace(replace(s, ' that  the ', ''), ' of  the ', ''), ' the ', ''), ' and ', ''))) as gone, (length(s) - length(replace(s, ' that  the ', ''))) // 11 * 2 + (length(replace(s, ' that  the ', '')) - length(replace(replace(s, ' that  the ', ''), ' of  the ', ''))) // 9 * 2 + (length(replace(replace(s, ' that  the ', ''), ' of  the ', '')) - length(replace(replace(replace(s, ' that  the ', ''), ' of  the ', ''), ' the ', ''))) // 5 + (length(replace(replace(replace(s, ' that  the ', ''), ' of  the ', ''), ' the ', '')) - length(replace(replace(replace(replace(s, ' that  the ', ''), ' of  the ', ''), ' the ', ''), ' and ', ''))) // 5 as covered from w) select doc_id, round(covered / n, 6) as share from x")
def stoplist_cover(spark, sf):
    ship(spark)
    common = [["that", "the"], ["of", "the"], ["the"], ["and"]]
    return docs(spark, sf).filter(F.size("t") > 0).select("doc_id", F.round(phrases.covered_udf(common)("t"), 6).alias("share"))


@query(None)
def stemmed_tokens(spark, sf):
    ship(spark)
    return docs(spark, sf).select("doc_id", F.array_join(stem.stems("t"), " ").alias("stems"))


@query(None)
def parsed_references(spark, sf):
    ship(spark)
    books = references.Books({"Conversation": ["CNV"], "Page": ["PAG", "PGE"]}, last={("CNV", 1): 3})
    rows = table(spark, sf, "conversations").select("conv_id", "turn", F.format_string("%s %d:%d-%d", F.when(F.col("turn") == 3, "Page").otherwise("Conversation"), F.col("conv_id") + 1, F.col("turn") + 1, F.col("turn") + 2).alias("reference"))
    return rows.withColumn("read", references.parse_udf(books)("reference")).select("conv_id", "turn", "reference", "read.status", F.size("read.ranges").alias("ranges"))


@query(None)
def rendered_documents(spark, sf):
    ship(spark)
    rows = table(spark, sf, "documents").select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.lit(" {{item "), (F.col("doc_id") % 50).cast("string"), F.lit("}} end")).alias("text"))
    passages = table(spark, sf, "benchmark").select(F.concat(F.lit("item "), F.col("item_id").cast("string")).alias("reference"), F.col("text").alias("body"), F.lit("bench").alias("label"))
    return render.render(rows, render.tags(rows), passages)


@query(f"with {VERDICTS}, i as (select *, verse - row_number() over (partition by conv_id, \"offset\" order by verse) as island from a where verdict = 'contradict') select conv_id, \"offset\", min(verse) as first, max(verse) as last, count(*) as n from i group by conv_id, \"offset\", island having count(*) >= 2")
def flagged_runs(spark, sf):
    return audit.contradicted_runs(audit.agreement(_turn_scores(spark, sf), ["conv_id"]), ["conv_id"], least=2, by_offset=True)
