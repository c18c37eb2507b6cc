"""Queries over (chapter, verse) grids: coordinate conversion, ranges, audits.

Orders are chapters and line items their verses (book L); conversations are
chapters too.  Numbering systems are made from them by arithmetic: system X
counts a title verse in every third chapter, Y splits verse 2 in every fifth.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stemmata.functions.text import tokens
from stemmata.operators import audit, coords, windows
from stemmata.plans.registry import query
from stemmata.plans.text_reuse import TOKENS
from stemmata.tables import table

VERSES = "v as (select distinct 'L' || cast(l_orderkey % 7 as varchar) as book, cast(l_orderkey as bigint) as chapter, cast(l_linenumber as bigint) as verse from lineitem)"
GRID = f"{VERSES}, g as (select book, chapter, max(verse) as last from v group by all)"


def verses(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem")
    return rows.select(F.concat(F.lit("L"), (F.col("l_orderkey") % 7).cast("string")).alias("book"), F.col("l_orderkey").alias("chapter"), F.col("l_linenumber").cast("long").alias("verse")).distinct()


def grid(spark: SparkSession, sf: str) -> DataFrame:
    return verses(spark, sf).groupBy("book", "chapter").agg(F.max("verse").alias("last"))


@query(f"with {VERSES} select book, chapter, max(verse) as last from v group by all having min(verse) = 1 and count(distinct verse) = max(verse)")
def grid_signature(spark, sf):
    return coords.signature(verses(spark, sf), ["book", "chapter"])


@query(f"with {GRID} select book, chapter, verse, verse <= least(last, 4) and verse >= 0 as valid from v join g using (book, chapter)")
def coordinate_validity(spark, sf):
    limits = grid(spark, sf).withColumn("last", F.least("last", F.lit(4)))
    return coords.validity(verses(spark, sf), limits)


MAPS = f"""{GRID}, tox as (select book, chapter, verse, book as p_book, chapter as p_chapter, verse - 1 as p_verse from v where chapter % 3 = 0),
fromy as (select book, chapter, verse as p_verse, unnest([verse, verse + 1]) as verse from v where chapter % 5 = 0 and verse = 2 union all select book, chapter, verse, verse + 1 from v where chapter % 5 = 0 and verse > 2)"""


def _maps(spark, sf):
    v = verses(spark, sf)
    to_pivot = v.filter("chapter % 3 = 0").select("book", "chapter", "verse", F.col("book").alias("p_book"), F.col("chapter").alias("p_chapter"), (F.col("verse") - 1).alias("p_verse"))
    fifth = v.filter("chapter % 5 = 0").select("book", "chapter", "verse", F.col("book").alias("p_book"), F.col("chapter").alias("p_chapter"), F.col("verse").alias("p_verse"))
    split = fifth.filter("verse = 2").withColumn("verse", F.explode(F.array(F.col("verse"), F.col("verse") + 1)))
    later = fifth.filter("verse > 2").withColumn("verse", F.col("verse") + 1)
    return v, to_pivot, split.unionByName(later)


@query(f"""with {MAPS}, q as (select v.*, coalesce(t.p_verse, v.verse) as qv from v left join tox t using (book, chapter, verse)),
t as (select q.book, q.chapter, q.verse, coalesce(f.verse, q.qv) as t_verse from q left join fromy f on f.book = q.book and f.chapter = q.chapter and f.p_verse = q.qv)
select t.book, t.chapter, t.verse, t_verse, case when t.chapter % 11 = 0 then 'refused:unreliable' when t_verse < 0 or t_verse > last then 'refused:absent' else 'ok' end as status from t join g using (book, chapter)""")
def convert_exact(spark, sf):
    v, to_pivot, from_pivot = _maps(spark, sf)
    g = grid(spark, sf)
    out = coords.convert_exact(v, to_pivot, from_pivot, g, g.filter("chapter % 11 = 0").select("book", "chapter"))
    return out.select("book", "chapter", "verse", "t_verse", "status")


@query(f"""with {GRID}, c as (select book, chapter, verse, unnest([verse, verse + 1]) as qv from v where chapter % 2 = 0 and verse % 2 = 1),
q as (select v.*, coalesce(c.qv, v.verse) as qv from v left join c using (book, chapter, verse)),
bk as (select book, chapter, verse as p_verse, unnest([verse, verse - 1]) as verse from v where chapter % 4 = 0 and verse >= 2),
t as (select distinct q.book, q.chapter, q.verse, coalesce(b.verse, q.qv) as t_verse from q left join bk b on b.book = q.book and b.chapter = q.chapter and b.p_verse = q.qv)
select t.book, t.chapter, t.verse, t_verse, case when t_verse < 0 or t_verse > last then 'refused:absent' else 'ok' end as status from t join g using (book, chapter)""")
def convert_covering(spark, sf):
    v = verses(spark, sf)
    pivot = [F.col("book").alias("p_book"), F.col("chapter").alias("p_chapter")]
    covers = v.filter("chapter % 2 = 0 and verse % 2 = 1").select("book", "chapter", "verse", *pivot, F.explode(F.array(F.col("verse"), F.col("verse") + 1)).alias("p_verse"))
    by = v.filter("chapter % 4 = 0 and verse >= 2").select("book", "chapter", F.col("verse").alias("p_verse"), *pivot, F.explode(F.array(F.col("verse"), F.col("verse") - 1)).alias("v"))
    by = by.withColumnRenamed("v", "verse")
    return coords.convert_covering(v, covers, by, grid(spark, sf)).select("book", "chapter", "verse", "t_verse", "status")


RANGES = f"{GRID}, r as (select chapter as id, book, chapter, cast(2 as bigint) as verse, chapter + 7 as end_chapter, cast(3 as bigint) as end_verse from g)"


def _ranges(spark, sf):
    two, three = F.lit(2).cast("long"), F.lit(3).cast("long")
    return grid(spark, sf).select(F.col("chapter").alias("id"), "book", "chapter", two.alias("verse"), (F.col("chapter") + 7).alias("end_chapter"), three.alias("end_verse"))


@query(f"with {RANGES}, e as (select r.id, r.book, g.chapter, case when g.chapter = r.chapter then r.verse else 1 end as lo, case when g.chapter = r.end_chapter then least(r.end_verse, last) else last end as hi from r join g on g.book = r.book and g.chapter between r.chapter and r.end_chapter) select id, book, chapter, unnest(range(lo, hi + 1)) as verse from e where lo <= hi")
def expand_ranges(spark, sf):
    return coords.expand(_ranges(spark, sf), grid(spark, sf), "id")


@query(f"with {VERSES}, k as (select * from v where (chapter + verse) % 4 <> 0), i as (select *, verse - row_number() over (partition by book, chapter order by verse) as island from k) select book, chapter, min(verse) as first, max(verse) as last from i group by book, chapter, island")
def coalesce_ranges(spark, sf):
    held = verses(spark, sf).filter("(chapter + verse) % 4 <> 0").withColumn("all", F.lit(0))
    return coords.coalesce(held, ["all"]).select("book", "chapter", "first", "last")


@query(f"""with {GRID}, b as (select *, coalesce(sum(last) over (partition by book order by chapter rows between unbounded preceding and 1 preceding), 0) as before from g),
k as (select b.book, chapter, verse, before + verse as place from v join b using (book, chapter) where (chapter + verse) % 4 <> 0), i as (select *, place - row_number() over (partition by book order by place) as island from k)
select book, arg_min(chapter, place) as chapter, arg_min(verse, place) as verse, arg_max(chapter, place) as end_chapter, arg_max(verse, place) as end_verse from i group by book, island""")
def merge_ranges(spark, sf):
    held = verses(spark, sf).filter("(chapter + verse) % 4 <> 0")
    single = held.select("book", "chapter", "verse", F.col("chapter").alias("end_chapter"), F.col("verse").alias("end_verse"))
    return coords.merge(single, grid(spark, sf), []).select("book", "chapter", "verse", "end_chapter", "end_verse")


@query(f"with {GRID}, p as (select book, chapter, last - cast(chapter % 13 = 0 as int) as last from g) select g.book, g.chapter, g.last, cast(p.last as bigint) as p_last from g join p using (book, chapter) where g.last <> p.last and g.chapter % 26 <> 0")
def unmappable_chapters(spark, sf):
    g = grid(spark, sf)
    pivot = g.withColumn("last", F.col("last") - (F.col("chapter") % 13 == 0).cast("int"))
    return coords.unmappable(g, pivot, g.filter("chapter % 26 = 0")).select("book", "chapter", "last", "p_last")


@query(f"""with {VERSES}, src as (select 's' || cast(verse % 3 as varchar) as source, book, chapter, verse from v), sys as (select 'even' as system, book, chapter, max(verse) - cast(max(verse) % 2 as int) as last from v group by book, chapter union all select 'third', book, chapter, max(verse) - cast(max(verse) % 3 as int) from v group by book, chapter),
e as (select source, book, chapter, max(verse) as fin from src group by all), f as (select source, system, round(avg(cast(fin = last as int)), 6) as share from e join sys using (book, chapter) group by all),
k as (select *, row_number() over (partition by source order by share desc, system) as place, lead(share) over (partition by source order by share desc, system) as next from f)
select source, system, share, coalesce(share - next < 0.05, false) as close from k where place = 1""")
def best_fit_system(spark, sf):
    v = verses(spark, sf)
    rows = v.withColumn("source", F.concat(F.lit("s"), (F.col("verse") % 3).cast("string")))
    ends = v.groupBy("book", "chapter").agg(F.max("verse").alias("m"))
    systems = ends.select(F.lit("even").alias("system"), "book", "chapter", (F.col("m") - F.col("m") % 2).alias("last")).unionByName(ends.select(F.lit("third").alias("system"), "book", "chapter", (F.col("m") - F.col("m") % 3).alias("last")))
    return coords.best_fit(rows, systems)


@query(f"with {VERSES}, i as (select *, verse - row_number() over (partition by book, chapter order by verse) as island from v where verse <> 3) select book, chapter, min(verse) as first, max(verse) as last, count(*) as n from i group by book, chapter, island")
def verse_runs(spark, sf):
    return windows.runs(verses(spark, sf).filter("verse <> 3"), ["book", "chapter"], "verse")


@query(f"with {VERSES}, i as (select book, chapter, chapter - 7 * row_number() over (partition by book order by chapter) as island, row_number() over (partition by book order by chapter) as k from (select distinct book, chapter // 7 * 7 as chapter from v)), n as (select *, row_number() over (partition by book, island order by chapter) - 1 as pos from i) select book, cast(min(chapter // 7) as bigint) as first, cast(max(chapter // 7) as bigint) as last, count(*) as n from n group by book, island, pos // 5")
def chapter_requests(spark, sf):
    held = verses(spark, sf).select("book", F.expr("chapter div 7").alias("chapter")).distinct()
    return windows.capped_runs(held, ["book"], "chapter", 5).drop("chapter")


TURNS = f"c as (select conv_id, turn, {TOKENS.format('text')} as t from conversations)"
JAC = "round(case when len(list_distinct(list_concat(m.t, o.t))) = 0 then 0 else len(list_intersect(m.t, o.t)) * 1.0 / len(list_distinct(list_concat(m.t, o.t))) end, 6)"
SCORES = f"{TURNS}, offs as (select unnest([-2, -1, 0, 1, 2]) as o), s as (select m.conv_id, m.turn as verse, offs.o as \"offset\", {JAC} as score from c m, offs join c o on o.conv_id = m.conv_id and o.turn = m.turn + (m.conv_id % 3 = 0)::int + offs.o)".replace("from c m, offs join", "from c m cross join offs join")


def _turn_scores(spark, sf):
    rows = table(spark, sf, "conversations").select("conv_id", F.col("turn").alias("verse"), tokens(F.coalesce("text", F.lit(""))).alias("t"))
    moved = rows.withColumn("verse", F.col("verse") - (F.col("conv_id") % 3 == 0).cast("int"))
    return audit.offset_scores(rows, moved, ["conv_id"])


@query(f"with {SCORES} select conv_id, verse, \"offset\", score from s")
def offset_join_scores(spark, sf):
    return _turn_scores(spark, sf)


VERDICTS = f"""{SCORES}, k as (select *, row_number() over (partition by conv_id, verse order by score desc, \"offset\") as rn, coalesce(max(case when \"offset\" = 0 then score end) over (partition by conv_id, verse), 0.0) as own from s),
a as (select conv_id, verse, score as best, \"offset\", own, case when score < 0.10 then 'weak' when \"offset\" = 0 or round(score - own, 6) < 0.05 then 'agree' else 'contradict' end as verdict from k where rn = 1)"""


@query(f"with {VERDICTS} select * from a")
def audit_agreement(spark, sf):
    return audit.agreement(_turn_scores(spark, sf), ["conv_id"])


@query(f"with {VERDICTS} select \"offset\", count(*) as checked, cast(sum((verdict = 'agree')::int) as bigint) as agree, cast(sum((verdict = 'contradict')::int) as bigint) as contradict, cast(sum((verdict = 'weak')::int) as bigint) as weak, round(sum((verdict = 'agree')::int) / nullif(sum((verdict <> 'weak')::int), 0), 4) as share from a group by \"offset\"")
def audit_confusion(spark, sf):
    return audit.confusion(audit.agreement(_turn_scores(spark, sf), ["conv_id"]), ["offset"])


@query(f"with {VERDICTS}, i as (select *, verse - row_number() over (partition by conv_id order by verse) as island from a where verdict = 'contradict') select conv_id, min(verse) as first, max(verse) as last, count(*) as n from i group by conv_id, island having count(*) >= 4")
def contradicted_runs(spark, sf):
    return audit.contradicted_runs(audit.agreement(_turn_scores(spark, sf), ["conv_id"]), ["conv_id"])


EDITIONS = f"{VERSES}, ed as (select 'e' || cast(k as varchar) as source, book, chapter, verse from v, (select unnest([0, 1, 2, 3]) as k) where not (k > 0 and verse > 3 and chapter % (k * 5 + 2) = 0))"


def _editions(spark, sf):
    v = verses(spark, sf).withColumn("k", F.explode(F.array(*[F.lit(i) for i in range(4)])))
    gone = (F.col("k") > 0) & (F.col("verse") > 3) & (F.col("chapter") % (F.col("k") * 5 + 2) == 0)
    return v.filter(~gone).select(F.concat(F.lit("e"), F.col("k").cast("string")).alias("source"), "book", "chapter", "verse")


@query(f"with {EDITIONS}, s as (select source, book, chapter, max(verse) as last from ed group by all having min(verse) = 1 and count(distinct verse) = max(verse)) select a.source as a, b.source as b, count(*) as shared, cast(sum((a.last <> b.last)::int) as bigint) as conflicts from s a join s b using (book, chapter) where a.source < b.source group by all")
def family_conflicts(spark, sf):
    return audit.conflicts(coords.signature(_editions(spark, sf), ["source", "book", "chapter"]))


@query(f"with {EDITIONS}, s as (select book, chapter, source, string_agg(cast(verse as varchar), ',' order by verse) as held from ed group by all) select book, chapter, count(distinct held) as versions, count(*) as witnesses from s group by all having count(distinct held) > 1")
def disputed_chapters(spark, sf):
    return audit.disputed(_editions(spark, sf), ["book", "chapter"])


@query(f"with {EDITIONS}, l as (select * from ed where source = 'e1'), r as (select * from ed where source = 'e2') select v.book, count(*) as verses, count(*) filter (l.verse is not null and r.verse is not null) as both, count(*) filter (l.verse is not null and r.verse is null) as only_left, count(*) filter (l.verse is null and r.verse is not null) as only_right, count(*) filter (l.verse is null and r.verse is null) as neither from v left join l using (book, chapter, verse) left join r using (book, chapter, verse) group by v.book".replace(" as both", ' as "both"'))
def edition_compare(spark, sf):
    e = _editions(spark, sf)
    return audit.compare(verses(spark, sf), e.filter("source = 'e1'"), e.filter("source = 'e2'"), ["book", "chapter", "verse"])


@query(f"with {EDITIONS}, e as (select source, book, chapter, max(verse) as hi, min(verse) as lo, count(distinct verse) as n from ed group by all), g as (select book, chapter, max(verse) as last from v group by all) select source, book, chapter, hi from e join g using (book, chapter) where lo <= 1 and n = hi - lo + 1 and hi = last and chapter % 17 <> 0")
def faithful_chapters(spark, sf):
    g = grid(spark, sf)
    return audit.faithful(_editions(spark, sf), g, g.filter("chapter % 17 = 0"), ["source", "book", "chapter"])


@query(f"with {EDITIONS}, w as (select book, chapter, verse, source, row_number() over (partition by book, chapter, verse order by case when source = 'e3' then 0 else 1 end, source) as k from ed) select book, chapter, verse, source from w where k = 1")
def first_witness(spark, sf):
    ranked = _editions(spark, sf).withColumn("priority", F.when(F.col("source") == "e3", 0).otherwise(1))
    return audit.first_holder(ranked, ["book", "chapter", "verse"], "priority").select("book", "chapter", "verse", "source")
