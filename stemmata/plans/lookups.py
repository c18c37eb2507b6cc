"""Queries that read verses by coordinate, choose among passages and check editions.

Conversations are chapters and their turns verses (books B0 to B4); three
editions hold them: x all, y without every second verse, z every second chapter.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from stemmata.functions.text import once, tokens
from stemmata.operators import audit, coords, lookups, passages, runs, windows
from stemmata.plans.coordinates import EDITIONS, GRID, MAPS, RANGES, VERDICTS, _editions, _maps, _ranges, _turn_scores, grid
from stemmata.plans.coordinates import verses as lines
from stemmata.plans.registry import query
from stemmata.plans.text_reuse import SEEDS, B, D, docs, items
from stemmata.tables import table

V = "vt as (select 'B' || cast(conv_id % 5 as varchar) as book, conv_id as chapter, turn + 1 as verse, coalesce(text, '') as text from conversations)"
ED = f"{V}, e3 as (select 'x' as corpus, * from vt union all select 'y', * from vt where verse % 2 = 1 union all select 'z', * from vt where chapter % 2 = 0)"
ASKED = f"{V}, ak as (select chapter * 10 + k as pos, book, chapter, k as verse from (select distinct book, chapter from vt), (select unnest([5, 3, 9, 1]) as k))"


def verses(spark, sf):
    rows = table(spark, sf, "conversations")
    return rows.select(F.concat(F.lit("B"), (F.col("conv_id") % 5).cast("string")).alias("book"), F.col("conv_id").alias("chapter"), (F.col("turn") + 1).alias("verse"), F.coalesce("text", F.lit("")).alias("text"))


def editions(spark, sf):
    v = verses(spark, sf)
    held = v.withColumn("corpus", F.explode(F.array(*[F.lit(c) for c in "xyz"])))
    return held.filter("corpus = 'x' or (corpus = 'y' and verse % 2 = 1) or (corpus = 'z' and chapter % 2 = 0)")


def _asked(spark, sf):
    chapters = verses(spark, sf).select("book", "chapter").distinct()
    return chapters.select("book", "chapter", F.explode(F.array(*[F.lit(k).cast("long") for k in (5, 3, 9, 1)])).alias("verse")).withColumn("pos", F.col("chapter") * 10 + F.col("verse"))


@query(f"with {ASKED} select vt.book, vt.chapter, vt.verse, text from vt join ak using (book, chapter, verse)")
def verse_lookup(spark, sf):
    return lookups.point(verses(spark, sf), _asked(spark, sf))


@query(f"with {ASKED} select pos, book, chapter, verse, text from ak join vt using (book, chapter, verse)")
def availability_lookup(spark, sf):
    return lookups.available(verses(spark, sf), _asked(spark, sf))


@query(f"with {V} select chapter * 10 + verse as pos, book, chapter, verse, text from vt where verse = 1")
def strict_fetch(spark, sf):
    v = verses(spark, sf)
    return lookups.strict(v, v.filter("verse = 1").select((F.col("chapter") * 10 + F.col("verse")).alias("pos"), "book", "chapter", "verse"))


@query(f"with {V} select *, cast(row_number() over (partition by book, chapter order by verse) as int) as k from vt")
def chapter_read(spark, sf):
    return lookups.chapters(verses(spark, sf))


@query(f"with {V} select distinct a.chapter as id, vt.book, vt.chapter, vt.verse, vt.text from vt join (select distinct book, chapter from vt) a using (book, chapter) where vt.verse between 2 and 4")
def verse_range(spark, sf):
    asked = verses(spark, sf).select(F.col("chapter").alias("id"), "book", "chapter", F.lit(2).cast("long").alias("verse"), F.lit(4).cast("long").alias("end_verse")).distinct()
    return lookups.between(verses(spark, sf), asked)


@query(f"with {V}, a as (select distinct chapter as id, book, chapter as c1 from vt), j as (select id, vt.*, row_number() over (partition by id order by vt.chapter, vt.verse) as k from a join vt on vt.book = a.book and (vt.chapter, vt.verse) >= (c1, 2) and (vt.chapter, vt.verse) <= (c1 + 15, 2)) select id, book, chapter, verse, cast(k as int) as k, text from j where k <= 12")
def cross_chapter_range(spark, sf):
    two = F.lit(2).cast("long")
    asked = verses(spark, sf).select(F.col("chapter").alias("id"), "book", "chapter", two.alias("verse"), (F.col("chapter") + 15).alias("end_chapter"), two.alias("end_verse")).distinct()
    return lookups.across(verses(spark, sf), asked)


@query(f"with {V} select book, max(chapter) as last_chapter, arg_max(verse, struct_pack(c := chapter, v := verse)) as last_verse from vt group by book")
def book_ends(spark, sf):
    return lookups.book_ends(verses(spark, sf))


@query(f"with {V}, e as (select book, min(chapter) as c0, max(chapter) as c1, arg_max(verse, struct_pack(c := chapter, v := verse)) as v1 from vt group by book) select book, chapter, verse, case when chapter = c0 and verse <= 3 then 'opening' else 'closing' end as position from vt join e using (book) where (chapter = c0 and verse <= 3) or (chapter = c1 and verse > v1 - 2)")
def positional_flags(spark, sf):
    return lookups.positions(verses(spark, sf))


@query("select o_orderkey as k, coalesce(bool_and(year(l_shipdate) > year(o_orderdate)), false) as anachronistic from orders join lineitem on l_orderkey = o_orderkey group by o_orderkey")
def anachronisms(spark, sf):
    both = table(spark, sf, "orders").join(table(spark, sf, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    return lookups.anachronistic(both.select(F.col("o_orderkey").alias("k"), F.year("o_orderdate").alias("work_year"), F.year("l_shipdate").alias("witness_year")), ["k"])


HITS = "hits as (select l_orderkey as id, l_suppkey as text_id, min(l_extendedprice) as score from lineitem group by all), plc as (select distinct l_suppkey as text_id, 'S' || cast(l_suppkey % 3 as varchar) as book, cast(l_suppkey // 10 as bigint) as chapter, cast(l_suppkey % 10 as bigint) as verse from lineitem)"


def _hits(spark, sf):
    rows = table(spark, sf, "lineitem")
    hits = rows.groupBy(F.col("l_orderkey").alias("id"), F.col("l_suppkey").alias("text_id")).agg(F.min("l_extendedprice").alias("score"))
    supplier = F.col("l_suppkey")
    places = rows.select(supplier.alias("text_id"), F.concat(F.lit("S"), (supplier % 3).cast("string")).alias("book"), F.expr("l_suppkey div 10").alias("chapter"), (supplier % 10).alias("verse")).distinct()
    return hits, places


@query(f"with {HITS}, v as (select id, book, chapter, verse, min(score) as score from hits join plc using (text_id) group by all), i as (select *, verse - row_number() over (partition by id, book, chapter order by verse) as island from v), r as (select id, book, chapter, min(verse) as first, max(verse) as last, min(score) as score from i group by id, book, chapter, island), p as (select *, row_number() over (partition by id order by score, book, chapter, first) as place from r) select id, book, chapter, first, last, score, cast(place as int) as place from p where place <= 12")
def located_passages(spark, sf):
    return lookups.located(*_hits(spark, sf))


@query(f"with {HITS} select id, book, min(score) as score, string_agg(distinct cast(chapter as varchar), ',' order by cast(chapter as varchar)) as members from hits join plc using (text_id) group by id, book")
def group_best_scores(spark, sf):
    hits, places = _hits(spark, sf)
    best = lookups.best_scores(hits.join(places.withColumn("chapter", F.col("chapter").cast("string")), "text_id"), ["id", "book"], "chapter")
    return best.withColumn("members", F.array_join("members", ","))


@query(f"with {V}, i as (select *, verse - row_number() over (partition by book, chapter order by verse) as island from vt where (chapter + verse) % 3 <> 0), s as (select book, chapter, min(verse) as first, max(verse) as last from i group by book, chapter, island) select book, chapter, first, last from (select *, row_number() over (partition by book, chapter order by last - first desc, first) as k from s) where k = 1")
def fullest_spans(spark, sf):
    held = windows.runs(verses(spark, sf).filter("(chapter + verse) % 3 <> 0"), ["book", "chapter"], "verse")
    return lookups.fullest_span(held, ["book", "chapter"])


@query(f"with {ED}, s as (select distinct chapter as id, book, chapter, 1 as a, 3 as b from vt) select s.id, corpus, string_agg(text, ' ' order by verse) as text, cast(count(*) as int) as verses from s join e3 on e3.book = s.book and e3.chapter = s.chapter and verse between a and b group by s.id, corpus")
def rendering_texts(spark, sf):
    spans = verses(spark, sf).select(F.col("chapter").alias("id"), "book", "chapter", F.lit(1).cast("long").alias("first"), F.lit(3).cast("long").alias("last")).distinct()
    return lookups.renderings(editions(spark, sf), spans)


SCORED = "sc as (select l_orderkey as id, l_linenumber as k, l_suppkey as source, max(round(l_discount * 10, 2)) as score from lineitem group by all)"


def _scored(spark, sf):
    return table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("k"), F.col("l_suppkey").alias("source")).agg(F.max(F.round(F.col("l_discount") * 10, 2)).alias("score"))


@query(f"with {SCORED}, b as (select *, max(score) over (partition by id) as best from sc), n as (select * from b where round(best - score, 6) <= 0.06) select *, count(*) over (partition by id) > 1 as tied from n")
def near_ties(spark, sf):
    return lookups.near_best(_scored(spark, sf), ["id"], lookups.NEAR_TIE)


@query(f"with {SCORED}, s as (select id, source, k, score / 10 as score from sc), b as (select *, max(score) over (partition by id) as best from s), n as (select * from b where round(best - score, 6) <= 0.03) select *, count(*) over (partition by id) > 1 as tied from n")
def same_renderings(spark, sf):
    return lookups.near_best(_scored(spark, sf).withColumn("score", F.col("score") / 10), ["id"], lookups.SAME_RENDERING)


@query("with m as (select l_orderkey as id, 'L' as book, l_partkey % 20 as chapter, l_linenumber as verse, l_suppkey as system, max(l_discount) as score from lineitem group by all) select id, book, chapter, verse, system, score from (select *, row_number() over (partition by id, book, chapter, verse order by score desc, system) as p from m) where p = 1")
def one_per_passage(spark, sf):
    rows = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id"), F.lit("L").alias("book"), (F.col("l_partkey") % 20).alias("chapter"), F.col("l_linenumber").alias("verse"), F.col("l_suppkey").alias("system"))
    return lookups.one_per_passage(rows.agg(F.max("l_discount").alias("score")), ["id"])


@query(f"with {ED} select corpus, book, chapter, verse, lead(chapter) over w as next_chapter, lead(verse) over w as next_verse, lag(chapter) over w as before_chapter, lag(verse) over w as before_verse from e3 window w as (partition by corpus, book order by chapter, verse)")
def neighbour_verses(spark, sf):
    return lookups.neighbours(editions(spark, sf))


@query("select o_orderkey, cast(row_number() over (order by md5('seed:' || cast(o_orderkey as varchar))) as int) as rank from (select distinct o_orderkey from orders) order by md5('seed:' || cast(o_orderkey as varchar)) limit 500")
def seeded_sample(spark, sf):
    return lookups.seeded_sample(table(spark, sf, "orders").select("o_orderkey").distinct(), F.col("o_orderkey"), "seed", 500)


@query(f"with {GRID}, dc as (select book, chapter, last + 1 as told from g where chapter % 3 = 0 union all select 'L9', 1, 4), s as (select book, chapter, max(verse) as seen from v where chapter % 4 <> 1 group by all) select book, chapter, coalesce(told, seen) as last, told is not null as declared from dc full join s using (book, chapter)")
def book_shapes(spark, sf):
    declared = grid(spark, sf).filter("chapter % 3 = 0").select("book", "chapter", (F.col("last") + 1).alias("last"))
    extra = spark.createDataFrame([("L9", 1, 4)], "book string, chapter long, last long")
    return lookups.book_shape(declared.unionByName(extra), lines(spark, sf).filter("chapter % 4 <> 1"))


@query(f"with {D}, {B}, ds as (select doc_id, i, [t[i], t[i + 1], t[i + 3], t[i + 5]] as w from (select doc_id, t, unnest(range(1, len(t) - 4)) as i from d where len(t) >= 6)), bs as (select item_id, i as j, [t[i], t[i + 1], t[i + 3], t[i + 5]] as w from (select item_id, t, unnest(range(1, len(t) - 4)) as i from b where len(t) >= 6)) select doc_id, item_id, cast(i - 1 as int) as i, cast(j - 1 as int) as j from ds join bs using (w)")
def spaced_seeds(spark, sf):
    return lookups.spaced_seeds(docs(spark, sf), items(spark, sf), "doc_id", "item_id", "110101")


@query(f"with {SEEDS}, an as (select distinct doc_id, pos + 1 as first from (select doc_id, unnest(t) as token, unnest(range(0, len(t))) as pos from d) where token in ('that', 'the')) select r.doc_id, r.item_id, cast(r.first as int) as first, documents.source, an.first is not null as announced from r join documents using (doc_id) left join an on an.doc_id = r.doc_id and an.first = r.first")
def gold_marks(spark, sf):
    rows = docs(spark, sf)
    marks = runs.shared_runs(rows, items(spark, sf), "doc_id", "item_id").select("doc_id", "item_id", "first")
    told = rows.select("doc_id", F.posexplode("t").alias("pos", "token")).filter(F.col("token").isin("that", "the")).select("doc_id", (F.col("pos") + 1).alias("first"))
    return lookups.gold_marks(marks, table(spark, sf, "documents").select("doc_id", "source"), told)


@query(f"with {D}, l as (select doc_id, len(t) as n, greatest(1, (len(t) - 12) // 6 + 1) as of_ from d where len(t) >= 12), p as (select *, unnest(range(0, (of_ - 1) // 50 + 1)) as part from l) select doc_id, part, part * 50 as first, least(50, of_ - part * 50) as windows, case when part * 50 + least(50, of_ - part * 50) = of_ then n else (part + 1) * 300 end - part * 300 as words from p")
def control_shards(spark, sf):
    return lookups.window_shards(docs(spark, sf).filter(F.size("t") >= 12).select("doc_id", F.size("t").alias("n")), "doc_id")


BLOCKS = f"{GRID}, bl as (select book, chapter, (verse - 1) * 5 as a, (verse - 1) * 5 + chapter % 4 as b, 4 as size from v where (chapter + verse) % 3 <> 0), bd as (select book, chapter, verse, (verse - 1) * 5 + chapter % 2 as place from v)"


def _boundaries(spark, sf):
    v = lines(spark, sf)
    start = (F.col("verse") - 1) * 5
    blocks = v.filter("(chapter + verse) % 3 <> 0").select("book", "chapter", start.alias("a"), (start + F.col("chapter") % 4).alias("b"), F.lit(4).alias("size"))
    return v.select("book", "chapter", "verse", (start + F.col("chapter") % 2).alias("at")), blocks


@query(f"with {BLOCKS}, j as (select bd.*, bl.a, bl.b, bl.size, row_number() over (partition by bd.book, bd.chapter, bd.verse order by bl.a desc) as k from bd left join bl on bl.book = bd.book and bl.chapter = bd.chapter and bl.a <= bd.place) select book, chapter, verse, place as \"at\", b + least(place - a, size) as projected from j where k = 1")
def projected_boundaries(spark, sf):
    bounds, blocks = _boundaries(spark, sf)
    return lookups.projected(bounds, blocks, ["book", "chapter"])


@query(f"with {BLOCKS}, j as (select bd.*, bl.a, bl.b, bl.size, row_number() over (partition by bd.book, bd.chapter, bd.verse order by bl.a desc) as k from bd left join bl on bl.book = bd.book and bl.chapter = bd.chapter and bl.a <= bd.place), p as (select book, chapter, place, b + least(place - a, size) as projected from j where k = 1) select book, chapter, count(*) as known, count(projected) as derived, count(*) filter (projected = place) as exact, count(*) filter (abs(projected - place) <= 2) as near from p group by all")
def boundary_recovery(spark, sf):
    bounds, blocks = _boundaries(spark, sf)
    return lookups.boundary_recovery(bounds, lookups.projected(bounds, blocks, ["book", "chapter"]), ["book", "chapter"])


@query(f"with {VERDICTS}, dr as (select conv_id, arg_max(o, struct_pack(n := n, o := -o)) as drift from (select conv_id, \"offset\" as o, count(*) as n from a where \"offset\" <> 0 group by all) group by conv_id), fm as (select conv_id, count(*) as verses, round(avg((\"offset\" = 0)::int), 4) as share from a group by conv_id) select fm.conv_id, verses, share, drift, share >= 0.95 as member from fm left join dr using (conv_id)")
def family_members(spark, sf):
    return lookups.membership(audit.agreement(_turn_scores(spark, sf), ["conv_id"]), ["conv_id"])


CONVERTED = f"""{MAPS}, q as (select v.*, coalesce(t.p_verse, v.verse) as qv from v left join tox t using (book, chapter, verse)),
t as (select q.book, q.chapter, q.verse, coalesce(f.verse, q.qv) as t_verse from q left join fromy f on f.book = q.book and f.chapter = q.chapter and f.p_verse = q.qv),
cv as (select t.book, t.chapter, t.verse, t_verse, case when t_verse < 0 or t_verse > last then 'refused:absent' else 'ok' end as status from t join g using (book, chapter))"""


def _converted(spark, sf):
    v, to_pivot, from_pivot = _maps(spark, sf)
    return coords.convert_exact(v, to_pivot, from_pivot, grid(spark, sf))


@query(f"with {CONVERTED} select book, chapter, verse, min(t_verse) filter (status = 'ok') as t_verse from cv group by book, chapter, verse")
def convert_first(spark, sf):
    return coords.convert_first(_converted(spark, sf), ["book", "chapter", "verse"]).select("book", "chapter", "verse", "t_verse")


@query(f"with {CONVERTED} select cv.book, count(*) as checked, count(*) filter (status <> 'ok') as refused, count(*) filter (status = 'ok' and h.verse is not null) as found, count(*) filter (status = 'ok' and h.verse is null) as ghosts from cv left join (select * from v where (chapter + verse) % 9 <> 0) h on h.book = cv.book and h.chapter = cv.chapter and h.verse = cv.t_verse group by cv.book")
def ghost_verses(spark, sf):
    return lookups.ghosts(_converted(spark, sf), lines(spark, sf).filter("(chapter + verse) % 9 <> 0"))


@query(f"""with {RANGES}, tox as (select book, chapter, verse, verse - 1 as p_verse from v where chapter % 3 = 0), e as (select r.id, r.book, g.chapter, case when g.chapter = r.chapter then r.verse else 1 end as lo, case when g.chapter = r.end_chapter then least(r.end_verse, last) else last end as hi from r join g on g.book = r.book and g.chapter between r.chapter and r.end_chapter),
x as (select id, book, chapter, unnest(range(lo, hi + 1)) as verse from e where lo <= hi), c as (select distinct id, x.book, x.chapter, coalesce(p_verse, x.verse) as verse from x left join tox using (book, chapter, verse)), k as (select c.* from c join g using (book, chapter) where verse between 0 and last),
i as (select *, verse - row_number() over (partition by id, book, chapter order by verse) as island from k) select id, book, chapter, min(verse) as first, max(verse) as last from i group by id, book, chapter, island""")
def convert_ranges(spark, sf):
    v, to_pivot, from_pivot = _maps(spark, sf)
    g = grid(spark, sf)
    return coords.convert_range(_ranges(spark, sf), g, to_pivot, from_pivot.limit(0), g, "id")


CORR = f"{MAPS}, co as (select case chapter % 4 when 0 then 'drop' when 1 then 'fix' else 'add' end as action, book, chapter, verse, book as p_book, chapter as p_chapter, verse as p_verse, 'why' || cast(chapter % 4 as varchar) as why from v where verse = 2 or (chapter % 4 = 3 and verse = 4)), jn as (select co.*, t.p_verse as old from co left join tox t using (book, chapter, verse)), st as (select *, case action when 'add' then old is not null when 'fix' then old is null or old = p_verse else old is null end as stale from jn)"


def _corrections(spark, sf):
    v, to_pivot, _ = _maps(spark, sf)
    k = F.col("chapter") % 4
    rows = v.filter("verse = 2 or (chapter % 4 = 3 and verse = 4)").select(F.when(k == 0, "drop").when(k == 1, "fix").otherwise("add").alias("action"), "book", "chapter", "verse", F.col("book").alias("p_book"), F.col("chapter").alias("p_chapter"), F.col("verse").alias("p_verse"), F.concat(F.lit("why"), k.cast("string")).alias("why"))
    return coords.corrected(to_pivot, rows)


@query(f"with {CORR} select tox.book, tox.chapter, tox.verse, tox.p_verse from tox where not exists (select 1 from st where not stale and st.book = tox.book and st.chapter = tox.chapter and st.verse = tox.verse) union all select book, chapter, verse, p_verse from st where not stale and action <> 'drop'")
def corrected_maps(spark, sf):
    return _corrections(spark, sf)[0].select("book", "chapter", "verse", "p_verse")


@query(f"with {CORR} select action, book, chapter, verse, why from st where stale")
def stale_corrections(spark, sf):
    return _corrections(spark, sf)[1]


@query("with a as (select letter, verse, row_number() over (order by letter, verse) as n from (select chr(65 + k) as letter, unnest(range(1, 6 + k)) as verse from (select unnest([0, 1, 2, 3, 4, 5]) as k))), c as (select chapter, 4 as from_verse, unnest(range(1, 11)) as k from (select unnest([10, 11, 12, 13]) as chapter)), l as (select chapter, from_verse + k - 1 as t_verse, row_number() over (order by chapter, k) as n from c) select letter, verse, cast(chapter as bigint) as chapter, cast(t_verse as bigint) as t_verse from a left join l using (n)")
def lettered_chapters(spark, sf):
    letters = spark.range(6).select(F.chr(F.col("id") + 65).alias("letter"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("id") + 5)).alias("verse"))
    held = spark.range(10, 14).select(F.col("id").alias("chapter"), F.lit(4).cast("long").alias("from_verse"), F.lit(10).cast("long").alias("verses"))
    return coords.lettered(letters, held)


@query(f"with {SCORED}, s as (select id, source, max(score) as score, source % 7 = 0 as own from sc group by id, source) select id, max(score) filter (own) as score, arg_max(source, struct_pack(a := score, b := source)) filter (not own) as rival, max(score) filter (not own) as rival_score from s group by id")
def judge_rivals(spark, sf):
    best = _scored(spark, sf).groupBy("id", "source").agg(F.max("score").alias("score")).withColumn("own", F.col("source") % 7 == 0)
    return lookups.best_rival(best, ["id"])


@query(f"with {EDITIONS}, ask as (select chapter * 10 + verse as id, case when verse % 2 = 0 then 'm' else 'n' end as language, 'e' || cast(chapter % 4 as varchar) as wanted, book || ' ' || chapter || ':' || verse as verse from v), chain(language, source, place) as (values ('m', 'e1', 0), ('m', 'e2', 1), ('m', 'e3', 2), ('n', 'e3', 0), ('n', 'e0', 1)), h as (select source, book || ' ' || chapter || ':' || verse as verse from ed), c as (select ask.id, h.source, row_number() over (partition by ask.id order by case when h.source = wanted then -1 else place end, h.source) as k from ask join chain using (language) join h on h.source = chain.source and h.verse = ask.verse) select ask.id, c.source, case when c.source is null then 'unreadable' when c.source = wanted then 'wanted' else 'fallback' end as status from ask left join c on c.id = ask.id and k = 1")
def rendering_fallback(spark, sf):
    name = F.concat("book", F.lit(" "), F.col("chapter").cast("string"), F.lit(":"), F.col("verse").cast("string"))
    asked = lines(spark, sf).select((F.col("chapter") * 10 + F.col("verse")).alias("id"), F.when(F.col("verse") % 2 == 0, "m").otherwise("n").alias("language"), F.concat(F.lit("e"), (F.col("chapter") % 4).cast("string")).alias("wanted"), name.alias("verse"))
    chain = spark.createDataFrame([("m", "e1", 0), ("m", "e2", 1), ("m", "e3", 2), ("n", "e3", 0), ("n", "e0", 1)], "language string, source string, place int")
    return lookups.fallback(asked, chain, _editions(spark, sf).select("source", name.alias("verse")))


@query(f"with {B}, w as (select distinct unnest(t) as a from b), u as (select distinct unnest(t) as b from b), p as (select a, b from w join u on left(a, 4) = left(b, 4) and a < b) select a, b, case when rtrim(a, 's') = rtrim(b, 's') then 'plural' when regexp_replace(a, '(ing|ed|er)$', '') = regexp_replace(b, '(ing|ed|er)$', '') then 'ending' when left(a, 5) = left(b, 5) then 'stem' else 'none' end as tier from p")
def variant_pricing(spark, sf):
    words = items(spark, sf).select(F.explode("t").alias("w")).distinct()
    start = F.substring("w", 1, 4).alias("s")
    pairs = words.select(F.col("w").alias("a"), start).join(words.select(F.col("w").alias("b"), start), "s").filter("a < b").select("a", "b")
    tiers = [("plural", lambda c: F.rtrim(c, F.lit("s"))), ("ending", lambda c: F.regexp_replace(c, "(ing|ed|er)$", "")), ("stem", lambda c: F.substring(c, 1, 5))]
    return lookups.bridging_tier(pairs, tiers)


@query(f"with {D} select source, lang, form, count(*) as n from (select source, lang, unnest(t) as form from d) where form in ('de', 'la', 'the', 'und', 'et', 'y') group by all")
def bare_word_audit(spark, sf):
    return lookups.bare_words(docs(spark, sf), ["de", "la", "the", "und", "et", "y"], ["source", "lang"])


@query("select doc_id, cast('0x' || left(md5(cast(doc_id as varchar)), 6) as bigint) % 10 < 3 as held_out from documents")
def held_out_split(spark, sf):
    return table(spark, sf, "documents").select("doc_id", lookups.held_out_split(F.col("doc_id")).alias("held_out"))


@query("with u as (select l_orderkey as id, l_partkey % 50 as x, l_suppkey % 50 as y, max(l_quantity) as bits from lineitem group by all), c as (select p_partkey % 50 as x, p_size % 50 as y, max(round(p_retailprice / 10000, 3)) as cosine from part group by all), j as (select id, max(struct_pack(cosine := cosine, bits := bits)) as m from u join c using (x, y) group by id) select id, m.cosine as cosine, round(least(20.0, 2 * m.bits * m.cosine), 6) as bits from j")
def soft_backoff(spark, sf):
    unshared = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id"), (F.col("l_partkey") % 50).alias("x"), (F.col("l_suppkey") % 50).alias("y")).agg(F.max("l_quantity").alias("bits"))
    cosines = table(spark, sf, "part").groupBy((F.col("p_partkey") % 50).alias("x"), (F.col("p_size") % 50).alias("y")).agg(F.max(F.round(F.col("p_retailprice") / 10000, 3)).alias("cosine"))
    return lookups.soft_backoff(unshared, cosines, ["id"], 20.0).withColumn("bits", F.round("bits", 6))


@query("select l_orderkey as id, l_linenumber as k, round(l_discount / 3, 4) as similarity, round(l_tax / 7, 4) as coverage, round(l_extendedprice / 7, 2) as bits, round(l_quantity / 700000, 6) as e_value from lineitem")
def reported_figures(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("k"), (F.col("l_discount") / 3).alias("similarity"), (F.col("l_tax") / 7).alias("coverage"), (F.col("l_extendedprice") / 7).alias("bits"), (F.col("l_quantity") / 700000).alias("e_value"))
    return lookups.reported(rows)


@query(None)
def passage_search(spark, sf):
    """The second and third verse of every chapter, asked of all editions."""
    held = editions(spark, sf).select("corpus", "book", "chapter", "verse", once(tokens(F.col("text"))).alias("t"))
    asked = held.filter("corpus = 'x' and verse between 2 and 3").groupBy(F.col("chapter").alias("id")).agg(F.array_sort(F.collect_list(F.struct("verse", "t"))).alias("v"))
    found = passages.search(asked.select("id", F.flatten("v.t").alias("t")), held, common=0.1)
    best = F.col("witnesses")[0]
    return found.select("id", "rank", "book", "chapter", "first", "last", best["corpus"].alias("corpus"), F.round(best["similarity"], 4).alias("similarity"), F.round(best["coverage"], 4).alias("coverage"), "run", F.round("containment", 4).alias("containment"))


@query(f"""with {V}, e as (select book, min(chapter) as c0, max(chapter) as c1, arg_max(verse, struct_pack(c := chapter, v := verse)) as v1 from vt group by book),
m as (select distinct book, chapter, chapter as id, 1990 + chapter % 20 as work_year from vt), w as (select *, unnest([struct_pack(corpus := 'x', s := 0.9, y := 1995), struct_pack(corpus := 'y', s := 0.9 - (chapter % 7) * 0.008, y := 2001), struct_pack(corpus := 'z', s := 0.85, y := null)]) as w from m),
a as (select id, book, chapter, string_agg(w.corpus, ',' order by w.corpus) filter (w.s >= 0.87) as editions, coalesce(bool_and(w.y > work_year) filter (w.y is not null), false) as anachronistic from w group by id, book, chapter)
select id, book, chapter, editions, anachronistic, case when chapter = c0 then 'opening' when chapter = c1 and 4 > v1 - 2 then 'closing' end as position from a join e using (book)""")
def decorated_matches(spark, sf):
    held = verses(spark, sf)
    score = F.round(0.9 - (F.col("chapter") % 7) * 0.008, 4)
    shown = F.array(*[F.struct(F.lit(c).alias("corpus"), s.cast("double").alias("similarity")) for c, s in (("x", F.lit(0.9)), ("y", score), ("z", F.lit(0.85)))])
    matches = held.select("book", "chapter", F.col("chapter").alias("id"), F.lit(1).alias("rank"), F.lit(2).cast("long").alias("first"), F.lit(4).cast("long").alias("last")).distinct().withColumn("witnesses", shown)
    works = matches.select("id", (1990 + F.col("id") % 20).alias("work_year"))
    years = spark.createDataFrame([("x", 1995), ("y", 2001), ("z", None)], "corpus string, witness_year int")
    return passages.decorated(matches, held, works, years).select("id", "book", "chapter", F.array_join("editions", ",").alias("editions"), "anachronistic", "position")
