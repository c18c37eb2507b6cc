"""Coordinate algebra: numbering systems that disagree, converted through a pivot.

A system is a set of DataFrames: ``grid`` (book, chapter, last: the last verse),
``to_pivot`` and ``from_pivot`` (book, chapter, verse, p_book, p_chapter,
p_verse; the second may have several rows for a pivot verse), and ``covers``
(verse to every pivot verse that it overlaps).  Coordinates without a row map to
themselves.  A refusal is a value of ``status``, never a missing row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

COORD = ["book", "chapter", "verse"]
ENTRY = r"^([1-4A-Z]{3}) (\d+):(\d+)(?:-(\d+))?$"


def signature(verses: DataFrame, key: list[str]) -> DataFrame:
    """Last verse of each chapter that has no gaps from verse 1 on."""
    grouped = verses.groupBy(*key).agg(F.min("verse").alias("lo"), F.max("verse").alias("last"), F.countDistinct("verse").alias("n"))
    return grouped.filter("lo = 1 and n = last").select(*key, "last")


def validity(refs: DataFrame, grid: DataFrame) -> DataFrame:
    """``refs`` with valid: the chapter is in the grid and the verse within it (0 is a title)."""
    joined = refs.join(grid, ["book", "chapter"], "left")
    return joined.withColumn("valid", F.col("last").isNotNull() & F.col("verse").between(0, F.col("last"))).drop("last")


def convert_exact(refs: DataFrame, to_pivot: DataFrame, from_pivot: DataFrame, grid: DataFrame, unreliable: DataFrame | None = None) -> DataFrame:
    """Every ref with its target coordinates t_* (several rows where one splits) and status.

    status is ok, refused:unreliable (a chapter listed as not mappable) or
    refused:absent (the target system has no such verse).
    """
    piv = [F.coalesce(f"p_{c}", c).alias(f"q_{c}") for c in COORD]
    pivots = refs.join(to_pivot, COORD, "left").select(*refs.columns, *piv)
    back = from_pivot.select(*[F.col(f"p_{c}").alias(f"q_{c}") for c in COORD], *[F.col(c).alias(f"f_{c}") for c in COORD])
    out = pivots.join(back, [f"q_{c}" for c in COORD], "left").select(*refs.columns, *[F.coalesce(f"f_{c}", f"q_{c}").alias(f"t_{c}") for c in COORD])
    return _checked(out, grid, unreliable)


def convert_covering(refs: DataFrame, covers: DataFrame, covered_by: DataFrame, grid: DataFrame, unreliable: DataFrame | None = None) -> DataFrame:
    """Like :func:`convert_exact`, but every target verse that shares any text."""
    spread = refs.join(covers, COORD, "left").select(*refs.columns, *[F.coalesce(f"p_{c}", c).alias(f"q_{c}") for c in COORD])
    back = covered_by.select(*[F.col(f"p_{c}").alias(f"q_{c}") for c in COORD], *[F.col(c).alias(f"f_{c}") for c in COORD])
    out = spread.join(back, [f"q_{c}" for c in COORD], "left").select(*refs.columns, *[F.coalesce(f"f_{c}", f"q_{c}").alias(f"t_{c}") for c in COORD])
    return _checked(out.distinct(), grid, unreliable)


def _checked(out: DataFrame, grid: DataFrame, unreliable: DataFrame | None) -> DataFrame:
    target = grid.select(F.col("book").alias("t_book"), F.col("chapter").alias("t_chapter"), F.col("last"))
    told = out.join(target, ["t_book", "t_chapter"], "left")
    absent = F.col("last").isNull() | ~F.col("t_verse").between(0, F.col("last"))
    status = F.when(absent, "refused:absent").otherwise("ok")
    if unreliable is not None:
        told = told.join(unreliable.select("book", "chapter", F.lit(True).alias("bad")), ["book", "chapter"], "left")
        status = F.when(F.col("bad"), "refused:unreliable").otherwise(status)
    return told.select(*[c for c in out.columns], status.alias("status"))


def expand(ranges: DataFrame, grid: DataFrame, key: str) -> DataFrame:
    """Every verse of ranges (book, chapter, verse to end_chapter, end_verse), whole chapters between included."""
    ends = grid.groupBy("book").agg(F.min("chapter").alias("_from"), F.max("chapter").alias("_to"))
    own = ranges.join(F.broadcast(ends), "book").withColumn("_from", F.greatest("_from", "chapter").cast("long")).withColumn("_to", F.least("_to", "end_chapter").cast("long"))
    spread = own.filter("chapter is not null and end_chapter is not null and _from <= _to").withColumn("c", F.explode(F.sequence("_from", "_to"))).drop("_from", "_to")
    joined = spread.join(grid.withColumnRenamed("chapter", "c"), ["book", "c"])
    low = F.when(F.col("c") == F.col("chapter"), F.col("verse")).otherwise(F.lit(1))
    high = F.when(F.col("c") == F.col("end_chapter"), F.least("end_verse", "last")).otherwise(F.col("last"))
    return joined.withColumn("lo", low).withColumn("hi", high).filter("lo <= hi").select(key, "book", F.col("c").alias("chapter"), F.explode(F.sequence("lo", "hi")).alias("verse"))


def coalesce(verses: DataFrame, key: list[str]) -> DataFrame:
    """Ranges of adjacent verses of a chapter; a verse with a subverse stands alone.

    ``verses`` has key, book, chapter, verse and, optionally, subverse.
    """
    own = verses if "subverse" in verses.columns else verses.withColumn("subverse", F.lit(""))
    plain, sub = own.filter("subverse = ''"), own.filter("subverse <> ''")
    place = [*key, "book", "chapter"]
    order = Window.partitionBy(*place).orderBy("verse")
    islands = plain.select(*place, "verse").distinct().withColumn("island", F.col("verse") - F.row_number().over(order))
    joined = islands.groupBy(*place, "island").agg(F.min("verse").alias("first"), F.max("verse").alias("last"), F.lit("").alias("subverse")).drop("island")
    alone = sub.select(*place, F.col("verse").alias("first"), F.col("verse").alias("last"), "subverse").distinct()
    return joined.unionByName(alone)


def ordinals(grid: DataFrame) -> DataFrame:
    """grid with ``before``: the number of verses in earlier chapters of the book."""
    order = Window.partitionBy("book").orderBy("chapter").rowsBetween(Window.unboundedPreceding, -1)
    return grid.withColumn("before", F.coalesce(F.sum("last").over(order), F.lit(0)))


def merge(ranges: DataFrame, grid: DataFrame, key: list[str]) -> DataFrame:
    """Union of overlapping or adjacent ranges, across chapter ends too."""
    place = ordinals(grid)
    start = place.select("book", "chapter", F.col("before").alias("b1"))
    end = place.select("book", F.col("chapter").alias("end_chapter"), F.col("before").alias("b2"))
    lined = ranges.join(start, ["book", "chapter"]).join(end, ["book", "end_chapter"]).withColumn("first", F.col("b1") + F.col("verse")).withColumn("last", F.col("b2") + F.col("end_verse"))
    order = Window.partitionBy(*key, "book").orderBy("first", "last")
    before = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = lined.withColumn("new", F.coalesce((F.col("first") > before + 1).cast("int"), F.lit(0)))
    numbered = marked.withColumn("part", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    ends = F.min(F.struct("first", "chapter", "verse")).alias("lo"), F.max(F.struct("last", "end_chapter", "end_verse")).alias("hi"), F.count("*").alias("n")
    joined = numbered.groupBy(*key, "book", "part").agg(*ends)
    return joined.select(*key, "book", F.col("lo.chapter"), F.col("lo.verse"), F.col("hi.end_chapter"), F.col("hi.end_verse"), "n")


def convert_first(converted: DataFrame, key: list[str]) -> DataFrame:
    """The first target of each coordinate, of those that are not refused; null where all are."""
    target = F.struct(*[F.col(f"t_{c}").alias(c) for c in COORD])
    return converted.groupBy(*key).agg(F.min(F.when(F.col("status") == "ok", target)).alias("t")).select(*key, *[F.col(f"t.{c}").alias(f"t_{c}") for c in COORD])


def convert_range(ranges: DataFrame, grid: DataFrame, to_pivot: DataFrame, from_pivot: DataFrame, target: DataFrame, key: str) -> DataFrame:
    """Ranges in the target system: expanded to verses, converted, and joined where they are adjacent again."""
    out = convert_exact(expand(ranges, grid, key), to_pivot, from_pivot, target).filter("status = 'ok'")
    return coalesce(out.select(key, *[F.col(f"t_{c}").alias(c) for c in COORD]), [key]).drop("subverse")


def corrected(mapped: DataFrame, corrections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Mappings after corrections, and the corrections that are stale.

    ``corrections`` has action, coordinates, p_* and why.  ``drop`` and ``fix`` are
    stale where the coordinate has no mapping, or has the fixed one already;
    ``add`` where it has one.
    """
    pivot = [f"p_{c}" for c in COORD]
    old = mapped.select(*COORD, F.struct(*[F.col(c).alias(c) for c in pivot]).alias("old"))
    joined = corrections.join(old, COORD, "left").withColumn("new", F.struct(*[F.col(c).alias(c) for c in pivot]))
    there, same = F.col("old").isNotNull(), F.col("old").eqNullSafe(F.col("new"))
    stale = F.when(F.col("action") == "add", there).when(F.col("action") == "fix", ~there | same).otherwise(~there)
    judged = joined.withColumn("stale", stale)
    live = judged.filter("not stale")
    kept = mapped.join(live.select(*COORD), COORD, "left_anti").select(*COORD, *pivot)
    return kept.unionByName(live.filter("action <> 'drop'").select(*COORD, *pivot)), judged.filter("stale").select("action", *COORD, "why")


def lettered(additions: DataFrame, chapters: DataFrame) -> DataFrame:
    """Verses of chapters named by letters as verses of a numbered continuation, by their ordinal.

    ``additions`` has letter and verse; ``chapters`` chapter, from_verse and verses of the continuation, in order.
    """
    own = additions.withColumn("ordinal", F.row_number().over(Window.orderBy("letter", "verse")))
    order = Window.orderBy("chapter").rowsBetween(Window.unboundedPreceding, -1)
    lined = chapters.withColumn("before", F.coalesce(F.sum("verses").over(order), F.lit(0)))
    spread = lined.withColumn("k", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("verses").cast("bigint")))).select((F.col("before") + F.col("k")).alias("ordinal"), "chapter", (F.col("from_verse") + F.col("k") - 1).alias("t_verse"))
    return own.join(spread, "ordinal", "left").select("letter", "verse", "chapter", "t_verse")


def unmappable(grid: DataFrame, pivot: DataFrame, mapped: DataFrame) -> DataFrame:
    """Chapters that both systems have with different lengths and no mapping touches."""
    joined = grid.join(pivot.select("book", "chapter", F.col("last").alias("p_last")), ["book", "chapter"]).filter("last <> p_last")
    return joined.join(mapped.select("book", "chapter").distinct(), ["book", "chapter"], "left_anti")


def best_fit(verses: DataFrame, systems: DataFrame, margin: float = 0.05) -> DataFrame:
    """source, system, share of its chapters that end where the system says; close when the next is within ``margin``.

    ``systems`` has system, book, chapter, last; ``verses`` source, book, chapter, verse.
    """
    ends = verses.groupBy("source", "book", "chapter").agg(F.max("verse").alias("end"))
    fits = ends.join(systems, ["book", "chapter"]).groupBy("source", "system").agg(F.round(F.avg((F.col("end") == F.col("last")).cast("double")), 6).alias("share"))
    order = Window.partitionBy("source").orderBy(F.desc("share"), "system")
    ranked = fits.withColumn("place", F.row_number().over(order)).withColumn("next", F.lead("share").over(order))
    return ranked.filter("place = 1").select("source", "system", "share", F.coalesce(F.col("share") - F.col("next") < margin, F.lit(False)).alias("close"))


def parse_entries(entries: DataFrame, column: str = "entry") -> DataFrame:
    """Mapping entries such as ``GEN 31:55`` or ``GEN 1:2-9`` as one row per verse; others have null coordinates."""
    part = lambda k: F.regexp_extract(column, ENTRY, k)
    chapter, first = F.expr("try_cast(c as int)"), F.expr("try_cast(v as int)")
    split = entries.withColumn("b", part(1)).withColumn("c", part(2)).withColumn("v", part(3)).withColumn("w", part(4))
    end = F.coalesce(F.expr("try_cast(w as int)"), first)
    return split.withColumn("verse", F.explode_outer(F.when(first.isNotNull() & (end >= first), F.sequence(first, end)))).select(
        *entries.columns, F.when(F.col("b") != "", F.col("b")).alias("book"), chapter.alias("chapter"), "verse")


def aligned(pairs: DataFrame) -> DataFrame:
    """Rows (left, right) of entry strings as verse by verse mappings; ranges of different length are an error."""
    numbered = pairs.select("left", "right").distinct().withColumn("id", F.xxhash64("left", "right"))

    def side(name: str, prefix: str) -> DataFrame:
        rows = parse_entries(numbered.select("id", F.col(name).alias("entry")))
        return rows.select("id", *[F.col(c).alias(f"{prefix}{c}") for c in COORD], F.row_number().over(Window.partitionBy("id").orderBy("verse")).alias("k"))

    joined = side("left", "").join(side("right", "p_"), ["id", "k"], "full_outer")
    unequal = F.col("verse").isNull() | F.col("p_verse").isNull()
    return joined.select(*COORD, *[f"p_{c}" for c in COORD], F.when(unequal, F.raise_error(F.lit("ranges of unequal length"))).otherwise(F.lit(True)).alias("ok")).filter("ok").drop("ok")


def reverse(mapped: DataFrame, grid: DataFrame, pivot: DataFrame) -> DataFrame:
    """Pivot verse to the system's verses: mapped rows first, then identity where nothing claims the pivot verse.

    Of several books that map to one pivot verse the pivot's own book wins, then
    the first; all its coordinates stay.
    """
    rank = F.dense_rank().over(Window.partitionBy("p_book", "p_chapter", "p_verse").orderBy((F.col("book") != F.col("p_book")).cast("int"), "book"))
    won = mapped.withColumn("place", rank).filter("place = 1").drop("place")
    every = pivot.select("book", "chapter", F.explode(F.sequence(F.lit(1), "last")).alias("verse"))
    taken = won.select(*[F.col(f"p_{c}").alias(c) for c in COORD])
    here = grid.select("book", "chapter", F.explode(F.sequence(F.lit(1), "last")).alias("verse")).join(mapped.select(*COORD), COORD, "left_anti")
    same = every.join(taken, COORD, "left_anti").join(here, COORD, "left_semi")
    return won.select(*COORD, *[f"p_{c}" for c in COORD]).unionByName(same.select(*COORD, *[F.col(c).alias(f"p_{c}") for c in COORD]))


def transpose(covers: DataFrame) -> DataFrame:
    """Pivot verse with the set of the system's verses that cover it."""
    return covers.groupBy(*[f"p_{c}" for c in COORD]).agg(F.array_sort(F.collect_set(F.struct(*COORD))).alias("by"))


def fingerprint(tables: dict[str, DataFrame]) -> DataFrame:
    """One order-insensitive 64-bit fingerprint and row count per table."""
    out = None
    for name, df in sorted(tables.items()):
        row = df.agg(F.count("*").alias("rows"), F.coalesce(F.bit_xor(F.xxhash64(*df.columns)), F.lit(0)).alias("print")).select(F.lit(name).alias("part"), "rows", "print")
        out = row if out is None else out.unionByName(row)
    return out
