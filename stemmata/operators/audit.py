"""Audits of mappings and editions: offset joins, agreement, contradicted runs, families, comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OFFSETS, WEAK, MARGIN = (-2, -1, 0, 1, 2), 0.10, 0.05


def jaccard(left: Column, right: Column) -> Column:
    """Set similarity of two token arrays; 0 for two empty ones."""
    union = F.size(F.array_union(left, right))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(left, right)) / union)


def offset_scores(left: DataFrame, right: DataFrame, key: list[str], verse: str = "verse", score: Column | None = None) -> DataFrame:
    """key, verse, offset and score of each left verse against the right verses around it.

    Both sides have key, verse and tokens ``t``.  The neighbour join is an equi-join
    on verse + offset.
    """
    shifted = left.select(*key, verse, F.col("t").alias("mine"), F.explode(F.array(*[F.lit(o) for o in OFFSETS])).alias("offset")).withColumn("other", F.col(verse) + F.col("offset"))
    joined = shifted.join(right.select(*key, F.col(verse).alias("other"), F.col("t").alias("theirs")), [*key, "other"])
    measure = score if score is not None else jaccard(F.col("mine"), F.col("theirs"))
    return joined.select(*key, verse, "offset", F.round(measure, 6).alias("score"))


def agreement(scores: DataFrame, key: list[str], verse: str = "verse") -> DataFrame:
    """Best offset (the first of equals, counted from the most negative), best and own score, verdict.

    weak: nothing reaches 0.10; agree: offset 0 is best or within 0.05; else contradict.
    """
    place = [*key, verse]
    best = F.max(F.struct("score", (-F.col("offset")).alias("o"))).alias("b")
    own = F.max(F.when(F.col("offset") == 0, F.col("score"))).alias("own")
    grouped = scores.groupBy(*place).agg(best, own).select(*place, F.col("b.score").alias("best"), (-F.col("b.o")).alias("offset"), F.coalesce("own", F.lit(0.0)).alias("own"))
    verdict = F.when(F.col("best") < WEAK, "weak").when((F.col("offset") == 0) | (F.round(F.col("best") - F.col("own"), 6) < MARGIN), "agree").otherwise("contradict")
    return grouped.withColumn("verdict", verdict)


def confusion(verdicts: DataFrame, key: list[str]) -> DataFrame:
    """Counts of verdicts, and the share of decisive ones that agree."""
    n = lambda v: F.count_if(F.col("verdict") == v)
    out = verdicts.groupBy(*key).agg(F.count("*").alias("checked"), n("agree").alias("agree"), n("contradict").alias("contradict"), n("weak").alias("weak"))
    return out.withColumn("share", F.round(F.col("agree") / F.nullif(F.col("agree") + F.col("contradict"), F.lit(0)), 4))


def contradicted_runs(verdicts: DataFrame, key: list[str], verse: str = "verse", least: int = 4, by_offset: bool = False) -> DataFrame:
    """Runs of at least ``least`` consecutive contradicted verses; with ``by_offset`` of one offset each."""
    place = [*key, "offset"] if by_offset else key
    order = Window.partitionBy(*place).orderBy(verse)
    bad = verdicts.filter("verdict = 'contradict'").withColumn("island", F.col(verse) - F.row_number().over(order))
    runs = bad.groupBy(*place, "island").agg(F.min(verse).alias("first"), F.max(verse).alias("last"), F.count("*").alias("n"))
    return runs.filter(F.col("n") >= least).drop("island")


def conflicts(signatures: DataFrame) -> DataFrame:
    """Pairs of sources (a < b) with shared chapters and how many of them end differently.

    The join is by chapter, and sources are few: its size is chapters times pairs
    of sources that hold them.
    """
    right = signatures.select("book", "chapter", F.col("source").alias("b"), F.col("last").alias("b_last"))
    left = signatures.select("book", "chapter", F.col("source").alias("a"), F.col("last").alias("a_last"))
    joined = left.join(right, ["book", "chapter"]).filter("a < b")
    return joined.groupBy("a", "b").agg(F.count("*").alias("shared"), F.count_if(F.col("a_last") != F.col("b_last")).alias("conflicts"))


def families(pairs: list[tuple[str, str, int, int]], chapters: dict[str, int], tolerance: float = 0.0, seeds: list[str] | None = None) -> dict[str, str | None]:
    """Family (its founder's name) of each source, or None where several would take it.

    Sources come by number of chapters, then name; each joins the one family with
    whose founder it conflicts in no more than ``tolerance`` of shared chapters,
    founds its own where there is none, and stays unassigned where there are
    several.  ``pairs`` are rows of :func:`conflicts`, of a few hundred sources at
    most.
    """
    clash = {}
    for a, b, shared, conflict in pairs:
        clash[a, b] = clash[b, a] = conflict / shared if shared else 1.0
    out: dict[str, str | None] = {s: s for s in seeds or []}
    founders = list(seeds or [])
    for source in sorted(chapters, key=lambda s: (-chapters[s], s)):
        if source in out:
            continue
        fits = [f for f in founders if clash.get((source, f), 1.0) <= tolerance]
        out[source] = fits[0] if len(fits) == 1 else source if not fits else None
        if not fits:
            founders.append(source)
    return out


def compare(pivot: DataFrame, left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """Per book: verses both, only left, only right and neither have of the pivot's grid."""
    a = left.select(*key).distinct().withColumn("l", F.lit(1))
    b = right.select(*key).distinct().withColumn("r", F.lit(1))
    joined = pivot.select(*key).distinct().join(a, key, "left").join(b, key, "left")
    both = F.col("l").isNotNull() & F.col("r").isNotNull()
    return joined.groupBy(key[0]).agg(
        F.count("*").alias("verses"), F.count_if(both).alias("both"), F.count_if(F.col("l").isNotNull() & F.col("r").isNull()).alias("only_left"),
        F.count_if(F.col("l").isNull() & F.col("r").isNotNull()).alias("only_right"), F.count_if(F.col("l").isNull() & F.col("r").isNull()).alias("neither"))


def disputed(verses: DataFrame, key: list[str], witness: str = "source") -> DataFrame:
    """Chapters whose witnesses hold different sets of verses."""
    sets = verses.groupBy(*key, witness).agg(F.array_join(F.transform(F.array_sort(F.collect_set("verse")), lambda v: v.cast("string")), ",").alias("held"))
    return sets.groupBy(*key).agg(F.countDistinct("held").alias("versions"), F.count("*").alias("witnesses")).filter("versions > 1")


def faithful(verses: DataFrame, grid: DataFrame, swapped: DataFrame, key: list[str]) -> DataFrame:
    """(source, chapter) without gaps whose ends are the system's, and whose content is not listed as swapped."""
    ends = verses.groupBy(*key).agg(F.min("verse").alias("lo"), F.max("verse").alias("hi"), F.countDistinct("verse").alias("n"))
    whole = ends.filter("lo <= 1 and n = hi - lo + 1").join(grid, ["book", "chapter"]).filter("hi = last")
    return whole.join(swapped, ["book", "chapter"], "left_anti").select(*key, "hi")


def first_holder(holders: DataFrame, key: list[str], priority: str) -> DataFrame:
    """The holder of best priority for each key (ties by source)."""
    order = Window.partitionBy(*key).orderBy(priority, "source")
    return holders.withColumn("place", F.row_number().over(order)).filter("place = 1").drop("place")


def admitted(judged: DataFrame, pair: list[str], least: float = 0.8) -> DataFrame:
    """Pairs whose measured share of right verdicts reaches ``least``; a pair never measured is not in the result."""
    out = judged.groupBy(*pair).agg(F.count("*").alias("rows"), F.round(F.avg(F.col("right").cast("double")), 4).alias("share"))
    return out.filter(F.col("share") >= least)


def unjudged(tasks: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """Tasks that no verdict answers yet."""
    return tasks.join(done.select(*key).distinct(), key, "left_anti")


def tally(verdicts: DataFrame, key: list[str]) -> DataFrame:
    """Three-way count of verdicts and whether yes and no both occur."""
    n = lambda v: F.count_if(F.col("verdict") == v)
    out = verdicts.groupBy(*key).agg(n("yes").alias("yes"), n("no").alias("no"), n("unsure").alias("unsure"))
    return out.withColumn("contradiction", (F.col("yes") > 0) & (F.col("no") > 0))


def length_correlation(lengths: DataFrame, least: int = 4, spread: float = 1.0) -> DataFrame:
    """Pearson correlation of verse lengths per chapter and pair of editions that hold the same verses.

    ``lengths`` has source, book, chapter, verse and words.
    """
    sets = lengths.groupBy("source", "book", "chapter").agg(F.xxhash64(F.array_sort(F.collect_set("verse"))).alias("held"), F.stddev_pop("words").alias("sd"), F.count("*").alias("n"))
    good = sets.filter((F.col("n") >= least) & (F.col("sd") >= spread))
    pairs = good.select("book", "chapter", "held", F.col("source").alias("a")).join(good.select("book", "chapter", "held", F.col("source").alias("b")), ["book", "chapter", "held"]).filter("a < b").drop("held")
    left = pairs.join(lengths.select("book", "chapter", "verse", F.col("source").alias("a"), F.col("words").alias("x")), ["book", "chapter", "a"])
    both = left.join(lengths.select("book", "chapter", "verse", F.col("source").alias("b"), F.col("words").alias("y")), ["book", "chapter", "verse", "b"])
    return both.groupBy("book", "chapter", "a", "b").agg(F.count("*").alias("verses"), F.round(F.corr("x", "y"), 4).alias("r"))


def arbitrate(overlaps: DataFrame, key: list[str], draw: float = 0.02) -> DataFrame:
    """Side with the larger best overlap with any arbiter; a draw within ``draw``.

    ``overlaps`` has key, side, arbiter and overlap.
    """
    best = overlaps.groupBy(*key, "side").agg(F.max("overlap").alias("best"), F.max_by("arbiter", F.struct("overlap", "arbiter")).alias("arbiter"))
    sides = best.groupBy(*key).agg(F.max("best").alias("hi"), F.min("best").alias("lo"), F.max_by("side", F.struct("best", "side")).alias("side"), F.count("*").alias("n"))
    return sides.select(*key, F.when((F.col("n") > 1) & (F.col("hi") - F.col("lo") < draw), "draw").otherwise(F.col("side")).alias("winner"), F.col("hi").alias("overlap"))
