"""Sequences, intervals and gaps-and-islands over document positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Words a formula reaches ahead, words of a shard, words that neighbouring shards share.
REACH, SHARD, OVERLAP = 6, 5000, 200


def runs(rows: DataFrame, key: list[str], at: str) -> DataFrame:
    """Maximal runs of consecutive numbers: key, first, last, n."""
    order = Window.partitionBy(*key).orderBy(at)
    islands = rows.select(*key, at).distinct().withColumn("island", F.col(at) - F.row_number().over(order))
    return islands.groupBy(*key, "island").agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("n")).drop("island")


def capped_runs(rows: DataFrame, key: list[str], at: str, most: int) -> DataFrame:
    """Runs cut into requests of at most ``most`` numbers."""
    order = Window.partitionBy(*key).orderBy(at)
    islands = rows.select(*key, at).distinct().withColumn("island", F.col(at) - F.row_number().over(order))
    inner = Window.partitionBy(*key, "island").orderBy(at)
    parts = islands.withColumn("part", F.floor((F.row_number().over(inner) - 1) / most))
    return parts.groupBy(*key, "island", "part").agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("n")).drop("island", "part")


def merged_intervals(rows: DataFrame, key: list[str], first: str = "first", last: str = "last", gap: int = 1) -> DataFrame:
    """Union of closed integer intervals; those at most ``gap`` apart are joined."""
    order = Window.partitionBy(*key).orderBy(first, last)
    before = F.max(last).over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = rows.withColumn("new", F.coalesce((F.col(first) > before + gap).cast("int"), F.lit(0)))
    numbered = marked.withColumn("part", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*key, "part").agg(F.min(first).alias("first"), F.max(last).alias("last"), F.count("*").alias("n")).drop("part")


def spread_clusters(rows: DataFrame, key: list[str], at: str, most: int, boundary: Column | None = None) -> DataFrame:
    """Mentions at most ``most`` apart, not severed by a boundary: key, cluster, first, last, n."""
    order = Window.partitionBy(*key).orderBy(at)
    cut = F.col(at) - F.lag(at).over(order) > most
    cut = cut | boundary if boundary is not None else cut
    marked = rows.withColumn("new", F.coalesce(cut.cast("int"), F.lit(0)))
    numbered = marked.withColumn("cluster", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*key, "cluster").agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("n"))


def majority_overlaps(left: DataFrame, right: DataFrame, key: list[str], same: Column) -> DataFrame:
    """Pairs of half-open spans of a document of which one claims the other.

    ``left`` has a_first, a_after and ``right`` b_first, b_after.  Spans of one
    passage (``same``) claim each other at any overlap, others when they share
    more than half of the shorter.
    """
    joined = left.join(right, key).withColumn("shared", F.least("a_after", "b_after") - F.greatest("a_first", "b_first"))
    shorter = F.least(F.col("a_after") - F.col("a_first"), F.col("b_after") - F.col("b_first"))
    return joined.filter((F.col("shared") > 0) & (same | (F.col("shared") * 2 > shorter)))


def not_contained(spans: DataFrame, key: list[str], first: str = "first", after: str = "after") -> DataFrame:
    """Spans that no other span of the key covers; of equal ones the row counts once."""
    spans = spans.select(*key, first, after).distinct()
    reach = Window.partitionBy(*key).orderBy(F.col(first), F.desc(after)).rowsBetween(Window.unboundedPreceding, -1)
    return spans.withColumn("reach", F.max(after).over(reach)).filter(F.col("reach").isNull() | (F.col(after) > F.col("reach"))).drop("reach")


def shards(tokenised_docs: DataFrame, key: str, size: int = SHARD, overlap: int = OVERLAP) -> DataFrame:
    """Documents cut into parts of ``size`` words, the next one starting ``overlap`` words before the end: key, part, parts, offset, t."""
    step = size - overlap
    n = F.greatest(F.lit(1), F.ceil((F.size("t") - overlap) / step).cast("int"))
    parts = tokenised_docs.withColumn("parts", n).withColumn("part", F.explode(F.sequence(F.lit(0), n - 1)))
    return parts.select(key, "part", "parts", (F.col("part") * step).alias("offset"), F.slice("t", F.col("part") * step + 1, F.lit(size)).alias("t"))


def reassembled(found: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Shards' findings in words of the whole document: duplicates of overlaps and contained spans go.

    ``found`` has key, part, offset, first, after and label; ``done`` has key, part
    and parts of every shard that ended well.  A document of which a shard is
    missing is left out entirely.
    """
    whole = done.groupBy(key).agg(F.countDistinct("part").alias("n"), F.max("parts").alias("parts")).filter("n = parts").select(key)
    based = found.join(whole, key, "left_semi").select(key, "label", (F.col("first") + F.col("offset")).alias("first"), (F.col("after") + F.col("offset")).alias("after"))
    return not_contained(based, [key, "label"])


def unmet(announced: DataFrame, found: DataFrame, key: str, reach: int = REACH) -> DataFrame:
    """Announcements (key, at: first word after the formula) that no finding starts within ``reach`` words or covers."""
    near = (announced[key] == found[key]) & (found["first"] < announced["at"] + reach) & (found["after"] > announced["at"])
    return announced.join(found, near, "left_anti")


def residue(words: DataFrame, found: DataFrame, key: str, at: str = "pos", lead: int = 6) -> DataFrame:
    """Words outside all findings and their ``lead`` words before."""
    inside = (words[key] == found[key]) & (words[at] >= found["first"] - lead) & (words[at] < found["after"])
    return words.join(found, inside, "left_anti")


def as_of(words: DataFrame, starts: DataFrame, key: list[str], at: str, start: str) -> DataFrame:
    """Each word with the latest start at or before it; one sort, no range join."""
    both = words.select(*key, F.col(at).alias("at"), F.lit(None).cast("long").alias("s"), F.lit(1).alias("kind")).unionByName(
        starts.select(*key, F.col(start).alias("at"), F.col(start).cast("long").alias("s"), F.lit(0).alias("kind")))
    order = Window.partitionBy(*key).orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("start", F.last("s", ignorenulls=True).over(order)).filter("kind = 1").select(*key, F.col("at").alias(at), "start")
