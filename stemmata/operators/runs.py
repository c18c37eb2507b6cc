"""Kernels of agreement between token sequences that are relational: runs on diagonals, offsets, containment.

A run of k words is an island on one diagonal i - j of the positions where both
sequences agree.  Joins of frequent words are avoided by seeding: a run of at
least k words holds k-grams, so only k-grams are joined.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The smaller side of a seed join is broadcast up to so many grams.
BROADCAST_GRAMS = 500_000


def grams(tokenised_rows: DataFrame, key: str, k: int, at: str) -> DataFrame:
    """key, position (from 0) and 64-bit hash of each k-gram of tokens ``t``, in one span of generated code."""
    places = tokenised_rows.filter(F.size("t") >= k).select(key, "t", F.explode(F.sequence(F.lit(0), F.size("t") - k)).alias(at))
    return places.select(key, at, F.xxhash64(F.slice("t", F.col(at) + 1, F.lit(k))).alias("gram"))


def shared_runs(docs: DataFrame, items: DataFrame, doc_key: str, item_key: str, least: int = 6) -> DataFrame:
    """doc, item, first word in both and length of every maximal common run of at least ``least`` words."""
    seeds = grams(items, item_key, least, "j")
    if seeds.limit(BROADCAST_GRAMS + 1).count() <= BROADCAST_GRAMS:
        seeds = F.broadcast(seeds)
    pairs = grams(docs, doc_key, least, "i").join(seeds, "gram").select(doc_key, item_key, "i", "j")
    diagonal = Window.partitionBy(doc_key, item_key, F.col("i") - F.col("j")).orderBy("i")
    islands = pairs.withColumn("island", F.col("i") - F.row_number().over(diagonal))
    grouped = islands.groupBy(doc_key, item_key, (F.col("i") - F.col("j")).alias("diagonal"), "island")
    return grouped.agg(F.min("i").alias("first"), F.min("j").alias("item_first"), (F.count("*") + least - 1).alias("run")).drop("island", "diagonal")


def longest_runs(runs: DataFrame, doc_key: str, item_key: str) -> DataFrame:
    """doc, item and the longest run; the earliest of equals."""
    best = F.max(F.struct(F.col("run"), (-F.col("first")).alias("f"), (-F.col("item_first")).alias("j"))).alias("b")
    return runs.groupBy(doc_key, item_key).agg(best).select(doc_key, item_key, F.col("b.run").alias("run"), (-F.col("b.f")).alias("first"), (-F.col("b.j")).alias("item_first"))


def agreeing(left: DataFrame, right: DataFrame, pair: list[str]) -> DataFrame:
    """Positions (i, j) of a pair that share a lemma, with the bits of their least surprising shared lemma.

    ``left`` has pair, i and lemma; ``right`` pair, j, lemma and bits.
    """
    return left.join(right, [*pair, "lemma"]).groupBy(*pair, "i", "j").agg(F.min("bits").alias("bits"))


def lemma_runs(agreements: DataFrame, pair: list[str]) -> DataFrame:
    """Longest diagonal run of agreeing positions per pair; of equal ones the most surprising."""
    diagonal = Window.partitionBy(*pair, F.col("i") - F.col("j")).orderBy("i")
    islands = agreements.withColumn("island", F.col("i") - F.row_number().over(diagonal)).withColumn("d", F.col("i") - F.col("j"))
    each = islands.groupBy(*pair, "d", "island").agg(F.count("*").alias("run"), F.round(F.sum("bits"), 4).alias("bits"), F.min("i").alias("first"))
    best = F.max(F.struct("run", "bits", (-F.col("first")).alias("f"))).alias("b")
    return each.groupBy(*pair).agg(best).select(*pair, F.col("b.run").alias("lemma_run"), F.col("b.bits").alias("bits"), (-F.col("b.f")).alias("first"))


def offset_peak(agreements: DataFrame, pair: list[str], floor_bits: float = 4.0) -> DataFrame:
    """Share of the commonest offset i - j among agreements of ``floor_bits`` or more."""
    voting = agreements.filter(F.col("bits") >= floor_bits)
    counted = voting.groupBy(*pair, (F.col("i") - F.col("j")).alias("d")).agg(F.count("*").alias("n"))
    return counted.groupBy(*pair).agg(F.max("n").alias("peak"), F.sum("n").alias("votes")).withColumn("share", F.round(F.col("peak") / F.col("votes"), 4))


def containment(docs: DataFrame, items: DataFrame, doc_key: str, item_key: str, pairs: DataFrame) -> DataFrame:
    """Share of an item's words that stand anywhere in the document, for given pairs."""
    joined = pairs.join(docs.select(doc_key, F.col("t").alias("mine")), doc_key).join(items.select(item_key, F.col("t").alias("theirs")), item_key)
    held = F.size(F.filter("theirs", lambda w: F.array_contains("mine", w)))
    return joined.select(doc_key, item_key, F.round(held / F.size("theirs"), 4).alias("containment"))


def fragmentation(positions: DataFrame, pair: list[str], at: str = "i") -> DataFrame:
    """(chunks / matches) ** 3 over the matching positions of a pair: 1 when all are scattered."""
    marked = positions.select(*pair, at).distinct()
    order = Window.partitionBy(*pair).orderBy(at)
    counted = marked.withColumn("new", F.coalesce((F.col(at) - F.lag(at).over(order) > 1).cast("int"), F.lit(1)))
    return counted.groupBy(*pair).agg(F.sum("new").alias("chunks"), F.count("*").alias("matches")).withColumn("fragmentation", F.round(F.pow(F.col("chunks") / F.col("matches"), 3), 4))


def recover(words: DataFrame, lexicon: DataFrame, word: str = "word", form: str = "form", shares: int = 1) -> DataFrame:
    """Forms within the word's edit bound: 1 for up to four letters, 2 beyond, none for words of over 24.

    Candidates meet by length and by deletion-free blocks: of bound + 1 pieces of
    the word one stands unchanged in the form, shifted by the bound at most; the
    edit distance itself is Spark's bounded ``levenshtein``.
    """
    bound = F.when(F.length(word) <= 4, 1).otherwise(2)
    asked = words.select(word).distinct().filter(F.length(word) <= 24).withColumn("k", bound)
    pieces = asked.withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("k")))).withColumn("size", F.floor(F.length(word) / (F.col("k") + 1)).cast("int"))
    start = F.col("piece") * F.col("size")
    span = F.when(F.col("piece") == F.col("k"), F.length(word) - start).otherwise(F.col("size"))
    keyed = pieces.withColumn("start", start).withColumn("span", span).withColumn("text", F.substr(F.col(word), F.col("start") + 1, F.col("span")))
    shifted = keyed.withColumn("shift", F.explode(F.sequence(-F.col("k"), F.col("k")))).withColumn("at", F.col("start") + F.col("shift")).filter("at >= 0")
    forms = lexicon.select(form).distinct().filter(F.length(form) <= 26)
    spans = forms.withColumn("span", F.explode(F.sequence(F.lit(0), F.least(F.length(form), F.lit(24))))).withColumn("at", F.explode(F.sequence(F.lit(0), F.length(form) - F.col("span"))))
    needed = F.broadcast(keyed.select("span").distinct())
    cut = spans.join(needed, "span").withColumn("text", F.substr(F.col(form), F.col("at") + 1, F.col("span")))
    met = shifted.join(cut, ["span", "at", "text"]).select(word, form, "k").distinct()
    near = met.filter(F.abs(F.length(word) - F.length(form)) <= F.col("k"))
    one = near.filter("k = 1").withColumn("distance", F.levenshtein(word, form, 1))
    two = near.filter("k = 2").withColumn("distance", F.levenshtein(word, form, 2))
    return one.union(two).filter("distance >= 0").select(word, form, "distance")
