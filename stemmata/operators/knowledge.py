"""Entities, parallels, profiles, passages, quotas and licences."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stemmata.functions import kernels
from stemmata.session import ship

CHAIN, BITS, MEMBERS = 4, 25.0, 8


def crosswalk(names: DataFrame, name: str = "name", entity: str = "entity") -> DataFrame:
    """name and the one entity that bears it, or null where several do: an ambiguous name is never guessed."""
    grouped = names.groupBy(name).agg(F.countDistinct(entity).alias("n"), F.min(entity).alias("one"))
    return grouped.select(name, F.when(F.col("n") == 1, F.col("one")).alias(entity), F.col("n").alias("bearers"))


def mentions(words: DataFrame, forms: DataFrame, key: str) -> DataFrame:
    """key, pos and entity of each word that is a form of an entity."""
    return words.join(forms, "token").select(key, "pos", "entity")


def co_mentions(found: DataFrame, key: str, spread: int = 4, least: int = 2) -> DataFrame:
    """Clusters of mentions at most ``spread`` apart that name at least ``least`` entities."""
    order = Window.partitionBy(key).orderBy("pos", "entity")
    marked = found.withColumn("new", F.coalesce((F.col("pos") - F.lag("pos").over(order) > spread).cast("int"), F.lit(0)))
    numbered = marked.withColumn("cluster", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    out = numbered.groupBy(key, "cluster").agg(F.min("pos").alias("first"), F.max("pos").alias("last"), F.array_sort(F.collect_set("entity")).alias("entities"))
    return out.filter(F.size("entities") >= least)


def episodes(events: DataFrame, members: DataFrame, least: int = 2) -> DataFrame:
    """event with its distinct entities, for events of at least ``least``."""
    return events.join(members, "event").groupBy("event").agg(F.array_sort(F.collect_set("entity")).alias("entities")).filter(F.size("entities") >= least)


def undirected(edges: DataFrame) -> DataFrame:
    """Both directions of every edge (a, b), once each."""
    return edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def allusions(gestures: DataFrame, candidates: DataFrame, weights: DataFrame, key: str, tie: float = 2.0) -> DataFrame:
    """Best candidate of each gesture by summed bits of shared words; within ``tie`` bits those already quoted win.

    ``gestures`` has key and token, ``candidates`` target, token and quoted, ``weights`` token and bits.
    """
    shared = gestures.distinct().join(candidates.distinct(), "token").join(weights, "token")
    scored = shared.groupBy(key, "target").agg(F.round(F.sum("bits"), 4).alias("bits"), F.max("quoted").alias("quoted"))
    best = Window.partitionBy(key)
    near = scored.withColumn("top", F.max("bits").over(best)).filter(F.col("top") - F.col("bits") <= tie)
    order = Window.partitionBy(key).orderBy(F.desc("quoted"), F.desc("bits"), "target")
    return near.withColumn("place", F.row_number().over(order)).filter("place = 1").select(key, "target", "bits", "quoted")


def allusions_in_blocks(gestures: DataFrame, candidates: DataFrame, weights: DataFrame, key: str, tie: float = 2.0, block: int = 2048) -> DataFrame:
    """:func:`allusions` for weights that leave no word out, so that nearly every gesture shares a word with every candidate.

    Blocks of gestures meet blocks of candidates, whose postings are added up in
    whole millionths of a bit; of a block only the best quoted and the best other
    candidate leave it, as no other can win.
    """

    def blocks(rows: DataFrame, id_: str, name: str, *more: str) -> DataFrame:
        texts = rows.distinct().groupBy(id_, *more).agg(F.collect_list("word").alias("words"))
        n = max(1, math.ceil(rows.select(id_).distinct().count() / block))
        held = texts.groupBy(F.pmod(F.xxhash64(id_), F.lit(n)).alias("b")).agg(F.collect_list(F.struct(F.col(id_).alias("id"), *more, "words")).alias("v"))
        sizes, flat = F.transform("v.words", F.size), F.flatten("v.words")
        return held.select(F.col("v.id").alias(f"{name}_ids"), sizes.alias(f"{name}_sizes"), flat.getField("token").alias(f"{name}_words"), *([flat.getField("worth").alias("worth")] if more else []), *[F.col(f"v.{m}").alias(m) for m in more])

    found = "array<struct<id:long,target:long,bits:long,quoted:int>>"

    def best(ids: pd.Series, sizes: pd.Series, words: pd.Series, targets: pd.Series, lengths: pd.Series, theirs: pd.Series, worths: pd.Series, quoted: pd.Series) -> pd.Series:
        out = []
        for g_ids, g_sizes, g_words, t_ids, t_sizes, t_words, worth_of, q in zip(ids, sizes, words, targets, lengths, theirs, worths, quoted, strict=True):
            order = np.argsort(np.asarray(t_ids))  # of equal sums the smaller target comes first
            places = np.repeat(np.argsort(order), np.asarray(t_sizes))
            t_ids, q = np.asarray(t_ids)[order], np.asarray(q)[order]
            postings: dict = {}
            for place, w, worth in zip(places, t_words, worth_of, strict=True):
                postings.setdefault(w, (int(worth), []))[1].append(place)
            held = {w: (worth, np.asarray(at)) for w, (worth, at) in postings.items()}
            sides = [np.flatnonzero(q == side) for side in (0, 1)]
            row = []
            for g, own in zip(g_ids, np.split(np.asarray(g_words), np.cumsum(g_sizes)[:-1]), strict=True):
                sums, hit = np.zeros(len(t_ids), dtype="int64"), np.zeros(len(t_ids), dtype=bool)
                for w in own:
                    if w in held:
                        worth, at = held[w]
                        sums[at] += worth
                        hit[at] = True
                rounded = np.where(hit, (sums + 50) // 100, np.iinfo("int64").min)
                for side, places in enumerate(sides):
                    if len(places) and hit[top := places[np.argmax(rounded[places])]]:
                        row.append({"id": int(g), "target": int(t_ids[top]), "bits": int(rounded[top]), "quoted": side})
            out.append(row)
        return pd.Series(out)

    spark = gestures.sparkSession
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20)
    worth = weights.select("token", F.round(F.col("bits") * 1_000_000).cast("long").alias("worth"))
    shown = gestures.select(key, F.struct("token").alias("word"))
    held = candidates.join(worth, "token").select("target", "quoted", F.struct("token", "worth").alias("word"))
    pairs = blocks(shown, key, "g").crossJoin(blocks(held, "target", "t", "quoted"))
    tops = pairs.select(F.explode(F.pandas_udf(best, found)("g_ids", "g_sizes", "g_words", "t_ids", "t_sizes", "t_words", "worth", "quoted")).alias("s")).select("s.*")
    near = tops.withColumn("top", F.max("bits").over(Window.partitionBy("id"))).filter(F.col("top") - F.col("bits") <= round(tie * 10_000))
    order = Window.partitionBy("id").orderBy(F.desc("quoted"), F.desc("bits"), "target")
    chosen = near.withColumn("place", F.row_number().over(order)).filter("place = 1")
    return chosen.select(F.col("id").alias(key), "target", (F.col("bits") / 10_000).alias("bits"), "quoted")


def parallel_edges(pairs: DataFrame, bits: dict[str, float], least_chain: int = CHAIN, least_bits: float = BITS) -> DataFrame:
    """Pairs (a, b) of texts ``ta`` and ``tb`` whose best chain has enough words and bits."""
    ship(pairs.sparkSession)
    scored = pairs.withColumn("c", kernels.chain_udf(bits)("ta", "tb"))
    return scored.filter((F.col("c.length") >= least_chain) & (F.col("c.bits") >= least_bits)).select("a", "b", F.col("c.length").alias("chain"), F.round("c.bits", 4).alias("bits"))


def profiles(witnesses: DataFrame, key: str) -> DataFrame:
    """Columns of the progressive alignment of each key's witnesses (key, source, t), sources in order."""
    ship(witnesses.sparkSession)
    schema = f"{key} {dict(witnesses.dtypes)[key]}, col int, forms map<string,double>, lemmas array<string>, is_insert boolean, members array<string>"

    def run(rows):
        import pandas as pd

        rows = rows.sort_values("source")
        made = kernels.merge_profile([(r.source, list(r.t)) for r in rows.itertuples()])
        first = rows[key].iloc[0]
        return pd.DataFrame([(first, k, c["forms"], c["lemmas"], c["insert"], c["members"]) for k, c in enumerate(made)], columns=[key, "col", "forms", "lemmas", "is_insert", "members"])

    return witnesses.groupBy(key).applyInPandas(run, schema)


def aligned_books(left: DataFrame, right: DataFrame, book: str = "book") -> DataFrame:
    """Verse by verse alignment of two editions' books (book, verse, t) by banded dynamic programming."""
    ship(left.sparkSession)

    def run(key, a, b):
        import pandas as pd

        a, b = a.sort_values("verse"), b.sort_values("verse")
        made = kernels.banded_alignment([set(x) for x in a["t"]], [set(x) for x in b["t"]])
        av, bv = a["verse"].tolist(), b["verse"].tolist()
        return pd.DataFrame([(key[0], None if i is None else av[i], None if j is None else bv[j], round(s, 6)) for i, j, s in made], columns=[book, "left", "right", "score"]).astype({"left": "Int64", "right": "Int64"})

    kind = dict(left.dtypes)[book]
    return left.groupBy(book).cogroup(right.groupBy(book)).applyInPandas(run, f"{book} {kind}, left long, right long, score double")


def resolve_passages(asked: DataFrame, held: DataFrame, editions: DataFrame) -> DataFrame:
    """Best edition of each passage in its own language: the first complete one by priority, else the best partial.

    ``asked`` has id, language and verse (one row per verse), ``held`` source and
    verse, ``editions`` source, language and priority.  status: ok, partial,
    no edition (of that language) or absent.
    """
    size = asked.groupBy("id", "language").agg(F.count("*").alias("verses"))
    fits = size.join(editions, "language", "left")
    found = asked.join(editions, "language").join(held, ["source", "verse"]).groupBy("id", "source").agg(F.count("*").alias("found"))
    joined = fits.join(found, ["id", "source"], "left").withColumn("found", F.coalesce("found", F.lit(0)))
    order = Window.partitionBy("id").orderBy(F.desc(F.col("found") == F.col("verses")), F.when(F.col("found") == F.col("verses"), F.col("priority")), F.desc("found"), "priority", "source")
    best = joined.withColumn("place", F.row_number().over(order)).filter("place = 1")
    status = F.when(F.col("source").isNull(), "no edition").when(F.col("found") == 0, "absent").when(F.col("found") < F.col("verses"), "partial").otherwise("ok")
    return best.select("id", F.when(F.col("found") > 0, F.col("source")).alias("source"), "verses", "found", status.alias("status"))


def quota_usage(used: DataFrame, quotas: DataFrame) -> DataFrame:
    """Per source: distinct verses, words and share of its text that was used, and which limits are passed.

    ``used`` has source, book, chapter, verse and words; ``quotas`` source, max_verses, max_share and total (verses).
    """
    once = used.dropDuplicates(["source", "book", "chapter", "verse"])
    spent = once.groupBy("source").agg(F.count("*").alias("verses"), F.sum("words").alias("words"))
    joined = spent.join(quotas, "source", "left").withColumn("share", F.round(F.col("verses") / F.col("total"), 6))
    return joined.select("source", "verses", "words", "share", F.coalesce(F.col("verses") > F.col("max_verses"), F.lit(False)).alias("over_verses"), F.coalesce(F.col("share") > F.col("max_share"), F.lit(False)).alias("over_share"))


def strictest(licences: DataFrame, key: str) -> DataFrame:
    """The licence of the highest rank per key; of equals the last id."""
    return licences.groupBy(key).agg(F.max_by("licence", F.struct("rank", "licence")).alias("licence"), F.max("rank").alias("rank"))


def alignment_grid(rows: DataFrame, sources: list[str], key: str = "pivot") -> DataFrame:
    """Pivot coordinate by edition, cells the sorted verses each edition has there."""
    return rows.groupBy(key).pivot("source", sources).agg(F.array_sort(F.collect_list("verse")))
