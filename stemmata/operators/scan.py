"""The scan pipeline: sweep, nominate, cluster, score, resolve, decorate.

Where the items make a small index, a task does all up to the scores for its own
documents and shuffles findings only; else retrieval and clustering are
relational.  Scoring looks at one candidate at a time; the greedy choice among
overlapping findings is one grouped stage per document.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stemmata.functions import kernels
from stemmata.operators import index, nominate, retrieve
from stemmata.session import ship

QUOTATION, COVERAGE, IDENTIFIED, TIE, LEAST_WORDS = 0.55, 0.90, 0.86, 0.06, 5
#: What an indirect finding needs: words and bits of its chain.
LEAST_CHAIN, LEAST_BITS = 4, 15
_FOUND = "doc_id long, item_id long, first int, after int, similarity double, coverage double, run int, chain int, bits double, grade string"
_ARROW = pa.schema([(c.split()[0], {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string()}[c.split()[1]]) for c in _FOUND.split(", ")])


def _scored(bits: dict, min_run: int):
    """Findings of candidate pairs, row by row; words are strings or numbers."""

    def one(r):
        words, item = list(r.words), list(r.item)
        there = set(item)
        if len(words) < LEAST_WORDS or sum(w in there for w in words) < 3:  # no span of these can be found
            return None
        span = kernels.matched_span(words, item)
        if span is None or span[1] - span[0] < LEAST_WORDS:
            return None
        own = words[span[0] : span[1]]
        agreed = [w for w in own if w in there]
        if len(agreed) < 3:  # too few words for any grade
            return None
        sizes = [b[2] for b in kernels.matching_blocks(own, item)]
        similarity, covered, longest = 2.0 * sum(sizes) / (len(own) + len(item)), sum(sizes) / len(own), max(sizes, default=0)
        needed = max(min_run, min(6, len(own) // 2))
        if longest < min(3, needed) and (len(agreed) < LEAST_CHAIN or sum(max(0.0, bits.get(w, 0.0)) for w in agreed) < LEAST_BITS - 1e-6):
            return None  # indirect, and no chain of these words is long or rare enough to stand
        length, worth, _, _ = kernels.chain([frozenset([w]) for w in own], [frozenset([w]) for w in item], bits)
        exact = (similarity >= QUOTATION or covered >= COVERAGE) and longest >= needed
        grade = "direct" if exact else "partial" if 3 <= longest < needed else "indirect"
        return r.doc_id, r.item_id, r.base + span[0], r.base + span[1], similarity, covered, longest, length, worth, grade

    def run(frames):
        for rows in frames:
            found = [made for made in map(one, rows.itertuples()) if made]
            yield pd.DataFrame(found, columns=[c.split()[0] for c in _FOUND.split(", ")])

    return run


def _resolved(rows):
    """The findings that no better one accounts for, with the items that came near as alternates.

    Findings are settled from the best down against the spans that stand by then:
    one of the same item accounts for any overlap, one of another item if it holds
    more than half of the shorter span.
    """
    rows = rows.sort_values(["similarity", "first", "item_id"], ascending=[False, True, True], ignore_index=True)
    first, after, item, near = (rows[c].to_numpy() for c in ("first", "after", "item_id", "similarity"))
    standing = np.zeros(len(rows), bool)
    rivals: dict[int, list[int]] = {}
    for k in range(len(rows)):
        held = np.flatnonzero(standing[:k])
        common = np.minimum(after[held], after[k]) - np.maximum(first[held], first[k])
        enough = np.where(item[held] == item[k], 0, np.minimum(after[held] - first[held], after[k] - first[k]) / 2)
        by = held[(common > 0) & (common > enough)]
        if not len(by):
            standing[k], rivals[k] = True, []
        elif item[k] != item[by[0]] and near[by[0]] - near[k] <= TIE:
            rivals[by[0]].append(int(item[k]))
    return rows[standing].assign(alternates=[list(dict.fromkeys(r)) for r in rivals.values()])


def _settled(frames):
    """:func:`_resolved` of each document, whose rows come together; most have one finding, which stands."""

    def settled(rows):
        alone = ~rows["doc_id"].duplicated(keep=False)
        if alone.any():
            yield rows[alone].assign(alternates=[[] for _ in range(int(alone.sum()))])
        for _, own in rows[~alone].groupby("doc_id", sort=False):
            yield _resolved(own)

    rest = None
    for rows in frames:
        rows = rows if rest is None else pd.concat([rest, rows], ignore_index=True)
        if len(rows):
            last = rows["doc_id"] == rows["doc_id"].iloc[-1]
            yield from settled(rows[~last])
            rest = rows[last]
    if rest is not None:
        yield from settled(rest)


def _within(docs: DataFrame, held: DataFrame, known: dict[str, int], bits: dict[str, float], min_run: int, common: float) -> DataFrame:
    """Scored candidates, found and scored where the documents are."""
    spark = docs.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20)
    rows = held.select("item_id", "t").orderBy("item_id").collect()
    shared = spark.sparkContext.broadcast(([r.item_id for r in rows], [list(r.t) for r in rows]))
    # needed runs have min_run words, or 2 and more in spans of LEAST_WORDS; a partial finding has 3
    run = min(3, max(min_run, min(6, LEAST_WORDS // 2)))

    def found(batches):
        made = nominate.Index(*shared.value, known, bits, common)
        for scored in _scored({k: bits[w] for k, w in enumerate(made.words)}, min_run)(nominate.candidates(made, batches, LEAST_WORDS, run, (LEAST_CHAIN, LEAST_BITS))):
            yield pa.RecordBatch.from_pandas(scored, schema=_ARROW, preserve_index=False)

    return docs.filter(F.col("doc_id").isNotNull() & (F.size("t") > 0)).select("doc_id", "t").mapInArrow(found, _FOUND)


def _joined(docs: DataFrame, held: DataFrame, df: DataFrame, bits: dict[str, float], total: int, mean: float, min_run: int, common: float) -> DataFrame:
    """Scored candidates by joins, for items of any number."""
    swept = retrieve.sweep(docs, "doc_id")
    terms = retrieve.query_terms(swept, df, total, ["doc_id", "offset"], retrieve.SWEEP_TERMS, common=common)
    found = retrieve.bm25(terms, index.postings(held, "item_id"), total, mean, ["doc_id", "offset"], "item_id", retrieve.SWEEP_CANDIDATES)
    chosen = retrieve.votes(found, "doc_id", "item_id").select("doc_id", "item_id")
    offsets = found.join(chosen, ["doc_id", "item_id"], "left_semi").select("doc_id", "item_id", "offset")
    runs = retrieve.clusters(offsets, ["doc_id", "item_id"])
    slack = runs.withColumn("base", F.greatest(F.lit(0), F.col("first") - retrieve.STRIDE)).withColumn("end", F.col("last") + retrieve.WINDOW + retrieve.STRIDE)
    texts = slack.join(docs.select("doc_id", "t"), "doc_id").select("doc_id", "item_id", "base", F.slice("t", F.col("base") + 1, F.col("end") - F.col("base")).alias("words"))
    both = texts.join(held.select("item_id", F.col("t").alias("item")), "item_id")
    return both.mapInPandas(_scored(bits, min_run), _FOUND)


def scan(docs: DataFrame, items: DataFrame, min_run: int = 3, common: float = 0.1) -> DataFrame:
    """Findings in each document: item, span of words, evidence, grade, alternates, and whether one item alone fits.

    ``docs`` has doc_id and tokens ``t``; ``items`` item_id and ``t``.  Frequencies of
    the items' words are collected, as their number is bounded by the items'.
    """
    ship(docs.sparkSession)
    held = items.filter(F.size("t") > 0)
    total, mean, different = held.agg(F.count("*"), F.avg(F.size("t")), F.count_distinct("item_id")).first()
    df = index.token_df(held, "item_id")
    known = {r.token: r.docs for r in df.collect()}
    bits = {w: math.log2(total / (n + 1)) for w, n in known.items()}
    if different == total and nominate.fits(total, round((mean or 0) * total), len(known), known, common):
        scored = _within(docs, held, known, bits, min_run, common)
    else:
        scored = _joined(docs, held, df, bits, total, mean, min_run, common)
    scored = scored.filter(f"grade <> 'indirect' or (chain >= {LEAST_CHAIN} and bits >= {LEAST_BITS})")
    return scored.repartition("doc_id").sortWithinPartitions("doc_id").mapInPandas(_settled, _FOUND + ", alternates array<long>").withColumn("identified", (F.col("similarity") >= IDENTIFIED) & (F.size("alternates") == 0))


def search(queries: DataFrame, items: DataFrame, limit: int = 5, common: float = 0.1) -> DataFrame:
    """Best items for each whole query text: BM25 candidates scored by ratio and coverage; ranks by coverage, similarity, id."""
    ship(queries.sparkSession)
    held = items.filter(F.size("t") > 0)
    total, mean = held.agg(F.count("*"), F.avg(F.size("t"))).first()
    terms = retrieve.query_terms(queries, index.token_df(held, "item_id"), total, ["doc_id"], common=common)
    found = retrieve.bm25(terms, index.postings(held, "item_id"), total, mean, ["doc_id"], "item_id", 12)
    asked = found.join(held.select("item_id", F.col("t").alias("item")), "item_id").groupBy("doc_id").agg(F.collect_list(F.struct("item_id", "item")).alias("items"))
    both = asked.join(queries.select("doc_id", "t"), "doc_id").select("doc_id", F.explode(kernels.scores_udf("t", "items")).alias("s"))
    scored = both.select("doc_id", "s.item_id", F.round("s.similarity", 4).alias("similarity"), F.round("s.coverage", 4).alias("coverage"))
    order = Window.partitionBy("doc_id").orderBy(F.desc("coverage"), F.desc("similarity"), "item_id")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)


def resolve_locally(matches: DataFrame, renderings: DataFrame, key: list[str], enough: float = IDENTIFIED, budget: int = 3) -> DataFrame:
    """First stored rendering, in order of ``priority``, that is decisive; else the best of the ``budget`` tried.

    ``renderings`` has key, source, priority and score.
    """
    order = Window.partitionBy(*key).orderBy("priority", "source")
    tried = matches.select(*key).join(renderings, key).withColumn("_place", F.row_number().over(order)).filter(F.col("_place") <= budget)
    first = F.min(F.when(F.col("score") >= enough, F.struct("_place", "source", "score"))).alias("_first")
    best = F.max(F.struct("score", (-F.col("_place")).alias("p"), "source")).alias("_best")
    chosen = F.coalesce("_first.source", "_best.source").alias("source"), F.coalesce("_first.score", "_best.score").alias("score")
    charged = F.coalesce("_first._place", F.lit(budget)).alias("charged")
    return tried.groupBy(*key).agg(first, best).select(*key, *chosen, F.col("_first").isNotNull().alias("decisive"), charged)
