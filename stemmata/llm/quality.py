"""Quality classifier by Bradley-Terry pairwise ranking.

A document's strength is linear in features of its whole text: shares of hashed
byte pairs, logarithms of the shares of byte values, and word statistics.
Weights are learnt from preference pairs (a document of label 1 against one of
label 0) by the logistic loss on the difference of their features.  The
threshold is the quantile of the labelled strengths at the labels' own share of
0; scores are a logistic function of the strength that is 0.7 there.

All labelled documents that are not held out are learnt from; of rows that share
an id, the one whose text hashes lowest.  They are dealt by hash into blocks of
about ``BLOCK``; executors make a block's features and weights, and the model is
the mean of the blocks' weights, each counted by its documents.  Where a label is
rare its documents stand in several blocks, so that every block has pairs.
Threshold and slope are exact over the strengths of all labelled documents, each counted once.

Defined cases: null and empty texts are scored by the features of an empty text;
labels that are null, or contradict each other for one id, are not learnt from;
without documents of both labels every score is 0.7 and a trifle, so nothing is rejected;
a text of any length is read whole, in time linear in its length; every input row
gives one row, repeated ids included; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import starmap
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stemmata.llm.shared import delete, lean, small_batches, written

PAIRS, BLOCK, OPPONENTS = 1024, 3072, 256
#: So many labelled ids are broadcast; more are joined by shuffle.
BROADCAST_LABELS = 1_000_000
CUT = 0.7
_STATS = 8
_SLOPES = np.geomspace(0.05, 20, 60)
_BINS = 4096
_FLOOR = 1e-4


def _pair_codes(data: np.ndarray) -> np.ndarray:
    """Hash of every two neighbouring bytes into ``PAIRS`` buckets."""
    code = data[:-1].astype(np.uint32) * np.uint32(256) + data[1:]
    return (code * np.uint32(2654435761)) >> np.uint32(22)


def features(text: bytes) -> np.ndarray:
    """The features of one text, all finite."""
    out = np.zeros(PAIRS + 256 + _STATS, np.float32)
    data = np.frombuffer(text, np.uint8)
    n = len(data)
    if n > 1:
        out[:PAIRS] = np.bincount(_pair_codes(data), minlength=PAIRS) * (10.0 / (n - 1))
    if n:
        out[PAIRS : PAIRS + 256] = np.log(np.bincount(data, minlength=256) / n + _FLOOR) - math.log(_FLOOR)
    words, lines = text.split(), [x for x in text.split(b"\n") if x]
    if words:
        k = len(words)
        same = sum(starmap(eq, zip(words, words[1:], strict=False)))
        upper = int(((data >= 65) & (data <= 90)).sum())
        letters = int(((data | 32) >= 97).sum())
        repeats = 1 - len(set(lines)) / max(1, len(lines))
        out[PAIRS + 256 :] = (
            math.log1p(k) / 5,
            n / k / 10,
            10 * same / k,
            math.log(same / k + 1e-3) / 2,
            math.log(1 - len(set(words)) / k + 1e-2) / 2,
            upper / max(1, letters) * 5,
            repeats * 3,
            math.log1p(k / max(1, len(lines))) / 3,
        )
    return out


@dataclass
class Model:
    """Weights of the features, the strength at the threshold, and the slope of the score around it."""

    weights: np.ndarray
    threshold: float
    slope: float

    def scores(self, strengths: np.ndarray) -> np.ndarray:
        z = self.slope * (strengths - self.threshold) + math.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))

    def __call__(self, text: bytes) -> float:
        return float(self.scores(np.float64(features(text) @ self.weights)))


def _draws(random: np.random.Generator, rows: int, needed: int) -> np.ndarray:
    """``needed`` rows in random order, none a second time before all were drawn."""
    return np.concatenate([random.permutation(rows) for _ in range(-(-needed // rows))])[:needed]


def fit_pairs(good: np.ndarray, bad: np.ndarray, rounds: int = 400, batch: int = 512, rate: float = 0.01, decay: float = 1e-4) -> np.ndarray:
    """Weights that rank rows of ``good`` over rows of ``bad``: Adam on the Bradley-Terry loss of random pairs.

    There are more rounds where a side has more rows than the pairs of ``rounds``, so that each row is in a pair.
    """
    random = np.random.default_rng(11)
    rounds = max(rounds, -(-max(len(good), len(bad)) // batch))
    ours, theirs = (_draws(random, len(side), rounds * batch).reshape(rounds, batch) for side in (good, bad))
    w, m, v = (np.zeros(good.shape[1]) for _ in range(3))
    for step in range(1, rounds + 1):
        gap = good[ours[step - 1]] - bad[theirs[step - 1]]
        lost = 1 / (1 + np.exp(np.clip(gap @ w.astype(gap.dtype), -40, 40)))
        slope = -(lost @ gap) / batch + decay * w
        m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope**2
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w


def held_out(doc_id: Column) -> Column:
    """True for the quarter of ids that is never learnt from; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _block_weights(label: list[int], rows: list[np.ndarray]) -> np.ndarray | None:
    """Weights of one block in the features' own units; None without both labels."""
    marks, made = np.array(label), np.array(rows, np.float32)
    rows.clear()
    if marks.min() == marks.max():
        return None
    mean, square = (sum(part(x).sum(axis=0) for x in np.array_split(made, -(-len(made) // 128))) / len(made) for part in (np.float64, lambda x: np.float64(x) ** 2))
    spread = np.sqrt(np.maximum(square - mean**2, 0)) + 0.05
    made /= spread.astype(np.float32)
    return fit_pairs(made[marks == 1], made[marks == 0]) / spread


def _learnt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """block, number of its own documents and weights of each block; rows come sorted by block."""

    def closed():
        w = _block_weights(labels, rows)
        return pa.record_batch({"block": pa.array([block], pa.int32()), "n": pa.array([n], pa.int64()), "w": pa.array([None if w is None else w.tobytes()], pa.binary())})

    block, n, labels, rows = None, 0, [], []
    for batch in batches:
        for b, own, label, text in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            if b != block and rows:
                yield closed()
                n, labels, rows = 0, [], []
            block = b
            n += own
            labels.append(label)
            rows.append(features(text))
    if rows:
        yield closed()


def _labelled(docs: DataFrame, labels: DataFrame, most: int | None) -> tuple[DataFrame, int] | None:
    """block, own, label and text of the labelled documents that are not held out, and the number of blocks; None without both labels.

    ``own`` is false for the copies that a rare label's documents have in other blocks.
    """
    known = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label"))
        .filter(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("other")).filter("label = other").select("doc_id", "label")
    )
    if most is not None:
        parts = [known.filter(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for label in (0, 1)]
        known = parts[0].union(parts[1])
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    # labels without a document would make blocks of one label
    known = known.join(texts.select("doc_id"), "doc_id", "left_semi")
    counts = dict(known.groupBy("label").count().collect())
    if len(counts) < 2:
        return None
    total = sum(counts.values())
    blocks = -(-total // BLOCK)
    copies = F.when(F.col("label") == 0, min(blocks, -(-OPPONENTS * blocks // counts[0]))).otherwise(min(blocks, -(-OPPONENTS * blocks // counts[1])))
    dealt = known.select("doc_id", "label", F.explode(F.sequence(F.lit(0), copies - 1)).alias("copy"))
    dealt = dealt.select("doc_id", "label", (F.col("copy") == 0).alias("own"), F.pmod(F.xxhash64("doc_id") + F.col("copy"), F.lit(blocks)).cast("int").alias("block"))
    placed = texts.join(F.broadcast(dealt) if total <= BROADCAST_LABELS else dealt, "doc_id")
    single = placed.groupBy("block", "doc_id", "own", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    return single.select("block", "own", "label", "text"), blocks


def fit(docs: DataFrame, labels: DataFrame, most: int | None = None) -> Model:
    """Learn from all labelled documents that are not held out, or from at most ``most`` of each label where that is given."""
    small_batches(docs.sparkSession)
    none = Model(np.zeros(PAIRS + 256 + _STATS, np.float32), -1e-6, 1.0)
    placed = _labelled(docs, labels, most)
    if placed is None:
        return none
    held, folder = written(placed[0])
    try:
        whole = held.repartition(placed[1], "block").sortWithinPartitions("block")
        found = sorted(whole.mapInArrow(lean("quality", _learnt), "block int, n long, w binary").filter("w is not null").collect())
        if not found:
            return none
        w = np.average([np.frombuffer(r.w, np.float64) for r in found], axis=0, weights=[max(1, r.n) for r in found])

        def strengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                made = [float(features(t) @ w) for t in batch.column(1).to_pylist()]
                yield pa.record_batch({"label": batch.column(0), "s": pa.array(made, pa.float64())})

        scored, kept = written(held.filter("own").select("label", "text").mapInArrow(lean("quality", strengths), "label int, s double"))
        try:
            return calibrate(scored, w)
        finally:
            delete(docs.sparkSession, kept)
    finally:
        delete(docs.sparkSession, folder)


def neighbours(values: DataFrame, place: int) -> tuple[float, float]:
    """The values at ``place`` (from 0) and at the next place, or the last one twice, of a table's one column of finite doubles in order.

    Only counts of bins leave the executors; the bin that holds both places is binned again.
    """
    name = values.columns[0]
    low, high, total = values.agg(F.min(name), F.max(name), F.count("*")).first()
    if place + 1 >= total:
        return high, high
    while low < high:
        share = F.floor((F.col(name) - low) / (high - low) * _BINS)
        bins = values.filter(F.col(name).between(low, high)).groupBy(F.least(share, F.lit(_BINS - 1)).alias("bin"))
        rows = sorted(bins.agg(F.count("*").alias("n"), F.min(name).alias("low"), F.max(name).alias("high")).collect())
        k = 0
        while place >= rows[k].n:
            place -= rows[k].n
            k += 1
        if place + 1 == rows[k].n:
            return rows[k].high, rows[k + 1].low
        low, high = rows[k].low, rows[k].high
    return low, low


def calibrate(scored: DataFrame, w: np.ndarray) -> Model:
    """Threshold at the strengths' (label, s) quantile that is the share of label 0, and the slope that fits the labels best."""
    below = scored.filter("label = 0").count()
    threshold = sum(neighbours(scored.select("s"), max(0, below - 1))) / 2

    def losses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(len(_SLOPES))
        for batch in batches:
            truth, s = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for k, slope in enumerate(_SLOPES):
                p = np.clip(Model(w, threshold, slope).scores(s), 1e-9, 1 - 1e-9)
                sums[k] -= np.log(np.where(truth == 1, p, 1 - p)).sum()
        yield pa.record_batch({"sums": pa.array([sums.tobytes()], pa.binary())})

    rows = scored.select("label", "s").mapInArrow(losses, "sums binary").collect()
    slope = float(_SLOPES[np.argmin(sum(np.frombuffer(r.sums, np.float64) for r in rows))])
    return Model(w.astype(np.float32), threshold, slope)


def score(model: Model, text: Column) -> Column:
    """Score of a text column, from 0 to 1."""

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series([model(bytes(t)) for t in texts], dtype="float64")

    return scored(F.coalesce(text, F.lit("")).cast("binary"))
