"""Exact top-k inner products with a pivot-distance index.

Every vector x gets one more component, the root of M - |x|^2 where M is the
largest square norm; a query gets 0 there.  Then |q - x|^2 = |q|^2 + M - 2 q.x, so
the highest inner products are the nearest neighbours, and distances obey the
triangle inequality.  Vectors are keyed by their nearest pivot and their distance
from it, and sorted by that key, so that a run of rows is an annulus around a
pivot.  A query visits the annuli of a block outwards from its own distance to
their pivot: no x of an annulus from ``lo`` to ``hi`` can be nearer to q than
lo - d(q, p) or d(q, p) - hi.  It stops at the first annulus whose bound lies beyond the
distance of its k-th best so far.  First k-th scores come from the pivots, which
are rows of the table themselves.

Pivots are a bounded sample: ``pivots`` rows by a hash.  All rows are indexed, so
results are exact.  Queries are a stated set; they meet the index in slices of at
most ``slice_rows``, one after the other, and rows in blocks of ``PART_ROWS``, so
neither side is held whole.

Defined cases: vectors that are null, empty or hold a null, and rows without an
id, take no part; a vector that is shorter than another counts as filled with
zeros, whatever the lengths; rows that share an id are candidates each by itself,
and queries each by itself (a row is left out of its own ranks only); fewer than k
candidates give as many ranks; equal scores rank by id; scores are exact, and one
beyond 64 bits is an error; an empty table or a table without queries gives no
rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stemmata.llm.shared import cut, small_batches

PIVOTS, SLICE_ROWS, PART_ROWS = 128, 8192, 8192
#: Rows of an annulus.
ANNULUS = 256
_RESULT = "query_row bigint, query_id bigint, vec_id bigint, score bigint"


def by_length(column) -> list[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and integer rows of a column of lists, for each length."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    firsts, values = flat.offsets.to_numpy(), flat.values.to_numpy(zero_copy_only=False)
    sizes = np.diff(firsts)
    return [(own, values[firsts[own][:, None] + np.arange(n)]) for n in np.unique(sizes) for own in [np.flatnonzero(sizes == n)]]


def _lists(vectors: list[list[int]]) -> list[tuple[np.ndarray, np.ndarray]]:
    return by_length(pa.array(vectors, pa.list_(pa.int64())))


def squares(groups, n: int) -> np.ndarray:
    """Square norms of ``n`` rows."""
    out = np.zeros(n)
    for own, rows in groups:
        out[own] = (rows.astype(np.float64) ** 2).sum(axis=1)
    return out


def products(left, right, shape: tuple[int, int]) -> np.ndarray:
    """Inner products in floating point, for bounds."""
    out = np.zeros(shape)
    for i, x in left:
        for j, y in right:
            n = min(x.shape[1], y.shape[1])
            out[np.ix_(i, j)] = x[:, :n].astype(np.float64) @ y[:, :n].T.astype(np.float64)
    return out


def exact(x: np.ndarray, y: np.ndarray, largest: float) -> np.ndarray:
    """Integer inner products of rows; ``largest`` bounds their absolute value."""
    n = min(x.shape[1], y.shape[1])
    x, y = x[:, :n], y[:, :n]
    if largest < 2.0**52:
        return np.rint(x.astype(np.float64) @ y.T.astype(np.float64)).astype(np.int64)
    if largest < 2.0**62:
        return x @ y.T
    whole = x.astype(object) @ y.T.astype(object)
    if whole.size and max(abs(whole.max()), abs(whole.min())) >= 1 << 63:
        raise OverflowError("an inner product is beyond 64 bits")
    return whole.astype(np.int64)


def _distances(dots: np.ndarray, left: np.ndarray, right: np.ndarray, top: float) -> np.ndarray:
    """Distances of vectors with their added component, from inner products and square norms."""
    gap = np.sqrt(np.maximum(0, top - left))[:, None] - np.sqrt(np.maximum(0, top - right))[None, :]
    return np.sqrt(np.maximum(0, left[:, None] + right[None, :] - 2 * dots + gap**2))


def _nearest(held: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top, _, vectors = held.value
        pivots = _lists(vectors)
        own = squares(pivots, len(vectors))
        for batch in batches:
            n, rows = batch.num_rows, by_length(batch.column(2))
            norms = squares(rows, n)
            distance = _distances(products(rows, pivots, (n, len(vectors))), norms, own, top)
            at = distance.argmin(axis=1) if n else np.empty(0, np.int64)
            kept = [*batch.columns, pa.array(at, pa.int32()), pa.array(distance[np.arange(n), at], pa.float64())]
            yield pa.record_batch(kept, names=["row", "vec_id", "z", "pivot", "distance"])

    return run


class Best:
    """The k best (score, smaller id first) of each query so far."""

    def __init__(self, rows: np.ndarray, vectors: list[list[int]], k: int):
        self.rows, self.k, n = rows, k, len(rows)
        self.groups = _lists(vectors)
        self.group_of, self.place = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for g, (own, _) in enumerate(self.groups):
            self.group_of[own], self.place[own] = g, np.arange(len(own))
        self.norms = squares(self.groups, n)
        self.scores, self.ids, self.held = np.zeros((n, k), np.int64), np.zeros((n, k), np.int64), np.zeros(n, np.int64)
        self.least = np.full(n, np.iinfo(np.int64).min)  # a score that a new candidate must reach
        self.scored = 0

    def offer(self, own: np.ndarray, rows: np.ndarray, ids: np.ndarray, z: np.ndarray, square: float) -> None:
        """Score candidates of one length for the queries ``own``; ``square`` is their largest square norm."""
        for g in np.unique(self.group_of[own]):
            mine = own[self.group_of[own] == g]
            queries = self.groups[g][1][self.place[mine]]
            score = exact(queries, z, float(np.sqrt(self.norms[mine].max() * square)))
            self.scored += score.size
            i, j = np.nonzero((score >= self.least[mine][:, None]) & (rows[None, :] != self.rows[mine][:, None]))
            if len(i):
                self._take(mine[i], score[i, j], ids[j])

    def _take(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        known = np.unique(query)
        i, j = np.nonzero(np.arange(self.k)[None, :] < self.held[known][:, None])
        query = np.concatenate([query, known[i]])
        score, ids = np.concatenate([score, self.scores[known[i], j]]), np.concatenate([ids, self.ids[known[i], j]])
        order = np.lexsort((ids, -score, query))
        query, score, ids = query[order], score[order], ids[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        keep = rank < self.k
        query, rank = query[keep], rank[keep]
        self.scores[query, rank], self.ids[query, rank] = score[keep], ids[keep]
        np.maximum.at(self.held, query, rank + 1)
        full = known[self.held[known] == self.k]
        self.least[full] = np.maximum(self.least[full], self.scores[full, -1])

    def reach(self, top: float) -> np.ndarray:
        """Distances beyond which no candidate can be among the k best."""
        known = self.least > np.iinfo(np.int64).min
        square = self.norms + top - 2 * np.where(known, self.least, 0).astype(np.float64)
        slack = 1e-9 * (self.norms + top + 2 * np.abs(self.least.astype(np.float64))) + 1e-6
        return np.where(known, np.sqrt(np.maximum(0, square + slack)), np.inf)


def annuli(pivot: np.ndarray, groups) -> list[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and integer rows of runs of at most ``ANNULUS`` rows of one pivot and length, in the order of their distance."""
    out = []
    for own, z in groups:
        edges = np.flatnonzero(np.diff(pivot[own], prepend=-1, append=-1))
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            out += [(own[i : min(b, i + ANNULUS)], z[i : min(b, i + ANNULUS)]) for i in range(a, b, ANNULUS)]
    return out


def search(best: Best, to_pivot: np.ndarray, top: float, block: pa.Table) -> None:
    """Offer a block of index rows to all queries, each outwards from its own distance and only as far as it reaches."""
    rows, ids, pivot, distance = (block[c].to_numpy() for c in ("row", "vec_id", "pivot", "distance"))
    rings = annuli(pivot, by_length(block["z"]))
    norms = [float((z.astype(np.float64) ** 2).sum(axis=1).max()) for _, z in rings]
    near = np.array([distance[own].min() for own, _ in rings])[:, None]
    far = np.array([distance[own].max() for own, _ in rings])[:, None]
    from_pivot = to_pivot[:, [pivot[own[0]] for own, _ in rings]].T
    bound = np.maximum(0, np.maximum(near - from_pivot, from_pivot - far)) * (1 - 1e-9) - 1e-6
    outwards = np.argsort(bound, axis=0, kind="stable")
    alive = np.arange(len(best.rows))
    for step in range(len(rings)):
        ring = outwards[step, alive]
        going = bound[ring, alive] <= best.reach(top)[alive]
        alive, ring = alive[going], ring[going]
        if not len(alive):
            break
        for r in np.unique(ring).tolist():
            own, z = rings[r]
            best.offer(alive[ring == r], rows[own], ids[own], z, norms[r])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches joined to blocks of about ``PART_ROWS`` rows."""
    held, n = [], 0
    for batch in batches:
        if batch.num_rows:
            held, n = [*held, batch], n + batch.num_rows
        if n >= PART_ROWS:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held)


def seeded(queries, pivots, k: int, top: float) -> tuple[Best, np.ndarray]:
    """Nothing found yet, but the k-th scores that the pivots give; and the queries' distances to the pivots."""
    (rows, _, vectors), (seed_rows, seed_vectors, pivot_vectors) = queries, pivots
    first, best = Best(rows, vectors, k), Best(rows, vectors, k)
    groups = _lists(seed_vectors)
    norms = squares(groups, len(seed_vectors))
    for own, z in groups:
        first.offer(np.arange(len(rows)), seed_rows[own], np.zeros(len(own), np.int64), z, float(norms[own].max()))
    full = first.held == k
    best.least[full] = first.scores[full, -1]
    dots = products(best.groups, _lists(pivot_vectors), (len(rows), len(pivot_vectors)))
    # a query's added component is 0, and a pivot's square norm with its own is ``top``
    return best, np.sqrt(np.maximum(0, best.norms[:, None] + top - 2 * dots))


def _search(held: Broadcast, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top, queries, pivots = held.value
        best, to_pivot = seeded(queries, pivots, k, top)
        for block in _blocks(batches):
            search(best, to_pivot, top, block)
        q, j = np.nonzero(np.arange(k)[None, :] < best.held[:, None])
        columns = queries[0][q], queries[1][q], best.ids[q, j], best.scores[q, j]
        yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], names=["query_row", "query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, is_query, k: int = 20, pivots: int = PIVOTS, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """query_id, rank (from 1), vec_id and score; ``vectors`` has vec_id and z (integers), ``is_query`` is a condition on vec_id."""
    spark = vectors.sparkSession
    small_batches(spark)
    context = spark.sparkContext
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("z").cast("array<bigint>").alias("z"))
    rows = rows.filter(F.col("vec_id").isNotNull() & (F.size("z") > 0) & ~F.exists("z", lambda x: x.isNull()))
    rows = rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", "z")
    square = F.aggregate("z", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    n, top = rows.agg(F.count("*"), F.max(square)).first()
    nothing = spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    if not n:
        return nothing
    top *= 1 + 1e-9
    sample = rows.orderBy(F.xxhash64("vec_id", "z"), "vec_id").limit(pivots).select("vec_id", "z").collect()
    held = context.broadcast((top, None, [list(r.z) for r in sample]))
    keyed = rows.mapInArrow(_nearest(held), "row bigint, vec_id bigint, z array<bigint>, pivot int, distance double")
    parts = max(1, -(-n // PART_ROWS))
    ranged = keyed.repartitionByRange(parts, "pivot", "distance", "vec_id", "row").sortWithinPartitions("pivot", F.size("z"), "distance", "vec_id", "row")
    index = cut(ranged)
    held.unpersist()
    picked = index.join(F.broadcast(spark.createDataFrame([(r.vec_id, list(r.z)) for r in sample], "vec_id bigint, z array<bigint>").distinct()), ["vec_id", "z"], "left_semi").select("row", "z")
    own_pivots = picked.limit(pivots).collect()
    seeds = (np.array([r.row for r in own_pivots], np.int64), [list(r.z) for r in own_pivots], [list(r.z) for r in sample])
    asked = index.filter(is_query).select("row", "vec_id", "z")
    slices = max(1, -(-asked.count() // slice_rows))
    found = None
    for s in range(slices):
        own = asked.filter(F.pmod(F.xxhash64("row"), F.lit(slices)) == s).collect()
        if own:
            queries = (np.array([r.row for r in own], np.int64), np.array([r.vec_id for r in own], np.int64), [list(r.z) for r in own])
            block = context.broadcast((top, queries, seeds))
            part = cut(index.mapInArrow(_search(block, k), _RESULT))
            block.destroy()
            found = part if found is None else found.union(part)
    if found is None:
        return nothing
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
