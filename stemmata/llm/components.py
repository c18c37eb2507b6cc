"""Connected components of a graph in a DataFrame, by alternating star contraction.

Large-star links every larger neighbour of a node to the node's smallest
neighbour, small-star every smaller one; the rounds end when they change
nothing.  Minima are aggregated on the map side and joined back, so a node with
very many neighbours is never gathered, and each round's edges are written to
the shared folder.

At most ``LOCAL_EDGES`` edges are contracted by the driver: rounds of a dozen
shuffles for a few thousand edges cost more tasks, and more lines in Spark's event
log, than everything else around them.  Both ways give the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemmata.llm.shared import cut, own_shuffles

#: Edges (two ids each) that are brought to the driver at most.
LOCAL_EDGES = 200_000


def components(edges: DataFrame) -> DataFrame:
    """node and root (the smallest node that can be reached) for every node of ``edges`` (a, b); loops are ignored."""
    low, high = F.least("a", "b"), F.greatest("a", "b")
    held = cut(edges.filter("a <> b").select(high.alias("b"), low.alias("a")).distinct())
    mark = _mark(held)
    if 0 < mark[0] <= LOCAL_EDGES:
        kind = held.schema["a"].dataType.simpleString()
        return edges.sparkSession.createDataFrame(_contracted(held.select("b", "a").collect()), f"node {kind}, root {kind}")
    while mark[0]:
        both = held.select(F.col("a").alias("u"), F.col("b").alias("v")).union(held.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("b"), F.col("m").alias("a")).distinct()
        down = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(down, "b").select(F.when(F.col("a") == F.col("m"), F.col("b")).otherwise(F.col("a")).alias("b"), F.col("m").alias("a"))
        held = cut(small.filter("a <> b").distinct())
        if (now := _mark(held)) == mark:
            break
        mark = now
    roots = held.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct()
    return held.select(F.col("b").alias("node"), F.col("a").alias("root")).union(roots)


def _contracted(edges: list) -> list[tuple]:
    """Every node of some edges with the smallest node that can be reached."""
    above: dict = {}

    def top(x):
        while (y := above.setdefault(x, x)) != x:
            above[x] = above[y]
            x = y
        return x

    for b, a in edges:
        x, y = top(a), top(b)
        above[max(x, y)] = min(x, y)
    return [(x, top(x)) for x in list(above)]


def _mark(edges: DataFrame) -> tuple:
    """Changes whenever the set of edges does, but for a chance of about 2 ** -64."""
    with own_shuffles(edges.sparkSession):
        return tuple(edges.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0))).first())
