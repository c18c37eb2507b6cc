"""MinHash near-duplicates by a signature-coordinate inverted join.

Every document becomes the set of its word shingles; equal sets are one class.
A class posts itself under each (coordinate, value) pair of its signature.
Pairs that only one class holds are dropped at once.  A class keeps its rarest
posted pairs, as many as a partner needs to meet it in one of them if they agree
in ``least`` coordinates (prefix), and postings whose classes are already in one
component are skipped, so that large groups of copies cost no pairs:

1. every posting nominates a centre, the member whose posted pairs are held by
   most others, which in a group of near copies is the text they come from; each
   member is compared with its centres, and links found are contracted to
   components;
2. the members of postings that still hold several components are gathered by
   centre, so that a class comes once and not for every posting it shares, and
   compared in blocks: first the signatures, then longer ones of ``SECOND``
   coordinates made for these members only.  Members without a candidate partner
   go; for the others the texts are brought in, candidates are confirmed from
   the most similar down, and those whose members are joined by then are
   skipped, so a block gives fewer links than it has members.

Every link is confirmed on both full shingle sets.

With 48 coordinates and 30 needed, a pair at similarity 0.85 is missed with
probability 3e-5, one at 0.8 needs ``least`` 26 for the like; the longer
signatures' bound is set 4.6 standard deviations below the mean.

Defined cases: null or empty texts have no shingles, are linked with nothing and
are kept; a text of any length is read whole; rows that share a doc_id count as one node, whatever their texts;
rows with a null doc_id take part through equal sets only and are kept where
their component has no id; every input row gives one row; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stemmata.llm.components import components
from stemmata.llm.hashing import batches_of, shingle_sets
from stemmata.llm.shared import SPACED, cut, lean, small_batches

#: Rows of ids that are broadcast at most; beyond that the join shuffles.
BROADCAST_IDS = 300_000
#: Members of a centre that are compared in one task at most, with as many others.
BLOCK = 1024
#: Coordinates of the longer signatures, of 16 bits each.
SECOND = 256
_TEXT_BYTES = 1 << 20


def factors(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers and offsets of the coordinates' hash functions."""
    random = np.random.default_rng(7)
    return random.integers(1, 1 << 63, size, dtype=np.uint64) * np.uint64(2) + np.uint64(1), random.integers(1, 1 << 63, size, dtype=np.uint64)


def signatures(sets: list[np.ndarray], size: int) -> list[bytes | None]:
    """``size`` little-endian 32-bit minima per set; None for an empty one."""
    full = [s for s in sets if len(s)]
    if not full:
        return [None] * len(sets)
    every, starts = np.concatenate(full), np.cumsum([0, *(len(s) for s in full)])[:-1]
    out = np.empty((len(full), size), np.uint32)
    for i, (a, b) in enumerate(zip(*factors(size), strict=True)):
        out[:, i] = np.minimum.reduceat(((every * a + b) >> np.uint64(32)).astype(np.uint32), starts)
    rows = iter(out)
    return [next(rows).tobytes() if len(s) else None for s in sets]


def _describe(n: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.translate(SPACED) for t in batch.column(1).to_pylist()]
            counts, prints, signs = [], [], []
            for a, b in batches_of([len(t) for t in texts], _TEXT_BYTES):
                sets = shingle_sets(texts[a:b], n)
                counts += [len(s) for s in sets]
                prints += [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                signs += signatures(sets, size)
            yield pa.record_batch({"doc_id": batch.column(0), "n_shingles": pa.array(counts, pa.int64()), "print": pa.array(prints, pa.binary()), "sign": pa.array(signs, pa.binary())})

    return lean("minhash", run)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))


def _confirm(n: int, num: int, den: int):
    """Of rows (a, b, text_a, text_b) those whose sets have den * intersection >= num * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple = (None, None)
        for batch in batches:
            a, b, left, right = (batch.column(i).to_pylist() for i in range(4))
            keep = []
            for k in range(len(a)):
                if held[0] != right[k]:
                    held = (right[k], shingle_sets([right[k].translate(SPACED)], n)[0])
                own = shingle_sets([left[k].translate(SPACED)], n)[0]
                keep.append(_similar(own, held[1], num, den))
            mask = pa.array(keep, pa.bool_())
            yield pa.record_batch({"a": batch.column(0).filter(mask), "b": batch.column(1).filter(mask)})

    return run


def _linked(pairs: DataFrame, docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) of doc_ids that their full sets confirm."""
    pairs = cut(pairs)
    wanted = cut(pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct())
    ids = F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted
    texts = _texts(docs).join(ids, F.col("doc_id") == F.col("id"), "left_semi")
    left = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    both = left.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    small_batches(docs.sparkSession)
    return both.select("a", "b", "text_a", "text_b").mapInArrow(_confirm(n, num, den), "a bigint, b bigint")


def _longer(n: int):
    """doc_id and longer signature of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.translate(SPACED) for t in batch.column(1).to_pylist()]
            signs = []
            for a, b in batches_of([len(t) for t in texts], _TEXT_BYTES):
                made = signatures(shingle_sets(texts[a:b], n), SECOND)
                signs += [x and np.frombuffer(x, np.uint32).astype(np.uint16).tobytes() for x in made]
            yield pa.record_batch({"id": batch.column(0), "longer": pa.array(signs, pa.binary())})

    return run


def _candidates(table: pa.Table, least: int, least_longer: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of a block pair's pairs of different components whose signatures agree in enough coordinates, the most similar first."""
    roots = table["root"].to_numpy()
    signs = np.frombuffer(b"".join(table["sign"].to_pylist()), np.uint32).reshape(len(roots), -1)
    longer = np.frombuffer(b"".join(table["longer"].to_pylist()), np.uint16).reshape(len(roots), -1)
    rows, columns = (np.flatnonzero(table[c].to_numpy(zero_copy_only=False)) for c in ("first", "second"))
    left, right, agree = [], [], []
    for start in range(0, len(rows), 64):
        own = rows[start : start + 64]
        same = (signs[own][:, None, :] == signs[columns][None, :, :]).sum(axis=2)
        i, j = np.nonzero((same >= least) & (roots[own][:, None] != roots[columns][None, :]))
        a, b = own[i], columns[j]
        for at in range(0, len(a), 4096):
            x, y = a[at : at + 4096], b[at : at + 4096]
            n = (longer[x] == longer[y]).sum(axis=1)
            left, right, agree = [*left, x[n >= least_longer]], [*right, y[n >= least_longer]], [*agree, n[n >= least_longer]]
    if not left:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    order = np.argsort(-np.concatenate(agree), kind="stable")
    return np.concatenate(left)[order], np.concatenate(right)[order]


def _paired(least: int, least_longer: int):
    """Members of a block pair of a centre that have any candidate partner there."""

    def run(key, table):
        x, y = _candidates(table, least, least_longer)
        ids = table["rep"].to_numpy()[np.union1d(x, y)]
        same = lambda k, t: pa.array([key[k].as_py()] * len(ids), t)
        return pa.table({"centre": same(0, pa.int64()), "lo": same(1, pa.int32()), "hi": same(2, pa.int32()), "rep": pa.array(ids, pa.int64())})

    return run


def _spanning(least: int, least_longer: int, n: int, num: int, den: int):
    """Links of a block pair that join different components; pairs that earlier links have joined are skipped."""

    def run(key, table):
        x, y = _candidates(table, least, least_longer)
        ids, roots, texts = table["rep"].to_pylist(), table["root"].to_pylist(), table["text"]
        above: dict[int, int] = {}

        def top(r: int) -> int:
            while r in above:
                r = above[r]
            return r

        made = lru_cache(512)(lambda k: shingle_sets([texts[k].as_py().translate(SPACED)], n)[0])
        found = []
        for a, b in zip(x.tolist(), y.tolist(), strict=True):
            if top(roots[a]) != top(roots[b]) and _similar(made(a), made(b), num, den):
                above[top(roots[a])] = top(roots[b])
                found.append((min(ids[a], ids[b]), max(ids[a], ids[b])))
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return run


def _similar(x: np.ndarray, y: np.ndarray, num: int, den: int) -> bool:
    """den * intersection >= num * union, and not empty; sizes alone may decide."""
    if den * min(len(x), len(y)) < num * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both > 0 and den * both >= num * (len(x) + len(y) - both)


def _coordinates(size: int) -> Column:
    """The (coordinate, value) pairs of a signature as longs."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(size - 1)),
        lambda i: F.shiftleft(i.cast("long"), 32) + F.conv(F.hex(F.substring(F.col("sign"), i * 4 + 1, F.lit(4))), 16, 10).cast("long"),
    )


def near_duplicates(docs: DataFrame, n: int = 5, num: int = 8, den: int = 10, size: int = 48, least: int = 26) -> DataFrame:
    """doc_id, n_shingles, component_id and kept per row of ``docs``.

    Two documents are linked when den * |A and B| >= num * |A or B| for their
    sets of ``n``-word shingles.  ``kept`` marks the smallest id of a component.
    """
    spark = docs.sparkSession
    small_batches(spark)
    described = cut(_texts(docs).mapInArrow(_describe(n, size), "doc_id bigint, n_shingles bigint, print binary, sign binary"))
    classes = described.filter("print is not null").groupBy("print").agg(F.min("doc_id").alias("rep"), F.first("sign").alias("sign"))
    classes = cut(classes)
    known = classes.filter("rep is not null")

    posted = known.select("rep", F.explode(_coordinates(size)).alias("pair"))
    # counts that are joined back are kept first, so that a popular pair or centre can be split over tasks
    shared = cut(posted.groupBy("pair").agg(F.count("*").alias("n")).filter("n > 1"))
    chosen = (
        posted.join(shared, "pair")
        .groupBy("rep")
        .agg(F.array_sort(F.collect_list(F.struct("n", "pair"))).alias("p"), F.sum("n").alias("score"))
        .filter(F.size("p") >= least)
        .select("rep", "score", F.slice("p", 1, F.size("p") - least + 1).alias("p"))
    )
    prefix = cut(chosen.select("rep", "score", F.explode(F.transform("p", lambda x: x["pair"])).alias("pair")))
    signs = known.select("rep", "sign")

    centres = cut(prefix.groupBy("pair").agg(F.max_by("rep", F.struct("score", (-F.col("rep")).alias("r"))).alias("centre"), F.count("*").alias("n")).filter("n > 1"))
    star = prefix.join(centres, "pair").filter("rep <> centre").select(F.least("rep", "centre").alias("a"), F.greatest("rep", "centre").alias("b")).distinct()
    links = cut(_linked(_agree(star, signs, size).filter(F.col("agree") >= least).select("a", "b"), docs, n, num, den))
    roots = cut(components(links).withColumnRenamed("node", "rep"))

    labelled = prefix.join(roots, "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    labelled = cut(labelled)
    mixed = labelled.groupBy("pair").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("n")).filter("lo <> hi and n > 2").select("pair")
    mixed = cut(mixed.join(centres.select("pair", "centre"), "pair"))
    # a class takes part once in each centre it shares, however many postings name that centre
    members = cut(labelled.join(mixed, "pair").select("centre", "rep", "root").distinct())
    members = members.join(cut(members.groupBy("centre").agg(F.count("*").alias("n"))), "centre")
    reps = cut(members.select(F.col("rep").alias("id")).distinct())
    wanted = F.broadcast(reps) if reps.count() <= BROADCAST_IDS else reps
    longer = _texts(docs).join(wanted, F.col("doc_id") == F.col("id"), "left_semi").mapInArrow(_longer(n), "id bigint, longer binary")
    longer = longer.filter("longer is not null").groupBy(F.col("id").alias("rep")).agg(F.first("longer").alias("longer"))
    one_sign = signs.groupBy("rep").agg(F.first("sign").alias("sign"))
    blocks = F.greatest(F.lit(1), F.ceil(F.col("n") / BLOCK)).cast("int")
    own = F.pmod(F.xxhash64("rep", "centre"), F.col("blocks")).cast("int")
    spread = members.withColumn("blocks", blocks).withColumn("own", own).join(one_sign.join(longer, "rep"), "rep")
    spread = spread.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "centre", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "rep", "root", "sign", "longer",
        (F.col("own") <= F.col("other")).alias("first"), (F.col("own") >= F.col("other")).alias("second"))
    share = num / den
    least_longer = int(SECOND * share - 4.6 * (SECOND * share * (1 - share)) ** 0.5)
    place = ["centre", "lo", "hi"]
    paired = cut(spread.groupBy(*place).applyInArrow(_paired(least, least_longer), "centre bigint, lo int, hi int, rep bigint"))
    reps = cut(paired.select(F.col("rep").alias("id")).distinct())
    wanted = F.broadcast(reps) if reps.count() <= BROADCAST_IDS else reps
    texts = _texts(docs).join(wanted, F.col("doc_id") == F.col("id"), "left_semi").select(F.col("doc_id").alias("rep"), "text").dropDuplicates(["rep"])
    blocks = spread.join(paired, [*place, "rep"]).join(texts, "rep")
    more_links = blocks.groupBy(*place).applyInArrow(_spanning(least, least_longer, n, num, den), "a bigint, b bigint")

    roots = components(links.union(cut(more_links))).withColumnRenamed("node", "rep")
    of_class = classes.select("print", "rep").join(roots, "rep", "left").select("print", F.coalesce("root", "rep").alias("component"))
    counted = described.select("doc_id", "n_shingles", "print")
    component = F.coalesce("component", F.when(F.col("n_shingles") == 0, F.col("doc_id")))
    joined = counted.join(of_class, "print", "left").withColumn("component_id", component)
    return joined.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"))


def _agree(pairs: DataFrame, signs: DataFrame, size: int) -> DataFrame:
    """The pairs (a, b) with the number of coordinates in which their signatures agree."""
    with_a = pairs.join(signs.select(F.col("rep").alias("a"), F.col("sign").alias("sign_a")), "a")
    with_b = with_a.join(signs.select(F.col("rep").alias("b"), F.col("sign").alias("sign_b")), "b")
    same = F.filter(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.substring("sign_a", i * 4 + 1, F.lit(4)) == F.substring("sign_b", i * 4 + 1, F.lit(4)))
    return with_b.select("a", "b", F.size(same).alias("agree"))


def one_per_group(docs: DataFrame, **parameters) -> DataFrame:
    """``docs`` with all their columns, without those that :func:`near_duplicates` does not keep.

    Of rows that repeat a kept doc_id one stays; rows with a null doc_id cannot be told apart and stay.
    """
    found = cut(near_duplicates(docs, **parameters).select("doc_id", "kept").filter("doc_id is not null"))
    for ids, single in ((found.filter("not kept").select("doc_id").distinct(), False), (found.filter("kept").groupBy("doc_id").count().filter("count > 1").select("doc_id"), True)):
        ids = cut(ids.select(F.col("doc_id").alias("_id")))
        n = ids.count()
        if n:
            ids = F.broadcast(ids) if n <= BROADCAST_IDS else ids
            here = docs["doc_id"].cast("long") == ids["_id"]
            rest = docs.join(ids, here, "left_anti")
            docs = rest.unionByName(docs.join(ids, here, "left_semi").dropDuplicates(["doc_id"])) if single else rest
    return docs
