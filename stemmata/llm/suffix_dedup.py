"""Removal of byte strings that repeat anywhere in a corpus, by maximal repeats.

A byte is removed when a string of ``least`` bytes that covers it also starts
anywhere else, in the same document or another.  Every such window is assigned
to the gram of ``GRAM`` bytes in it whose hash is smallest, which depends on the
window's bytes alone, so equal windows meet at equal grams:

1. each document posts its grams, about one in 70 bytes, with the stretch of
   windows that belong to each; grams that occur once are dropped, most of them
   where they are made, by a bitmap of one size at any scale;
2. equal stretches are one class with a count, combined on the map side, so
   that copies of passages are weighed and never gathered;
3. the classes of a gram go, as one example of each, to buckets of bounded size,
   in each of which an enhanced suffix array and the tree of its common-prefix
   intervals give the maximal repeats with all their occurrences
   (:mod:`stemmata.llm.suffix`).  A class that stands for several places is a
   leaf that repeats by itself; a gram with one class has a tree of that leaf alone;
4. a gram with more than ``MOST`` classes would not fit a task.  It is widened:
   of the bytes that a window has beside the gram, half stand to its left or to
   its right, so the windows fall into two wider grams, whose classes are made
   and sorted in the same way.  A gram as wide as a window has one class, so this ends;
5. what the groups cover in a class is brought back to every place of the class.

Equal texts are one class from the start: they go as a whole, and the marks are
brought back to the other texts only, so a group of copies is never gathered.

Defined cases: a null text is empty; texts of fewer than ``least`` bytes keep
all; rows with equal texts are separate occurrences, whatever their ids; texts
and stretches are told apart by 96 bits of hashes each; every input
row gives one row; a text of any length is posted in pieces; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stemmata.llm.hashing import batches_of, mix, prefix_sums, slices
from stemmata.llm.shared import cut, delete, lean, sieve, sifted, small_batches, written
from stemmata.llm.suffix import maximal_repeats

GRAM, MOST, BUCKET_BYTES = 64, 1024, 1 << 18
#: Keys of texts that are broadcast at most; beyond that texts are shuffled.
BROADCAST_IDS = 300_000
#: Places of the bitmap of repeated grams: 16 MB.
SIEVE_BITS = 1 << 27
KEY = ["key", "tag"]
#: Bytes of texts that are hashed together (numpy takes some 70 times as much meanwhile), and of an Arrow batch.
_CHUNK, _BATCH = 1 << 18, 2 << 20
_PLACE_BITS = np.uint64(28)
_CLASS = "gram bigint, whole int"
_SPANS = "array<int>"


def _smallest(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours."""
    k, out = 1, values
    while 2 * k <= width:
        out, k = np.minimum(out[:-k], out[k:]), 2 * k
    return np.minimum(out[: len(values) - width + 1], out[width - k : len(values) - k + 1])


def stretches(texts: list[bytes], least: int) -> tuple[np.ndarray, ...]:
    """text number, start and length of each stretch of windows with one gram, and hashes of gram (64 bits) and stretch (32 bits).

    ``texts`` are taken together; one of more than 2 ** 28 bytes must be cut before.
    """
    data = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    firsts = np.cumsum(sizes) - sizes
    none = np.empty(0, np.int64)
    if len(data) < least:
        return none, none, none, none, none
    sums, mask = prefix_sums(data), (np.uint64(1) << _PLACE_BITS) - np.uint64(1)
    at = np.arange(len(data) - GRAM + 1)
    grams = slices(sums, at, at + GRAM)
    chosen = (_smallest((grams & ~mask) | at.astype(np.uint64), least - GRAM + 1) & mask).astype(np.int64)
    inside = np.zeros(len(chosen) + 1, bool)
    for a, n in zip(firsts.tolist(), sizes.tolist(), strict=True):
        if n >= least:
            inside[a : a + n - least + 1] = True
    inside = inside[:-1]
    change = np.flatnonzero(np.diff(np.where(inside, chosen, -1), prepend=-2, append=-2))
    lo, hi = change[:-1], change[1:]  # windows lo .. hi - 1 have one gram
    keep = inside[lo]
    lo, hi = lo[keep], hi[keep]
    # windows of neighbouring texts never share a stretch, as the last windows of a text lie outside
    after = hi - 1 + least
    own = np.searchsorted(firsts, lo, side="right") - 1
    gram = grams[chosen[lo]]
    whole = slices(sums, lo, after) ^ ((chosen[lo] - lo).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return own, lo - firsts[own], after - lo, gram.view(np.int64), (whole >> np.uint64(32)).astype(np.uint32).view(np.int32)


def text_key(text: Column) -> list[Column]:
    """The two columns that tell texts apart."""
    return [F.xxhash64(text).alias("key"), F.hash(text).alias("tag")]


def _post(least: int, often: Broadcast | None = None):
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
    names = ["gram", "whole", "key", "tag", "start", "size"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, tags, texts = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_pylist()
            # a text longer than a chunk is cut at fixed places, with an overlap of one window less a byte
            cuts = [(k, a, t[a : a + _CHUNK + least - 1]) for k, t in enumerate(texts) for a in range(0, max(1, len(t) - least + 1), _CHUNK) if len(t) >= least]
            for i, j in batches_of([len(t) for _, _, t in cuts], _CHUNK):
                own, start, size, gram, whole = stretches([t for _, _, t in cuts[i:j]], least)
                if often is not None and len(own):
                    own, start, size, gram, whole = (c[sifted(often.value, gram)] for c in (own, start, size, gram, whole))
                number, base = np.array([k for k, _, _ in cuts[i:j]]), np.array([a for _, a, _ in cuts[i:j]])
                columns = (gram, whole, keys[number[own]], tags[number[own]], start + base[own], size) if len(own) else ([],) * 6
                yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    return lean("suffix_dedup", run)


def _runs(covered: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Byte spans of the windows that are marked."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], covered, [False]]).astype(np.int8)))
    return [(a, b - 1 + least) for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)]


def _bucket(least: int):
    """What the maximal repeats among one bucket's classes cover in each class."""

    def run(key, table):
        texts, counts = table["bytes"].to_pylist(), table["n"].to_pylist()
        marked = [np.zeros(max(0, len(t) - least + 1), bool) for t in texts]
        for length, numbers, offsets in maximal_repeats(texts, least, counts):
            for k, a in zip(numbers.tolist(), offsets.tolist(), strict=True):
                marked[k][a : a + length - least + 1] = True
        found = [(k, runs) for k, m in enumerate(marked) if (runs := _runs(m, least))]
        rows = pa.array([k for k, _ in found], pa.int64())
        return pa.table({
            "gram": table["gram"].take(rows), "whole": table["whole"].take(rows),
            "starts": pa.array([[a for a, _ in r] for _, r in found], pa.list_(pa.int32())), "ends": pa.array([[b for _, b in r] for _, r in found], pa.list_(pa.int32()))})

    return run


def _groups(least: int):
    """The maximal repeats among one bucket's classes, a row for each place of each group."""

    def run(key, table):
        grams, wholes, counts = (table[c].to_numpy() for c in ("gram", "whole", "n"))
        out = []
        for number, (length, numbers, offsets) in enumerate(maximal_repeats(table["bytes"].to_pylist(), least, counts.tolist())):
            out += [(key[0].as_py(), number, length, int(grams[k]), int(wholes[k]), a, int(counts[k])) for k, a in zip(numbers.tolist(), offsets.tolist(), strict=True)]
        kinds = {"bucket": pa.int64(), "number": pa.int64(), "length": pa.int32(), "gram": pa.int64(), "whole": pa.int32(), "offset": pa.int32(), "n": pa.int64()}
        columns = list(zip(*out, strict=True)) or [()] * 7
        return pa.table({c: pa.array(x, t) for x, (c, t) in zip(columns, kinds.items(), strict=True)})

    return run


def _hash(data: bytes, salt: int) -> int:
    """64 bits of some bytes and a number."""
    sums = prefix_sums(np.frombuffer(data, np.uint8))
    value = slices(sums, np.array([0]), np.array([len(data)])) ^ (np.array([salt], np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return int(mix(value).view(np.int64)[0])


def core_of(text: bytes, gram: int, least: int) -> int:
    """Where the gram of a stretch stands that all its windows hold."""
    sums = prefix_sums(np.frombuffer(text, np.uint8))
    at = np.arange(len(text) - least, least - GRAM + 1)
    return int(at[slices(sums, at, at + GRAM).view(np.int64) == gram][0])


def widened(text: bytes, at: int, core: int, least: int) -> list[tuple[int, int, int, int]]:
    """(first byte, byte after, new place, new width) of a stretch's one or two parts with a wider gram.

    Every window holds ``core`` bytes from ``at`` and ``slack`` more.  Those with at least half
    of the slack to the left hold as many bytes there, the others hold the rest of it and one more to the right.
    """
    slack = least - core
    half = (slack + 1) // 2
    last = len(text) - least  # the first byte of the last window
    out = []
    if at >= half:
        out.append((0, min(last, at - half) + least, at - half, core + half))
    first = max(0, at - half + 1)
    if first <= min(last, at):
        out.append((first, len(text), at - first, core + slack - half + 1))
    return out


def _widen(least: int):
    """The parts of each class with wider grams; ``at`` is null for a class that has not been widened."""
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int32(), pa.int32()]
    names = ["of_gram", "of_whole", "offset", "gram", "whole", "n", "bytes", "at", "core"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for gram, whole, n, text, at, core in zip(*(batch.column(c).to_pylist() for c in ("gram", "whole", "n", "bytes", "at", "core")), strict=True):
                if at is None:
                    at, core = core_of(text, gram, least), GRAM
                for a, b, place, width in widened(text, at, core, least):
                    part = text[a:b]
                    # the place of the old gram in the new one tells the two sides apart
                    own = _hash(part[place : place + width], 2 * width + int(a + place < at))
                    out.append((gram, whole, a, own, _hash(part, place) >> 32, n, part, place, width))
            columns = list(zip(*out, strict=True)) or [()] * 9
            yield pa.record_batch([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], names=names)

    return run


def _rows(docs: DataFrame, least: int) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(*text_key(text), text.cast("binary").alias("text")).filter(F.length("text") >= least)


class Postings:
    """The stretches of a corpus and their classes, each kept in the shared folder until :meth:`close`.

    ``posted`` has gram, whole, key, tag, start and size of every stretch whose gram
    occurs twice; ``classes`` has gram, whole, their number ``n``, how many ``kinds``
    the gram has (null for one), and one of the places; ``copied`` has the texts that rows share.
    """

    def __init__(self, docs: DataFrame, least: int):
        self.spark, self.least, self.rows, self.folders = docs.sparkSession, least, _rows(docs, least), []
        small_batches(self.spark, _BATCH)
        every = lambda held: self.rows.mapInArrow(_post(least, held), f"{_CLASS}, key bigint, tag int, start int, size int")
        often = self._kept(every(None).groupBy("gram").agg(F.count("*").alias("n")).filter("n > 1").select("gram"))
        held = self.spark.sparkContext.broadcast(sieve(often, SIEVE_BITS))
        self.posted = self._kept(every(held).join(often, "gram", "left_semi"))
        held.unpersist()
        first = F.min(F.struct(*KEY, "start", "size")).alias("first")
        classes = self._kept(self.posted.groupBy("gram", "whole").agg(F.count("*").alias("n"), first).select("gram", "whole", "n", "first.*"))
        kinds = self._kept(classes.groupBy("gram").agg(F.count("*").alias("kinds")).filter("kinds > 1"))
        self.classes = self._kept(classes.join(kinds, "gram", "left"))
        self.several, self.alone = self.classes.filter("kinds is not null"), self.classes.filter("kinds is null")
        self.copied = cut(self.rows.groupBy(*KEY).agg(F.count("*").alias("n"), F.first(F.length("text")).alias("size")).filter("n > 1"))
        self.few_copied = self.copied.count() <= BROADCAST_IDS

    def _kept(self, table: DataFrame) -> DataFrame:
        out, folder = written(table)
        self.folders.append(folder)
        return out

    def close(self) -> None:
        for folder in self.folders:
            delete(self.spark, folder)

    def examples(self) -> DataFrame:
        """gram, whole, n, kinds and the bytes of one place of every class of a gram that has several."""
        keys = cut(self.several.select(*KEY).distinct())
        rows = self.rows.join(F.broadcast(keys), KEY, "left_semi") if keys.count() <= BROADCAST_IDS else self.rows
        texts = rows.groupBy(*KEY).agg(F.first("text").alias("text"))
        own = F.substring("text", F.col("start") + 1, F.col("size")).alias("bytes")
        nothing = F.lit(None).cast("int")
        return texts.join(self.several, KEY).select("gram", "whole", "n", "kinds", own, nothing.alias("at"), nothing.alias("core"))


def _bucketed(examples: DataFrame, size: int) -> DataFrame:
    buckets = max(1, -(-size // BUCKET_BYTES))
    return examples.withColumn("bucket", F.pmod("gram", F.lit(buckets))).select("bucket", "gram", "whole", "n", "bytes")


def _extent(classes: DataFrame, size: str) -> tuple[int, int]:
    """Bytes in all, and the most classes of a gram."""
    return tuple(classes.agg(F.coalesce(F.sum(size), F.lit(0)), F.coalesce(F.max("kinds"), F.lit(0))).first())


def _covered(examples: DataFrame, size: int, widest: int, least: int) -> DataFrame:
    """gram, whole, starts and ends of what repeats cover in the classes ``examples``: ``size`` bytes, ``widest`` of one gram at most."""
    usual = _bucketed(examples.filter(F.col("kinds") <= MOST), size)
    covered = usual.groupBy("bucket").applyInArrow(_bucket(least), f"{_CLASS}, starts {_SPANS}, ends {_SPANS}")
    if widest <= MOST:
        return covered
    parts = cut(examples.filter(F.col("kinds") > MOST).mapInArrow(_widen(least), f"of_gram bigint, of_whole int, offset int, {_CLASS}, n bigint, bytes binary, at int, core int"))
    classes = cut(parts.groupBy("gram", "whole").agg(F.sum("n").alias("n"), *(F.first(c).alias(c) for c in ("bytes", "at", "core"))))
    kinds = cut(classes.groupBy("gram").agg(F.count("*").alias("kinds"), F.sum(F.length("bytes")).alias("bytes")))
    inner = _covered(cut(classes.join(kinds.select("gram", "kinds"), "gram")), *_extent(kinds, "bytes"), least)
    back = parts.select("of_gram", "of_whole", "offset", "gram", "whole").join(cut(inner), ["gram", "whole"])
    return covered.unionByName(back.select(F.col("of_gram").alias("gram"), F.col("of_whole").alias("whole"), _moved("starts", "offset"), _moved("ends", "offset")))


def _moved(spans: str, by: str) -> Column:
    return F.transform(spans, lambda x: x + F.col(by)).alias(spans)


def repeat_groups(docs: DataFrame, least: int = 200) -> tuple[DataFrame, DataFrame]:
    """The maximal repeats with all their occurrences, and the places of the classes that they name.

    Groups: bucket and number (a group), length, gram and whole (a class), offset in the class and n (its places);
    a repeat that is longer than a stretch is given stretch by stretch.  Places: gram, whole, key, tag, start.
    Grams of more than ``MOST`` classes are grouped in buckets of their own size here.
    """
    held = Postings(docs, least)
    size, _ = _extent(held.several, "size")
    names = f"bucket bigint, number bigint, length int, {_CLASS}, offset int, n bigint"
    groups = _bucketed(held.examples(), size).groupBy("bucket").applyInArrow(_groups(least), names)
    single = held.alone.filter("n > 1").select(F.lit(-1).cast("bigint").alias("bucket"), F.col("gram").alias("number"), F.col("size").alias("length"), "gram", "whole", F.lit(0).alias("offset"), "n")
    return groups.unionByName(single), held.posted.select("gram", "whole", *KEY, "start")


def repeated_spans(docs: DataFrame, least: int = 200) -> tuple[DataFrame, DataFrame]:
    """Of texts that one row has: key, tag and spans of bytes that may overlap, arrays ``starts`` and ``ends``; and key, tag and size of texts that rows share."""
    held = Postings(docs, least)
    size, widest = _extent(held.several, "size")
    one = held.alone.filter("n > 1").select("gram", "whole", F.array(F.lit(0)).alias("starts"), F.array("size").alias("ends"))
    examples = held.examples() if widest <= MOST else held._kept(held.examples())  # read once, or several times
    covered = cut(_covered(examples, size, widest, least).unionByName(one))
    copied = held.copied.select(*KEY)
    places = held.posted.join(F.broadcast(copied) if held.few_copied else copied, KEY, "left_anti").join(covered, ["gram", "whole"])
    moved = places.select(*KEY, _moved("starts", "start"), _moved("ends", "start"))
    spans = cut(moved.groupBy(*KEY).agg(F.flatten(F.collect_list("starts")).alias("starts"), F.flatten(F.collect_list("ends")).alias("ends")))
    held.close()
    return spans, held.copied.select(*KEY, F.col("size").cast("int").alias("size"))


def kept_parts(text: bytes, starts: list[int], ends: list[int]) -> tuple[list[bytes], list[tuple[int, int]]]:
    """What is left of a text, and the maximal removed runs."""
    runs: list[list[int]] = []
    for a, b in sorted(zip(starts, ends, strict=True)):
        if runs and a <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], int(b))
        else:
            runs.append([int(a), int(b)])
    bounds = [0, *(x for run in runs for x in run), len(text)]
    return [text[a:b] for a, b in zip(bounds[::2], bounds[1::2], strict=True)], [(a, b) for a, b in runs]


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts, starts, ends = (batch.column(i).to_pylist() for i in range(4))
        out = []
        for doc_id, text, a, b in zip(ids, texts, starts, ends, strict=True):
            parts, runs = kept_parts(text, a or (), b or ())
            out.append((doc_id, len(text), sum(y - x for x, y in runs), len(runs), hashlib.sha256(b"".join(parts)).hexdigest(), [{"start": x, "end": y} for x, y in runs]))
        columns = list(zip(*out, strict=True)) or [()] * 6
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct({"start": pa.int64(), "end": pa.int64()}))]
        yield pa.record_batch([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])


def _marked(docs: DataFrame, least: int) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """``docs`` in three parts: rows with two more columns, the ``starts`` and ``ends`` of their spans; rows that go as a whole; rows without spans.

    While keys are few enough to broadcast, only texts of the first part are
    shuffled; beyond that all are, in one join, and there is only the first part, with nulls for no spans.
    """
    free = "_"
    while any(c.startswith(free) for c in docs.columns):
        free += "_"
    spans, copied = repeated_spans(docs, least)
    own = [free + c for c in KEY]
    named = lambda table: table.select(*[F.col(c).alias(free + c) for c in table.columns])
    hashes = text_key(F.coalesce(docs["text"], F.lit("")))
    keyed = docs.select("*", *[h.alias(c) for h, c in zip(hashes, own, strict=True)])
    gone, some = named(copied.select(*KEY)), named(spans.select(*KEY))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    if gone.count() + some.count() > BROADCAST_IDS:
        whole = copied.select(*KEY, F.array(F.lit(0)).alias("starts"), F.array("size").alias("ends"))
        return keyed.join(named(spans.unionByName(whole)), own, "left").select(*columns, f"{free}starts", f"{free}ends"), None, None
    marked = keyed.join(F.broadcast(some), own, "left_semi").join(named(spans), own).select(*columns, f"{free}starts", f"{free}ends")
    rest = keyed.join(F.broadcast(gone.unionByName(some)), own, "left_anti").select(*columns)
    return marked, keyed.join(F.broadcast(gone), own, "left_semi").select(*columns), rest


def removal_report(docs: DataFrame, least: int = 200) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the removed spans per row of ``docs``."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    marked, gone, rest = _marked(docs, least)
    out = marked.select("doc_id", F.col("text").cast("binary"), *marked.columns[-2:]).mapInArrow(
        lean("suffix_dedup", _removed), "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, spans array<struct<start:bigint,end:bigint>>")
    raw = F.col("text").cast("binary")
    size, none = F.length(raw).cast("long"), F.lit(0).cast("long")
    if gone is not None:
        span = F.array(F.struct(none.alias("start"), size.alias("end")))
        out = out.unionByName(gone.select("doc_id", size.alias("n_bytes"), size.alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.sha2(F.lit(b""), 256).alias("kept_sha256"), span.alias("spans")))
    if rest is not None:
        nothing = F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans")
        out = out.unionByName(rest.select("doc_id", size.alias("n_bytes"), none.alias("n_removed"), none.alias("n_spans"), F.sha2(raw, 256).alias("kept_sha256"), nothing))
    return out


def without_repeats(docs: DataFrame, least: int = 200) -> DataFrame:
    """``docs`` with repeated bytes cut out of ``text``; a character that a cut splits goes with it.  All columns stay."""
    marked, gone, rest = _marked(docs, least)
    starts, ends = marked.columns[-2:]

    @F.pandas_udf("string")
    def kept(texts: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.Series:
        return pd.Series([b"".join(kept_parts(bytes(t), a, b)[0]).decode("utf-8", "ignore") for t, a, b in zip(texts, starts, ends, strict=True)], dtype=object)

    short = marked.filter(F.col(starts).isNotNull()).withColumn("text", kept(F.col("text").cast("binary"), starts, ends)).drop(starts, ends)
    if rest is None:
        return short.unionByName(marked.filter(F.col(starts).isNull()).drop(starts, ends))
    return short.unionByName(gone.withColumn("text", F.lit(""))).unionByName(rest)
