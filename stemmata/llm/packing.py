"""Best-fit packing of documents by hierarchical residual packing.

Pieces of at most ``capacity`` tokens are packed best-fit, longest first, within
partitions of bounded size.  Bins that are nearly full are emitted; underfull
ones go on as items of their total length.  Partitions are then merged, ``FAN``
to one, and packed again, until one is left or merging makes no progress.  Each
round's rows are written to the shared folder, and a task never holds more than
about ``GROUP`` items.

Defined cases: a null or empty text is its end mark alone (id 0); equal rows are
packed each by itself; null doc_ids are kept; a text of any length is cut as told;
an empty table gives no rows; other columns are ignored.  Only a document of more than ``capacity`` tokens is
cut; its last piece may be shorter.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemmata.llm.shared import cut, kept, lean, small_batches
from stemmata.llm.tokens import MOST_PIECES, WordTokenizer

GROUP, FAN = 20_000, 8
_PIECE = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def _tokenize(path: str, capacity: int, with_ids: bool, remembered: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # tokenizers keep what they have seen from task to task
        held = kept("packing")
        if (path, remembered) not in held:
            held[path, remembered] = WordTokenizer(path, remembered)
        words = held[path, remembered]
        end = bytes(4)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = words.ids(text) + end
                for k, a in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[a : a + 4 * capacity]
                    rows.append((doc_id, k, a // 4, len(own) // 4, zlib.crc32(own), own))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            n = 6 if with_ids else 5
            yield pa.record_batch([pa.array(list(c), t) for c, t in zip(columns[:n], kinds, strict=False)], names=names[:n])

    return lean("packing", run)


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, with_ids: bool = False, remembered: int = MOST_PIECES) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 (and ids, if asked for) per piece of a document's tokens.

    ``remembered`` is how many words a worker keeps the ids of; it bounds memory and changes no result.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    return rows.mapInArrow(_tokenize(tokenizer, capacity, with_ids, remembered), _PIECE + (", ids binary" if with_ids else ""))


def best_fit(lengths: np.ndarray, capacity: int) -> list[int]:
    """Bin of each item: the fullest one that has room, items taken from the longest."""
    place = [0] * len(lengths)
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    there, bins = 0, 0  # bit r of ``there``: some bin has r left
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        fits = there >> size
        if fits:
            r = (fits & -fits).bit_length() - 1 + size
            place[i] = room[r].pop()
            if not room[r]:
                there ^= 1 << r
        else:
            r, place[i] = capacity, bins
            bins += 1
        if not room[r - size]:
            there |= 1 << (r - size)
        room[r - size].append(place[i])
    return place


def _round(number: int, capacity: int, slack: int):
    """Pack one partition's bins; rows get their bin, their offset in it and whether it is emitted."""

    def run(key, rows):
        if number:
            items = rows.groupby("sequence_id", sort=True)["length"].sum()
            own = np.searchsorted(items.index.to_numpy(), rows["sequence_id"].to_numpy())
            lengths = items.to_numpy()
        else:
            own, lengths = np.arange(len(rows)), rows["length"].to_numpy()
        place = np.array(best_fit(lengths, capacity), np.int64)
        fill = np.bincount(place, weights=lengths).astype(np.int64)
        # items follow each other in a bin by their order here; an item's own rows keep their offsets
        order = np.lexsort((np.arange(len(place)), place))
        before = np.cumsum(lengths[order]) - lengths[order]
        first = np.zeros(len(fill), np.int64)
        starts = np.flatnonzero(np.diff(place[order], prepend=-1))
        first[place[order][starts]] = before[starts]
        at = np.empty(len(place), np.int64)
        at[order] = before - first[place[order]]
        return rows.assign(
            sequence_id=(np.int64(number) << 56) + (np.int64(key[0]) << 24) + place[own],
            offset=rows["offset"].to_numpy() + at[own],
            done=fill[place[own]] >= capacity - slack,
        )

    return run


def pack(items: DataFrame, capacity: int = 2048, slack: int = 4, group: int = GROUP) -> DataFrame:
    """``items`` (pieces with a length) with sequence_id and offset; sequences hold at most ``capacity``."""
    keep = items.columns
    types = dict(items.dtypes)
    held = cut(items.select("*", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.lit(False).alias("done")))
    schema = ", ".join(f"`{c}` {types[c]}" for c in keep) + ", part bigint, sequence_id bigint, offset bigint, done boolean"
    n = held.count()
    parts = max(1, -(-n // group))
    carried = held.withColumn("part", F.pmod(F.xxhash64(*keep, F.monotonically_increasing_id()), F.lit(parts)))
    emitted, number = [], 0
    while True:
        packed = cut(carried.select(*keep, "part", "sequence_id", "offset", "done").groupBy("part").applyInPandas(_round(number, capacity, slack), schema))
        emitted.append(packed.filter("done").select(*keep, "sequence_id", "offset"))
        rest = packed.filter("not done")
        left = rest.select("sequence_id").distinct().count()
        fewer = max(-(-parts // FAN), -(-left // group), 1)
        if parts == 1 or fewer >= parts:
            emitted.append(rest.select(*keep, "sequence_id", "offset"))
            break
        parts, number = fewer, number + 1
        carried = rest.withColumn("part", F.pmod("part", F.lit(parts)))
    out = emitted[0]
    for more in emitted[1:]:
        out = out.union(more)
    return out
