"""Benchmark decontamination with one Aho-Corasick automaton.

Benchmark items (questions and answers) are normalised to lower-case words and
cut into windows of ``window`` consecutive words; an item with fewer words, but
not none, is one window.  Words of the benchmark are numbered and written as two
characters each, of different alphabets, so a window is a string of at most twice
``window`` characters and the automaton has at most that many nodes for a word of
the benchmark.  It scans the numbers of each document's words once (a word that
the benchmark lacks is two characters 0), and hits are mapped back to the
document's own characters.

What is broadcast is the text of the benchmark, at most ``slice_bytes`` of it;
every worker builds the automaton from it once, and keeps it for later tasks.  A
larger benchmark is split by item into slices of that size, each with an
automaton of its own, and the slices' passes are chained; so memory is bounded
and no item is dropped.  An item that is longer than a slice is cut between windows.

Defined cases: a null or empty text has no words and no hits; an item without
words has no window; windows that several items share count for all of them;
repeated items count once by id; a null item_id is written as the empty string;
a text of any length is read whole, in time linear in its length and its hits;
every input row gives one row, repeated doc_ids included; an empty benchmark
hits nothing; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import pickle
import re
import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemmata.llm.shared import alnum_words, kept, small_batches

SLICE_BYTES = 4 << 20
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_RESULT = "doc_id bigint, n_words bigint, n_hit bigint, item_ids array<string>, spans array<struct<start:bigint,end:bigint>>"


def _letter(n: int) -> str:
    """Character ``n``, surrogates left out."""
    return chr(n if n < 0xD800 else n + 0x800)


class Machine:
    """The automaton over the windows of some items, given as (item id, text)."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        self.trie = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        self.sizes: list[int] = []  # words of each window, and the item or items it stands in
        self.owners: list[str | set[str]] = []
        texts = [(item, alnum_words(text)) for item, text in items]
        self.letters = dict.fromkeys(w for _, words in texts for w in words)
        # two digits, so that no node has more children than about the root of the number of words
        base = max(2, math.isqrt(len(self.letters)) + 1)
        for n, w in enumerate(self.letters):
            self.letters[w] = _letter(1 + n // base) + _letter(1 + base + n % base)
        for item, words in texts:
            for i in range(max(1, len(words) - window + 1) if words else 0):
                self._add("".join(map(self.letters.__getitem__, words[i : i + window])), item)
        self.full = bool(self.sizes)
        if self.full:
            self.trie.make_automaton()

    def _add(self, line: str, item: str) -> None:
        at = self.trie.get(line, -1)
        if at < 0:
            self.trie.add_word(line, len(self.sizes))
            self.sizes.append(len(line) // 2)
            self.owners.append(item)
        elif isinstance(self.owners[at], set):
            self.owners[at].add(item)
        elif self.owners[at] != item:
            self.owners[at] = {self.owners[at], item}

    def scan(self, text: bytes) -> tuple[int, list[tuple[int, int]], set[str]]:
        """Number of words, (first, last + 1) word spans of the windows found, and the items they belong to."""
        words = alnum_words(text)
        spans, items = [], set()
        if words and self.full:
            known = self.letters.get
            for last, at in self.trie.iter("".join([known(w, "\0\0") for w in words])):
                end = last // 2 + 1
                spans.append((end - self.sizes[at], end))
                own = self.owners[at]
                if isinstance(own, set):
                    items |= own
                else:
                    items.add(own)
        return len(words), spans, items


def _machine(held: Broadcast) -> Machine:
    """The machine of a slice; a worker keeps the one that it built last."""
    name, window, items = held.value
    machines = kept("decontaminate")
    if name not in machines:
        machines.clear()
        machines[name] = Machine(items, window)
    return machines[name]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of half-open spans, touching ones joined, in order."""
    out: list[list[int]] = []
    for first, after in sorted(spans):
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], after)
        else:
            out.append([first, after])
    return [(a, b) for a, b in out]


def char_spans(text: bytes, spans: list[tuple[int, int]]) -> list[dict]:
    """Word spans as character spans of the original text."""
    places = [m.span() for m in _WORD.finditer(text)]
    chars = np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)
    return [{"start": int(chars[places[a][0]]) - 1, "end": int(chars[places[b - 1][1] - 1])} for a, b in spans]


def _pass(held: Broadcast, last: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _machine(held)
        for batch in batches:
            ids, texts, carried = (batch.column(i).to_pylist() for i in range(3))
            rows = []
            for text, before in zip(texts, carried, strict=True):
                n, spans, items = machine.scan(text)
                if before:
                    old_spans, old_items = pickle.loads(before)
                    spans, items = spans + old_spans, items | old_items
                rows.append((n, merged(spans), items))
            if last:
                yield pa.record_batch(
                    {
                        "doc_id": pa.array(ids, pa.int64()),
                        "n_words": pa.array([n for n, _, _ in rows], pa.int64()),
                        "n_hit": pa.array([sum(b - a for a, b in s) for _, s, _ in rows], pa.int64()),
                        "item_ids": pa.array([sorted(x) for _, _, x in rows], pa.list_(pa.string())),
                        "spans": pa.array([char_spans(t, s) if s else [] for t, (_, s, _) in zip(texts, rows, strict=True)], pa.list_(pa.struct({"start": pa.int64(), "end": pa.int64()}))),
                    }
                )
            else:
                yield pa.record_batch({"doc_id": pa.array(ids, pa.int64()), "text": pa.array(texts, pa.binary()), "carried": pa.array([pickle.dumps((s, x)) if s else None for _, s, x in rows], pa.binary())})

    return run


def _parts(text: bytes, window: int, slice_bytes: int) -> Iterator[bytes]:
    """``text``, or if it is longer than a slice its normalised words in parts that hold all its windows."""
    if len(text) <= slice_bytes:
        yield text
        return
    words = alnum_words(text)
    step = max(1, slice_bytes // 16)
    for a in range(0, max(1, len(words) - window + 1), step):
        yield b" ".join(words[a : a + step + window - 1])


def _slices(benchmark: DataFrame, window: int, slice_bytes: int) -> Iterator[Broadcast]:
    """Name, window and items of every slice of the benchmark, each broadcast; one slice at least."""
    context = benchmark.sparkSession.sparkContext
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    held, size, slices = [], 0, 0
    for item, text in items.toLocalIterator():
        for part in _parts(bytes(text), window, slice_bytes):
            if held and size + len(part) > slice_bytes:
                yield context.broadcast((uuid.uuid4().hex, window, held))
                held, size, slices = [], 0, slices + 1
            held.append((item, part))
            size += len(part)
    if held or not slices:
        yield context.broadcast((uuid.uuid4().hex, window, held))


def without_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """``docs`` with all their columns, without those in which any window stands."""
    small_batches(docs.sparkSession)
    for held in _slices(benchmark, window, slice_bytes):
        docs = docs.filter(~_hit(held)(F.coalesce("text", F.lit("")).cast("binary")))
    return docs


def _hit(held: Broadcast):
    @F.pandas_udf("boolean")
    def hit(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        machine = _machine(held)
        for texts in batches:
            yield pd.Series([bool(machine.scan(bytes(t))[1]) for t in texts], dtype=bool)

    return hit


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, item_ids and spans (characters of the original text) per row of ``docs``."""
    small_batches(docs.sparkSession)
    held = list(_slices(benchmark, window, slice_bytes))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"), F.lit(None).cast("binary").alias("carried"))
    for k, patterns in enumerate(held):
        last = k == len(held) - 1
        rows = rows.mapInArrow(_pass(patterns, last), _RESULT if last else "doc_id bigint, text binary, carried binary")
    return rows
