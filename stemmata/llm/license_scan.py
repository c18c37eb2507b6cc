"""License scan: exact phrases, and fuzzy search for short notices.

Exact: places where a phrase's words stand consecutively.  Fuzzy: a notice that
may be ``k`` edits away is split into ``k + 1`` pieces; by the pigeonhole
principle one of them stands unchanged in every occurrence.  One Aho-Corasick
pass finds the pieces.  Each piece names the place where its notice would start,
and the ``regex`` library's bounded-error matching verifies the window around
that place by itself: it is hardly longer than the notice, so time is linear in
the pieces found, and no match hides another in front of it.  Of verified places
of one notice that overlap, that with the fewest edits stays, the first of equals.
Both searches work on the normalised text (lower-case words, single spaces);
spans are reported in words and in characters of the original.

Defined cases: a null or empty text has no words and no places; every input row
gives one row, repeated doc_ids included; a text of any length is read whole, in
time linear in its length; an empty table gives no rows; places of different
notices or phrases that overlap are all reported; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemmata.llm.decontaminate import char_spans
from stemmata.llm.shared import alnum_words, small_batches

#: Exact phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Short notices as normalised words, their labels, and most edits (characters inserted, deleted or changed).
NOTICES = {
    "licensed under the apache license version 2 0": ("apache", 4),
    "you may obtain a copy of the license at http www apache org licenses": ("apache", 6),
    "released under the mit license": ("mit", 3),
    "permission is hereby granted free of charge to any person obtaining a copy": ("mit", 6),
    "the terms of the gnu general public license": ("gpl", 4),
    "the gnu lesser general public license": ("lgpl", 3),
    "licensed under creative commons attribution": ("cc-by", 4),
    "licensed under cc by sa 4 0": ("cc-by-sa", 2),
    "redistribution and use in source and binary forms with or without modification": ("bsd", 6),
    "mozilla public license version 2 0": ("mpl", 3),
    "all rights reserved": ("proprietary", 1),
}


class Finder:
    """Searches one normalised text for phrases and notices."""

    def __init__(self, phrases: dict[str, str], notices: dict[str, tuple[str, int]]):
        self.phrases = [(f" {words} ".encode(), label) for words, label in phrases.items()]
        self.notices = []
        self.seeds = ahocorasick.Automaton()
        seeds: dict[str, list] = {}
        for words, (label, edits) in notices.items():
            n, at = len(words), len(self.notices)
            self.notices.append((regex.compile(rf"(?b)(?<= )(?:{regex.escape(words)}){{e<={edits}}}(?= )"), label, edits, n))
            cuts = [round(i * n / (edits + 1)) for i in range(edits + 2)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                seeds.setdefault(words[a:b], []).append((at, a))
        for piece, places in seeds.items():
            self.seeds.add_word(piece, (len(piece), places))
        if notices:
            self.seeds.make_automaton()

    def exact(self, normal: bytes) -> list[tuple[str, int, int]]:
        """(label, first byte, byte after) of every place of a phrase, its two outer spaces left off."""
        found = []
        for words, label in self.phrases:
            at = normal.find(words)
            while at >= 0:
                found.append((label, at + 1, at + len(words) - 1))
                at = normal.find(words, at + 1)
        return found

    def fuzzy(self, normal: str) -> list[tuple[str, int, int, int]]:
        """(label, first, after, edits) of verified notices, the best of those that overlap under one notice."""
        if not self.notices:
            return []
        wanted: set[tuple[int, int]] = set()
        for end, (size, places) in self.seeds.iter(normal):
            wanted.update((at, end + 1 - size - offset) for at, offset in places)
        verified: dict[int, set[tuple[int, int, int]]] = {}
        for at, start in wanted:
            pattern, _, edits, n = self.notices[at]
            m = pattern.search(normal, max(0, start - edits - 1), min(len(normal), start + n + edits + 1))
            if m:
                verified.setdefault(at, set()).add((sum(m.fuzzy_counts), m.start(), m.end()))
        return [(self.notices[at][1], a, b, edits) for at, found in verified.items() for edits, a, b in best_apart(found)]


def best_apart(found: set[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Of (edits, first, after) those that overlap none with fewer edits, nor an earlier one with as many."""
    firsts: list[int] = []
    kept: list[tuple[int, int, int]] = []
    for edits, a, b in sorted(found):
        k = bisect_right(firsts, a)
        if (k == 0 or kept[k - 1][2] <= a) and (k == len(kept) or b <= kept[k][1]):
            firsts.insert(k, a)
            kept.insert(k, (edits, a, b))
    return kept


def _scan(phrases: dict, notices: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(phrases, notices)
        place = pa.struct({"label": pa.string(), "exact": pa.bool_(), "edits": pa.int32(), "first_word": pa.int64(), "n_words": pa.int64(), "start": pa.int64(), "end": pa.int64()})
        for batch in batches:
            counts, places = [], []
            for text in batch.column(1).to_pylist():
                words = alnum_words(text)
                normal = b" %b " % b" ".join(words)
                hits = [(label, a, b, -1) for label, a, b in finder.exact(normal)]
                hits += finder.fuzzy(normal.decode("latin-1"))
                counts.append(len(words))
                gaps = np.flatnonzero(np.frombuffer(normal, np.uint8) == 32) if hits else ()
                ends = [(int(np.searchsorted(gaps, a)) - 1, int(np.searchsorted(gaps, b))) for _, a, b, _ in hits]
                own = char_spans(text, ends) if hits else []
                places.append(
                    [
                        {"label": label, "exact": e < 0, "edits": max(0, e), "first_word": a, "n_words": b - a} | c
                        for (label, _, _, e), (a, b), c in zip(hits, ends, own, strict=True)
                    ]
                )
            yield pa.record_batch({"doc_id": batch.column(0), "n_words": pa.array(counts, pa.int64()), "places": pa.array(places, pa.list_(place))})

    return run


def scan_licenses(docs: DataFrame, phrases: dict[str, str] | None = None, notices: dict[str, tuple[str, int]] | None = None) -> DataFrame:
    """doc_id, n_words and places (label, exact, edits, words and characters) per row of ``docs``."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    schema = "doc_id bigint, n_words bigint, places array<struct<label:string,exact:boolean,edits:int,first_word:bigint,n_words:bigint,start:bigint,end:bigint>>"
    return rows.mapInArrow(_scan(PHRASES if phrases is None else phrases, NOTICES if notices is None else notices), schema)
