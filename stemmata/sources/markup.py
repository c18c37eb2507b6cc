"""Readers of verse-marked texts: standard markers, TEI, OSIS, HTML, word lists.

Each reader takes a DataFrame with path and content (as ``spark.read.text`` with
wholetext, or ``binaryFile``, gives) and returns book, chapter, verse, subverse
and text, in file order by ``seq``.  What is a pattern is read with Spark's
regular expressions; what needs a walk over the document is one Arrow stage per
file.
"""

from __future__ import annotations

import html
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from io import BytesIO

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stemmata.session import ship

VERSE_SCHEMA = "path string, seq int, book string, chapter int, verse int, subverse string, text string"
#: Marker pairs whose content is not text, and heading lines.
_NOTES = r"(?s)\\(f|fe|x|ef)\s.*?\\\1\*"
_HEADINGS = r"(?m)^\\(?:mt|ms|mr|s|sr|r|d|sp|h|toc|toca|rem|sts|ide|usfm|cl|cp|imt|is|ip)\d*\s.*$"
_SKIPPED = {"note", "rdg", "head", "del", "fw", "figure", "teiHeader"}


def files(rows: DataFrame) -> DataFrame:
    """path and content of ``spark.read.format('binaryFile')`` rows as text."""
    return rows.select("path", F.decode("content", "UTF-8").alias("content"))


def standard_markers(rows: DataFrame) -> DataFrame:
    """Books written with backslash markers: id, c and v; notes, cross references and headings go, word marks are unwrapped."""
    text = F.regexp_replace("content", _NOTES, "")
    text = F.regexp_replace(text, _HEADINGS, "")
    text = F.regexp_replace(text, r"\\\+?w\s+([^|\\]*)(?:\|[^\\]*)?\\\+?w\*", "$1")
    book = F.regexp_extract("content", r"\\id\s+(\S+)", 1)
    chapters = rows.select("path", book.alias("book"), F.posexplode(F.split(text, r"\\c\s+", -1)).alias("cn", "body")).filter("cn > 0")
    numbered = chapters.select("path", "book", "cn", F.expr(r"try_cast(regexp_extract(body, '^(\\d+)', 1) as int)").alias("chapter"), F.posexplode(F.split("body", r"\\v\s+", -1)).alias("vn", "part")).filter("vn > 0")
    label = F.regexp_extract("part", r"^(\d+)([a-z]?)", 1)
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace("part", r"^\d+[a-z]?(?:-\d+)?\s*", ""), r"\\\+?[a-z]+\d*\*?", " "), r"\s+", " "))
    order = Window.partitionBy("path").orderBy("cn", "vn")
    return numbered.select("path", F.row_number().over(order).alias("seq"), "book", "chapter", label.cast("int").alias("verse"), F.regexp_extract("part", r"^(\d+)([a-z]?)", 2).alias("subverse"), plain.alias("text"))


def verse_label(label: str) -> tuple[int, str] | None:
    """``t`` is the title (verse 0), ``12a`` verse 12 and subverse a; others are None."""
    if label == "t":
        return 0, ""
    found = re.fullmatch(r"(\d+)([a-z]?)", label or "")
    return (int(found[1]), found[2]) if found else None


def _name(element: ET.Element) -> str:
    return element.tag.rpartition("}")[2] if isinstance(element.tag, str) else ""


def flat_text(element: ET.Element) -> str:
    """Text of an element without notes, variant readings, headings and deletions; blocks are set apart by a space."""

    def walk(e: ET.Element) -> Iterator[str]:
        if _name(e) not in _SKIPPED:
            yield e.text or ""
            for child in e:
                yield from walk(child)
                yield child.tail or ""
            if _name(e) in ("p", "l", "lg", "ab", "div", "seg", "w", "lb"):
                yield " "

    return " ".join("".join(walk(element)).split())


def tei_verses(root: ET.Element) -> Iterator[tuple[str, int, int, str, str]]:
    """Verses of nested divisions: book and chapter from the divisions above, the verse from a division or ab of type verse."""

    def walk(e: ET.Element, book: str, chapter: int) -> Iterator[tuple]:
        kind, n = e.get("subtype") or e.get("type") or "", e.get("n") or ""
        if kind == "book":
            book = n
        if kind == "chapter" and n.isdigit():
            chapter = int(n)
        label = verse_label(n.rpartition(":")[2].rpartition(".")[2])
        if kind in ("verse", "section") and label:
            yield book, chapter, *label, flat_text(e)
            return
        for child in e:
            yield from walk(child, book, chapter)

    yield from walk(root, "", 0)


def tei_milestones(root: ET.Element) -> Iterator[tuple[str, int, int, str, str]]:
    """Verses as the text between empty marks of unit book, chapter and verse."""
    book, chapter, verse, parts = "", 0, None, []

    def walk(e: ET.Element) -> Iterator[tuple]:
        nonlocal book, chapter, verse, parts
        if _name(e) in _SKIPPED:
            return
        unit, n = (e.get("unit"), e.get("n") or "") if _name(e) == "milestone" else (None, "")
        if unit in ("book", "chapter", "verse"):
            if verse is not None:
                yield book, chapter, *verse, " ".join("".join(parts).split())
            parts, verse = [], verse_label(n) if unit == "verse" else None
            book = n if unit == "book" else book
            chapter = int(n) if unit == "chapter" and n.isdigit() else chapter
        parts.append(e.text or "")
        for child in e:
            yield from walk(child)
            parts.append(child.tail or "")

    yield from walk(root)
    if verse is not None:
        yield book, chapter, *verse, " ".join("".join(parts).split())


def osis_verses(root: ET.Element) -> Iterator[tuple[str, int, int, str, str]]:
    """Verses with an osisID such as Gen.1.1; words are joined by spaces, segments within a word are not."""
    for e in root.iter():
        if _name(e) == "verse" and (found := re.fullmatch(r"(\w+)\.(\d+)\.(\d+)", e.get("osisID") or "")):
            words = ["".join(w.itertext()) for w in e.iter() if _name(w) == "w"]
            text = " ".join(words) if words else flat_text(e)
            yield found[1], int(found[2]), int(found[3]), "", text.replace("/", "")


def zipped_members(content: bytes, suffix: str) -> Iterator[tuple[str, bytes]]:
    """Names and bytes of a zip's members that end with ``suffix``, in name order."""
    with zipfile.ZipFile(BytesIO(content)) as held:
        for name in sorted(n for n in held.namelist() if n.endswith(suffix)):
            yield name, held.read(name)


def xml_reader(walk: Callable[[ET.Element], Iterator[tuple]]) -> Callable[[DataFrame], DataFrame]:
    """A reader of XML files by one of the walks above."""

    def read(rows: DataFrame) -> DataFrame:
        ship(rows.sparkSession)

        def run(batches):
            for batch in batches:
                for path, content in zip(batch["path"], batch["content"], strict=True):
                    out = [(path, k, *v) for k, v in enumerate(walk(ET.fromstring(content)), 1)]
                    yield pd.DataFrame(out, columns=["path", "seq", "book", "chapter", "verse", "subverse", "text"])

        return rows.select("path", "content").mapInPandas(run, VERSE_SCHEMA)

    return read


read_tei, read_milestones, read_osis = xml_reader(tei_verses), xml_reader(tei_milestones), xml_reader(osis_verses)


def word_rows(words: DataFrame, coordinate: list[str], order: str, word: str = "word") -> DataFrame:
    """One word per row to verses, words in file order."""
    return words.groupBy(*coordinate).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, word))), lambda x: x[word]), " ").alias("text"))


def transliterate(text, source: str, target: str):
    """A letter-by-letter rewriting of a column; a letter without an equivalent is an error."""
    unknown = F.regexp_replace(text, f"[{re.escape(source)}\\s\\p{{Punct}}]", "")
    return F.when(unknown == "", F.translate(text, source, target)).otherwise(F.raise_error(F.concat(F.lit("letters without an equivalent: "), unknown)))


class _Passages(HTMLParser):
    """Collects text of span elements whose class names a verse, leaving notes and numbers out."""

    LEFT_OUT = {"footnote", "crossreference", "versenum", "chapternum", "script", "style", "h3", "sup"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, str | None, bool]] = []
        self.found: dict[str, list[str]] = {}

    def handle_starttag(self, tag, attrs):
        classes = (dict(attrs).get("class") or "").split()
        verse = next((c for c in classes if re.fullmatch(r"[1-4]?[A-Za-z]+-\d+-\d+", c)), None) if "text" in classes else None
        skip = tag in self.LEFT_OUT or bool(self.LEFT_OUT & set(classes))
        if tag not in ("br", "img", "hr", "meta", "link", "input"):
            self.open.append((tag, verse, skip))

    def handle_endtag(self, tag):
        while self.open and self.open.pop()[0] != tag:
            pass

    def handle_data(self, data):
        if any(skip for _, _, skip in self.open):
            return
        if verse := next((v for _, v, _ in reversed(self.open) if v), None):
            self.found.setdefault(verse, []).append(data)


def html_passages(content: str) -> list[tuple[str, int, int, str, str]]:
    """Verses of a page whose spans carry classes such as ``text Gen-1-3``; parts of one verse are joined."""
    parser = _Passages()
    parser.feed(content)
    out = []
    for name, parts in parser.found.items():
        book, chapter, verse = name.rsplit("-", 2)
        out.append((book, int(chapter), int(verse), "", " ".join("".join(parts).split())))
    return out


def read_html(rows: DataFrame) -> DataFrame:
    """:func:`html_passages` of every file."""
    ship(rows.sparkSession)

    def run(batches):
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                yield pd.DataFrame([(path, k, *v) for k, v in enumerate(html_passages(content or ""), 1)], columns=["path", "seq", "book", "chapter", "verse", "subverse", "text"])

    return rows.select("path", "content").mapInPandas(run, VERSE_SCHEMA)


def page_text(content):
    """Title and plain text of an HTML column, by regular expressions alone: scripts, styles, comments and tags go."""
    title = F.trim(F.regexp_extract(content, r"(?is)<title[^>]*>(.*?)</title>", 1))
    bare = F.regexp_replace(content, r"(?is)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->", " ")
    bare = F.regexp_replace(bare, r"(?s)<[^>]*>", " ")
    for entity, letter in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(entity), F.lit(letter))
    return title, F.trim(F.regexp_replace(bare, r"\s+", " "))


def copyright_block(content):
    """The first notice that starts with the word or the sign, to the end of its element."""
    return F.trim(F.regexp_extract(content, r"(?is)((?:copyright|©|&copy;)[^<]*)", 1))


def unescape(text: str) -> str:
    """Entities as letters."""
    return html.unescape(text)


def records(rows: DataFrame, separator: str = r"\n\s*\n") -> DataFrame:
    """Blank-line separated records of key=value lines: path, record number and a map."""
    split = rows.select("path", F.posexplode(F.split("content", separator)).alias("record", "body")).filter(F.trim("body") != "")
    lines = F.filter(F.split("body", "\n"), lambda x: F.instr(x, "=") > 0)
    pairs = F.transform(lines, lambda x: F.struct(F.trim(F.substring_index(x, "=", 1)).alias("k"), F.trim(F.substr(x, F.instr(x, "=") + 1)).alias("v")))
    keep_last = F.aggregate(pairs, F.array().cast("array<struct<k:string,v:string>>"), lambda acc, p: F.concat(F.filter(acc, lambda a: a["k"] != p["k"]), F.array(p)))
    return split.select("path", "record", F.map_from_entries(keep_last).alias("fields"))
