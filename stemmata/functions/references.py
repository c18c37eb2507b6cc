"""Reading references as people and printed editions write them.

Book names come as a table of aliases; a name that several books share is
``ambiguous``, never guessed.  The parsers take one string and give ranges of
coordinates; the UDF gives them for a column, with a status where nothing, or
nothing certain, was read.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words and numerals that stand before a numbered book's name.
_NUMBERS = {"first": "1", "second": "2", "third": "3", "fourth": "4", "1st": "1", "2nd": "2", "3rd": "3", "4th": "4", "i": "1", "ii": "2", "iii": "3", "iv": "4"}
#: Roman digits.
_ROMAN = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}
#: What a reference is made of: numbers with a letter behind them, words, and single marks.
_TOKEN = re.compile(r"\d+|[^\W\d_]+|\S")
_DASHES = ("-", "–", "—")


def arabic(numeral: str) -> int | None:
    """The value of a roman numeral, or None for other text."""
    digits = [_ROMAN.get(c) for c in numeral.strip().lower()]
    if not digits or None in digits:
        return None
    return sum(-d if any(e > d for e in digits[k + 1 :]) else d for k, d in enumerate(digits)) or None


def plain_name(name: str) -> str:
    """A book's name for lookup: no marks or punctuation, lower case, a numeral in front as a digit."""
    bare = "".join(c for c in unicodedata.normalize("NFD", name) if unicodedata.category(c) != "Mn").lower()
    words = re.findall(r"[^\W_]+", bare)
    if len(words) > 1 and words[0] in _NUMBERS:
        words[0] = _NUMBERS[words[0]]
    return "".join(words)


@dataclass
class Books:
    """Codes by alias, books of a single chapter, and the last verse of chapters for whole-chapter references."""

    aliases: dict[str, list[str]]
    single: frozenset[str] = frozenset()
    last: dict[tuple[str, int], int] = field(default_factory=dict)

    def __post_init__(self):
        named: dict[str, set[str]] = {}
        for name, codes in self.aliases.items():
            named.setdefault(plain_name(name), set()).update(codes)
        self.named = {k: sorted(v) for k, v in named.items()}

    def resolve(self, name: str) -> tuple[str | None, str]:
        """(code, status): ok, unknown, or ambiguous with no code."""
        codes = self.named.get(plain_name(name), [])
        return (codes[0], "ok") if len(codes) == 1 else (None, "ambiguous" if codes else "unknown")


class _Reader:
    """Reads places from the tokens of a reference, from a given token on."""

    def __init__(self, tokens: list[re.Match], at: int):
        self.tokens, self.at = tokens, at

    def peek(self, ahead: int = 0) -> str:
        k = self.at + ahead
        return self.tokens[k][0] if k < len(self.tokens) else ""

    def take(self, *marks: str) -> bool:
        found = self.peek() in marks and self.peek() != ""
        self.at += found
        return found

    def done(self) -> bool:
        return self.at == len(self.tokens)

    def chapter(self) -> str | None:
        """A number, or one of the letters that name added chapters, in front of a colon."""
        word = self.peek()
        if self.peek(1) == ":" and (word.isdecimal() or word in ("A", "B", "C", "D", "E", "F")):
            self.at += 2
            return word
        return None

    def verse(self) -> tuple[int, str] | None:
        """A number, and the letter that stands right behind it."""
        if not self.peek().isdecimal():
            return None
        number, sub = self.tokens[self.at], self.peek(1)
        self.at += 1
        if len(sub) == 1 and "a" <= sub <= "z" and self.tokens[self.at].start() == number.end():
            self.at += 1
            return int(number[0]), sub
        return int(number[0]), ""

    def piece(self, chapter: str) -> tuple | None:
        """A verse or a range of verses; later chapters may be named."""
        first = self.chapter() or chapter
        verse = self.verse()
        if verse is None:
            return None
        if not self.take(*_DASHES):
            return first, *verse, first, *verse
        last = self.chapter() or first
        until = self.verse()
        return None if until is None else (first, *verse, last, *until)

    def pieces(self, chapter: str) -> list[tuple] | None:
        """Pieces between commas, to the end; None where something else stands."""
        out: list[tuple] = []
        while not out or self.take(","):
            made = self.piece(chapter)
            if made is None:
                return None
            out.append(made)
            chapter = made[3]
        return out if self.done() else None


def _numbered(reader: _Reader) -> str | None:
    return reader.chapter()


def _roman(reader: _Reader) -> str | None:
    value = arabic(reader.peek())
    if value is None or not reader.peek(1):
        return None
    reader.at += 1
    reader.take(".")
    return str(value)


def _dotted(reader: _Reader) -> str | None:
    if reader.peek().isdecimal() and reader.peek(1) == ".":
        chapter = reader.peek()
        reader.at += 2
        return chapter
    return None


def parse(text: str, books: Books, whole_chapters: bool = False) -> tuple[list[tuple], str]:
    """Ranges (book, chapter, verse, sub, end chapter, end verse, end sub) and a status.

    Read are ``Luke 2:42-3:1``, verse lists ``Rom 1:21, 22``, several references
    between semicolons, roman (``1 Tim. iii. 16``) and dotted (``Ps 3.1``)
    chapters, verses alone for books of one chapter, and whole chapters if asked.
    A later reference without a book takes the one before.
    """
    out: list[tuple] = []
    held = None
    for part in (p.strip() for p in text.split(";")):
        if not part:
            continue
        if held and re.match(r"(?:[A-F]|\d+)\s*:", part):
            part = f"{held} {part}"
        ranges, status, name = _one(part, books, whole_chapters)
        if status != "ok":
            return [], status
        out += ranges
        held = name
    return out, "ok" if out else "unread"


def _one(text: str, books: Books, whole_chapters: bool) -> tuple[list[tuple], str, str]:
    """Ranges, status and the book's name: for each way to write a chapter, the shortest name of a book that it can follow."""
    tokens = list(_TOKEN.finditer(text))
    seen = "unread"
    for chapter_of in (_numbered, _roman, _dotted, None):
        for k in range(1, len(tokens)):
            name = text[: tokens[k - 1].end()].rstrip(". ")
            if not name or not (tokens[k].start() > tokens[k - 1].end() or tokens[k - 1][0] == "."):
                continue
            reader = _Reader(tokens, k)
            chapter = chapter_of(reader) if chapter_of else ""
            if chapter is None or not reader.peek().isdecimal():
                continue
            code, status = books.resolve(name)
            if code is None:
                seen = status if seen in ("unread", "unknown") else seen
                continue
            if chapter_of is None:
                return _bare(reader, code, name, books, whole_chapters)
            ranges = reader.pieces(chapter)
            if ranges is None:
                return [], "unread", name
            return _in_order([(code, *r) for r in ranges], name)
    return [], seen, ""


def _in_order(ranges: list[tuple], name: str) -> tuple[list[tuple], str, str]:
    backwards = any(a.isdecimal() and b.isdecimal() and (int(a), v) > (int(b), w) for _, a, v, _, b, w, _ in ranges)
    return ([], "out of order", name) if backwards else (ranges, "ok", name)


def _bare(reader: _Reader, code: str, name: str, books: Books, whole_chapters: bool) -> tuple[list[tuple], str, str]:
    """A number without a chapter: verses of a book of one chapter, or a whole chapter."""
    number = reader.peek()
    if code in books.single:
        ranges = reader.pieces("1")
        return _in_order([(code, *r) for r in ranges], name) if ranges else ([], "unread", name)
    last = books.last.get((code, int(number))) if not reader.peek(1) else None
    if whole_chapters and last is not None:
        return [(code, number, 1, "", number, last, "")], "ok", name
    return [], "needs a verse" if reader.peek(1) in ("", *_DASHES) else "unread", name


_FIELDS = ("book", "chapter", "verse", "sub", "end_chapter", "end_verse", "end_sub")


def parse_udf(books: Books, whole_chapters: bool = False):
    """An Arrow UDF: struct of status and ranges for a column of references."""
    one = T.StructType([T.StructField(f, T.IntegerType() if f in ("verse", "end_verse") else T.StringType()) for f in _FIELDS])
    kind = T.StructType([T.StructField("status", T.StringType()), T.StructField("ranges", T.ArrayType(one))])

    @F.pandas_udf(kind)
    def read(texts: pd.Series) -> pd.DataFrame:
        rows = [parse(t or "", books, whole_chapters) for t in texts]
        return pd.DataFrame({"status": [s for _, s in rows], "ranges": [[dict(zip(_FIELDS, r, strict=True)) for r in ranges] for ranges, _ in rows]})

    return read
