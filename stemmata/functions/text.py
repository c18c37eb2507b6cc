"""Text normal form and tokens: the key that every index here rests on.

``fold`` lower-cases, drops diacritics and brings final sigma and ligatures to
their plain letters, as Column expressions for alphabets whose accented letters
are precomposed (Latin, Greek, Cyrillic).  ``fold_any`` does the same for any
script, with one Arrow UDF.  Two tokenisers exist side by side and must not be
mixed: ``tokens`` (letters and digits) for search, ``ngram_tokens`` (split at
white space, punctuation stays) for n-gram models.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

FOLD_VERSION = 1
#: Code points whose canonical decomposition is one letter and marks are folded by rule, up to here.
_LAST_FOLDED = 0x1FFF


def _bases() -> tuple[str, str]:
    """Lower-case letters with marks, and their bare letters, found by decomposition."""
    source, target = [], []
    for code in range(0xC0, _LAST_FOLDED + 1):
        letter = chr(code)
        if letter.lower() != letter or not letter.isalpha():
            continue
        bare = "".join(c for c in unicodedata.normalize("NFD", letter) if unicodedata.category(c) != "Mn")
        if len(bare) == 1 and bare != letter:
            source.append(letter)
            target.append(bare)
    return "".join(source), "".join(target)


_MARKED, _BARE = _bases()
#: Letters written as two.
_LIGATURES = {"æ": "ae", "œ": "oe", "ﬁ": "fi", "ﬂ": "fl"}


def _letters(text: Column, language: str | None) -> Column:
    """The normal form but for white space."""
    folded = F.translate(F.lower(text), _MARKED + "ς", _BARE + "σ")
    for ligature, letters in _LIGATURES.items():
        folded = F.replace(folded, F.lit(ligature), F.lit(letters))
    if language == "la":
        folded = F.translate(folded, "jv[]", "iu")
    return folded


def fold(text: Column, language: str | None = None) -> Column:
    """The normal form of a text column; ``la`` also reads j as i, v as u, and drops square brackets."""
    return F.trim(F.regexp_replace(_letters(text, language), r"\s+", " "))


def tokens(text: Column, language: str | None = None) -> Column:
    """Search tokens: runs of letters and digits of the normal form."""
    return F.regexp_extract_all(_letters(text, language), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def once(made: Column) -> Column:
    """``made`` as a generator's output, so that filters on it are not pushed below and do not evaluate it again."""
    return F.explode(F.array(made))


def ngram_tokens(text: Column, language: str | None = None) -> Column:
    """Model tokens: the normal form split at spaces, punctuation attached."""
    return F.filter(F.split(fold(text, language), " "), lambda w: w != "")


def fold_text(text: str, language: str | None = None) -> str:
    """The normal form of one string, for any script: decompose, drop marks, lower, plain letters."""
    bare = "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) != "Mn").lower().replace("ς", "σ")
    bare = unicodedata.normalize("NFC", bare)
    for ligature, letters in _LIGATURES.items():
        bare = bare.replace(ligature, letters)
    if language == "la":
        bare = bare.translate(str.maketrans({"j": "i", "v": "u", "[": None, "]": None}))
    return " ".join(bare.split())


@F.pandas_udf(T.StringType())
def fold_any(texts: pd.Series) -> pd.Series:
    """:func:`fold_text` over Arrow batches, for scripts without precomposed letters."""
    return texts.map(lambda t: None if t is None else fold_text(t))


def idf(total: Column, docs: Column) -> Column:
    """ln(total / docs); a word that no text holds counts 1."""
    return F.when(docs > 0, F.log(total / docs)).otherwise(F.lit(1.0))


def surprisal(total: Column, docs: Column) -> Column:
    """log2(total / (docs + 1)); 0 for an empty collection.  Slightly negative for a word in every text."""
    return F.when(total == 0, F.lit(0.0)).otherwise(F.log2(total / (docs + 1)))


def scaled_run(floor: int, length: Column) -> Column:
    """Shortest exact run that a quotation of ``length`` words must have: half of them, between ``floor`` and 6."""
    return F.greatest(F.lit(floor), F.least(F.lit(6), F.floor(length / 2)))
