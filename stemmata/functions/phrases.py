"""Phrases in token streams: longest first, from the left, without overlap."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def found(tokens: Sequence[str], phrases: Iterable[Sequence[str]]) -> list[tuple[str, int, int]]:
    """(phrase, first, after) of each phrase; at one place the longest wins, and the walk goes on behind it."""
    by_first: dict[str, list[tuple[str, ...]]] = {}
    for p in sorted({tuple(p) for p in phrases if p}, key=lambda p: (-len(p), p)):
        by_first.setdefault(p[0], []).append(p)
    out, at = [], 0
    while at < len(tokens):
        hit = next((p for p in by_first.get(tokens[at], ()) if tuple(tokens[at : at + len(p)]) == p), None)
        if hit:
            out.append((" ".join(hit), at, at + len(hit)))
        at += len(hit) if hit else 1
    return out


def covered(tokens: Sequence[str], phrases: Iterable[Sequence[str]]) -> float:
    """Share of the words that phrases cover."""
    return sum(b - a for _, a, b in found(tokens, phrases)) / len(tokens) if len(tokens) else 0.0


def found_udf(phrases: list[list[str]]):
    """An Arrow UDF over a column of tokens: the phrases and where they stand."""
    place = T.StructType([T.StructField("phrase", T.StringType()), T.StructField("first", T.IntegerType()), T.StructField("after", T.IntegerType())])

    @F.pandas_udf(T.ArrayType(place))
    def apply(tokens: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(("phrase", "first", "after"), f, strict=True)) for f in found(list(t), phrases)] for t in tokens])

    return apply


def covered_udf(phrases: list[list[str]]):
    """An Arrow UDF over a column of tokens: the covered share; 0.8 or more is furniture."""

    @F.pandas_udf(T.DoubleType())
    def apply(tokens: pd.Series) -> pd.Series:
        return pd.Series([covered(list(t), phrases) for t in tokens], dtype="float64")

    return apply
