"""One place to ask: conversion, passages, search, scan, inventory, digests.

Options are checked before any job starts; an unknown one is an error.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stemmata.functions.text import tokens
from stemmata.operators import coords, scan
from stemmata.sources import store


@dataclass(frozen=True)
class Options:
    """Options of search and scan."""

    limit: int = 5
    min_run: int = 3
    common: float = 0.1
    min_grade: str = "indirect"

    @classmethod
    def of(cls, given: dict) -> Options:
        """Options from a mapping of strings or values; unknown names and values out of range are errors."""
        kinds = {f.name: f.type for f in fields(cls)}
        if unknown := sorted(set(given) - set(kinds)):
            raise ValueError(f"unknown option: {unknown[0]}")
        cast = {"int": int, "float": float, "str": str}
        try:
            made = cls(**{k: cast[kinds[k]](v) for k, v in given.items()})
        except (TypeError, ValueError):
            raise ValueError(f"not a value of its kind: {given}") from None
        if not 0 < made.common <= 1 or made.limit < 1 or made.min_run < 1 or made.min_grade not in scan_grades():
            raise ValueError(f"out of range: {given}")
        return made


def scan_grades() -> list[str]:
    """Grades from the weakest."""
    return ["indirect", "partial", "direct"]


class Library:
    """Reference texts (corpus, item_id, text) and what can be asked of them."""

    def __init__(self, spark: SparkSession, items: DataFrame):
        self.spark, self.items = spark, items

    def _held(self) -> DataFrame:
        return self.items.select("item_id", tokens(F.coalesce("text", F.lit(""))).alias("t"))

    def scan(self, docs: DataFrame, **given) -> DataFrame:
        """Findings in documents (doc_id, text), of the least grade asked for."""
        options = Options.of(given)
        rows = docs.select("doc_id", tokens(F.coalesce("text", F.lit(""))).alias("t"))
        wanted = scan_grades()[scan_grades().index(options.min_grade) :]
        return scan.scan(rows, self._held(), options.min_run, options.common).filter(F.col("grade").isin(wanted))

    def search(self, queries: DataFrame, **given) -> DataFrame:
        """Best items for each query text (doc_id, text)."""
        options = Options.of(given)
        rows = queries.select("doc_id", tokens(F.coalesce("text", F.lit(""))).alias("t"))
        return scan.search(rows, self._held(), options.limit, options.common)

    def convert(self, refs: DataFrame, to_pivot: DataFrame, from_pivot: DataFrame, grid: DataFrame, covering: bool = False) -> DataFrame:
        """References in another numbering, each with a status."""
        made = coords.convert_covering if covering else coords.convert_exact
        return made(refs, to_pivot, from_pivot, grid)

    def digest(self) -> DataFrame:
        """Fingerprint of the reference texts."""
        return store.digest({"items": self.items})

    def health(self) -> dict:
        """Whether there is anything to search."""
        n = self.items.limit(1).count()
        return {"status": "ok" if n else "empty"}
