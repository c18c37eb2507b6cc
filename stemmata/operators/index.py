"""Inverted index over distinct texts: texts, references, postings, document frequencies, state.

Texts are stored once however many coordinates hold them; frequencies count
distinct texts, lemma frequencies count coordinates.  A staleness check compares
what was indexed with what there is now.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stemmata.functions.text import FOLD_VERSION, tokens


def tokenised(rows: DataFrame, key: str, text: str = "text", language: str | None = None) -> DataFrame:
    """``key`` and its search tokens ``t``."""
    return rows.select(F.col(key), tokens(F.coalesce(F.col(text), F.lit("")), language).alias("t"))


def text_ids(tokenised_rows: DataFrame, key: str) -> DataFrame:
    """References: ``key`` and the digest of its token string; rows without tokens are not indexed."""
    return tokenised_rows.filter(F.size("t") > 0).select(key, F.sha1(F.array_join("t", " ").cast("binary")).alias("text_id"), "t")


def distinct_texts(tokenised_rows: DataFrame, key: str) -> DataFrame:
    """One row per distinct token string: text_id, t, the number of references and the smallest key."""
    return text_ids(tokenised_rows, key).groupBy("text_id").agg(F.first("t").alias("t"), F.count("*").alias("refs"), F.min(key).alias("first_key"))


def postings(texts: DataFrame, key: str = "text_id") -> DataFrame:
    """token, key, tf and the text's length, from texts with tokens ``t``."""
    words = texts.select(key, F.size("t").alias("length"), F.explode("t").alias("token"))
    return words.groupBy("token", key, "length").agg(F.count("*").alias("tf"))


def token_df(texts: DataFrame, key: str = "text_id") -> DataFrame:
    """token and the number of texts that hold it."""
    return texts.select(F.explode(F.array_distinct("t")).alias("token")).groupBy("token").agg(F.count("*").alias("docs"))


def lemma_readings(tokenised_rows: DataFrame, key: str, lexicon: DataFrame) -> DataFrame:
    """Positions with their sorted candidate lemmas; a form the lexicon lacks is its own lemma.

    ``lexicon`` has form and lemma, one form may have several.
    """
    forms = lexicon.groupBy("form").agg(F.array_sort(F.collect_set("lemma")).alias("lemmas"))
    words = tokenised_rows.select(key, F.posexplode("t").alias("pos", "form"))
    return words.join(forms, "form", "left").select(key, "pos", F.coalesce("lemmas", F.array("form")).alias("lemmas"))


def lemma_texts(readings: DataFrame, key: str) -> DataFrame:
    """Lemma tokens of each key in order, every candidate of a position included."""
    ordered = readings.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "lemmas"))).alias("r"))
    return ordered.select(key, F.flatten(F.transform("r", lambda x: x["lemmas"])).alias("t"))


def lemma_df(readings: DataFrame, key: str, language: Column) -> DataFrame:
    """language, lemma and the number of coordinates that may hold it (coordinates, not distinct texts)."""
    return readings.select(language.alias("language"), key, F.explode("lemmas").alias("lemma")).distinct().groupBy("language", "lemma").agg(F.count("*").alias("docs"))


def coverage(meta: DataFrame, state: DataFrame) -> DataFrame:
    """Every source of ``meta`` (source, verses) with the state of its index.

    ``state`` has source, verses and fold_version.  A normal form of another
    version is told before counts are compared; null stays unknown.
    """
    joined = meta.alias("m").join(state.alias("s"), "source", "left")
    told = (
        F.when(F.col("s.verses").isNull() & F.col("s.fold_version").isNull(), "missing")
        .when(F.col("s.fold_version").isNull(), "unknown")
        .when(F.col("s.fold_version") != FOLD_VERSION, "drifted")
        .when(F.col("s.verses").isNull() | F.col("m.verses").isNull(), "unknown")
        .when(F.col("s.verses") != F.col("m.verses"), "drifted")
        .otherwise("current")
    )
    return joined.select("source", F.col("m.verses").alias("verses"), F.col("s.verses").alias("indexed"), told.alias("state"))


def searchable(meta: DataFrame, state: DataFrame) -> DataFrame:
    """Sources that have an index of any state."""
    return meta.join(state.select("source").distinct(), "source", "left_semi")


def orphans(texts: DataFrame, references: DataFrame, key: str = "text_id") -> DataFrame:
    """Texts that no reference names; an anti join, so null keys do no harm."""
    return texts.join(references.select(key).distinct(), key, "left_anti")


def selected(named: list[str], state: DataFrame) -> tuple[list[str], list[str]]:
    """Names that are indexed and current, and those with a warning; a name without an index is refused."""
    held = {r["source"]: r["state"] for r in state.filter(F.col("source").isin(named)).collect()}
    if refused := [n for n in named if held.get(n, "missing") == "missing"]:
        raise ValueError(f"not indexed: {', '.join(sorted(refused))}")
    return [n for n in named if held[n] == "current"], [n for n in named if held[n] != "current"]
