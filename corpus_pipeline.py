"""Corpus pipeline: quality, near-duplicates, repeated passages, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next one's ``docs``.  All but the last return
the columns of ``documents``.

Defined cases, in every stage: a null or empty text is scored like an empty one,
is nobody's copy, has no passages and no windows, and is packed as its end mark;
texts of any length are read whole; of rows that share a doc_id one stays at the
near-duplicate stage; a null doc_id is kept; other columns, whatever their names,
are carried through by all stages but the last, which drops them; an empty table
gives no rows.  Where labels of both kinds are missing nothing is rejected; an
empty benchmark hits nothing.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stemmata.llm import decontaminate, minhash, packing, quality, suffix_dedup
from stemmata.llm.shared import new_folder


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches the threshold; learnt from the labels that are not held out."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.filter(quality.score(model, F.col("text")) >= quality.CUT)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group whose 5-word shingle sets are similar by 0.8 or more."""
    return minhash.one_per_group(docs, n=5, num=8, den=10, least=26)


def repeated_passage_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without bytes under 200-byte strings that stand anywhere else; n_chars follows the text."""
    short = suffix_dedup.without_repeats(docs, least=200)
    return short.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else short


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of ten words of any benchmark item."""
    return decontaminate.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=10)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document stands in sequences of 2048 tokens."""
    # fewer words remembered than by the operator alone: other stages' workers and a grown heap stand beside
    return packing.pack(packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json"), remembered=100_000))


STAGES = [
    ("quality classifier", quality_stage),
    ("minhash near-dedup", near_duplicate_stage),
    ("suffix-array dedup", repeated_passage_stage),
    ("benchmark decontamination", benchmark_stage),
    ("best-fit packing", packing_stage),
]

#: SQL can express neither the classifier nor the tokenizer; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is kept in the shared folder for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        folder = new_folder(spark, "stage")
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return STAGES[-1][1](spark, docs, sf_dir)
