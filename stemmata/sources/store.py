"""Storage, provenance and the build: replace by corpus, chapter upserts, manifest, digests, pipeline of steps."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def write_corpus(verses: DataFrame, path: str) -> None:
    """Write verses below ``path``, replacing exactly the corpora they belong to."""
    verses.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("corpus").parquet(path)


def upserted(held: DataFrame, new: DataFrame, key: list[str], keep: list[str]) -> DataFrame:
    """``held`` with rows of ``new`` in their place; columns in ``keep`` keep the old value where the new one is null."""
    old = held.select(*key, *[F.col(c).alias(f"_old_{c}") for c in keep])
    filled = new.join(old, key, "left")
    for c in keep:
        filled = filled.withColumn(c, F.coalesce(c, f"_old_{c}"))
    return held.join(new.select(*key), key, "left_anti").unionByName(filled.select(*held.columns))


def dropped(verses: DataFrame, references: DataFrame, texts: DataFrame, corpora: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Verses, references and texts without the corpora; texts that no reference names any more go with them."""
    left = references.filter(~F.col("corpus").isin(corpora))
    return verses.filter(~F.col("corpus").isin(corpora)), left, texts.join(left.select("text_id").distinct(), "text_id", "left_semi")


def latest(manifest: DataFrame, key: list[str], stamp: str = "fetched_at") -> DataFrame:
    """Last entry of the append-only log for each file; of equal stamps the larger digest."""
    order = Window.partitionBy(*key).orderBy(F.desc(stamp), F.desc("sha256"))
    return manifest.withColumn("place", F.row_number().over(order)).filter("place = 1").drop("place")


def to_copy(theirs: DataFrame, ours: DataFrame) -> DataFrame:
    """Entries whose content is not held here yet, whatever their path."""
    return theirs.join(ours.select("sha256").distinct(), "sha256", "left_anti")


def rehashed(rows: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files (path, content) against the manifest: status ok, changed or unknown."""
    now = rows.select("path", F.sha2("content", 256).alias("now"))
    status = F.when(F.col("sha256").isNull(), "unknown").when(F.col("sha256") == F.col("now"), "ok").otherwise("changed")
    return now.join(manifest.select("path", "sha256"), "path", "left").select("path", status.alias("status"))


def digest(tables: dict[str, DataFrame]) -> DataFrame:
    """Part, rows and fingerprint of each table; the order of rows does not matter."""
    from stemmata.operators.coords import fingerprint

    return fingerprint(tables)


def inventory(verses: DataFrame) -> DataFrame:
    """Chapters and verses held per corpus and book."""
    return verses.groupBy("corpus", "book").agg(F.countDistinct("chapter").alias("chapters"), F.count("*").alias("verses"))


def jsonl(df: DataFrame, path: str) -> None:
    """Records as JSON lines."""
    df.write.mode("overwrite").json(path)


def run_steps(spark: SparkSession, steps: dict[str, tuple[list[str], Callable[[SparkSession], DataFrame]]]) -> dict[str, str]:
    """Run steps whose needs have succeeded; status ok, failed (also for no rows), or skipped."""
    status: dict[str, str] = {}
    while len(status) < len(steps):
        ready = [n for n, (needs, _) in steps.items() if n not in status and all(x in status for x in needs)]
        if not ready:
            raise ValueError(f"steps need each other: {sorted(set(steps) - set(status))}")
        for name in ready:
            needs, make = steps[name]
            if any(status[x] != "ok" for x in needs):
                status[name] = "skipped"
                continue
            try:
                status[name] = "ok" if make(spark).limit(1).count() else "failed"
            except Exception:
                status[name] = "failed"
    return status
