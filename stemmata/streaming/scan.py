"""Extensions: the quotation scan over a stream of documents, and session clusters of events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemmata.functions.text import tokens
from stemmata.operators import runs


def scan_stream(docs: DataFrame, items: DataFrame, path: str, checkpoint: str, least: int = 6):
    """Write the longest common run of each streamed document and item as Parquet, batch by batch.

    A document is scanned by itself, so there is no state between batches; a batch
    that is run again replaces its own folder.
    """
    held = items.select("item_id", tokens(F.coalesce("text", F.lit(""))).alias("t")).cache()

    def batch(rows: DataFrame, number: int) -> None:
        own = rows.select("doc_id", tokens(F.coalesce("text", F.lit(""))).alias("t"))
        found = runs.longest_runs(runs.shared_runs(own, held, "doc_id", "item_id", least), "doc_id", "item_id")
        found.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return docs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)


def sessions(events: DataFrame, key: str, time: str, gap: str, late: str | None = None) -> DataFrame:
    """Sessions of each key with their number of events and sum of values; ``late`` is the watermark of a stream."""
    rows = events.withWatermark(time, late) if late else events
    grouped = rows.groupBy(key, F.session_window(time, gap).alias("s")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return grouped.select(key, F.col("s.start").alias("first"), F.col("s.end").alias("after"), "n", "total")
