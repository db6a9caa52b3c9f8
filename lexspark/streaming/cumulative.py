"""Documents that arrive over time: term counts kept up to date, and windowed event counts.

The reference model has no streams; these are additions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text as T


def cumulative_terms(docs: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Each batch adds its term and document counts as a partition of path, so a replayed batch overwrites itself."""

    def add(batch: DataFrame, number: int) -> None:
        t = batch.select("doc_id", F.explode(T.tokens(F.col("text"))).alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("tf"))
        t.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf")).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return docs.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def term_totals(batches: DataFrame) -> DataFrame:
    return batches.groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))


def windowed_events(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Event counts by type in tumbling windows, late rows admitted up to the watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))
