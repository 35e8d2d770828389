"""Streams of documents into a store, and event windows. An addition: nothing that is matched here streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestar.operators.chunking import chunk_window
from lodestar.plans import scratch
from lodestar.plans.catalog import Store


def ingest_stream(documents: DataFrame, store: Store, checkpoint: str, size: int = 200, overlap: int = 40) -> StreamingQuery:
    """documents: a stream of id, uri, title, metadata, text. A micro-batch that is run again changes nothing, as equal content is skipped.

    Of a document that occurs several times in a micro-batch the greatest (title, uri, metadata, text) counts, whatever order its rows come in.
    """

    def one(batch: DataFrame, _: int) -> None:
        shown = F.struct("title", "uri", "metadata", "text")
        batch = scratch.keep(batch.groupBy("id").agg(F.max(shown).alias("d")).select("id", "d.*"), "micro-batch")
        chunks = chunk_window(batch, "id", "text", size, overlap).withColumnRenamed("id", "document_id")
        store.ingest(batch.select("id", "uri", "title", "metadata"), chunks.withColumn("embedding", F.array().cast("array<float>")))

    return documents.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_windows(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Count and sum of value by window and type; on a stream, rows later than ``late`` are left out."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("ts", late) if events.isStreaming else timed
    out = timed.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")
