"""Streaming ingest into the point store and windowed latency statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from millrace.operators.documents import chunk, clean_documents, identifiers
from millrace.operators.store import PointStore


def ingest(stream: DataFrame, store: PointStore, collection: str, checkpoint: str, source: str = "stream") -> StreamingQuery:
    """Clean, chunk and upsert every micro-batch; points are keyed by content, so a replayed batch changes nothing."""

    def write(batch: DataFrame, _: int) -> None:
        chunks = chunk(clean_documents(batch), "semantic", target=500)
        points = identifiers(chunks, F.lit(source), F.col("doc_id").cast("string"), F.col("chunk_text"), F.col("chunk_index"))
        store.write(collection, points.select(F.col("point_uuid").alias("id"), "doc_id", "chunk_index", "chunk_text"))

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_latency(events: DataFrame, ts: str = "ts", value: str = "value", by: str = "event_type", window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Count, mean and greatest value by kind and time window; rows later than ``late`` are dropped once their window is out."""
    stamped = events.withColumn(ts, F.col(ts).cast("timestamp"))
    if events.isStreaming:
        stamped = stamped.withWatermark(ts, late)
    return (
        stamped.groupBy(F.window(ts, window).alias("w"), by)
        .agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(value), 6).alias("mean"), F.max(value).alias("max"))
        .select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), by, "n", "mean", "max")
    )
