"""Documents that keep arriving: their bags are appended to an index as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillspan.config import EngineConfig
from quillspan.operators.bags import doc_terms, plain_sections


def append_bags(documents: DataFrame, config: EngineConfig, out: str, checkpoint: str) -> StreamingQuery:
    """Starts a stream of ``(doc_id, text)`` into ``out/batch=N``, once over what is there.

    A batch that runs again after a failure overwrites its own folder, so every document counts once.
    """

    def one(batch: DataFrame, number: int) -> None:
        bags = doc_terms(plain_sections(batch), config)
        bags.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return documents.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def live_document_frequency(postings: DataFrame, watermark: str = "1 hour", window: str = "1 day") -> DataFrame:
    """``(window_start, term, n_rows, tf)`` of a stream of postings with ``flushed_at``; rows later than the watermark are left out."""
    return (
        postings.where("term is not null and flushed_at is not null")
        .withWatermark("flushed_at", watermark)
        .groupBy(F.window("flushed_at", window).alias("w"), "term")
        .agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum("tf"), F.lit(0)).alias("tf"))
        .select(F.col("w.start").alias("window_start"), "term", "n_rows", "tf")
    )
