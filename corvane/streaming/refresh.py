"""Incremental refresh of an index from a stream of chunks; an extra, with no ranking of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.keyword import Index


def refresh(chunks: DataFrame, root: str, checkpoint: str, fields: tuple[str, ...] = ("body",)) -> StreamingQuery:
    """Write each batch's chunks, postings and statistics as one folder a batch, so that a batch run again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/chunks/batch={number}")
        Index.of(batch, fields).write(f"{root}/index/batch={number}")

    return chunks.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def refreshed(spark: SparkSession, root: str) -> Index:
    """The index over all batches: their tokens together, and statistics weighted by their chunks."""
    tokens = spark.read.option("basePath", f"{root}/index").parquet(f"{root}/index/*/postings").drop("batch")
    parts = spark.read.option("basePath", f"{root}/index").parquet(f"{root}/index/*/stats")
    stats = parts.groupBy("source").agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("average")) / F.sum("n")).alias("average"))
    return Index(tokens, stats)
