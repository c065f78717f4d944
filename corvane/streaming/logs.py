"""A sink for log rows: all of them in files, and the last few at hand, kept from batch to batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: Rows that stay at hand.
KEPT = 500


def _folder(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _batches(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the batches that are written whole."""
    folder, files = _folder(spark, path)
    if not files.exists(folder):
        return []
    names = [s.getPath().getName() for s in files.listStatus(folder)]
    whole = [n for n in names if n.startswith("batch=") and files.exists(_folder(spark, f"{path}/{n}/_SUCCESS")[0])]
    return sorted(int(n.removeprefix("batch=")) for n in whole)


def last_rows(rows: DataFrame, kept: int, by: tuple[str, ...]) -> DataFrame:
    """The last rows by (time, log_id), of each key if there are keys; pruned before their shuffle."""
    newest = (F.desc("time"), F.desc("log_id"))
    if not by:
        return rows.orderBy(*newest).limit(kept)
    return rows.withColumn("__rn", F.row_number().over(Window.partitionBy(*by).orderBy(*newest))).where(F.col("__rn") <= kept).drop("__rn")


def sink(logs: DataFrame, root: str, checkpoint: str, kept: int = KEPT, by: tuple[str, ...] = ()) -> StreamingQuery:
    """Write a stream of rows with time and log_id: every row to ``root``/all, the last ``kept`` (of each key) to ``root``/last.

    A batch takes what the batch before left at hand, adds its own rows and keeps the last of both, so state is bounded by
    ``kept`` a key. Batches are folders by their number: one that runs again after a failure replaces itself and starts from
    the same state, so rows are neither lost nor doubled.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{root}/all/batch={number}")
        before = [n for n in _batches(spark, f"{root}/last") if n < number]
        rows = spark.read.schema(batch.schema).parquet(f"{root}/all/batch={number}")
        if before:
            rows = rows.unionByName(spark.read.schema(batch.schema).parquet(f"{root}/last/batch={before[-1]}"))
        last_rows(rows, kept, by).coalesce(1).write.mode("overwrite").parquet(f"{root}/last/batch={number}")
        for old in before[:-1]:
            path, files = _folder(spark, f"{root}/last/batch={old}")
            files.delete(path, True)

    return logs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def tail(spark: SparkSession, root: str, schema) -> DataFrame:
    """The rows at hand, newest first; none where nothing has been written."""
    numbers = _batches(spark, f"{root}/last")
    rows = spark.read.schema(schema).parquet(f"{root}/last/batch={numbers[-1]}") if numbers else spark.createDataFrame([], schema)
    return rows.orderBy(F.desc("time"), F.desc("log_id"))
