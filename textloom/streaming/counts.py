"""Counting as data arrives, and event-time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ngrams


def stream_files(spark: SparkSession, path: str, schema: str, files_per_batch: int = 500) -> DataFrame:
    """A stream of the Parquet files of a folder; a batch takes so many."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def count_stream(docs: DataFrame, out: str, checkpoint: str, text: str = "text", orders: tuple[int, ...] = ngrams.ORDERS):  # noqa: ANN201
    """A query that adds the counts of each batch as one folder under OUT, named by the batch.

    A batch that is run again after a failure replaces its own folder, so nothing counts twice; texts are whole within a batch. counted() adds the folders up. There is no state that grows in the executors.
    """

    def add(batch: DataFrame, batch_id: int) -> None:
        ngrams.counts(ngrams.sequences_of(batch, text), orders=orders).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return docs.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def counted(spark: SparkSession, out: str) -> DataFrame:
    """ord, ctx, next, cnt over all batches."""
    return spark.read.parquet(out).groupBy("ord", "ctx", "next").agg(F.sum("cnt").alias("cnt"))


def compact(spark: SparkSession, out: str, to: str) -> None:
    """One table from all batches: the new base that later batches are merged with."""
    counted(spark, out).write.mode("overwrite").parquet(to)


def event_windows(events: DataFrame, time: str, key: str, value: str, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """win_start, key, n, total in tumbling windows of event time; later than LATE behind the newest is dropped in a stream."""
    return (
        events.withWatermark(time, late)
        .groupBy(F.window(time, size).alias("w"), key)
        .agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
        .select(F.col("w.start").alias("win_start"), key, "n", "total")
    )
