"""The ingestion queue as a stream: each micro-batch claims new jobs and folds what they give into the tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

JOB = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("type", T.StringType()), T.StructField("payload", T.StringType()), T.StructField("status", T.StringType()),
    T.StructField("attempts", T.IntegerType()), T.StructField("max_attempts", T.IntegerType()), T.StructField("error", T.StringType()),
    T.StructField("not_before", T.TimestampType()), T.StructField("created_at", T.TimestampType()), T.StructField("updated_at", T.TimestampType()),
])


def jobs_stream(spark: SparkSession, folder: str, most_files: int = 100) -> DataFrame:
    """New files of jobs in a folder; the checkpoint makes sure that each is claimed once."""
    return spark.readStream.schema(JOB).option("maxFilesPerTrigger", most_files).parquet(folder)


def run_worker(
    jobs: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, on_drain: Callable[[], None] | None = None
) -> None:
    """All jobs there are, batch by batch; then on_drain once if any batch had rows.

    handle gets the arrived jobs, merges them into the queue and runs ingest.ingest, which leaves those that are
    not due and counts the failures; it must be idempotent by batch number.
    """
    dirty = []

    def batch(df: DataFrame, number: int) -> None:
        if not df.isEmpty():
            handle(df, number)
            dirty.append(number)

    query = jobs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    if dirty and on_drain is not None:
        on_drain()
