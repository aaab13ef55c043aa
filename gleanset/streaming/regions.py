"""Region files as a stream: each micro-batch of whole scans goes through the batch operators.

An extension: the same DataFrame functions run on a folder that keeps getting JSON files of text regions. A batch's result
is written under its number, so a batch that is run again after a failure replaces its own rows and no others."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from gleanset.operators.titles import REGION, select_titles


def follow(spark: SparkSession, source: str, target: str, checkpoint: str, operator: Callable[[DataFrame], DataFrame] = select_titles, files_per_batch: int = 100) -> StreamingQuery:
    """Starts a query that applies operator to each batch of region files in source. A scan's regions are in one file."""

    def handle(batch: DataFrame, number: int) -> None:
        operator(batch).write.mode("overwrite").parquet(f"{target.rstrip('/')}/batch={number}")

    files = spark.readStream.schema(REGION).option("maxFilesPerTrigger", files_per_batch).json(source)
    return files.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
