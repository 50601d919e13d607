"""Incremental runs over a folder of files: an extension, with the checkpoint in place of resume files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def run_available(spark: SparkSession, source: str, schema: str, checkpoint: str, sink: Callable[[DataFrame, int], None], change: Callable[[DataFrame], DataFrame] = lambda d: d) -> None:
    """Handle the files that came since the last run, once each, and stop. `sink` gets batches and their number."""
    stream = change(spark.readStream.schema(schema).parquet(source))
    stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def first_by_id(stream: DataFrame, key: str, time: str, late: str = "1 hour") -> DataFrame:
    """The first event of each id; ids are forgotten once the watermark has passed."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])
