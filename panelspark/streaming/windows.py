"""Event-time windows over a stream of files, appended to a table once each window is closed."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.sources import schemas


def stream(spark: SparkSession, directory: str, name: str, files_per_batch: int | None = None) -> DataFrame:
    """The table's files as a stream, each file once, in the order of their arrival."""
    reader = spark.readStream.schema(schemas.TABLES[name])
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(f"{directory}/[{name[0]}]{name[1:]}.parquet")  # a pattern may name a file or a folder


def window_totals(
    events: DataFrame, time: str, keys: Sequence[str], length: str, delay: str, measures: Mapping[str, Column]
) -> DataFrame:
    """One row per window and group of ``keys``: ``opens``, the keys and the measures.

    ``time`` is the event's own.  On a stream a window is closed, and its row final, once an event more
    than ``delay`` after its end was seen; events that come later than that are dropped.  Events without
    a time are in no window.
    """
    timed = events.withColumn(time, F.col(time).cast("timestamp")).filter(F.col(time).isNotNull())
    totals = (
        timed.withWatermark(time, delay)
        .groupBy(F.window(time, length).alias("window"), *keys)
        .agg(*[c.alias(name) for name, c in measures.items()])
    )
    return totals.select(F.col("window.start").alias("opens"), *keys, *measures)


def append_closed(totals: DataFrame, table: str, checkpoint: str) -> DataFrame:
    """Reads all that has arrived, appends the windows closed by it to ``table``, and returns the table.

    Called again with the same ``checkpoint``, also after a failure, it goes on where it stopped: the
    offsets and the open windows lie in the checkpoint, and the table lists the files of each finished
    batch, so nothing is read or appended twice.
    """
    query = (
        totals.writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(table)
    )
    query.awaitTermination()
    return totals.sparkSession.read.schema(totals.schema).parquet(table)
