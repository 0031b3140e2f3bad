"""Folder conversion that goes on where it stopped: each file is converted once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from starloom.plans.convert import Options, convert_to


def convert_new(spark: SparkSession, folder: str, directory: str, options: Options, checkpoint: str, ending: str = ".fits") -> StreamingQuery:
    """Converts what the folder got since the last run, then stops; the checkpoint remembers which files those are."""
    arrivals = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("pathGlobFilter", f"*{ending}").load(folder).select("path")

    def batch(rows: DataFrame, _: int) -> None:
        paths = [r["path"] for r in rows.select("path").distinct().collect()]  # names only; the work is one plan
        if paths:
            convert_to(spark, "\n".join(sorted(paths)), directory, options).count()

    return arrivals.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_events(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums of an event stream by event-time window and kind; events later than ``late`` are left out."""
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    return timed.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
