"""Streams: studies from files as they arrive, counts of audit events in windows, keep-first by key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

STUDY = T.StructType([T.StructField(c, T.IntegerType() if c == "year" else T.StringType()) for c in ("pmid", "title", "authors", "journal", "year", "abstract", "doi", "raw_text")])


def stream_studies(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines below path, with the time of arrival."""
    return spark.readStream.schema(STUDY).json(path).withColumn("arrived_at", F.current_timestamp())


def first_arrivals(studies: DataFrame, within: str = "1 day") -> DataFrame:
    """The first row of each pmid; ids are remembered for `within`, so the state stays bounded."""
    return studies.withWatermark("arrived_at", within).dropDuplicatesWithinWatermark(["pmid"])


def event_windows(events: DataFrame, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(window_start, event_type, n, total) of events(ts, event_type, value); rows later than `late` are left out."""
    counted = events.withWatermark("ts", late).groupBy(F.window("ts", length), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return counted.select(F.col("window.start").alias("window_start"), "event_type", "n", "total")
