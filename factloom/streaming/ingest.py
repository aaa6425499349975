"""Structured Streaming over arriving annotations and tuples, with the same functions as in batch.

Rows arrive late by days and some are sent again: counts are kept by event time under a watermark, and repeats within
the watermark are dropped by id. State is bounded by the watermark, not by the stream.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.operators import nested, rewrite
from factloom.runtime import squeeze
from factloom.sources import annotations


def read(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 100) -> DataFrame:
    """Parquet files as they arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def deduplicated(stream: DataFrame, id_col: str, event_time: str, late: str = "10 days") -> DataFrame:
    """Each id once; the same id counts as sent again if it comes within ``late``."""
    return stream.withColumn(event_time, F.col(event_time).cast("timestamp")).withWatermark(event_time, late).dropDuplicatesWithinWatermark([id_col])


def extracted(stream: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """Tuples of arriving annotations; stateless."""
    return rewrite.extract(annotations.sentences(stream, id_col, json_col), "clauses")


def shredded(stream: DataFrame, id_col: str, json_col: str, tables: list[nested.Nested]) -> DataFrame:
    """Flat rows of arriving annotations; stateless."""
    return nested.shred(stream, id_col, json_col, tables)


def predicate_counts(stream: DataFrame, event_time: str, window: str = "1 day", late: str = "10 days") -> DataFrame:
    """Occurrences of each predicate by window of event time."""
    timed = stream.withColumn(event_time, F.col(event_time).cast("timestamp")).withWatermark(event_time, late)
    return timed.groupBy(F.window(event_time, window), F.lower(squeeze(F.col("predicate.word"))).alias("predicate")).agg(F.count("*").alias("n"))
