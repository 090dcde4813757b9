"""The same stateless detection over a stream of files, and its counts by event time.

Detection keeps no state, so the batch operator runs on a stream as it is.  Counts use a
watermark: rows later than it are dropped from windows that are already closed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mathloom.operators.detect import detect


def text_stream(spark: SparkSession, folder: str) -> DataFrame:
    """New files of a folder as rows (source_file, arrived, text)."""
    files = spark.readStream.format("text").option("wholetext", "true").load(folder)
    return files.select(F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_modification_time").alias("arrived"), F.col("value").alias("text"))


def table_stream(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """New Parquet files of a folder as rows."""
    return spark.readStream.schema(schema).parquet(folder)


def detect_stream(documents: DataFrame, keys: tuple[str, ...] = ("source_file",), text: str = "text") -> DataFrame:
    """The formulas of a stream of documents."""
    return detect(documents, keys, text)


def windowed_type_counts(formulas: DataFrame, time: str, window: str = "1 day", late: str = "30 days") -> DataFrame:
    """Formulas by type and window of event time; rows up to ``late`` behind the latest still count."""
    windows = formulas.withWatermark(time, late).groupBy(F.window(time, window), "math_type").agg(F.count("*").alias("n"))
    return windows.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "math_type", "n")
