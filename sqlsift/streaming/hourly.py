"""The hourly roll-up of log files as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sqlsift.functions.ids import uuid5
from sqlsift.sources import logs


def watch(spark: SparkSession, path: str, files_each: int = 16) -> DataFrame:
    """file, text of the log files that appear under a path, some a micro-batch; whole files, as servers rotate them."""
    rows = spark.readStream.format("text").option("wholetext", True).option("maxFilesPerTrigger", files_each).load(path)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))


def hourly(files: DataFrame, late: str = "2 hours") -> DataFrame:
    """database, query_text_uid, hour (UTC), total_count, total_duration_us; an hour is whole once the log is `late` past it.
    Hours are cut in the session's time zone, which should be UTC.

    Durations that stand in an entry of their own need the order of a file's entries: their statements count with -1
    microseconds here, and the batch load pairs them.
    """
    runs = logs.executions(logs.entries(files)).withColumn("at", F.col("utc_time").cast("timestamp")).withWatermark("at", late)
    out = runs.groupBy(F.window("at", "1 hour").alias("w"), "database", uuid5(F.col("query")).alias("query_text_uid")).agg(F.count("*").alias("total_count"), F.sum("duration_us").alias("total_duration_us"))
    return out.select("database", "query_text_uid", F.col("w.start").cast("timestamp_ntz").alias("hour"), "total_count", "total_duration_us")
