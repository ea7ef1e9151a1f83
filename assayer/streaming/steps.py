"""A running pipeline's step summaries as a stream. This goes beyond what the engine's batch queries need."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.sources.tables import parse_steps


def read_steps(spark: SparkSession, folder: str) -> DataFrame:
    """New JSON-lines files below a folder as they come, with the time at which each file was written."""
    lines = spark.readStream.schema("value string").text(folder)
    return parse_steps(lines.select("value", F.col("_metadata.file_modification_time").alias("seen_at")), "seen_at")


def tallies(steps: DataFrame, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """(window, passed, failed): closed when nothing older can come."""
    return steps.withWatermark("seen_at", late).groupBy(F.window("seen_at", window)).agg(F.count_if(F.col("exit_code") == 0).alias("passed"), F.count_if(F.coalesce(F.col("exit_code") != 0, F.lit(True))).alias("failed"))
