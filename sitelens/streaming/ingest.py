"""Specimens that arrive as files: enriched row by row, counted by zone and period."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.enrich import assign_period, assign_zone, filter_region, quality_filter
from ..schema import SPECIMEN


def specimen_stream(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """A stream of standard rows from Parquet files as they arrive."""
    return spark.readStream.schema(SPECIMEN).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def enrich_stream(rows: DataFrame, bbox=None) -> DataFrame:
    """Region, quality, period and zone of each row; stateless."""
    return assign_zone(assign_period(quality_filter(filter_region(rows, bbox))))


def zone_period_counts(rows: DataFrame) -> DataFrame:
    """Running counts and sums by zone and period; its state has a row for each pair."""
    dated = rows.filter(F.col("zone").isNotNull() & F.col("period").isNotNull())
    return dated.groupBy("zone", "period").agg(F.count(F.lit(1)).alias("n"), F.avg("d13C_coll").alias("d13C_mean"), F.avg("d15N_coll").alias("d15N_mean"))


def event_windows(events: DataFrame, time: str = "ts", late: str = "1 hour", window: str = "1 hour") -> DataFrame:
    """Counts of a watermarked event stream in tumbling windows."""
    return events.withWatermark(time, late).groupBy(F.window(time, window)).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "n")
