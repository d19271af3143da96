"""Landed station readings to hourly means of zones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonalis.sources.readers import READINGS, flatten_readings


def hourly_means(readings: DataFrame, station_zones: DataFrame) -> DataFrame:
    """Batch or stream: (station_id, ts, value) to (zone_id, hour, mean_value, n), stations of unknown zones left out."""
    zoned = readings.join(station_zones, "station_id")
    sums = zoned.groupBy("zone_id", F.window("ts", "1 hour").alias("w")).agg(F.avg("value").alias("mean_value"), F.count(F.lit(1)).alias("n"))
    return sums.select("zone_id", F.col("w.start").alias("hour"), "mean_value", "n")


def stream_zone_readings(spark: SparkSession, path: str, station_zones: DataFrame, late: str = "2 hours") -> DataFrame:
    """Files of readings as they land; one reading per station and time, later ones than the watermark left out."""
    payloads = spark.readStream.schema(READINGS).option("multiLine", True).json(path)
    fresh = flatten_readings(payloads).withWatermark("ts", late).dropDuplicatesWithinWatermark(["station_id", "ts"])
    return hourly_means(fresh, station_zones)
