"""Fold a stream of exposures into a mosaic.

The combiners that are sums or extremes can be kept up to date by a streaming aggregation; what depends on
all images at once (median, background matching) cannot and is left to batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fold(exposures: DataFrame) -> DataFrame:
    """Sums and extremes of (y, x, value, footprint) rows; streaming or not."""
    rows = exposures.where("value is not null and not isnan(value)")
    v, f = F.col("value"), F.col("footprint")
    return rows.groupBy("y", "x").agg(F.sum(v * f).alias("total"), F.sum(f).alias("footprint"), F.min(F.when(f > 0, v)).alias("low"), F.max(F.when(f > 0, v)).alias("high"), F.count(F.lit(1)).alias("n"))


def mean(folded: DataFrame) -> DataFrame:
    return folded.select("y", "x", F.when(F.col("footprint") != 0, F.try_divide("total", "footprint")).alias("value"), "footprint")


def windowed(exposures: DataFrame, time: str, length: str, late: str) -> DataFrame:
    """Means for each window of time; rows later than ``late`` are not waited for."""
    rows = exposures.where("value is not null").withWatermark(time, late)
    got = rows.groupBy(F.window(time, length), "y", "x").agg(F.sum(F.col("value") * F.col("footprint")).alias("t"), F.sum("footprint").alias("f"))
    return got.select(F.col("window.start").alias("start"), "y", "x", F.try_divide("t", "f").alias("value"), F.col("f").alias("footprint"))


class TileFold:
    """``foreachBatch`` sink: each micro-batch becomes one folder of partial sums, named by its number.

    A batch that is delivered again overwrites its own folder, so the mosaic counts it once.
    """

    def __init__(self, path: str):
        self.path = path.rstrip("/")

    def __call__(self, batch: DataFrame, number: int) -> None:
        fold(batch).write.mode("overwrite").parquet(f"{self.path}/batch={number}")

    def mosaic(self, spark) -> DataFrame:
        parts = spark.read.parquet(self.path)
        got = parts.groupBy("y", "x").agg(F.sum("total").alias("total"), F.sum("footprint").alias("footprint"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n"))
        return got
