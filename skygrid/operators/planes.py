"""Planes as colour channels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHANNELS = ("red", "green", "blue")


def transparent(pixels: DataFrame, alpha: DataFrame | None = None) -> DataFrame:
    """Planes 0 .. 2 (and 3, an opacity of 0 to 255) as bytes y, x, red, green, blue, alpha.

    Where a colour is missing the pixel is transparent and black.  ``alpha`` (y, x, alpha from 0 to 1) multiplies the
    opacity; a pixel without a row there keeps its own.  Fractions of a byte are cut off.
    """
    value = F.when(~F.isnan("value"), F.col("value"))
    wide = pixels.groupBy("y", "x").agg(*[F.max(F.when(F.col("plane") == k, value)).alias(c) for k, c in enumerate((*CHANNELS, "own"))])
    out = wide.withColumn("part", F.lit(1.0)) if alpha is None else wide.join(alpha.select("y", "x", F.col("alpha").alias("part")), ["y", "x"], "left")
    whole = F.col("red").isNotNull() & F.col("green").isNotNull() & F.col("blue").isNotNull()
    byte = lambda c: F.when(whole, F.pmod(F.floor(c).cast("int"), F.lit(256))).otherwise(0)
    opacity = F.coalesce("own", F.lit(255.0)) * F.coalesce("part", F.lit(1.0))
    return out.select("y", "x", *[byte(F.col(c)).alias(c) for c in CHANNELS], byte(opacity).alias("alpha"))
