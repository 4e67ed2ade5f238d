"""Mosaics: resample images onto one grid and fold them.

Images become one table of (image_id, y, x, value, footprint); every way of combining is a partial
aggregate over (y, x), so each map task sends at most one row for a pixel.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..raster import Grid, Raster
from ..storage import cut
from . import background, stack
from .bounds import bounds_of
from .interpolate import interpolate
from .stack import Stack

COMBINE = ("mean", "sum", "first", "last", "min", "max", "median")


def combine(layers: DataFrame, how: str) -> DataFrame:
    """Fold (image_id, y, x, value, footprint) rows: plane, y, x, value, footprint of touched pixels.

    mean and sum weigh by footprint; first and last go by image_id; min and max carry the footprint of the image that
    won, the first one if several did; the median is over images with a positive footprint.
    """
    if how not in COMBINE:
        raise ValueError(f"combine function must be one of {', '.join(COMBINE)}")
    v, f, i = F.col("value"), F.col("footprint"), F.col("image_id")
    keys = [k for k in ("plane", "y", "x") if k in layers.columns]
    rows = layers.where(v.isNotNull() & ~F.isnan("value"))
    if how in ("mean", "sum"):
        got = rows.groupBy(*keys).agg(F.sum(v * f).alias("total"), F.sum(f).alias("footprint"))
        value = F.when(F.col("footprint") != 0, F.try_divide("total", "footprint")) if how == "mean" else F.col("total")
        return got.select(*keys, value.alias("value"), "footprint")
    rows = rows.where(f > 0)
    if how == "median":
        return rows.groupBy(*keys).agg(F.median(v).alias("value"), F.sum(f).alias("footprint"))
    if how in ("min", "max"):
        rows = rows.where((v != float("inf")) & (v != float("-inf")))
    pick: dict[str, Callable[[], Column]] = {
        "first": lambda: F.min(F.struct(i.alias("k"), v.alias("v"), f.alias("f"))),
        "last": lambda: F.max(F.struct(i.alias("k"), v.alias("v"), f.alias("f"))),
        "min": lambda: F.min(F.struct(v.alias("v"), i.alias("k"), f.alias("f"))),
        "max": lambda: F.max(F.struct(v.alias("v"), (-i).alias("k"), f.alias("f"))),
    }
    got = rows.groupBy(*keys).agg(pick[how]().alias("best"))
    return got.select(*keys, F.col("best.v").alias("value"), F.col("best.f").alias("footprint"))


def fill_blank(pixels: DataFrame, folded: DataFrame, blank: float | None = 0.0) -> DataFrame:
    """Every pixel of the grid; those whose summed footprint is exactly zero get the blank value and footprint 0."""
    keys = [k for k in ("plane", "y", "x") if k in folded.columns and k in pixels.columns]
    out = pixels.join(folded, keys, "left")
    none = F.coalesce(F.col("footprint"), F.lit(0.0)) == 0
    blank_value = F.lit(None).cast("double") if blank is None or np.isnan(blank) else F.lit(float(blank))
    return out.select(*keys, F.when(none, blank_value).otherwise(F.col("value")).alias("value"), F.coalesce("footprint", F.lit(0.0)).alias("footprint"))


def weighted(layer: DataFrame, weights: DataFrame) -> DataFrame:
    """A layer with its footprint multiplied by weights at the same pixels; without a weight a pixel does not count."""
    keys = [k for k in ("image_id", "y", "x") if k in layer.columns and k in weights.columns]
    w = weights.where("value is not null and not isnan(value)").select(*keys, F.col("value").alias("weight"))
    return layer.join(w, keys).withColumn("footprint", F.col("footprint") * F.col("weight")).drop("weight")


def layers_of(images: list[Raster] | Stack, grid: Grid, function=interpolate, weights: list[Raster] | Stack | None = None, **options) -> DataFrame:
    """All images on the grid.  Each is resampled inside its bounds only; images that miss the grid are left out.

    A stack is mapped by one plan whatever the number of its images; a list is resampled image by image, by any function.
    """
    if isinstance(images, Stack):
        if function is not interpolate or not (weights is None or isinstance(weights, Stack)):
            raise ValueError("a stack is interpolated, and its weights are a stack")
        layers = stack.resample(images, grid, **options)
        return layers if weights is None else weighted(layers, stack.resample(weights, grid, **options).select("image_id", "y", "x", "value"))
    out = []
    for k, image in enumerate(images):
        part = bounds_of(image.shape[-2:], image.wcs, grid)
        if part is None:
            continue
        layer = function(image, grid, bounds=part, **options).where("value is not null").withColumn("image_id", F.lit(k).cast("long"))
        if weights is not None:
            moved = function(weights[k], grid, bounds=part, **options)
            layer = weighted(layer, moved.select("y", "x", "value"))
        out.append(layer.select("image_id", "plane", "y", "x", "value", "footprint"))
    if not out:
        spark = images[0].pixels.sparkSession
        return spark.createDataFrame([], "image_id long, plane long, y long, x long, value double, footprint double")
    return reduce(DataFrame.unionByName, out)


def coadd(
    images: list[Raster] | Stack, target, shape=None, weights: list[Raster] | Stack | None = None, function=interpolate, how: str = "mean", match_background: bool = False,
    background_reference: int | None = None, blank: float | None = 0.0, **options,
) -> DataFrame:
    """Resample and co-add: plane, y, x, value, footprint for every pixel of the grid."""
    if not len(images):
        raise ValueError("there are no images")
    if how not in COMBINE:
        raise ValueError(f"combine function must be one of {', '.join(COMBINE)}")
    if weights is not None and len(weights) != len(images):
        raise ValueError("there must be as many weights as images")
    grid = Grid.parse(target, shape)
    layers = layers_of(images, grid, function, weights, **options)
    if match_background:
        layers = background.match(cut(layers), len(images), background_reference)
    folded = combine(layers, how)
    pixels = images.pixels.select("plane") if isinstance(images, Stack) else reduce(DataFrame.unionByName, [i.pixels.select("plane") for i in images])
    spark, planes = pixels.sparkSession, pixels.distinct()
    return fill_blank(planes.join(grid.pixels(spark)), folded, blank)
