"""Flux-exact resampling by the overlap of pixels on the sky.

Every input pixel's corners are carried into the target; its bounding box there gives candidate pixels, as
rows that meet the target's corners by an equi-join.  Areas of overlap are computed for Arrow batches of
pairs, and two sums give value and footprint.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions import polygons
from ..functions.backend import bind
from ..functions.wcs import Wcs, from_sky, to_sky
from ..raster import Grid, Raster

D2R = math.pi / 180
CORNERS = ((-0.5, -0.5), (0.5, -0.5), (0.5, 0.5), (-0.5, 0.5))


def corners(pixels: DataFrame, wcs: Wcs, frame: str, name: str) -> DataFrame:
    """Add the sky positions of the four corners of pixel (y, x) in a frame: ``<name>_lon0``, ``<name>_lat0``, ..."""
    points = {f"{name}{k}": (F.col("x") + dx, F.col("y") + dy) for k, (dx, dy) in enumerate(CORNERS)}
    i, j = wcs.celestial
    return to_sky(pixels, wcs, points, frame).withColumnsRenamed({f"{name}{k}_w{a}": f"{name}_{n}{k}" for k in range(4) for a, n in ((i, "lon"), (j, "lat"))})


@F.pandas_udf(DoubleType())
def overlap_area(*cells: pd.Series) -> pd.Series:
    """Overlap of two quadrilaterals in steradians: lon, lat of four corners each, in degrees."""
    arrays = [np.asarray(c, float) * D2R for c in cells]
    lon1, lat1, lon2, lat2 = (np.stack(arrays[k : k + 8 : 2], 1) for k in (0, 1, 8, 9))
    return pd.Series(polygons.overlap(lon1, lat1, lon2, lat2))


def area(a: str, b: str) -> Column:
    cells = [f"{p}_{k}{i}" for p in (a, b) for i in range(4) for k in ("lon", "lat")]
    return overlap_area(*cells)


def resample(raster: Raster, target, shape=None, bounds=None) -> DataFrame:
    """Exact resampling of two-dimensional celestial images: plane, y, x, value, footprint.

    The value is the overlap-weighted mean, the footprint the covered share of the pixel.  An input pixel without a value
    leaves every pixel that it overlaps without one; it still counts as covering.
    """
    grid = Grid.parse(target, shape)
    if raster.wcs.naxis != 2 or grid.wcs.naxis != 2 or not raster.wcs.has_celestial or not grid.wcs.has_celestial:
        raise ValueError("exact resampling needs two-dimensional celestial images")
    spark = raster.pixels.sparkSession
    if grid.wcs.pixel_scale() < 1e-6 / 3600:
        import warnings

        warnings.warn("pixels are so small that areas lose precision", stacklevel=2)
    frame = grid.wcs.sky
    out_pixels = grid.pixels(spark, bounds)
    # geometry once for all planes
    inner = corners(raster.grid.pixels(spark), raster.wcs, frame, "a")
    i, j = grid.wcs.celestial
    inner = inner.withColumns({f"p{k}_w{i}": F.col(f"a_lon{k}") for k in range(4)} | {f"p{k}_w{j}": F.col(f"a_lat{k}") for k in range(4)})
    inner = from_sky(inner, grid.wcs, [f"p{k}" for k in range(4)]).withColumnsRenamed({f"p{k}_w{a}": f"{n}{k}" for k in range(4) for a, n in ((0, "px"), (1, "py"))})
    inner = inner.where(" and ".join(f"{c}{k} is not null and not isnan({c}{k})" for c in ("px", "py") for k in range(4)))
    low = lambda c: F.floor(F.least(*[F.col(f"{c}{k}") for k in range(4)]) + 0.5)
    high = lambda c: F.floor(F.greatest(*[F.col(f"{c}{k}") for k in range(4)]) + 0.5)
    y0, y1, x0, x1 = bounds or (0, grid.ny, 0, grid.nx)
    box = {"l": F.greatest(low("px"), F.lit(x0)), "r": F.least(high("px"), F.lit(x1 - 1)), "b": F.greatest(low("py"), F.lit(y0)), "t": F.least(high("py"), F.lit(y1 - 1))}
    inner = bind(inner, {k: v.cast("long") for k, v in box.items()}).where("l <= r and b <= t")
    own = [f"a_{k}{n}" for n in range(4) for k in ("lon", "lat")]
    pairs = inner.select(F.col("y").alias("sy"), F.col("x").alias("sx"), *own, "l", "r", F.explode(F.sequence("b", "t")).alias("y")).select("sy", "sx", "y", *own, F.explode(F.sequence("l", "r")).alias("x"))
    pairs = corners(pairs, grid.wcs, frame, "b")
    pairs = pairs.select("sy", "sx", "y", "x", area("a", "b").alias("shared")).where("shared > 0")
    whole = corners(out_pixels, grid.wcs, frame, "a").select("y", "x", area("a", "a").alias("whole"))
    data = raster.dense().select("plane", F.col("y").alias("sy"), F.col("x").alias("sx"), "value")
    sums = pairs.join(data, ["sy", "sx"]).groupBy("plane", "y", "x").agg(
        F.sum(F.col("shared") * F.col("value")).alias("flux"), F.sum("shared").alias("shared"), F.max((F.col("value").isNull() | F.isnan("value")).cast("int")).alias("bad")
    )
    planes = raster.pixels.select("plane").distinct()
    out = planes.join(whole).join(sums, ["plane", "y", "x"], "left")
    value = F.when(F.col("bad") == 0, F.try_divide("flux", "shared"))
    return out.select("plane", "y", "x", value.alias("value"), F.coalesce(F.try_divide("shared", "whole"), F.lit(0.0)).alias("footprint"))
