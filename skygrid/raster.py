"""Rasters and target grids: the data model of the engine.

A raster is a DataFrame of pixels (plane, y, x, value) with a coordinate description.  Planes share the
description; "no data" is NULL, and a pixel without a row has no data either.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.wcs import OwnWcs, Wcs


@dataclass(frozen=True)
class Grid:
    """A target: coordinate description and shape (ny, nx)."""

    wcs: Wcs
    shape: tuple[int, ...]

    def __post_init__(self):
        if not self.shape:
            raise ValueError("the shape of the target is empty")
        if len(self.shape) != self.wcs.naxis:
            raise ValueError("shape and coordinate description differ in dimensions")

    @property
    def ny(self) -> int:
        return int(self.shape[-2])

    @property
    def nx(self) -> int:
        return int(self.shape[-1])

    @staticmethod
    def parse(target, shape: tuple[int, ...] | None = None) -> Grid:
        """From a Grid, a header (whose NAXISn wins over ``shape``), or a Wcs with a shape."""
        if isinstance(target, Grid):
            return target
        wcs = Wcs.from_header(target) if isinstance(target, dict) else target
        if not isinstance(wcs, (Wcs, OwnWcs)):
            raise TypeError("the target must be a header, a coordinate description or a grid")
        own = wcs.shape if isinstance(target, dict) and wcs.shape else shape or wcs.shape
        if own is None:
            raise ValueError("the shape of the target has to be given")
        return Grid(wcs, tuple(int(n) for n in own))

    @property
    def nz(self) -> int:
        """Length of the third axis; 1 for an image."""
        return int(self.shape[-3]) if self.wcs.naxis == 3 else 1

    def cells(self, spark: SparkSession) -> DataFrame:
        """All positions (z, y, x) of a cube."""
        ids = spark.range(self.nz * self.ny * self.nx)
        return ids.select(F.expr(f"id div {self.ny * self.nx}").alias("z"), F.expr(f"id div {self.nx} % {self.ny}").alias("y"), F.pmod("id", F.lit(self.nx)).alias("x"))

    def pixels(self, spark: SparkSession, bounds: tuple[int, int, int, int] | None = None) -> DataFrame:
        """All pixel positions (y, x), or those with y0 <= y < y1, x0 <= x < x1."""
        y0, y1, x0, x1 = bounds or (0, self.ny, 0, self.nx)
        y0, y1, x0, x1 = max(0, y0), min(self.ny, y1), max(0, x0), min(self.nx, x1)
        width = max(0, x1 - x0)
        ids = spark.range(max(0, y1 - y0) * width)
        return ids.select((F.expr(f"id div {max(1, width)}") + y0).alias("y"), (F.pmod("id", F.lit(max(1, width))) + x0).alias("x"))


@dataclass(frozen=True)
class Raster:
    """Pixels (plane, y, x, value), their description and the shape of a plane, or of a cube.

    With a description of three axes, a plane is a place on the third one: plane = z, and z + nz k in the k-th of several
    cubes that share the description.
    """

    pixels: DataFrame
    wcs: Wcs
    shape: tuple[int, ...]

    def __post_init__(self):
        if len(self.shape) != self.wcs.naxis:
            raise ValueError("shape and coordinate description differ in dimensions")

    @property
    def ny(self) -> int:
        return int(self.shape[-2])

    @property
    def nx(self) -> int:
        return int(self.shape[-1])

    @property
    def nz(self) -> int:
        """Length of the third axis; 1 for an image."""
        return int(self.shape[-3]) if self.wcs.naxis == 3 else 1

    @property
    def grid(self) -> Grid:
        return Grid(self.wcs, self.shape)

    @staticmethod
    def of(pixels: DataFrame, wcs: Wcs, shape: tuple[int, ...]) -> Raster:
        """From any DataFrame with y, x, value and perhaps plane; NaN becomes NULL."""
        plane = F.col("plane").cast("long") if "plane" in pixels.columns else F.lit(0).cast("long")
        value = F.col("value").cast("double")
        own = pixels.select(plane.alias("plane"), F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), F.when(~F.isnan(value), value).alias("value"))
        return Raster(own, wcs, tuple(shape))

    @staticmethod
    def from_array(spark: SparkSession, array: np.ndarray, wcs: Wcs) -> Raster:
        """From a numpy array; axes before the last two are planes."""
        a = np.asarray(array, float)
        if a.ndim < 2:
            raise ValueError("an image has two axes at least")
        flat = a.reshape(-1, *a.shape[-2:])
        k, y, x = (v.ravel() for v in np.indices(flat.shape))
        import pyarrow as pa

        v = flat.ravel()
        table = pa.table({"plane": pa.array(k), "y": pa.array(y), "x": pa.array(x), "value": pa.array(v, mask=np.isnan(v))})
        return Raster.of(spark.createDataFrame(table), wcs, a.shape[-2:] if wcs.naxis == 2 else a.shape)

    def dense(self) -> DataFrame:
        """One row for every pixel of every plane that occurs; what has no row is NULL."""
        spark = self.pixels.sparkSession
        planes = self.pixels.select("plane").distinct()
        full = planes.join(self.grid.pixels(spark))
        return full.join(self.pixels, ["plane", "y", "x"], "left")


def to_array(pixels: DataFrame, shape: tuple[int, int], column: str = "value") -> np.ndarray:
    """An array (planes, ny, nx) on the driver; NULL and missing become NaN.  For results that fit it."""
    t = pixels.select("plane" if "plane" in pixels.columns else F.lit(0).alias("plane"), "y", "x", F.col(column).cast("double").alias("v")).toArrow()
    plane, y, x = (np.asarray(t.column(k)).astype(int) for k in ("plane", "y", "x"))
    v = np.asarray(t.column("v").to_pandas(), float)
    out = np.full((plane.max() + 1 if len(plane) else 1, *shape), np.nan)
    out[plane, y, x] = v
    return out
