"""Many images as one table: their descriptions are rows, and one plan maps them all.

The parameters of every image (pole, linear part, shape, bounds in the target) are a table with a row an image, so the
plan does not grow with their number.  Images of one stack share the kind of their axes: projection, frame, axis order.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.backend import ColumnMath, bind
from ..functions.wcs import PROJECTIONS, Wcs, from_sky, to_sky
from ..raster import Grid, Raster
from .bounds import bounds_of
from .interpolate import check_pair, order_number

PARAMETERS = "image_id long, y0 long, y1 long, x0 long, x1 long, ny long, nx long, a double, sd double, cd double, turn double, m00 double, m01 double, m10 double, m11 double, i00 double, i01 double, i10 double, i11 double, c0 double, c1 double"
_NAMES = [p.strip().split(" ")[0] for p in PARAMETERS.split(",")]


@dataclass(frozen=True)
class Stack:
    """Pixels (image_id, plane, y, x, value) of all images, and each image's shape and description by its id."""

    pixels: DataFrame
    images: tuple[tuple[tuple[int, int], Wcs], ...]

    def __post_init__(self):
        kinds = {(w.naxis, w.celestial, w.projection(w.celestial[0]) if w.has_celestial else w.ctype, w.sky if w.has_celestial else None) for _, w in self.images}
        if len(kinds) > 1 or any(w.naxis != 2 for _, w in self.images):
            raise ValueError("images of a stack are two-dimensional and share projection, frame and order of axes")

    def __len__(self) -> int:
        return len(self.images)

    @staticmethod
    def of(rasters: list[Raster]) -> Stack:
        """From single images; here the plan of the pixels, not that of the map, grows with their number."""
        parts = [r.pixels.select(F.lit(k).cast("long").alias("image_id"), "plane", "y", "x", "value") for k, r in enumerate(rasters)]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return Stack(out, tuple(((r.ny, r.nx), r.wcs) for r in rasters))


def parameters(stack: Stack, grid: Grid) -> list[tuple]:
    """A row for each image that the target may show."""
    out = []
    for k, ((ny, nx), wcs) in enumerate(stack.images):
        part = bounds_of((ny, nx), wcs, grid)
        if part is None:
            continue
        if wcs.has_celestial:
            a, pole, turn = wcs._pole()
            pole *= math.pi / 180
            sky = (float(a), math.sin(pole), math.cos(pole), float(turn))
        else:
            sky = (float(wcs.crval[0]), float(wcs.crval[1]), 0.0, 0.0)
        m = np.diag(wcs.cdelt) @ wcs.matrix
        out.append((k, *map(int, part), ny, nx, *sky, *map(float, m.ravel()), *map(float, np.linalg.inv(m).ravel()), float(wcs.crpix[0] - 1), float(wcs.crpix[1] - 1)))
    return out


def _rotated(df: DataFrame, first, second, shift, low: float, names: tuple[str, str]) -> DataFrame:
    """Angles about the native pole, whose latitude is a column, as two columns."""
    c = F.cos(F.radians(second))
    cells = {
        "_vx": F.sin(F.radians(second)) * F.col("cd") - c * F.cos(F.radians(first)) * F.col("sd"), "_vy": -c * F.sin(F.radians(first)),
        "_vz": F.sin(F.radians(second)) * F.col("sd") + c * F.cos(F.radians(first)) * F.col("cd"),
    }
    df = bind(df, cells)
    x, y, z = (F.col(k) for k in cells)
    return bind(df, {names[0]: F.pmod(F.degrees(F.atan2(y, x)) + (shift - low), F.lit(360.0)) + low, names[1]: F.degrees(F.atan2(z, F.sqrt(x * x + y * y)))}).drop(*cells)


def places(stack: Stack, grid: Grid, roundtrip: bool = True) -> DataFrame:
    """The target's pixels in each image's bounds with their position in it: image_id, y, x, ny, nx, xi, yi."""
    spark, wcs = stack.pixels.sparkSession, stack.images[0][1]
    check_pair(wcs, grid.wcs)
    rows = spark.createDataFrame(parameters(stack, grid), PARAMETERS)
    df = rows.select("*", F.explode(F.sequence(F.col("y0"), F.col("y1") - 1)).alias("y")).select("*", F.explode(F.sequence(F.col("x0"), F.col("x1") - 1)).alias("x"))
    at = (F.col("x").cast("double"), F.col("y").cast("double"))
    if wcs.has_celestial:
        i, j = grid.wcs.celestial
        to_native, to_plane, _ = PROJECTIONS[wcs.projection(wcs.celestial[0])]
        df = to_sky(df, grid.wcs, {"s": at}, wcs.sky)
        df = _rotated(df, F.col(f"s_w{i}") - F.col("a"), F.col(f"s_w{j}"), F.col("turn"), -180.0, ("_phi", "_theta"))
        plane = to_plane(ColumnMath, F.col("_phi"), F.col("_theta"))
        u, v = plane if wcs.celestial == (0, 1) else plane[::-1]
    else:
        df = to_sky(df, grid.wcs, {"s": at})
        u, v = F.col("s_w0") - F.col("a"), F.col("s_w1") - F.col("sd")
    df = bind(df, {"_u": u, "_v": v})
    df = bind(df, {"xi": F.col("i00") * F.col("_u") + F.col("i01") * F.col("_v") + F.col("c0"), "yi": F.col("i10") * F.col("_u") + F.col("i11") * F.col("_v") + F.col("c1")})
    if roundtrip and wcs.has_celestial:
        px, py = F.col("xi") - F.col("c0"), F.col("yi") - F.col("c1")
        df = bind(df, {"_u": F.col("m00") * px + F.col("m01") * py, "_v": F.col("m10") * px + F.col("m11") * py})
        a, b = ("_u", "_v") if wcs.celestial == (0, 1) else ("_v", "_u")
        phi, theta = to_native(ColumnMath, F.col(a), F.col(b))
        df = bind(df, {"_phi": phi, "_theta": theta})
        df = _rotated(df, F.col("_phi") - F.col("turn"), F.col("_theta"), F.col("a"), 0.0, (f"b_w{i}", f"b_w{j}"))
        df = from_sky(df, grid.wcs, ["b"], wcs.sky)
        near = (F.abs(F.col("b_w0") - at[0]) <= 1) & (F.abs(F.col("b_w1") - at[1]) <= 1)
        df = df.where(near)
    good = F.col("xi").isNotNull() & F.col("yi").isNotNull() & ~F.isnan("xi") & ~F.isnan("yi")
    return df.where(good).select("image_id", "y", "x", "ny", "nx", "xi", "yi")


def resample(stack: Stack, grid: Grid, order: str | int = "bilinear", roundtrip: bool = True) -> DataFrame:
    """All images on the grid: image_id, plane, y, x, value, footprint of the pixels that have a value."""
    k = order_number(order)
    if k > 1:
        raise ValueError("a stack is resampled by nearest-neighbor or bilinear")
    x, y, nx, ny = (F.col(c) for c in ("xi", "yi", "nx", "ny"))
    ok = places(stack, grid, roundtrip).where((x >= -0.5) & (x < nx - 0.5) & (y >= -0.5) & (y < ny - 0.5))
    ok = bind(ok, {"xi": F.greatest(F.lit(0.0), F.least(nx - 1.0, x)), "yi": F.greatest(F.lit(0.0), F.least(ny - 1.0, y))})
    right = stack.pixels.where("value is not null").select("image_id", "plane", F.col("y").alias("sy"), F.col("x").alias("sx"), F.col("value").alias("v"))
    on = ["image_id", "sy", "sx"]
    if k == 0:
        near = ok.select("image_id", "y", "x", F.floor(y + 0.5).cast("long").alias("sy"), F.floor(x + 0.5).cast("long").alias("sx"))
        return near.join(right, on).select("image_id", "plane", "y", "x", F.col("v").alias("value"), F.lit(1.0).alias("footprint"))
    spot = lambda c, n: [(F.floor(c).cast("long"), 1 - (c - F.floor(c))), (F.least(F.floor(c).cast("long") + 1, n - 1), c - F.floor(c))]
    taps = [F.struct(F.lit(2 * b + a).alias("tap"), sy.alias("sy"), sx.alias("sx"), (wy * wx).alias("w")) for b, (sy, wy) in enumerate(spot(y, ny)) for a, (sx, wx) in enumerate(spot(x, nx))]
    long = ok.select("image_id", "y", "x", F.inline(F.array(*taps))).join(right, on)
    got = long.groupBy("image_id", "plane", "y", "x").agg(*[F.max(F.when(F.col("tap") == t, F.col("w") * F.col("v"))).alias(f"t{t}") for t in range(4)])
    value = F.col("t0") + F.col("t1") + F.col("t2") + F.col("t3")
    return got.select("image_id", "plane", "y", "x", value.alias("value"), F.lit(1.0).alias("footprint")).where("value is not null")
