"""Anti-aliased adaptive resampling (DeForest 2004).

Around every target pixel the coordinate map is replaced by its Jacobian; the target pixel's averaging
kernel, carried into the input by the Jacobian with singular values padded to one, weighs all input pixels
in a bounding box.  The box is exploded into pixel keys, so that the band join becomes an equi-join.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.backend import bind
from ..functions.wcs import Wcs, move
from ..raster import Grid, Raster
from .interpolate import check_pair

KERNELS = ("hann", "gaussian")
BOUNDARIES = ("strict", "constant", "grid-constant", "ignore", "ignore_threshold", "nearest")
BAD_VALUES = ("strict", "constant", "ignore")
PARTS = ("j00", "j01", "j10", "j11")


def jacobian(grid: Grid, source: Wcs, pixels: DataFrame, centered: bool = False, roundtrip: bool = True) -> DataFrame:
    """Target pixels with xi, yi and the derivatives of the input position: j00 = dx/dx', j01 = dx/dy', ...

    Without ``centered`` it is the mean of the differences to the neighbours on both sides.
    """
    h = 0.5 if centered else 1.0
    x, y = F.col("x").cast("double"), F.col("y").cast("double")
    out = move(pixels, grid.wcs, source, {"i": (x, y), "r": (x + h, y), "l": (x - h, y), "u": (x, y + h), "d": (x, y - h)}, roundtrip)
    out = out.withColumnsRenamed({f"{p}_w{a}": f"{k}{p}" for p in "irlud" for a, k in enumerate("xy")})
    d = 2 * h
    return out.select(
        *pixels.columns, "xi", "yi", ((F.col("xr") - F.col("xl")) / d).alias("j00"), ((F.col("xu") - F.col("xd")) / d).alias("j01"),
        ((F.col("yr") - F.col("yl")) / d).alias("j10"), ((F.col("yu") - F.col("yd")) / d).alias("j11"),
    )


def despike(field: DataFrame, shape: tuple[int, int]) -> DataFrame:
    """Replace Jacobians that exceed their surroundings by far.

    Where the squared size exceeds ten times the third least of the 3 x 3 pixels around (for a border pixel: around its
    inner neighbour), the mean of the adjacent Jacobians below that threshold takes its place.  Corners stay.
    """
    ny, nx = shape
    if ny < 3 or nx < 3:
        return field
    size = F.col("j00") * F.col("j00") + F.col("j01") * F.col("j01") + F.col("j10") * F.col("j10") + F.col("j11") * F.col("j11")
    base = field.withColumn("size", size)
    near = F.array(*[F.struct(F.lit(b).alias("dy"), F.lit(a).alias("dx")) for b in (-1, 0, 1) for a in (-1, 0, 1)])
    rows = base.select(*[F.col(k).alias(f"n_{k}") for k in ("y", "x", "size", *PARTS)], F.explode(near).alias("d"))
    rows = rows.select("*", (F.col("n_y") + F.col("d.dy")).alias("y"), (F.col("n_x") + F.col("d.dx")).alias("x"))
    around = rows.groupBy("y", "x").agg(F.sort_array(F.collect_list("n_size")).alias("sizes"), F.collect_list(F.struct("n_y", "n_x", "n_size", *[f"n_{k}" for k in PARTS])).alias("cells"))
    limit = around.where((F.col("y") >= 1) & (F.col("y") <= ny - 2) & (F.col("x") >= 1) & (F.col("x") <= nx - 2)).select(F.col("y").alias("cy"), F.col("x").alias("cx"), (10 * F.get("sizes", F.lit(2))).alias("limit"))
    wide = base.join(around.select("y", "x", "cells"), ["y", "x"])
    inner = lambda c, n: F.least(F.greatest(c, F.lit(1)), F.lit(n - 2)).cast("long")
    wide = wide.withColumns({"cy": inner(F.col("y"), ny), "cx": inner(F.col("x"), nx)}).join(limit, ["cy", "cx"])
    corner = F.col("y").isin(0, ny - 1) & F.col("x").isin(0, nx - 1)
    spike = ~corner & (F.col("size") > F.col("limit"))
    good = F.filter("cells", lambda c: (c["n_size"] < F.col("limit")) & ((c["n_y"] != F.col("y")) | (c["n_x"] != F.col("x"))))
    mean = lambda k: F.try_divide(F.aggregate(good, F.lit(0.0), lambda acc, c: acc + c[f"n_{k}"]), F.size(good))
    return wide.select(*[k for k in field.columns if k not in PARTS], *[F.when(spike, mean(k)).otherwise(F.col(k)).alias(k) for k in PARTS])


def singular_values(j00: Column, j01: Column, j10: Column, j11: Column) -> dict[str, Column]:
    """Rotations u, v and scales s, t of the 2 x 2 matrix; the scales are padded to one at least.

    The smaller scale of a reflection is negative and therefore becomes one.
    """
    e, f, g, h = (j00 + j11) / 2, (j00 - j11) / 2, (j10 + j01) / 2, (j10 - j01) / 2
    big, small = F.sqrt(e * e + h * h), F.sqrt(f * f + g * g)
    a1, a2 = F.atan2(g, f), F.atan2(h, e)
    return {"s": F.greatest(F.lit(1.0), big + small), "t": F.greatest(F.lit(1.0), big - small), "u": (a2 + a1) / 2, "v": (a2 - a1) / 2}


def _compose(u: Column, s: Column, t: Column, v: Column) -> list[Column]:
    """Rotation by u, scales s and t, rotation by v."""
    cu, su, cv, sv = F.cos(u), F.sin(u), F.cos(v), F.sin(v)
    return [cu * s * cv - su * t * sv, -cu * s * sv - su * t * cv, su * s * cv + cu * t * sv, -su * s * sv + cu * t * cv]


def resample(
    raster: Raster, target, shape=None, kernel: str = "gaussian", kernel_width: float = 1.3, sample_region_width: float = 4, center_jacobian: bool = False,
    despike_jacobian: bool = False, roundtrip: bool = True, conserve_flux: bool = False, boundary_mode: str = "strict", boundary_fill_value: float = 0.0,
    boundary_ignore_threshold: float = 0.5, x_cyclic: bool = False, y_cyclic: bool = False, bad_value_mode: str = "strict", bad_fill_value: float = 0.0,
    max_samples_width: float = -1, bounds=None,
) -> DataFrame:
    """Adaptive resampling: plane, y, x, value, footprint for every target pixel."""
    for value, known, what in ((kernel, KERNELS, "kernel"), (boundary_mode, BOUNDARIES, "boundary mode"), (bad_value_mode, BAD_VALUES, "bad value mode")):
        if value not in known:
            raise ValueError(f"unknown {what}: {value}")
    grid = Grid.parse(target, shape)
    check_pair(raster.wcs, grid.wcs)
    spark = raster.pixels.sparkSession
    ny, nx = raster.ny, raster.nx
    pixels = grid.pixels(spark, bounds)
    field = jacobian(grid, raster.wcs, grid.pixels(spark) if despike_jacobian else pixels, center_jacobian, roundtrip)
    if despike_jacobian:
        field = despike(field, (grid.ny, grid.nx))
        if bounds:
            field = field.join(pixels, ["y", "x"])
    field = field.where(" and ".join(f"{k} is not null and not isnan({k})" for k in ("xi", "yi", *PARTS)))
    svd = singular_values(*[F.col(k) for k in PARTS])
    field = bind(field, {"det": F.abs(F.col("j00") * F.col("j11") - F.col("j01") * F.col("j10")), **svd})
    s, t = F.col("s"), F.col("t")
    p = _compose(F.col("u"), s, t, F.col("v"))
    q = _compose(-F.col("v"), 1 / s, 1 / t, -F.col("u"))
    field = bind(field, {f"p{i}": x for i, x in enumerate(p)} | {f"q{i}": x for i, x in enumerate(q)} | {"least": F.least(1 / s, 1 / t)})
    if kernel == "hann":
        half_x, half_y = F.abs("p0") + F.abs("p1"), F.abs("p2") + F.abs("p3")
    else:
        half_x = half_y = F.lit(float(sample_region_width)) / (2 * F.col("least"))
    field = bind(field, {"hx": half_x, "hy": half_y})
    if max_samples_width > 0:
        field = field.where(2 * F.greatest("hx", "hy") <= max_samples_width)
    box = {"left": F.ceil(F.col("xi") - F.col("hx")), "right": F.floor(F.col("xi") + F.col("hx")), "bottom": F.ceil(F.col("yi") - F.col("hy")), "top": F.floor(F.col("yi") + F.col("hy"))}
    field = bind(field, {k: v.cast("long") for k, v in box.items()})
    axes = [("left", "right", nx, x_cyclic), ("bottom", "top", ny, y_cyclic)]
    outside = F.lit(False)
    for low, high, n, cyclic in axes:
        if cyclic:
            continue
        if boundary_mode == "strict":
            field = field.where((F.col(low) >= 0) & (F.col(high) <= n - 1))
        elif boundary_mode == "ignore":
            field = field.withColumns({low: F.greatest(F.col(low), F.lit(0).cast("long")), high: F.least(F.col(high), F.lit(n - 1).cast("long"))})
        outside = outside | (F.col(high) < 0) | (F.col(low) > n - 1)
    beyond = None
    if boundary_mode == "grid-constant":
        beyond = field.where(outside).select("y", "x")
    if boundary_mode != "nearest":
        field = field.where(~outside)
    else:
        # far outside one row or column of the nearest values is enough, and an empty box still takes one
        for low, high, _, cyclic in axes:
            field = field.withColumn(high, F.when(outside, F.greatest(F.col(low), F.col(high))).otherwise(F.col(high)))
    field = field.where("left <= right and bottom <= top")
    ox, oy = F.col("px") - F.col("xi"), F.col("py") - F.col("yi")
    boxed = field.select("y", "x", "xi", "yi", "det", "q0", "q1", "q2", "q3", "left", "right", F.explode(F.sequence("bottom", "top")).alias("py")).select("*", F.explode(F.sequence("left", "right")).alias("px"))
    a, b = F.col("q0") * ox + F.col("q1") * oy, F.col("q2") * ox + F.col("q3") * oy
    boxed = bind(boxed.select("y", "x", "det", "px", "py", "xi", "yi", "q0", "q1", "q2", "q3"), {"a": a, "b": b})
    if kernel == "hann":
        weight = F.when((F.abs("a") < 1) & (F.abs("b") < 1), (F.cos(F.col("a") * math.pi) + 1) * (F.cos(F.col("b") * math.pi) + 1)).otherwise(0.0)
    else:
        weight = F.exp((F.col("a") * F.col("a") + F.col("b") * F.col("b")) * (-2 / (kernel_width * kernel_width)))
    boxed = bind(boxed.select("y", "x", "det", "px", "py", "a", "b"), {"w": weight}).where("w > 0")

    def placed(c: str, n: int, cyclic: bool) -> Column:
        if cyclic:
            return F.pmod(F.col(c), F.lit(n))
        if boundary_mode == "nearest":
            return F.greatest(F.lit(0), F.least(F.lit(n - 1), F.col(c))).cast("long")
        return F.col(c)

    boxed = boxed.select("y", "x", "det", "w", placed("py", ny, y_cyclic).alias("sy"), placed("px", nx, x_cyclic).alias("sx"))
    inner = (F.col("sy") >= 0) & (F.col("sy") < ny) & (F.col("sx") >= 0) & (F.col("sx") < nx)
    data = raster.dense() if boundary_mode in ("constant", "grid-constant", "ignore_threshold") or bad_value_mode != "ignore" else raster.pixels
    right = data.select("plane", F.col("y").alias("sy"), F.col("x").alias("sx"), F.col("value").alias("v"), F.lit(True).alias("there"))
    planes = raster.pixels.select("plane").distinct()
    # the optimiser takes boxes for as small as the target: without the hint it broadcasts their pixels through the driver
    joined = boxed.where(inner).join(right.hint("merge"), ["sy", "sx"])
    if boundary_mode in ("constant", "grid-constant", "ignore_threshold"):
        fill = F.lit(float(boundary_fill_value)) if boundary_mode != "ignore_threshold" else F.lit(None).cast("double")
        joined = joined.unionByName(boxed.where(~inner).join(planes).withColumns({"v": fill, "there": F.lit(False)}))
    bad = F.col("v").isNull() | F.isnan("v") | (F.abs("v") == float("inf"))
    counts = F.col("there") | F.lit(boundary_mode in ("constant", "grid-constant"))
    if bad_value_mode == "constant":
        joined = joined.withColumn("v", F.when(counts & bad, F.lit(float(bad_fill_value))).otherwise(F.col("v")))
    used = counts & ~bad
    sums = joined.groupBy("plane", "y", "x").agg(
        F.sum(F.when(used, F.col("w") * F.col("v"))).alias("total"), F.sum(F.when(used, F.col("w"))).alias("weight"), F.first("det").alias("det"),
        F.sum(F.when(~F.col("there"), F.col("w")).otherwise(0.0)).alias("ignored"), F.max((counts & bad).cast("int")).alias("bad"),
    )
    value = F.try_divide("total", "weight")
    if conserve_flux:
        value = value * F.col("det")
    if bad_value_mode == "strict":
        value = F.when(F.col("bad") == 0, value)
    if boundary_mode == "ignore_threshold":
        value = F.when(F.try_divide(F.col("ignored"), F.col("ignored") + F.coalesce("weight", F.lit(0.0))) <= boundary_ignore_threshold, value)
    hits = sums.select("plane", "y", "x", value.alias("value"))
    if beyond is not None:
        hits = hits.unionByName(beyond.join(planes).select("plane", "y", "x", F.lit(float(boundary_fill_value)).alias("value")))
    out = planes.join(pixels).join(hits, ["plane", "y", "x"], "left")
    return out.select("plane", "y", "x", "value", F.col("value").isNotNull().cast("double").alias("footprint"))
