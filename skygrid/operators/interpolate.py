"""Interpolation: each target pixel is carried to its place in the input and joined with its neighbours.

The coordinate map is part of the plan.  Positions outside [-0.5, n - 0.5) have no value, those in the
outer half of a border pixel count as its centre.  Neighbours are numbered, so that a pixel's value is one
expression of fixed order over its neighbours, whatever the order in which they arrive.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.backend import bind
from ..functions.wcs import Wcs, move
from ..raster import Grid, Raster

ORDERS = {"nearest-neighbor": 0, "nearest": 0, "bilinear": 1, "biquadratic": 2, "bicubic": 3}


def order_number(order: str | int) -> int:
    if isinstance(order, str):
        if order not in ORDERS:
            raise ValueError(f"unknown order: {order}")
        return ORDERS[order]
    if order not in (0, 1, 2, 3):
        raise ValueError("order must be 0, 1, 2 or 3")
    return order


def check_pair(source: Wcs, target: Wcs) -> None:
    """Descriptions must agree in dimensions and in the kinds of their axes."""
    if source.naxis != target.naxis:
        raise ValueError(f"Number of dimensions in input and output WCS should match (got {source.naxis} and {target.naxis})")
    for a, b, one, other in ((source, target, "Input", "output"), (target, source, "Output", "input")):
        if a.has_celestial and not b.has_celestial:
            raise ValueError(f"{one} WCS has celestial components but {other} WCS does not")
    if source.has_spectral and target.has_spectral:
        kinds = source.ctype[source.spectral], target.ctype[target.spectral]
        if kinds[0][:4] != kinds[1][:4]:
            raise ValueError(f"The input ({kinds[0]}) and output ({kinds[1]}) spectral coordinate types are not equivalent.")
    for a, b, one, other in ((source, target, "Input", "output"), (target, source, "Output", "input")):
        if a.has_spectral and not b.has_spectral:
            raise ValueError(f"{one} WCS has a spectral component but {other} WCS does not")


def mapped(grid: Grid, source: Wcs, pixels: DataFrame, roundtrip: bool = True) -> DataFrame:
    """Target pixels with their position (xi, yi) in the input; NULL where there is none."""
    out = move(pixels, grid.wcs, source, {"at": (F.col("x").cast("double"), F.col("y").cast("double"))}, roundtrip)
    return out.withColumnsRenamed({"at_w0": "xi", "at_w1": "yi"})


def inside(c: Column, n: int) -> Column:
    return (c >= -0.5) & (c < n - 0.5)


def clamp(c: Column, n: int) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(float(n - 1)), c))


def _mirror(i: Column, n: int) -> Column:
    """Index reflected about the centres of the border pixels."""
    if n == 1:
        return F.lit(0).cast("long")
    m = F.pmod(i, F.lit(2 * n - 2))
    return F.when(m >= n, 2 * n - 2 - m).otherwise(m)


def spline_weights(t: Column, order: int) -> list[Column]:
    """Weights of the B-spline of an order at distance t from the first tap's base."""
    if order == 2:
        return [0.5 * (0.5 - t) * (0.5 - t), 0.75 - t * t, 0.5 * (0.5 + t) * (0.5 + t)]
    u = 1 - t
    return [u * u * u / 6, (4 - 6 * t * t + 3 * t * t * t) / 6, (4 - 6 * u * u + 3 * u * u * u) / 6, t * t * t / 6]


def _taps(c: Column, n: int, order: int) -> tuple[list[Column], list[Column]]:
    """(indices, weights) along one axis, for a clamped coordinate."""
    if order == 0:
        return [F.floor(c + 0.5).cast("long")], [F.lit(1.0)]
    if order == 1:
        base = F.floor(c)
        t = c - base
        return [base.cast("long"), F.least(base.cast("long") + 1, F.lit(n - 1).cast("long"))], [1 - t, t]
    base = F.floor(c + 0.5) if order == 2 else F.floor(c)
    w = spline_weights(c - base, order)
    return [_mirror(base.cast("long") + k, n) for k in range(-1, order)], w


def interpolate(raster: Raster, target, order: str | int = "bilinear", shape=None, roundtrip: bool = True, bounds=None, fixed: int = 0) -> DataFrame:
    """Resample onto a grid: plane, y, x, value, footprint for every target pixel.

    The footprint is 1 where a value was found.  A missing neighbour makes the value missing.  The map is made once and
    shared by all planes.  ``bounds`` restricts the target to y0 <= y < y1, x0 <= x < x1.  Descriptions of three axes map
    whole cubes, along all axes; ``fixed`` = 1 leaves the third one alone: each plane is resampled by itself.
    """
    grid, k = Grid.parse(target, shape), order_number(order)
    check_pair(raster.wcs, grid.wcs)
    if fixed:
        return _by_plane(raster, grid, k, roundtrip, bounds, fixed)
    if raster.wcs.naxis == 3:
        if bounds is not None:
            raise ValueError("bounds restrict images, not cubes")
        return _cube(raster, grid, k, roundtrip)
    if raster.wcs.naxis != 2:
        raise ValueError("maps have two or three axes")
    spark = raster.pixels.sparkSession
    places = mapped(grid, raster.wcs, grid.pixels(spark, bounds), roundtrip)
    data = raster.pixels if k < 2 else spline_coefficients(raster, k)
    out = sample(places, data, raster.shape, k, every=raster.pixels.select("plane").distinct().join(grid.pixels(spark, bounds)))
    return out.select("plane", "y", "x", "value", F.col("value").isNotNull().cast("double").alias("footprint"))


def _by_plane(raster: Raster, grid: Grid, order: int, roundtrip: bool, bounds, fixed: int) -> DataFrame:
    """Planes one to one: the descriptions are sliced to their first two axes."""
    if fixed != 1 or raster.wcs.naxis != 3:
        raise ValueError("one axis of three can be left alone")
    if raster.nz != grid.nz:
        raise ValueError("Dimensions to be looped over must match exactly")
    flat = Raster(raster.pixels, raster.wcs.without_axis(2), raster.shape[-2:])
    return interpolate(flat, Grid(grid.wcs.without_axis(2), grid.shape[-2:]), order, None, roundtrip, bounds)


def _cube(raster: Raster, grid: Grid, order: int, roundtrip: bool) -> DataFrame:
    """Three axes at once; cubes that share the description share the map."""
    spark = raster.pixels.sparkSession
    at = tuple(F.col(k).cast("double") for k in "xyz")
    places = move(grid.cells(spark), grid.wcs, raster.wcs, {"at": at}, roundtrip).withColumnsRenamed({f"at_w{i}": f"{k}i" for i, k in enumerate("xyz")})
    data = raster.pixels if order < 2 else spline_coefficients(raster, order)
    cube = data.select(F.expr(f"plane div {raster.nz}").alias("plane"), F.pmod("plane", F.lit(raster.nz)).alias("z"), "y", "x", "value")
    cubes = raster.pixels.select(F.expr(f"plane div {raster.nz}").alias("plane")).distinct()
    out = sample(places, cube, raster.shape, order, keys=("z", "y", "x"), axes="xyz", every=cubes.join(grid.cells(spark)))
    return out.select((F.col("plane") * grid.nz + F.col("z")).alias("plane"), "y", "x", "value", F.col("value").isNotNull().cast("double").alias("footprint"))


def sample(places: DataFrame, data: DataFrame, shape: tuple[int, ...], order: int, keys: tuple[str, ...] = ("y", "x"), axes: str = "xy", every: DataFrame | None = None) -> DataFrame:
    """Values of ``data`` at the positions (xi, yi, and zi of a cube): plane, keys and value; only positions inside have rows.

    ``every`` (plane, keys) gives each of its rows a row of the result, NULL where nothing was found.  They go into the
    shuffle of the neighbours, so that pixels without a value cost no join of their own.
    """
    length = dict(zip("xyz", reversed(shape)))
    within = inside(F.col("xi"), length["x"])
    for a in axes[1:]:
        within = within & inside(F.col(f"{a}i"), length[a])
    ok = bind(places.where(within), {f"{a}i": clamp(F.col(f"{a}i"), length[a]) for a in axes})
    taps = {a: _taps(F.col(f"{a}i"), length[a], order) for a in axes}
    spots = [f"s{a}" for a in reversed(axes)]
    right = data.select("plane", *[F.col(a).alias(f"s{a}") for a in axes], F.col("value").alias("v"))
    if order == 0:
        near = ok.select(*keys, *[taps[a][0][0].alias(f"s{a}") for a in axes])
        got = near.join(right, spots).select("plane", *keys, F.col("v").alias("value"))
        if every is None:
            return got
        return got.unionByName(every.select("plane", *keys, F.lit(None).cast("double").alias("value"))).groupBy("plane", *keys).agg(F.max("value").alias("value"))
    n = len(taps["x"][0])
    # the neighbours along one axis after another, the last axis first, numbered in C order
    long, tap, weight = ok, F.lit(0), None
    for done, a in enumerate(reversed(axes)):
        at, w = taps[a]
        near = F.inline(F.array(*[F.struct(F.lit(i).alias(f"{a}_tap"), p.alias(f"s{a}"), w[i].alias(f"{a}_w")) for i, p in enumerate(at)]))
        before = [f"{b}{e}" for b in axes[::-1][:done] for e in ("_tap", "_w")] + spots[:done]
        long = long.select(*keys, *[f"{b}i" for b in axes[::-1][done + 1 :]], *before, near)
        tap = tap * n + F.col(f"{a}_tap")
        weight = F.col(f"{a}_w") if weight is None else weight * F.col(f"{a}_w")
    long = long.select(*keys, tap.alias("tap"), *spots, weight.alias("w")).join(right, spots).select("plane", *keys, "tap", "w", "v")
    if every is not None:
        long = long.unionByName(every.select("plane", *keys, F.lit(-1).alias("tap"), F.lit(0.0).alias("w"), F.lit(None).cast("double").alias("v")))
    # the weighted neighbours in fixed order; one is missing if fewer than all have a value
    count = n ** len(axes)
    terms = [F.max(F.when(F.col("tap") == t, F.col("w") * F.col("v"))).alias(f"t{t}") for t in range(count)]
    got = long.groupBy("plane", *keys).agg(*terms)
    total = F.col("t0")
    for t in range(1, count):
        total = total + F.col(f"t{t}")
    return got.select("plane", *keys, total.alias("value"))


POLES = {2: [math.sqrt(8) - 3], 3: [math.sqrt(3) - 2]}


def prefilter(rows: np.ndarray, order: int) -> np.ndarray:
    """B-spline coefficients along the last axis, mirrored at the border pixels (Unser 1999)."""
    c = np.array(rows, float)
    n = c.shape[-1]
    if n == 1:
        return c
    for z in POLES[order]:
        c *= (1 - z) * (1 - 1 / z)
        k = np.arange(n)
        # the exact sum over the mirrored signal
        zn = z ** (n - 1)
        weights = z**k.astype(float)
        tail = np.zeros(n)
        tail[1 : n - 1] = (z ** (2 * (n - 1) - k[1 : n - 1]).astype(float))
        first = (c * (weights + tail)).sum(-1) / (1 - zn * zn)
        c[..., 0] = first
        for i in range(1, n):
            c[..., i] += z * c[..., i - 1]
        c[..., n - 1] = (z / (z * z - 1)) * (c[..., n - 1] + z * c[..., n - 2])
        for i in range(n - 2, -1, -1):
            c[..., i] = z * (c[..., i + 1] - c[..., i])
    return c


def spline_coefficients(raster: Raster, order: int) -> DataFrame:
    """Coefficients of all pixels: a pass along each axis, over Arrow batches of whole lines.

    A line with a missing pixel has no coefficients, as the filter runs over all of it.
    """
    nz = raster.nz
    out = raster.pixels.select(F.expr(f"plane div {nz}").alias("cube"), F.pmod("plane", F.lit(nz)).alias("z"), "y", "x", "value")
    for axis, n in (("x", raster.nx), ("y", raster.ny), *((("z", nz),) if raster.wcs.naxis == 3 else ())):
        out = _filter_lines(out, axis, n, order)
    return out.select((F.col("cube") * nz + F.col("z")).alias("plane"), "y", "x", "value")


def _filter_lines(pixels: DataFrame, axis: str, n: int, order: int) -> DataFrame:
    line = [k for k in ("cube", "z", "y", "x") if k != axis]
    whole = pixels.where("value is not null").groupBy(*line).agg(F.sort_array(F.collect_list(F.struct(F.col(axis).alias("at"), "value"))).alias("cells"))
    whole = whole.where(F.size("cells") == n).select(*line, F.col("cells.value").alias("values"))

    def run(records):
        for rec in records:
            flat = np.asarray(rec.column(3).flatten()).reshape(-1, n)
            out = prefilter(flat, order)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, n), pa.int32()), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([*rec.columns[:3], lists], names=[*line, "values"])

    filtered = whole.mapInArrow(run, ", ".join(f"{k} long" for k in line) + ", values array<double>")
    return filtered.select(*line, F.posexplode("values").alias(axis, "value")).withColumn(axis, F.col(axis).cast("long"))


def footprint_of(pixels: DataFrame) -> DataFrame:
    return pixels.groupBy("plane").agg(F.sum("footprint").alias("footprint"))
