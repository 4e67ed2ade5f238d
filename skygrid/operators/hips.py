"""Hierarchical tile pyramids on HEALPix cells.

Tiles are rows (norder, npix, y, x, value): pixel (y, x) of a tile of width T is the nested HEALPix pixel
npix T^2 + interleave(T - 1 - y, x) of order norder + log2 T, so its position on the sky is exact integer
arithmetic, at borders and in the polar caps too.  Three-dimensional tiles add (forder, fpix, z).
"""

from __future__ import annotations

import math
from dataclasses import replace

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import healpix as hp
from ..functions import spectral
from ..functions.backend import bind
from ..functions.wcs import Wcs, change_frame, frame_name, from_sky, separation
from ..raster import Grid, Raster
from .bounds import bounds_of
from .interpolate import order_number, sample, spline_coefficients
from .spherical import positions_in

ALLSKY_ORDER = 3
ALLSKY_TILE = 64
RESERVED = ("creator_did", "obs_title", "hips_version", "hips_release_date", "hips_status", "hips_tile_format", "hips_tile_width", "hips_order", "hips_frame", "dataproduct_type")


def check_tile(size: int) -> int:
    if size < 2 or size & (size - 1):
        raise ValueError("the tile size must be a power of two")
    return size.bit_length() - 1


def tile_sky(tiles: DataFrame, order: int, tile: int) -> DataFrame:
    """All pixels of tiles (npix): npix, y, x, lon, lat."""
    k = check_tile(tile)
    rows = tiles.select("npix", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(tile * tile - 1).cast("long"))).alias("id"))
    rows = rows.select("npix", F.expr(f"id div {tile}").alias("y"), F.pmod("id", F.lit(tile)).alias("x"))
    rows = bind(rows, {"_pix": F.col("npix") * (tile * tile) + hp.interleave(tile - 1 - F.col("y"), F.col("x"))})
    return hp.nested_positions(rows, F.col("_pix"), 1 << (order + k)).drop("_pix")


def cell_radius(order: int) -> float:
    """No point of a cell is farther from its centre (degrees)."""
    return min(180.0, 85.0 / (1 << order))


def cone(spark: SparkSession, lon: float, lat: float, radius: float, order: int) -> DataFrame:
    """Cells of an order that may touch a cone: npix.  Cells are refined order by order, and pruned each time."""
    cells = spark.range(12).withColumnRenamed("id", "npix")
    for k in range(order + 1):
        if k:
            cells = cells.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda c: F.col("npix") * 4 + c)).alias("npix"))
        if radius < 120:
            cells = hp.nested_positions(cells, F.col("npix"), 1 << k)
            cells = cells.where(separation(F.col("lon"), F.col("lat"), F.lit(float(lon)), F.lit(float(lat))) <= radius + cell_radius(k)).select("npix")
    return cells


def level_for(raster: Raster, tile: int) -> int:
    """The least order whose pixels are as fine as the image's."""
    return max(0, hp.nside_for_resolution(raster.wcs.pixel_scale() * tile).bit_length() - 1)


def image_cone(raster: Raster, frame: str) -> tuple[float, float, float]:
    """Centre of an image and a radius that reaches its corners with room (degrees)."""
    ny, nx = raster.ny, raster.nx
    xs = np.array([(nx - 1) / 2, -0.5, nx - 0.5, nx - 0.5, -0.5])
    ys = np.array([(ny - 1) / 2, -0.5, -0.5, ny - 0.5, ny - 0.5])
    world = raster.wcs.pixel_to_world(xs, ys)
    i, j = raster.wcs.celestial
    lon, lat = change_frame(world[i], world[j], raster.wcs.sky, frame)
    if not np.isfinite(lon[0]):
        return 0.0, 0.0, 180.0
    far = separation(lon[1:], lat[1:], lon[0], lat[0])
    radius = 180.0 if not np.isfinite(far).all() else 1.5 * float(far.max())
    return float(lon[0]), float(lat[0]), radius if radius <= 120 else 180.0


def to_tiles(raster: Raster, frame: str, tile: int = 512, level: int | None = None, order: str | int = "bilinear") -> DataFrame:
    """Tiles of the finest order: norder, npix, plane, y, x, value, footprint; tiles without any value are left out."""
    if raster.wcs.naxis != 2 or not raster.wcs.has_celestial:
        raise ValueError("tiles are made of two-dimensional celestial images")
    spark = raster.pixels.sparkSession
    depth = level_for(raster, tile) if level is None else level
    k = order_number(order)
    sky = tile_sky(cone(spark, *image_cone(raster, frame), depth), depth, tile)
    data = raster.pixels if k < 2 else spline_coefficients(raster, k)
    hits = sample(positions_in(sky, raster, frame), data, raster.shape, k, keys=("npix", "y", "x")).where("value is not null")
    return hits.select(F.lit(depth).alias("norder"), "npix", "plane", "y", "x", "value", F.lit(1.0).alias("footprint"))


def merge_borders(layers: DataFrame) -> DataFrame:
    """Footprint-weighted mean of several layers of the same tile pixels."""
    keys = [k for k in ("norder", "npix", "plane", "y", "x") if k in layers.columns]
    got = layers.where("value is not null and footprint > 0").groupBy(*keys).agg(F.sum(F.col("value") * F.col("footprint")).alias("t"), F.sum("footprint").alias("f"))
    return got.select(*keys, F.try_divide("t", "f").alias("value"), F.least(F.lit(1.0), F.col("f")).alias("footprint"))


def coarser(tiles: DataFrame, tile: int, keys: tuple[str, ...] = (), spectral: bool = False, depth: int | None = None, spatial: bool = True) -> DataFrame:
    """One order up: pixels are averaged two by two (NULL left out) and put into the parent's quadrant.

    With ``spectral``, z is averaged two by two as well and fpix halves.
    """
    half = tile // 2
    own = {"norder": F.col("norder"), "npix": F.col("npix"), "y": F.col("y"), "x": F.col("x")}
    if spatial:
        child = F.pmod("npix", F.lit(4))
        own = {
            "norder": (F.col("norder") - 1).cast("int"), "npix": F.shiftright("npix", 2),
            "y": F.when(child.isin(0, 2), half).otherwise(0).cast("long") + F.expr("y div 2"), "x": F.when(child >= 2, half).otherwise(0).cast("long") + F.expr("x div 2"),
        }
    if "fpix" in tiles.columns:
        if spectral:
            upper = F.pmod("fpix", F.lit(2)) * (depth // 2)
            own |= {"forder": (F.col("forder") - 1).cast("int"), "fpix": F.expr("fpix div 2"), "z": (upper + F.expr("z div 2")).cast("long")}
        else:
            own |= {k: F.col(k) for k in ("forder", "fpix", "z")}
    rows = tiles.where("value is not null").select(*keys, *[v.alias(k) for k, v in own.items()], "value")
    return rows.groupBy(*keys, *own).agg(F.avg("value").alias("value"))


def pyramid(tiles: DataFrame, tile: int, level: int, cut=None, **options) -> DataFrame:
    """All orders from ``level`` to 0.  Each order is the mean of the next finer one; ``cut`` may end lineage between orders."""
    out, here = tiles.select("norder", "npix", "y", "x", "value"), tiles.select("norder", "npix", "y", "x", "value")
    for _ in range(level):
        here = coarser(here, tile, **options)
        if cut:
            here = cut(here)
        out = out.unionByName(here)
    return out


def pyramid_3d(tiles: DataFrame, tile: int, depth: int, level: int, spectral_level: int, cut=None) -> DataFrame:
    """All spatial orders of a cube; the spectral order halves with the spatial one until it is 0."""
    columns = ["norder", "npix", "forder", "fpix", "z", "y", "x", "value"]
    out = here = tiles.select(*columns)
    for k in range(level):
        here = coarser(here, tile, spectral=spectral_level - k > 0, depth=depth)
        if cut:
            here = cut(here)
        out = out.unionByName(here.select(*columns))
    return out


def allsky_factor(tile: int) -> int:
    """The largest power of two by which a tile shrinks without falling below the preview's tile."""
    factor = 1
    while tile // (factor * 2) >= ALLSKY_TILE and tile % (factor * 2) == 0:
        factor *= 2
    return factor


def allsky(tiles: DataFrame, order: int, tile: int) -> DataFrame:
    """The preview of an order: y, x, value of tiles shrunk by block means and laid side by side in index order."""
    factor = allsky_factor(tile)
    small, width = tile // factor, math.isqrt(12 * 4**order)
    y = F.expr(f"(npix div {width}) * {small} + y div {factor}")
    x = F.expr(f"(npix % {width}) * {small} + x div {factor}")
    return tiles.where((F.col("norder") == order) & F.col("value").isNotNull()).groupBy(y.alias("y"), x.alias("x")).agg(F.avg("value").alias("value"))


def read_level(tiles: DataFrame, order: int, tile: int, wanted: DataFrame | None = None) -> DataFrame:
    """All pixels of an order, or of the wanted tiles (npix); what has no tile is NULL."""
    spark = tiles.sparkSession
    cells = wanted if wanted is not None else spark.range(12 * 4**order).withColumnRenamed("id", "npix")
    full = cells.select("npix", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(tile * tile - 1).cast("long"))).alias("id"))
    full = full.select("npix", F.expr(f"id div {tile}").alias("y"), F.pmod("id", F.lit(tile)).alias("x"))
    return full.join(tiles.where(F.col("norder") == order).select("npix", "y", "x", "value"), ["npix", "y", "x"], "left")


def missing_tiles(tiles: DataFrame, order: int) -> DataFrame:
    """Cells of an order without a tile."""
    cells = tiles.sparkSession.range(12 * 4**order).withColumnRenamed("id", "npix")
    return cells.join(tiles.where(F.col("norder") == order).select("npix"), "npix", "left_anti")


def trim(tiles: DataFrame) -> DataFrame:
    """Bounding box of the values of each three-dimensional tile; tiles without a value are left out."""
    keys = ["norder", "npix", "forder", "fpix"]
    ends = [f(k).alias(f"{k}{e}") for k in ("z", "y", "x") for f, e in ((F.min, "0"), (F.max, "1"))]
    return tiles.where("value is not null").groupBy(*keys).agg(*ends)


def untrim(trimmed: DataFrame, tile: int, depth: int) -> DataFrame:
    """Whole tiles again: NULL outside the stored box."""
    keys = ["norder", "npix", "forder", "fpix"]
    full = trimmed.select(*keys).distinct().select(*keys, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(tile * tile * depth - 1).cast("long"))).alias("id"))
    full = full.select(*keys, F.expr(f"id div {tile * tile}").alias("z"), F.expr(f"id div {tile} % {tile}").alias("y"), F.pmod("id", F.lit(tile)).alias("x"))
    return full.join(trimmed, [*keys, "z", "y", "x"], "left")


def union_of(sets: list[DataFrame], on_overlap: str = "last") -> DataFrame:
    """Tiles of several pyramids; where they meet, the last (or first) set's tile wins, or pixels do with "fill".

    ``fill`` takes each pixel from the last set that has a value there.
    """
    if on_overlap not in ("first", "last", "fill", "error"):
        raise ValueError("on_overlap must be first, last, fill or error")
    keys = ["norder", "npix"]
    rows = None
    for k, s in enumerate(sets):
        s = s.select(*keys, "y", "x", "value").withColumn("set", F.lit(k))
        rows = s if rows is None else rows.unionByName(s)
    if on_overlap == "fill":
        best = rows.where("value is not null").groupBy(*keys, "y", "x").agg(F.max(F.struct("set", "value")).alias("b"))
        return best.select(*keys, "y", "x", F.col("b.value").alias("value"))
    pick = F.max("set") if on_overlap == "last" else F.min("set")
    owner = rows.groupBy(*keys).agg(pick.alias("set"), F.countDistinct("set").alias("n") if on_overlap == "error" else F.lit(1).alias("n"))
    if on_overlap == "error" and owner.where("n > 1").limit(1).count():
        raise NotImplementedError("tile sets overlap")
    return rows.join(owner.drop("n"), [*keys, "set"]).drop("set")


def blend(sets: list[DataFrame]) -> DataFrame:
    """Colour tiles (planes 0 .. 3, bytes, plane 3 the opacity) of several sets laid over each other, the first one on top."""
    keys, rows = ["norder", "npix", "y", "x"], None
    for k, s in enumerate(sets):
        s = s.select(*keys, "plane", "value").withColumn("set", F.lit(k))
        rows = s if rows is None else rows.unionByName(s)
    wide = rows.groupBy(*keys, "set").agg(*[F.coalesce(F.max(F.when(F.col("plane") == c, F.col("value"))), F.lit(0.0)).alias(f"p{c}") for c in range(4)])
    layers = wide.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("set", *[f"p{c}" for c in range(4)]))).alias("layers"))

    def over(acc, e):
        a = e["p3"] / 255 * (1 - acc["a"])
        return F.struct((acc["a"] + a).alias("a"), *[(acc[f"c{c}"] + a * e[f"p{c}"]).alias(f"c{c}") for c in range(3)])

    start = F.struct(F.lit(0.0).alias("a"), *[F.lit(0.0).alias(f"c{c}") for c in range(3)])
    done = layers.select(*keys, F.aggregate("layers", start, over).alias("b"))
    cells = [F.struct(F.lit(c).cast("long").alias("plane"), F.coalesce(F.try_divide(F.col(f"b.c{c}"), F.col("b.a")), F.lit(0.0)).alias("value")) for c in range(3)]
    cells.append(F.struct(F.lit(3).cast("long").alias("plane"), (F.col("b.a") * 255).alias("value")))
    return done.select(*keys, F.inline(F.array(*cells)))


# --- names and texts --------------------------------------------------------------------------


def tile_path(order: Column, npix: Column, extension: str) -> Column:
    folder = F.floor(npix / 10000).cast("long") * 10000
    return F.concat(F.lit("Norder"), order.cast("string"), F.lit("/Dir"), folder.cast("string"), F.lit("/Npix"), npix.cast("string"), F.lit(f".{extension}"))


def tile_path_3d(order: Column, npix: Column, forder: Column, fpix: Column, extension: str) -> Column:
    """Spatial folders by ten thousands, spectral ones by tens."""
    folder, spectral = F.floor(npix / 10000).cast("long") * 10000, F.floor(fpix / 10).cast("long") * 10
    text = [F.lit("Norder"), order, F.lit("_"), forder, F.lit("/Dir"), folder, F.lit("_"), spectral, F.lit("/Npix"), npix, F.lit("_"), fpix, F.lit(f".{extension}")]
    return F.concat(*[t.cast("string") for t in text])


def parse_path(path: Column) -> dict[str, Column]:
    """norder and npix of a tile's path, forder and fpix (null in two dimensions)."""
    part = lambda pattern, kind: F.nullif(F.regexp_extract(path, pattern, 1), F.lit("")).cast(kind)
    return {"norder": part(r"Norder(\d+)", "int"), "npix": part(r"Npix(\d+)", "long"), "forder": part(r"Norder\d+_(\d+)", "int"), "fpix": part(r"Npix\d+_(\d+)", "long")}


def properties_lines(values: DataFrame) -> DataFrame:
    """(key, value) rows as lines of a properties file."""
    return values.select(F.concat(F.rpad("key", 20, " "), F.lit(" = "), F.col("value")).alias("line"))


def parse_properties(lines: DataFrame) -> DataFrame:
    """key and value of each line; comments and blank lines are skipped, only the first "=" separates."""
    rows = lines.where("line not like '#%' and line like '%=%'").select(F.split("line", "=", 2).alias("p"))
    return rows.select(F.trim(F.col("p")[0]).alias("key"), F.trim(F.col("p")[1]).alias("value"))


def pixel_cut(tiles: DataFrame) -> tuple[float | None, float | None]:
    """The least and the largest value of a tile set; None without values."""
    return tuple(tiles.agg(F.min("value"), F.max("value")).first())


def properties_of(tiles: DataFrame, frame: str, tile: int, level: int, title: str, own: dict | None = None) -> dict:
    """Properties of a tile set; ``own`` may add but not override."""
    for k in own or {}:
        if k in RESERVED:
            raise ValueError(f"Cannot override property {k}")
    low, high = pixel_cut(tiles)
    out = {
        "obs_title": title, "hips_version": "1.4", "hips_status": "public master clonableOnce", "hips_tile_format": "parquet", "hips_tile_width": tile, "hips_order": level,
        "hips_frame": frame, "dataproduct_type": "image",
    }
    if low is not None and math.isfinite(low) and math.isfinite(high):
        out["hips_pixel_cut"] = f"{low} {high}"
    return out | (own or {})


def _hpx_wcs(cx: float, cy: float, order: int, tile: int, size: int, frame: str) -> Wcs:
    """The HPX projection turned by 45 degrees, of ``size`` pixels around a plane position; tiles are upright in it."""
    res = 45.0 / tile / 2**order
    names = {"galactic": ("GLON-HPX", "GLAT-HPX"), "ecliptic": ("ELON-HPX", "ELAT-HPX")}.get(frame_name(frame), ("RA---HPX", "DEC--HPX"))
    # plane position of the centre, undone by the matrix [[-r, -r], [r, -r]]
    px, py = (-cx + cy) / (2 * res), (-cx - cy) / (2 * res)
    return Wcs((-px + size / 2 + 0.5, -py + size / 2 + 0.5), (1.0, 1.0), (0.0, 0.0), names, ((-res, -res), (res, -res)), frame=frame_name(frame), shape=(size, size))


def tile_wcs(order: int, npix: int, tile: int, frame: str = "icrs", second: bool = False) -> Wcs:
    """The HPX projection of one tile; ``second``: that of its other place, for tiles at the border of the plane."""
    cx, cy = _hpx_corner(order, npix)
    if second:
        if not is_border(order, npix):
            raise ValueError("the tile has one place only")
        cx += 360 if cx < 0 else -360
    return _hpx_wcs(cx, cy, order, tile, tile, frame)


def is_border(order: int, npix: int) -> bool:
    """Does a tile meet the meridian at which the plane is cut, so that it has two places?"""
    cx, cy = _hpx_corner(order, npix)
    return abs(cy) <= 45 and abs(abs(cx) - 180) < 45.0 / 2**order


def map_grid(order: int, tile: int, frame: str = "icrs") -> Grid:
    """The whole map of an order as one image: five by five base cells, of which twelve (one twice) are filled."""
    size = 5 * tile * 2**order
    return Grid(_hpx_wcs(0.0, 0.0, order, tile, size, frame), (size, size))


def cube_wcs(wcs: Wcs, forder: int, depth: int, fpix: int = 0) -> Wcs:
    """A tile's or map's description with the frequency axis, of which ``fpix`` is the first cell."""
    axis = spectral.header_axis(forder, fpix, depth)
    pc = np.eye(3)
    pc[:2, :2] = wcs.matrix
    return replace(
        wcs, crpix=(*wcs.crpix, float(axis["CRPIX3"])), cdelt=(*wcs.cdelt, axis["CDELT3"]), crval=(*wcs.crval, axis["CRVAL3"]), ctype=(*wcs.ctype, axis["CTYPE3"]),
        cunit=("deg", "deg", axis["CUNIT3"]), pc=tuple(map(tuple, pc)), shape=None if wcs.shape is None else (depth, *wcs.shape),
    )


def _places() -> list[tuple[int, int, int]]:
    """(base cell, row, column) of the base cells in the map; the one at the cut has two places."""
    out = []
    for face in range(12):
        cx, cy = _hpx_corner(0, face)
        out += [(face, round((-x - cy) / 90 + 2), round((-x + cy) / 90 + 2)) for x in ((cx,) if abs(cx) < 180 else (cx, -cx))]
    return out


def on_map(tiles: DataFrame, order: int, tile: int) -> DataFrame:
    """Tile pixels of an order at their (first) place in the map: plane, y, x, value."""
    n = 1 << order
    own = tiles.where(F.col("norder") == order)
    first = dict((face, (row, col)) for face, row, col in reversed(_places()))
    pick = lambda k: F.get(F.array(*[F.lit(first[f][k]).cast("long") for f in range(12)]), F.expr(f"cast(npix div {n * n} as int)"))
    inner = F.pmod("npix", F.lit(n * n))
    ty, tx = n - 1 - hp.gather_bits(inner), hp.gather_bits(F.shiftright(inner, 1))
    plane = F.col("plane") if "plane" in tiles.columns else F.lit(0).cast("long")
    return own.select(plane.alias("plane"), ((pick(0) * n + ty) * tile + F.col("y")).alias("y"), ((pick(1) * n + tx) * tile + F.col("x")).alias("x"), "value")


def from_map(pixels: DataFrame, order: int, tile: int) -> DataFrame:
    """Pixels of the map (y, x, ...) as tile pixels: norder, npix, y, x and the other columns; those outside all base cells go."""
    n = 1 << order
    size = n * tile
    table = [-1] * 25
    for face, row, col in _places():
        table[row * 5 + col] = face
    face = F.get(F.array(*map(F.lit, table)), F.expr(f"cast(y div {size} * 5 + x div {size} as int)")).cast("long")
    ty, tx = F.expr(f"y % {size} div {tile}"), F.expr(f"x % {size} div {tile}")
    rest = [k for k in pixels.columns if k not in ("y", "x")]
    rows = bind(pixels, {"npix": face * (n * n) + hp.interleave(n - 1 - ty, tx), "face": face}).where("face >= 0")
    return rows.select(F.lit(order).alias("norder"), "npix", *rest, F.expr(f"y % {tile}").alias("y"), F.expr(f"x % {tile}").alias("x"))


def to_tiles_by(function, raster: Raster, frame: str, tile: int = 512, level: int | None = None, **options) -> DataFrame:
    """Tiles made by any resampling function (raster, grid, bounds=..., ...) that gives plane, y, x, value, footprint.

    The function is called once, on the part of the whole map that the image may reach, not tile by tile.  At the cut a
    tile has two places, of which each gets a part; they meet as the footprint-weighted mean.
    """
    depth = level_for(raster, tile) if level is None else level
    grid = map_grid(depth, tile, frame)
    part = bounds_of(raster.shape[-2:], raster.wcs, grid)
    if part is None:
        part = (0, 0, 0, 0)
    made = function(raster, grid, bounds=part, **options).where("value is not null and footprint > 0")
    return merge_borders(from_map(made.select("plane", "y", "x", "value", "footprint"), depth, tile))


def to_tiles_3d(raster: Raster, frame: str, tile: int = 512, depth: int = 16, level: int | None = None, level_depth: int = 0, order: str | int = "bilinear") -> DataFrame:
    """Three-dimensional tiles of a spectral cube: norder, npix, forder, fpix, z, y, x, value.

    The frequency axis of a pixel follows the cells' logarithmic steps; cells that the cube's own range misses are not made.
    """
    wcs, axis = raster.wcs, raster.wcs.spectral
    if wcs.naxis != 3 or not wcs.has_celestial or axis is None or wcs.ctype[axis][:4] != "FREQ":
        raise ValueError("three-dimensional tiles are made of cubes with celestial axes and a frequency")
    spark, k = raster.pixels.sparkSession, order_number(order)
    sizes = list(reversed(raster.shape))
    middle = [(n - 1) / 2 for n in sizes]
    ends = [[v if a != axis else e for a, v in enumerate(middle)] for e in (-0.5, sizes[axis] - 0.5)]
    hz = sorted(float(wcs.pixel_to_world(*map(np.float64, e))[axis]) for e in ends)
    cells = [int(2.0 ** (level_depth + 1) * (math.log10(min(max(f, spectral.FREQ_MIN), spectral.FREQ_MAX * 0.999)) + 18) // spectral.DECADES) for f in hz]
    i, j = wcs.celestial
    corners = np.array([[s * n - 0.5 for s, n in zip(c, sizes)] for c in np.ndindex(2, 2, 2)] + [middle]).T
    world = wcs.pixel_to_world(*corners)
    lon, lat = change_frame(world[i], world[j], wcs.sky, frame)
    far = separation(lon[:-1], lat[:-1], lon[-1], lat[-1])
    radius = 1.5 * float(far.max()) if np.isfinite(far).all() else 180.0
    flat = wcs.without_axis(axis) if axis == 2 else None
    if level is None:
        level = level_for(Raster(raster.pixels, flat or wcs, raster.shape[-2:] if flat else raster.shape), tile)
    sky = tile_sky(cone(spark, float(lon[-1]), float(lat[-1]), radius if radius <= 120 else 180.0, level), level, tile)
    rows = sky.select("*", F.explode(F.sequence(F.lit(cells[0] * depth).cast("long"), F.lit((cells[1] + 1) * depth - 1).cast("long"))).alias("at"))
    rows = rows.select("npix", F.expr(f"at div {depth}").alias("fpix"), F.pmod("at", F.lit(depth)).alias("z"), "y", "x", "lon", "lat", spectral.index_to_coord(level_depth, (F.col("at") + 0.5) / depth).alias(f"s_w{axis}"))
    placed = from_sky(rows.withColumns({f"s_w{i}": F.col("lon"), f"s_w{j}": F.col("lat")}), wcs, ["s"], frame_name(frame))
    placed = placed.withColumnsRenamed({f"s_w{a}": f"{c}i" for a, c in enumerate("xyz")})
    bad = F.lit(False)
    for c in "xyz":
        bad = bad | F.col(f"{c}i").isNull() | F.isnan(f"{c}i")
    data = raster.pixels if k < 2 else spline_coefficients(raster, k)
    cube = data.select(F.lit(0).cast("long").alias("plane"), F.col("plane").alias("z"), "y", "x", "value")
    hits = sample(placed.where(~bad), cube, raster.shape, k, keys=("npix", "fpix", "z", "y", "x"), axes="xyz").where("value is not null")
    return hits.select(F.lit(level).alias("norder"), "npix", F.lit(level_depth).alias("forder"), "fpix", "z", "y", "x", "value")


def _hpx_corner(order: int, npix: int) -> tuple[float, float]:
    """Plane position (degrees) of a cell's centre in the HPX projection."""
    n = 1 << order
    face, inner = divmod(npix, n * n)
    x = sum((inner >> 2 * b & 1) << b for b in range(order))
    y = sum((inner >> (2 * b + 1) & 1) << b for b in range(order))
    row, col = divmod(face, 4)
    u, v = (x + 0.5) / n, (y + 0.5) / n
    base = 90.0 * col + (0.0 if row == 1 else 45.0)
    lon = base + 45 * (u - v)
    lat = 45.0 * (u + v - row)
    return (lon + 180) % 360 - 180, lat
