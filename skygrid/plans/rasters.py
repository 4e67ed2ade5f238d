"""Rasters that are plain integer arithmetic on the keys of the driver's tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.wcs import Wcs
from ..operators.stack import Stack
from ..raster import Raster

WIDTH = 100


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def linear(cdelt: float = 1.0, crval: float = 0.0, crpix: float = 1.0, pc=None) -> Wcs:
    """World = crval + cdelt (pixel + 1 - crpix) on both axes."""
    return Wcs((crpix, crpix), (cdelt, cdelt), (crval, crval), ("", ""), pc)


def _keyed(spark, sf_dir, name: str, key: str, value: str, width: int) -> tuple[DataFrame, tuple[int, int]]:
    rows = table(spark, sf_dir, name)
    last = rows.agg(F.max(key)).first()[0]
    k = F.col(key).cast("long")
    pixels = rows.select(F.expr(f"cast({key} as long) div {width}").alias("y"), F.pmod(k, F.lit(width)).alias("x"), F.expr(value).alias("value"))
    return pixels, (0 if last is None else int(last) // width + 1, width)


def events(spark, sf_dir, wcs: Wcs | None = None, value: str = "value") -> Raster:
    pixels, shape = _keyed(spark, sf_dir, "events", "event_id", value, WIDTH)
    return Raster.of(pixels, wcs or linear(), shape)


#: Rows and columns of a plane of the events' cube.
CUBE_NY, CUBE_NX = 10, 20


def cube(spark, sf_dir, wcs: Wcs) -> Raster:
    """Roots of the events' values as a cube of planes of CUBE_NY x CUBE_NX."""
    rows = table(spark, sf_dir, "events")
    last = rows.agg(F.max("event_id")).first()[0]
    size, e = CUBE_NY * CUBE_NX, "cast(event_id as long)"
    pixels = rows.selectExpr(f"{e} div {size} as plane", f"{e} % {size} div {CUBE_NX} as y", f"{e} % {CUBE_NX} as x", "sqrt(value) as value")
    return Raster.of(pixels, wcs, (0 if last is None else int(last) // size + 1, CUBE_NY, CUBE_NX))


def holes(spark, sf_dir, wcs: Wcs | None = None) -> Raster:
    """Events, without a value where a user's number is divisible by 50."""
    return events(spark, sf_dir, wcs, "if(user_id % 50 = 0, null, value)")


def orders(spark, sf_dir, wcs: Wcs | None = None, value: str = "o_totalprice") -> Raster:
    pixels, shape = _keyed(spark, sf_dir, "orders", "o_orderkey", value, WIDTH)
    return Raster.of(pixels, wcs or linear(), shape)


def parts(spark, sf_dir, wcs: Wcs | None = None) -> Raster:
    pixels, shape = _keyed(spark, sf_dir, "part", "p_partkey", "p_retailprice", 20)
    return Raster.of(pixels, wcs or linear(), shape)


def embeddings(spark, sf_dir, wcs: Wcs | None = None) -> Raster:
    """A stack of 8 x 8 planes that share one description."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("plane"), F.posexplode("embedding").alias("k", "value"))
    return Raster.of(rows.select("plane", F.expr("k div 8").alias("y"), F.expr("k % 8").alias("x"), "value"), wcs or linear(), (8, 8))


def exposures(spark, sf_dir, value: str = "value + 10.0D * image_id", source: str = "o_totalprice", count: int = 5, width: int = 40, step: int = 15) -> Stack:
    """Overlapping crops of the orders' raster as one stack, each with an additive offset."""
    whole = orders(spark, sf_dir, value=source)
    cut = whole.pixels.select("*", F.explode(F.array(*[F.lit(k).cast("long") for k in range(count)])).alias("image_id")).withColumn("x", F.col("x") - step * F.col("image_id"))
    pixels = cut.where((F.col("x") >= 0) & (F.col("x") < width)).select("image_id", "plane", "y", "x", F.expr(value).alias("value"))
    return Stack(pixels, tuple(((whole.ny, width), whole.wcs.shifted(step * k, 0)) for k in range(count)))


def weights(spark, sf_dir) -> Stack:
    """Weights of the exposures: (o_custkey % 5) / 4."""
    return exposures(spark, sf_dir, "value", "(o_custkey % 5) / 4.0D")


def order_for(count: int) -> int:
    """The least order with so many cells."""
    order = 0
    while 12 * 4**order < count:
        order += 1
    return order


def cell_order(spark, sf_dir, share: int = 1, name: str = "events", key: str = "event_id") -> int:
    """The least order at which every ``share`` rows of a table (ids from 0) have a cell of their own."""
    last = table(spark, sf_dir, name).agg(F.max(key)).first()[0]
    return order_for(0 if last is None else int(last) // share + 1)


def healpix_map(spark, sf_dir) -> DataFrame:
    """One cell an event: all events, on a map of order ``cell_order``; cells beyond the last event are missing."""
    return table(spark, sf_dir, "events").select(F.col("event_id").cast("long").alias("ipix"), "value")


def tiles(spark, sf_dir, order: int, tile: int = 4, name: str = "events", key: str = "event_id", value: str = "if(user_id % 50 = 0, null, sqrt(value))") -> DataFrame:
    """Tiles of an order filled from a table, row by row; the last tile may be partly filled, later ones are missing."""
    e, t2 = f"cast({key} as long)", tile * tile
    return table(spark, sf_dir, name).select(
        F.lit(order).alias("norder"), F.expr(f"{e} div {t2}").alias("npix"), F.expr(f"{e} % {t2} div {tile}").alias("y"), F.expr(f"{e} % {tile}").alias("x"), F.expr(value).alias("value"),
    )


def cube_tiles(spark, sf_dir, order: int, forder: int = 1, tile: int = 2, depth: int = 2) -> DataFrame:
    """Three-dimensional tiles filled from events; a third of the users' values are missing."""
    size = tile * tile * depth
    cells = 2 ** (forder + 1)
    e = "cast(event_id as long)"
    return table(spark, sf_dir, "events").select(
        F.lit(order).alias("norder"), F.expr(f"{e} div {size * cells}").alias("npix"), F.lit(forder).alias("forder"), F.expr(f"{e} div {size} % {cells}").alias("fpix"),
        F.expr(f"{e} % {size} div {tile * tile}").alias("z"), F.expr(f"{e} % {tile * tile} div {tile}").alias("y"), F.expr(f"{e} % {tile}").alias("x"),
        F.expr("if(user_id % 3 = 0, null, sqrt(value))").alias("value"),
    )


# --- the same in SQL -----------------------------------------------------------------------------

#: Roots of the values: means of them do not end in a digit on which roundings may differ.
ROOT_SQL = "SELECT event_id // 100 AS y, event_id % 100 AS x, sqrt(value) AS value FROM events"
PLANES_SQL = "SELECT event_id // 200 AS z, event_id % 200 // 20 AS y, event_id % 20 AS x, sqrt(value) AS value FROM events"
EV_SQL = "SELECT event_id // 100 AS y, event_id % 100 AS x, value FROM events"
HOLES_SQL = "SELECT event_id // 100 AS y, event_id % 100 AS x, CASE WHEN user_id % 50 <> 0 THEN value END AS value FROM events"
ORD_SQL = "SELECT o_orderkey // 100 AS y, o_orderkey % 100 AS x, o_totalprice AS value, o_custkey FROM orders"
EXPOSURES_SQL = """SELECT k, y, x, value + 10.0::DOUBLE * k AS value, (o_custkey % 5) / 4.0::DOUBLE AS w
    FROM (SELECT o_orderkey // 100 AS y, o_orderkey % 100 AS x, o_totalprice AS value, o_custkey FROM orders) o
    CROSS JOIN (SELECT unnest([0, 1, 2, 3, 4])::BIGINT AS k) n WHERE x >= 15 * k AND x < 15 * k + 40"""


def order_sql(share: int = 1, name: str = "events", key: str = "event_id") -> str:
    """The least order at which every ``share`` rows have a cell of their own, as a scalar."""
    return f"(SELECT min(k) FROM (SELECT unnest(generate_series(0, 29)) AS k) WHERE 12 * (1::BIGINT << (2 * k)) >= (SELECT max({key}) // {share} + 1 FROM {name}))"


#: Orders of a pyramid that its SQL can unroll.
UNROLLED = 12
TILES_SQL = f"""SELECT {order_sql(16)}::INTEGER AS norder, event_id // 16 AS npix, event_id % 16 // 4 AS y, event_id % 4 AS x,
    CASE WHEN user_id % 50 <> 0 THEN sqrt(value) END AS value FROM events"""
ORDER_TILES_SQL = f"""SELECT {order_sql(16, "orders", "o_orderkey")}::INTEGER AS norder, o_orderkey // 16 AS npix, o_orderkey % 16 // 4 AS y, o_orderkey % 4 AS x, o_totalprice AS value FROM orders"""
CUBE_SQL = f"""SELECT {order_sql(32)}::INTEGER AS norder, event_id // 32 AS npix, 1 AS forder, event_id // 8 % 4 AS fpix, event_id % 8 // 4 AS z, event_id % 4 // 2 AS y, event_id % 2 AS x,
    CASE WHEN user_id % 3 <> 0 THEN sqrt(value) END AS value FROM events"""


def nested_sql(cells: str, keys: str = "ipix") -> str:
    """lon and lat of the centres of nested cells ``ipix`` of order ``k``, written out from the definition."""
    names = ", ".join(dict.fromkeys([*(k.strip() for k in keys.split(",")), "ipix"]))
    steps = f"SELECT {names}, 1::BIGINT << k AS n, ipix >> (2 * k) AS face, ipix & ((1::BIGINT << (2 * k)) - 1) AS ex, (ipix & ((1::BIGINT << (2 * k)) - 1)) >> 1 AS ey FROM ({cells})"
    masks = [(0, 0x5555555555555555), (1, 0x3333333333333333), (2, 0x0F0F0F0F0F0F0F0F), (4, 0x00FF00FF00FF00FF), (8, 0x0000FFFF0000FFFF), (16, 0x00000000FFFFFFFF)]
    for shift, mask in masks:
        own = lambda c: f"({c} | ({c} >> {shift})) & {mask} AS {c}" if shift else f"{c} & {mask} AS {c}"  # noqa: B023, E731
        steps = f"SELECT {names}, n, face, {own('ex')}, {own('ey')} FROM ({steps})"
    steps = f"SELECT {names}, n, face, ex, ey, (face // 4 + 2) * n - ex - ey - 1 AS jr, 2 * (face % 4) + CASE WHEN face // 4 = 1 THEN 0 ELSE 1 END AS base FROM ({steps})"
    steps = f"SELECT *, CASE WHEN jr < n THEN jr WHEN jr > 3 * n THEN 4 * n - jr ELSE n END AS nr FROM ({steps})"
    return f"""SELECT {names}, ((base * nr + ex - ey) * 45.0::DOUBLE / nr + 360) % 360 AS lon,
        degrees(asin(CASE WHEN jr < n THEN 1 - nr * nr / (3.0::DOUBLE * n * n) WHEN jr > 3 * n THEN nr * nr / (3.0::DOUBLE * n * n) - 1 ELSE (2 * n - jr) * 2.0::DOUBLE / (3 * n) END)) AS lat FROM ({steps})"""


def ring_info_sql(r: str) -> dict[str, str]:
    """Of ring r = 1 .. 4 n - 1: first pixel, number of pixels, shift of the first centre, z."""
    s = f"(4 * n - {r})"
    return {
        "first": f"CASE WHEN {r} < n THEN 2 * {r} * ({r} - 1) WHEN {r} > 3 * n THEN 12 * n * n - 2 * {s} * ({s} + 1) ELSE 2 * n * (n - 1) + ({r} - n) * 4 * n END",
        "size": f"CASE WHEN {r} < n THEN 4 * {r} WHEN {r} > 3 * n THEN 4 * {s} ELSE 4 * n END",
        "shift": f"CASE WHEN {r} < n OR {r} > 3 * n OR ({r} + n) % 2 = 0 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END",
        "z": f"CASE WHEN {r} < n THEN 1 - {r} * {r} / (3.0::DOUBLE * n * n) WHEN {r} > 3 * n THEN {s} * {s} / (3.0::DOUBLE * n * n) - 1 ELSE (2 * n - {r}) * 2.0::DOUBLE / (3 * n) END",
    }


def ring_centres_sql(order: str) -> str:
    """ipix, lon, lat of all ring-ordered pixels of an order."""
    info = ring_info_sql("r")
    return f"""SELECT ipix, 90.0::DOUBLE * (ipix - first + shift) * 4 / size AS lon, degrees(asin(z)) AS lat FROM (SELECT ipix, {", ".join(f"{v} AS {k}" for k, v in info.items())} FROM (
        SELECT ipix, n, CASE WHEN ipix < 2 * n * (n - 1) THEN floor((1 + sqrt(1.0::DOUBLE + 2 * ipix)) / 2)::BIGINT
        WHEN ipix >= 12 * n * n - 2 * n * (n - 1) THEN 4 * n - floor((1 + sqrt(1.0::DOUBLE + 2 * (12 * n * n - 1 - ipix))) / 2)::BIGINT ELSE (ipix - 2 * n * (n - 1)) // (4 * n) + n END AS r FROM (
        SELECT n, unnest(generate_series(0, 12 * n * n - 1)) AS ipix FROM (SELECT 1::BIGINT << {order} AS n))))"""
