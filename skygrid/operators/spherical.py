"""Between images and HEALPix maps.  A map is a DataFrame (ipix, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import healpix as hp
from ..functions.backend import bind
from ..functions.wcs import frame_name, from_sky, to_sky
from ..raster import Grid, Raster
from .interpolate import order_number, sample, spline_coefficients


def image_from_healpix(healpix: DataFrame, nside: int, frame: str, target, shape=None, order: str | int = "bilinear", nested: bool = False) -> DataFrame:
    """Resample a map onto an image: plane, y, x, value, footprint.

    Nearest takes the pixel that holds the position.  Bilinear weighs two neighbours on each of the two rings around it; a
    missing neighbour makes the value missing.  Positions off the sky have no value and footprint 0; all others have 1.
    """
    k = order_number(order)
    if k > 1:
        raise ValueError("only nearest-neighbor and bilinear are possible")
    hp.check_nside(nside)
    grid = Grid.parse(target, shape)
    spark = healpix.sparkSession
    pixels = grid.pixels(spark)
    i, j = grid.wcs.celestial
    sky = to_sky(pixels, grid.wcs, {"s": (F.col("x").cast("double"), F.col("y").cast("double"))}, frame_name(frame))
    sky = sky.withColumnsRenamed({f"s_w{i}": "lon", f"s_w{j}": "lat"}).where("lon is not null and lat is not null and not isnan(lon) and not isnan(lat)")
    right = healpix.select(F.col("ipix").cast("long").alias("ipix"), F.col("value").cast("double").alias("v"))
    if k == 0:
        hits = bind(sky, {"ipix": hp.lonlat_to_pix(F.col("lon"), F.col("lat"), nside, nested)}).select("y", "x", "ipix").join(right, "ipix", "left").select("y", "x", F.col("v").alias("value"))
    else:
        taps = hp.bilinear_taps(sky.select("y", "x", "lon", "lat"), nside).select("y", "x", F.posexplode("taps").alias("tap", "n"))
        taps = taps.select("y", "x", "tap", F.col("n.weight").alias("w"), F.col("n.pix").alias("ipix"))
        long = (hp.renumbered(taps, "ipix", nside, False) if nested else taps).join(right, "ipix", "left")
        term = lambda t: F.max(F.when(F.col("tap") == t, F.col("w") * F.col("v"))).alias(f"t{t}")
        got = long.groupBy("y", "x").agg(*[term(t) for t in range(6)], F.count(F.lit(1)).alias("n"), F.count("v").alias("found"))
        total = F.col("t0")
        for t in range(1, 6):
            total = total + F.coalesce(f"t{t}", F.lit(0.0))
        hits = got.select("y", "x", F.when(F.col("n") == F.col("found"), total).alias("value"))
    out = pixels.join(hits.withColumn("on_sky", F.lit(1.0)), ["y", "x"], "left")
    return out.select(F.lit(0).cast("long").alias("plane"), "y", "x", "value", F.coalesce("on_sky", F.lit(0.0)).alias("footprint"))


def sky_positions(spark: SparkSession, nside: int, nested: bool) -> DataFrame:
    """ipix, lon, lat of all pixels of a map."""
    pixels = spark.range(hp.npix(hp.check_nside(nside))).withColumnRenamed("id", "ipix")
    return hp.positions(pixels, F.col("ipix"), nside, nested)


def positions_in(places: DataFrame, raster: Raster, frame: str, cut: float | None = None) -> DataFrame:
    """Places with lon and lat in a frame, and their position (xi, yi) in an image, cut at a native longitude."""
    i, j = raster.wcs.celestial
    out = from_sky(places.withColumns({f"s_w{i}": F.col("lon"), f"s_w{j}": F.col("lat")}), raster.wcs, ["s"], frame_name(frame), cut)
    out = out.withColumnsRenamed({"s_w0": "xi", "s_w1": "yi"})
    bad = F.col("xi").isNull() | F.col("yi").isNull() | F.isnan("xi") | F.isnan("yi")
    return bind(out, {k: F.when(~bad, F.col(k)) for k in ("xi", "yi")})


def image_to_healpix(raster: Raster, frame: str, nside: int = 128, order: str | int = "bilinear", nested: bool = False, cut: float | None = None) -> DataFrame:
    """Resample a two-dimensional celestial image onto a map: ipix, value, footprint of every pixel.

    The image's native longitudes begin at -180 degrees, or at ``cut``.
    """
    if raster.wcs.naxis != 2 or not raster.wcs.has_celestial:
        raise ValueError("only two-dimensional celestial images can be made into a map")
    k = order_number(order)
    frame_name(frame)
    spark = raster.pixels.sparkSession
    sky = sky_positions(spark, nside, nested)
    data = raster.pixels if k < 2 else spline_coefficients(raster, k)
    hits = sample(positions_in(sky, raster, frame, cut), data, raster.shape, k, keys=("ipix",))
    out = spark.range(hp.npix(nside)).withColumnRenamed("id", "ipix").join(hits.select("ipix", "value"), "ipix", "left")
    return out.select("ipix", "value", F.col("value").isNotNull().cast("double").alias("footprint"))

