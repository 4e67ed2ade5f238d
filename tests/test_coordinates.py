import numpy as np
import pytest
from pyspark.sql import functions as F

from skygrid.functions import healpix as hp
from skygrid.functions.wcs import PROJECTIONS, Wcs, change_frame, move, separation, transform, transform_roundtrip

CODES = sorted(PROJECTIONS)


def image(code, crval=(30.0, 40.0), **options):
    if PROJECTIONS[code][2] != 90:
        crval = (crval[0], 0.0)
    return Wcs((11.0, 9.0), (-0.5, 0.5), crval, (f"RA---{code}", f"DEC--{code}"), **options)


@pytest.mark.parametrize("code", CODES)
def test_pixels_return(code):
    y, x = (v.ravel().astype(float) for v in np.indices((18, 22)))
    wcs = image(code)
    back = wcs.world_to_pixel(*wcs.pixel_to_world(x, y))
    assert np.allclose(back[0], x, atol=1e-8) and np.allclose(back[1], y, atol=1e-8)
    lon, lat = wcs.pixel_to_world(np.float64(10), np.float64(8))
    assert np.allclose((lon, lat), (wcs.crval[0], wcs.crval[1]), atol=1e-9)


def test_columns_equal_arrays(spark):
    y, x = (v.ravel().astype(float) for v in np.indices((12, 12)))
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double")
    for code in ("TAN", "MOL", "HPX", "SFL"):
        source, target = image(code), Wcs((5.0, 6.0), (-0.4, 0.4), (100.0, 10.0), ("GLON-TAN", "GLAT-TAN"), ((0.8, -0.6), (0.6, 0.8)))
        got = move(df, source, target, {"p": (F.col("x"), F.col("y"))}).select("x", "y", "p_w0", "p_w1").toPandas().sort_values(["y", "x"])
        want = transform(source, target, x, y)
        for k in (0, 1):
            assert np.allclose(got[f"p_w{k}"].astype(float), want[k], atol=1e-6, equal_nan=True), code


def test_tangent_plane_shows_one_hemisphere():
    sky = Wcs((1.0, 91.0), (1.0, 1.0), (0.0, 0.0), ("RA---CAR", "DEC--CAR"))
    pole = Wcs((1.0, 1.0), (-0.1, 0.1), (0.0, 90.0), ("RA---TAN", "DEC--TAN"))
    x, y = np.array([10.0, 10.0]), np.array([120.0, 60.0])
    px, _ = transform_roundtrip(sky, pole, x, y)
    assert np.isfinite(px[0]) and np.isnan(px[1])


def test_frames():
    lon, lat = change_frame(np.float64(192.85948), np.float64(27.12825), "icrs", "galactic")
    assert abs(lat - 90) < 1e-9
    lon, lat = change_frame(np.float64(266.40499), np.float64(-28.93617), "icrs", "galactic")
    assert separation(lon, lat, 0.0, 0.0) < 1e-3
    with pytest.raises(ValueError):
        change_frame(np.float64(0), np.float64(0), "icrs", "nowhere")


def test_headers_and_slices():
    h = {"NAXIS": 2, "NAXIS1": 8, "NAXIS2": 6, "CTYPE1": "RA---TAN", "CTYPE2": "DEC--TAN", "CRPIX1": 3.0, "CRPIX2": 2.0, "CRVAL1": 10.0, "CRVAL2": 20.0, "CD1_1": -0.1, "CD1_2": 0.0, "CD2_1": 0.0, "CD2_2": 0.1}
    wcs = Wcs.from_header(h)
    assert wcs.shape == (6, 8) and wcs.has_celestial and wcs.pixel_scale() == pytest.approx(0.1)
    cut = wcs.shifted(2, 1)
    assert np.allclose(cut.pixel_to_world(np.float64(1), np.float64(1)), wcs.pixel_to_world(np.float64(3), np.float64(2)))
    again = Wcs.from_header(wcs.to_header())
    assert np.allclose(again.pixel_to_world(np.float64(5), np.float64(4)), wcs.pixel_to_world(np.float64(5), np.float64(4)))
    cube = Wcs((1.0, 1.0, 1.0), (-0.1, 0.1, 5.0), (0.0, 0.0, 1.0), ("RA---CAR", "DEC--CAR", "FREQ"))
    assert cube.has_spectral and cube.without_axis(2).naxis == 2
    with pytest.raises(ValueError):
        Wcs((1.0, 1.0), (1.0, 0.0), (0.0, 0.0))
    with pytest.raises(ValueError):
        Wcs((1.0, 1.0), (1.0, 1.0), (0.0, 0.0), ("RA---XYZ", "DEC--XYZ"))


def test_latitude_may_come_first():
    wcs = Wcs((1.0, 1.0), (0.1, -0.1), (40.0, 30.0), ("DEC--TAN", "RA---TAN"))
    lat, lon = wcs.pixel_to_world(np.float64(0), np.float64(0))
    assert np.allclose((lat, lon), (40, 30))


@pytest.mark.parametrize("nside", [1, 4, 32])
def test_healpix_centres_return(spark, nside):
    for nested in (True, False):
        df = hp.positions(spark.range(hp.npix(nside)), F.col("id"), nside, nested)
        bad = df.where(hp.lonlat_to_pix(F.col("lon"), F.col("lat"), nside, nested) != F.col("id"))
        assert bad.count() == 0
    both = hp.renumbered(hp.renumbered(spark.range(hp.npix(nside)).withColumn("p", F.col("id")), "p", nside, True), "p", nside, False)
    assert both.where("p <> id").count() == 0


def test_bilinear_taps(spark):
    df = spark.createDataFrame([(float(a), float(b)) for a in range(3, 360, 23) for b in range(-88, 89, 8)], "lon double, lat double")
    taps = hp.bilinear_taps(df, 8)
    total = taps.select(F.aggregate("taps", F.lit(0.0), lambda s, t: s + t["weight"]).alias("w"), F.exists("taps", lambda t: (t["weight"] < -1e-9) | (t["pix"] < 0) | (t["pix"] >= 768)).alias("bad"))
    assert total.where("bad or abs(w - 1) > 1e-9").count() == 0


def test_longitudes_begin_at_a_cut(spark):
    """Beyond the pole the tangent plane's two sides meet 180 degrees from its centre; that meridian begins the range."""
    tangent, plain = Wcs((6.0, 4.0), (-0.05, 0.04), (30.0, 40.0), ("RA---TAN", "DEC--TAN")), Wcs((1.0, 1.0), (0.1, 0.1), (0.0, 0.0), ("RA---CAR", "DEC--CAR"))
    rows = spark.range(3000).selectExpr("cast(id % 20 as double) as px", "cast(id div 20 * 40 as double) as py")
    got = np.array([tuple(r) for r in move(rows, tangent, plain, {"p": (F.col("px"), F.col("py"))}, cut=-150.0).select("px", "py", "p_w0").collect()], float)
    u, v, c = np.radians(-0.05 * (got[:, 0] - 5)), np.radians(0.04 * (got[:, 1] - 3)), np.radians(40)
    lon = 30 + np.degrees(np.arctan2(u, np.cos(c) - v * np.sin(c)))
    assert (got[:, 2] > 1800).any() and np.allclose(got[:, 2], lon * 10, atol=1e-6)
    flat = Wcs((1.0, 1.0), (0.1, 0.1), (0.0, 0.0))
    with pytest.raises(ValueError):
        move(rows, flat, flat, {"p": (F.col("px"), F.col("py"))}, cut=0.0)
