import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from skygrid.functions import polygons
from skygrid.functions.wcs import Wcs
from skygrid.operators import adaptive, interpolate, overlap
from skygrid.raster import Grid, Raster, to_array

LINEAR = Wcs((1.0, 1.0), (1.0, 1.0), (0.0, 0.0))
TAN = Wcs((6.0, 5.0), (-0.1, 0.1), (43.0, 23.0), ("RA---TAN", "DEC--TAN"))


def array(df, shape, column="value"):
    return to_array(df, shape, column)[0]


def test_identity_with_offset_leaves_a_ring(spark):
    a = np.random.default_rng(1).normal(size=(9, 11))
    for order in ("nearest-neighbor", "bilinear", "bicubic"):
        out = array(interpolate.interpolate(Raster.from_array(spark, a, TAN), Grid(TAN.shifted(-1, -1), (11, 13)), order), (11, 13))
        assert np.allclose(out[1:-1, 1:-1], a, atol=1e-6)
        ring = np.ones((11, 13), bool)
        ring[1:-1, 1:-1] = False
        assert np.isnan(out[ring]).all()


def test_bilinear_against_numpy(spark):
    rng = np.random.default_rng(2)
    a = rng.normal(size=(7, 8))
    a[2, 3] = np.nan
    wcs = Wcs((1.0, 1.0), (0.43, 0.37), (-0.9, -1.1))
    out = array(interpolate.interpolate(Raster.from_array(spark, a, LINEAR), Grid(wcs, (25, 26))), (25, 26))
    for y in range(25):
        for x in range(26):
            xi, yi = 0.43 * x - 0.9, 0.37 * y - 1.1
            if not (-0.5 <= xi < 7.5 and -0.5 <= yi < 6.5):
                assert np.isnan(out[y, x])
                continue
            xc, yc = min(max(xi, 0), 7), min(max(yi, 0), 6)
            i, j = int(xc), int(yc)
            i1, j1 = min(i + 1, 7), min(j + 1, 6)
            s, t = xc - i, yc - j
            want = (1 - t) * (1 - s) * a[j, i] + (1 - t) * s * a[j, i1] + t * (1 - s) * a[j1, i] + t * s * a[j1, i1]
            assert out[y, x] == pytest.approx(want, nan_ok=True)


def test_prefilter_reproduces_samples():
    a = np.random.default_rng(3).normal(size=(4, 17))
    for order in (2, 3):
        c = interpolate.prefilter(a, order)
        p = np.concatenate([c[:, 1:2], c, c[:, -2:-1]], axis=1)
        side, mid = (1 / 8, 6 / 8) if order == 2 else (1 / 6, 4 / 6)
        assert np.allclose(side * p[:, :-2] + mid * p[:, 1:-1] + side * p[:, 2:], a)


def test_planes_share_the_map(spark):
    a = np.random.default_rng(4).normal(size=(3, 6, 7))
    grid = Grid(Wcs((1.0, 1.0), (0.5, 0.5), (0.25, 0.25)), (10, 12))
    all_of = to_array(interpolate.interpolate(Raster.from_array(spark, a, LINEAR), grid), (10, 12))
    for k in range(3):
        one = array(interpolate.interpolate(Raster.from_array(spark, a[k], LINEAR), grid), (10, 12))
        assert np.allclose(all_of[k], one, equal_nan=True)


def test_bounds_and_errors(spark):
    raster = Raster.from_array(spark, np.ones((5, 5)), LINEAR)
    part = interpolate.interpolate(raster, Grid(LINEAR, (5, 5)), bounds=(1, 3, 2, 9))
    assert {(r.y, r.x) for r in part.collect()} == {(y, x) for y in (1, 2) for x in (2, 3, 4)}
    with pytest.raises(ValueError):
        interpolate.interpolate(raster, Grid(TAN, (5, 5)))
    with pytest.raises(ValueError):
        interpolate.order_number("cubic")
    with pytest.raises(ValueError):
        Grid.parse(LINEAR)
    with pytest.raises(ValueError):
        adaptive.resample(raster, Grid(LINEAR, (5, 5)), kernel="box")


def test_adaptive_conserves_flux(spark):
    a = np.zeros((20, 20))
    a[12, 13] = 1
    source, target = Wcs((11.0, 11.0), (1.0, 1.0), (0.0, 0.0)), Wcs((16.0, 16.0), (0.8, 0.9), (0.0, 0.0))
    for kernel, width in (("hann", 4), ("gaussian", 5)):
        out = adaptive.resample(Raster.from_array(spark, a, source), Grid(target, (30, 30)), kernel=kernel, sample_region_width=width, conserve_flux=True, boundary_mode="ignore")
        assert np.nansum(array(out, (30, 30))) == pytest.approx(1, abs=0.004)


@pytest.mark.parametrize("mode", adaptive.BOUNDARIES)
def test_adaptive_boundaries(spark, mode):
    """Ones on a grid that reaches beyond the image on every side."""
    raster = Raster.from_array(spark, np.ones((12, 12)), LINEAR)
    out = array(adaptive.resample(raster, Grid(LINEAR.shifted(-4.3, -4.3), (20, 20)), kernel="hann", boundary_mode=mode, boundary_fill_value=0.0), (20, 20))
    assert np.allclose(out[7:13, 7:13], 1)
    corner = out[0, 0]
    if mode in ("strict", "constant", "ignore", "ignore_threshold"):
        assert np.isnan(corner)
    else:
        assert corner == (1 if mode == "nearest" else 0)
    if mode == "constant":
        assert (out[np.isfinite(out)] <= 1).all() and (out[np.isfinite(out)] < 1).any()


def test_adaptive_bad_values_and_cycles(spark):
    a = np.ones((10, 10))
    a[5, 5] = np.nan
    raster, grid = Raster.from_array(spark, a, LINEAR), Grid(LINEAR.shifted(0.3, 0.3), (9, 9))
    strict = array(adaptive.resample(raster, grid, kernel="hann", boundary_mode="ignore"), (9, 9))
    assert np.isnan(strict).sum() == 4
    ignored = array(adaptive.resample(raster, grid, kernel="hann", boundary_mode="ignore", bad_value_mode="ignore"), (9, 9))
    assert np.allclose(ignored, 1)
    filled = array(adaptive.resample(raster, grid, kernel="hann", boundary_mode="ignore", bad_value_mode="constant", bad_fill_value=3.0), (9, 9))
    assert filled.max() > 1
    ring = np.tile(np.arange(10.0), (10, 1))
    out = array(adaptive.resample(Raster.from_array(spark, ring, LINEAR), Grid(LINEAR.shifted(4, 0), (10, 10)), kernel="hann", x_cyclic=True), (10, 10))
    assert np.allclose(out[4], np.roll(ring[4], -4))


@pytest.mark.parametrize("options", [{"kernel": "gaussian"}, {"kernel": "hann"}, {"kernel": "hann", "boundary_mode": "ignore", "bad_value_mode": "ignore"}, {"kernel": "hann", "boundary_mode": "ignore_threshold"}])
def test_pixels_of_the_boxes_do_not_pass_the_driver(spark, options):
    """A small target's boxes hold many pixels, which the optimiser does not know: they are never broadcast."""
    image = spark.range(4_000_000).selectExpr("id div 2000 as y", "id % 2000 as x", "1.0D as value")
    out = adaptive.resample(Raster.of(image, LINEAR, (2000, 2000)), Grid(Wcs((1.0, 1.0), (10.0, 10.0), (4.5, 4.5)), (200, 200)), **options)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [sy" in plan and "BroadcastHashJoin [sy" not in plan


def test_quads_overlap():
    e = math.radians(0.01)
    lon, lat = np.array([[0, e, e, 0]]), np.array([[0, 0, e, e]])
    for flip in (slice(None), slice(None, None, -1)):
        assert polygons.overlap(lon, lat, lon[:, flip], lat[:, flip])[0] == pytest.approx(e * e, rel=1e-6)
        assert polygons.overlap(lon, lat, lon[:, flip] + e / 2, lat[:, flip])[0] == pytest.approx(e * e / 2, rel=1e-6)
    big = math.radians(30)
    lon, lat = np.array([[0, big, big, 0]]), np.array([[-big, -big, big, big]])
    whole = polygons.overlap(lon, lat, lon, lat)[0]
    halves = sum(polygons.overlap(lon, lat, np.array([[a, a + big / 2, a + big / 2, a]]), np.array([[-big, -big, big, big]]))[0] for a in (0, big / 2))
    assert 0 < halves <= whole * 1.001
    assert polygons.overlap(lon, lat, lon + math.pi, lat)[0] == 0


def test_exact_identity_and_flux(spark):
    a = np.random.default_rng(5).random((8, 9))
    out = overlap.resample(Raster.from_array(spark, a, TAN), Grid(TAN, (8, 9)))
    assert np.allclose(array(out, (8, 9)), a, atol=1e-8)
    assert np.allclose(array(out, (8, 9), "footprint"), 1, atol=1e-8)
    fine = Wcs((12.3, 10.1), (-0.05, 0.05), (43.0, 23.0), ("RA---TAN", "DEC--TAN"), ((0.8, -0.6), (0.6, 0.8)))
    got = overlap.resample(Raster.from_array(spark, np.ones((8, 9)), TAN), Grid(fine, (30, 30))).where("footprint > 0")
    assert got.agg(F.min("value"), F.max("value")).first()[0] == pytest.approx(1)
