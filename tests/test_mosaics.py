from dataclasses import replace

import numpy as np
import pytest

from skygrid.functions.wcs import Wcs, change_frame
from skygrid.operators import background, bounds, mosaic, target
from skygrid.operators.stack import Stack
from skygrid.raster import Grid, Raster, to_array

TAN = Wcs((9.0, 8.0), (-0.1, 0.1), (43.0, 23.0), ("RA---TAN", "DEC--TAN"))


def pieces(spark, a, offset=0.0):
    cuts = [(0, 9, 0, 11), (0, 10, 8, 20), (7, 16, 0, 12), (8, 16, 9, 20)]
    return [Raster.from_array(spark, a[y0:y1, x0:x1] + k * offset, TAN.shifted(x0, y0)) for k, (y0, y1, x0, x1) in enumerate(cuts)]


def test_tiles_recombine(spark):
    a = np.random.default_rng(6).random((16, 20))
    for how in ("mean", "first", "last", "min", "max", "median"):
        out = mosaic.coadd(pieces(spark, a), Grid(TAN, a.shape), how=how)
        got = to_array(out, a.shape)[0]
        # a bilinear sample at an exact pixel needs its right and upper neighbour, which the border has
        assert np.allclose(got, a, atol=1e-6), how


def test_order_and_blank(spark):
    one = [Raster.from_array(spark, np.full((4, 4), float(v)), TAN) for v in (3, 1, 2)]
    grid = Grid(TAN.shifted(-1, 0), (4, 6))
    value = {}
    for how in mosaic.COMBINE:
        value[how] = to_array(mosaic.coadd(one, grid, how=how, blank=-5.0, order="nearest-neighbor"), (4, 6))[0]
        assert (value[how][:, 0] == -5).all()
    assert {h: v[1, 2] for h, v in value.items()} == {"mean": 2, "sum": 6, "first": 3, "last": 2, "min": 1, "max": 3, "median": 2}
    with pytest.raises(ValueError):
        mosaic.coadd(one, grid, how="mode")
    far = Raster.from_array(spark, np.ones((4, 4)), TAN.shifted(500, 0))
    assert to_array(mosaic.coadd([far], grid, order="nearest-neighbor"), (4, 6))[0].max() == 0


def test_background_is_matched(spark):
    a = np.random.default_rng(7).random((16, 20))
    out = to_array(mosaic.coadd(pieces(spark, a, offset=10.0), Grid(TAN, a.shape), match_background=True, background_reference=0, order="nearest-neighbor"), a.shape)[0]
    assert np.allclose(out, a, atol=1e-6)


@pytest.mark.parametrize("n,scale", [(4, 1.0), (33, 1e30), (44, 1e-50)])
def test_corrections(n, scale):
    c = np.random.default_rng(n).normal(size=n) * scale
    c -= c.mean()
    offset = c[:, None] - c[None]
    offset[0, 3] = offset[3, 0] = np.nan
    assert np.allclose(background.solve(offset) / scale, c / scale, atol=1e-9)


def test_edges_and_bounds():
    edges = bounds.sample_edges((6, 8), 11)
    assert edges.shape == (2, 40) and edges.min() == -0.5 and edges[0].max() == 5.5 and edges[1].max() == 7.5
    flat = Wcs((1.0, 1.0), (1.0, 1.0), (0.0, 0.0))
    assert bounds.bounds_of((9, 11), flat.shifted(3, 2), Grid(flat, (16, 20))) == (2, 11, 3, 14)
    y0, y1, x0, x1 = bounds.bounds_of((9, 11), TAN.shifted(3, 2), Grid(TAN, (16, 20)))
    assert y0 <= 2 and y1 >= 11 and x0 <= 3 and x1 >= 14
    assert bounds.bounds_of((9, 11), TAN.shifted(300, 2), Grid(TAN, (16, 20))) is None


def test_optimal_grid():
    wcs = Wcs((1.0, 2.0), (-0.1, 0.1), (43.0, 23.0), ("RA---TAN", "DEC--TAN"))
    g = target.optimal_grid([((30, 40), wcs)])
    assert g.shape == (30, 40) and np.allclose(g.wcs.crval, (43, 23)) and np.allclose(g.wcs.crpix, (1, 2)) and np.allclose(g.wcs.cdelt, (-0.1, 0.1))
    assert target.optimal_grid([((30, 40), wcs)], frame="galactic").wcs.sky == "galactic"
    with pytest.raises(TypeError):
        target.optimal_grid([((30, 40), Wcs((1.0, 1.0), (1.0, 1.0), (0.0, 0.0)))])
    with pytest.raises(ValueError):
        target.optimal_grid([((3, 30, 40), Wcs((1.0, 1.0, 1.0), (1.0, 1.0, 1.0), (0.0, 0.0, 0.0), ("RA---TAN", "DEC--TAN", "FREQ")))])


def test_a_stack_is_its_images(spark):
    """One plan for all images gives what image by image gives, on the sky and across frames."""
    rng = np.random.default_rng(8)
    turned = ((0.8, -0.6), (0.6, 0.8))
    own = [Wcs((5.0 + k, 6.0), (-0.1, 0.1), (43.0 + 0.3 * k, 23.0 - 0.2 * k), ("RA---TAN", "DEC--TAN"), turned if k == 2 else None) for k in range(4)]
    images = [Raster.from_array(spark, np.where(rng.random((9, 11)) < 0.05, np.nan, rng.random((9, 11))), w) for w in (*own, own[0].shifted(9000, 0))]
    far = Wcs((10.0, 10.0), (-0.11, 0.11), (140.0, 40.0), ("GLON-TAN", "GLAT-TAN"))
    for grid in (Grid(TAN, (24, 30)), Grid(replace(far, crval=change_frame(43.0, 23.0, "icrs", "galactic")), (30, 30))):
        for order in ("bilinear", "nearest"):
            one, all_of = (mosaic.layers_of(x, grid, order=order) for x in (images, Stack.of(images)))
            value = lambda df: {(r.image_id, r.y, r.x): r.value for r in df.collect()}
            a, b = value(one), value(all_of)
            assert a.keys() == b.keys() and len(a) > 200 and all(abs(a[k] - b[k]) < 1e-9 for k in a)
    flat = [Raster.from_array(spark, rng.random((6, 7)), Wcs((1.0 - 4 * k, 1.0), (1.0, 1.0), (0.0, 0.0))) for k in range(3)]
    grid = Grid(Wcs((1.0, 1.0), (0.5, 0.5), (0.0, 0.25)), (12, 30))
    a, b = (to_array(mosaic.coadd(x, grid, how="mean"), (12, 30))[0] for x in (flat, Stack.of(flat)))
    assert np.allclose(a, b, atol=1e-12)
    with pytest.raises(ValueError):
        Stack.of([images[0], flat[0]])


def test_corrections_of_many_images():
    rng = np.random.default_rng(4)
    n = 20_000
    c = rng.normal(size=n)
    i = np.concatenate([np.arange(n - 1), rng.integers(0, n, 60_000)])
    j = np.concatenate([np.arange(1, n), rng.integers(0, n, 60_000)])
    i, j = i[i != j], j[i != j]
    assert np.allclose(background.solve_pairs(i, j, c[i] - c[j], n), c - c.mean(), atol=1e-6)
    apart = background.solve_pairs(np.array([0, 3]), np.array([1, 4]), np.array([2.0, 4.0]), 6)
    assert np.allclose(apart, [1, -1, 0, 2, -2, 0])


def test_equal_boxes_are_compared_once_and_lose_no_pair(spark, monkeypatch):
    monkeypatch.setattr(bounds, "SHARED_IDS", 16)
    box = ("id % 7 * 11 as y0", "id % 7 * 11 + 5 + id % 5 * 9 as y1", "id % 3 * 20 as x0", "id % 3 * 20 + 30 as x1")
    images = spark.range(2000).selectExpr("if(id = 3, null, id) as image_id", *box)
    chunks = spark.range(1000, 1300).selectExpr("cast(id as string) as chunk_id", *box)
    left, right = images.collect(), chunks.collect()
    cut = lambda a, c: (max(a.y0, c.y0), min(a.y1, c.y1), max(a.x0, c.x0), min(a.x1, c.x1))
    expected = [(a.image_id, c.chunk_id, *o) for a in left for c in right for o in [cut(a, c)] if o[0] < o[1] and o[2] < o[3]]
    got = bounds.overlap_join(images, chunks, 16)
    assert got.columns == ["image_id", "chunk_id", "oy0", "oy1", "ox0", "ox1"]
    order = lambda rows: sorted(map(tuple, rows), key=str)
    assert order(got.collect()) == order(expected)
    shared = bounds._equal_boxes(images, "image_id").collect()
    assert len(shared) == 210 and max(len(r.image_ids) for r in shared) <= 16 and sum(len(r.image_ids) for r in shared) == 2000
