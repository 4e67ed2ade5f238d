import numpy as np
import pytest
from pyspark.sql import functions as F

from skygrid.functions.wcs import OwnWcs, Wcs, change_frame
from skygrid.operators import coverage, hips, interpolate, spherical
from skygrid.raster import Grid, Raster, to_array
from skygrid.sources import fits, png, tiles, tree
from skygrid.streaming import coadd as stream

#: The 30 x 40 image at (30, 40) whose tiles and map pixels are known.
SIMPLE = Wcs((1.0, 2.0), (-0.05, 0.04), (30.0, 40.0), ("RA---TAN", "DEC--TAN"))


def test_map_pixels_inside_an_image(spark):
    raster = Raster.from_array(spark, np.ones((30, 40)), SIMPLE)
    out = spherical.image_to_healpix(raster, "icrs", 64, "nearest-neighbor")
    assert out.where("value is not null").count() == 4
    assert out.count() == 12 * 64 * 64


def test_constant_map_to_image(spark):
    ones = spark.range(768).select(F.col("id").alias("ipix"), F.lit(2.0).alias("value"))
    wcs = Wcs((18.5, 9.5), (-10.0, 10.0), (180.0, 0.0), ("RA---CAR", "DEC--CAR"))
    for order in ("nearest-neighbor", "bilinear"):
        for nested in (True, False):
            got = to_array(spherical.image_from_healpix(ones, 8, "galactic", Grid(wcs, (18, 36)), order=order, nested=nested), (18, 36))[0]
            assert np.allclose(got, 2.0)
    with pytest.raises(ValueError):
        spherical.image_from_healpix(ones, 8, "icrs", Grid(wcs, (18, 36)), order="bicubic")


def test_tiles_of_an_image(spark):
    raster = Raster.from_array(spark, np.ones((30, 40)), SIMPLE)
    found = hips.to_tiles(raster, "icrs", 4, 4, "nearest-neighbor")
    want = spherical.image_to_healpix(raster, "icrs", 64, "nearest-neighbor", nested=True).where("value is not null")
    assert {r.npix for r in found.select("npix").distinct().collect()} == {r.p for r in want.select((F.col("ipix") / 16).cast("long").alias("p")).distinct().collect()}
    assert found.count() == want.count()
    low = hips.pyramid(found, 4, 2)
    assert {r.norder for r in low.select("norder").distinct().collect()} == {4, 3, 2}
    assert low.where("abs(value - 1) > 1e-12").count() == 0


def test_children_go_to_their_quadrants(spark):
    rows = [(1, 4 + k, y, x, float(k)) for k in range(4) for y in range(2) for x in range(2)]
    up = {(r.y, r.x): r.value for r in hips.coarser(spark.createDataFrame(rows, "norder int, npix long, y long, x long, value double"), 2).collect()}
    assert up == {(1, 0): 0.0, (0, 0): 1.0, (1, 1): 2.0, (0, 1): 3.0}


def test_coverage(spark):
    cells = spark.createDataFrame([(2, p) for p in range(16)] + [(2, 40), (1, 12)], "norder int, ipix long")
    assert {(r.norder, r.ipix) for r in coverage.normalise(cells, 2).collect()} == {(0, 0), (2, 40), (1, 12)}
    assert {(r.start, r.stop) for r in coverage.ranges(cells, 2).collect()} == {(0, 16), (40, 41), (48, 52)}
    with pytest.raises(ValueError):
        hips.union_of([cells], "never")


def test_fits_images(spark, tmp_path):
    a = np.random.default_rng(8).normal(size=(5, 7))
    a[1, 2] = np.nan
    path = str(tmp_path / "a.fits")
    fits.write_image(path, a, SIMPLE.to_header())
    back, header = fits.read_image(path)
    assert np.array_equal(a, back, equal_nan=True) and header["CTYPE1"] == "RA---TAN"
    raster = fits.raster(spark, path)
    assert np.array_equal(to_array(raster.pixels, (5, 7))[0], a, equal_nan=True)
    assert np.allclose(raster.wcs.crval, (30, 40)) and raster.shape == (5, 7)
    for bitpix in (16, 32, -32):
        fits.write_image(str(tmp_path / f"{bitpix}.fits"), np.arange(6).reshape(2, 3), bitpix=bitpix)
        assert (fits.read_image(str(tmp_path / f"{bitpix}.fits"))[0] == np.arange(6).reshape(2, 3)).all()


def test_png():
    a = np.random.default_rng(9).integers(0, 256, (4, 6, 5)).astype(np.uint8)
    for n in (1, 3, 4):
        assert (png.decode(png.encode(a[:n])) == a[:n]).all()
    rgb = a[:3].astype(float)
    rgb[0, 2, 2] = np.nan
    out = png.transparent(rgb)
    assert out.shape == (4, 6, 5) and out[3, 2, 2] == 0 and out[3, 0, 0] == 255


def test_tile_tables(spark, tmp_path):
    a = np.random.default_rng(10).normal(size=(10, 13))
    a[3, 3] = np.nan
    raster = Raster.from_array(spark, a, SIMPLE)
    rows = tiles.to_arrays(raster.pixels, (10, 13), 4)
    assert {(r.h, r.w) for r in rows.select("h", "w").distinct().collect()} == {(4, 4), (2, 4), (4, 1), (2, 1)}
    assert np.array_equal(to_array(tiles.from_arrays(rows, 4), (10, 13))[0], a, equal_nan=True)
    tiles.write(raster.pixels, str(tmp_path / "t"), 4)
    assert np.array_equal(to_array(tiles.read(spark, str(tmp_path / "t")), (10, 13))[0], a, equal_nan=True)


def test_stream_of_exposures(spark, tmp_path):
    source, sink = tmp_path / "in", tmp_path / "out"
    for k in range(3):
        spark.range(12).select((F.col("id") % 3).alias("y"), F.expr("id div 3").alias("x"), (F.col("id") + k).cast("double").alias("value"), F.lit(1.0).alias("footprint")).write.mode("append").parquet(str(source))
    schema = "y long, x long, value double, footprint double"
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    folder = stream.TileFold(str(sink))
    q = reader.writeStream.foreachBatch(folder).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    folder(spark.read.schema(schema).parquet(str(source)).limit(0), 99)
    got = {(r.y, r.x): r.value for r in stream.mean(folder.mosaic(spark)).collect()}
    assert got == {(i % 3, i // 3): i + 1.0 for i in range(12)}


def test_trees_of_tiles(spark, tmp_path):
    rows = [(k, p, y, x, float(y * 4 + x) if (y, x) != (1, 1) else None) for k, p in ((1, 3), (1, 40), (0, 10)) for y in range(4) for x in range(4)]
    made = spark.createDataFrame(rows, "norder int, npix long, y long, x long, value double")
    folder = f"file://{tmp_path}/tree"
    (tmp_path / "tree").mkdir()
    assert tree.write_tree(made, folder, 4, 1, "galactic", title="a = b", properties={"note": "x"}).count() == 3
    back = tree.read_tree(spark, folder)
    assert back.count() == 30 and tree.read_tree(spark, folder, 0).count() == 15
    assert back.where("norder = 1 and npix = 40 and y = 2 and x = 3").first().value == 11.0
    with pytest.raises(ValueError):
        tree.read_tree(spark, folder, 2)
    found = tree.read_properties(spark, folder)
    assert {(r.start, r.stop) for r in tree.read_coverage(spark, folder).collect()} == {(3, 4), (40, 41)}
    assert (tmp_path / "tree" / "Norder0" / "Allsky.fits").exists() and (tmp_path / "tree" / "Norder1" / "Allsky.fits").exists()
    assert tree.read_map(spark, folder).pixels.where("value is not null").count() == 30
    assert found["hips_frame"] == "galactic" and found["obs_title"] == "a = b" and found["hips_order"] == "1"
    assert (tmp_path / "tree" / "Norder1" / "Dir0" / "Npix40.fits").exists() and (tmp_path / "tree" / "index.html").exists()
    with pytest.raises(FileExistsError):
        tree.write_tree(made, folder, 4, 1)
    with pytest.raises(ValueError):
        tree.write_tree(made, f"file://{tmp_path}/other", 4, 1, properties={"hips_order": 3})
    colours = made.where("norder = 0").crossJoin(spark.range(3).withColumnRenamed("id", "plane"))
    assert tree.write_tiles(colours, f"file://{tmp_path}/png", 4, "png").count() == 1
    pixels = png.read(spark, str(tmp_path / "png"))
    assert pixels.count() == 4 * 16 and pixels.where("plane = 3 and value = 0").count() == 1


def test_trees_of_cubes(spark, tmp_path):
    rows = [(2, p, 1, f, z, y, x, float(z * 16 + y * 4 + x)) for p, f in ((7, 1), (100, 1), (100, 2)) for z in range(3) for y in range(1, 4) for x in range(2)]
    made = spark.createDataFrame(rows, "norder int, npix long, forder int, fpix long, z long, y long, x long, value double")
    folder = f"file://{tmp_path}/cubes"
    (tmp_path / "cubes").mkdir()
    assert tree.write_tree(made, folder, 4, 2, depth=8, level_depth=1).count() == 3
    image, head = fits.image_from_bytes((tmp_path / "cubes" / "Norder2_1" / "Dir0_0" / "Npix100_2.fits").read_bytes())
    assert image.shape == (3, 3, 2) and [head[k] for k in ("ONAXIS1", "ONAXIS3", "TRIM2", "FPIX")] == [4, 8, 1, 2] and head["CRPIX3"] == 1 - 2 * 8
    back = tree.read_tree(spark, folder)
    assert sorted(map(tuple, back.collect())) == sorted(rows)
    assert {r.fpix for r in tree.read_tree(spark, folder, hertz=(1e11, 1e20)).collect()} == {2}
    assert sorted(map(tuple, tree.read_coverage(spark, folder).collect())) == [(1, 7, 8), (1, 100, 101), (2, 100, 101)]
    with pytest.raises(ValueError):
        tree.read_map(spark, folder)


def test_map_and_tiles_agree(spark):
    """A tile's own header, its place in the map and its cell are three ways to the same sky."""
    for order, tile in ((0, 4), (2, 4)):
        cells = spark.range(12 * 4**order).withColumnRenamed("id", "npix")
        sky = hips.tile_sky(cells, order, tile).withColumn("norder", F.lit(order)).withColumn("value", F.col("npix").cast("double"))
        placed = sky.select("norder", "npix", "y", "x", (F.col("npix") * 1000 + F.col("y") * 10 + F.col("x")).alias("value"))
        on_map = hips.on_map(placed, order, tile)
        back = hips.from_map(on_map.drop("plane"), order, tile)
        assert all(r.value == r.npix * 1000 + r.y * 10 + r.x for r in back.collect()) and back.count() == sky.count()
        grid, at = hips.map_grid(order, tile), {r.value: (r.x, r.y) for r in on_map.collect()}
        for r in sky.sample(0.5, 3).collect():
            x, y = at[r.npix * 1000 + r.y * 10 + r.x]
            for wcs, px, py in ((grid.wcs, x, y), (hips.tile_wcs(order, r.npix, tile), r.x, r.y), *([(hips.tile_wcs(order, r.npix, tile, second=True), r.x, r.y)] if hips.is_border(order, r.npix) else [])):
                lon, lat = (float(v) for v in wcs.pixel_to_world(np.float64(px), np.float64(py)))
                assert abs(lat - r.lat) < 1e-9 and abs((lon - r.lon + 180) % 360 - 180) < 1e-9, (order, r)


def test_tiles_by_any_function(spark):
    wcs = Wcs((10.5, 10.5), (-0.5, 0.5), (180.0, 3.0), ("RA---TAN", "DEC--TAN"))  # across the cut of the plane
    raster = Raster.from_array(spark, np.arange(400.0).reshape(20, 20), wcs)
    own = {(r.npix, r.y, r.x): r.value for r in hips.to_tiles(raster, "icrs", 8, 3, "nearest").collect()}
    by = {(r.npix, r.y, r.x): r.value for r in hips.to_tiles_by(interpolate.interpolate, raster, "icrs", 8, 3, order="nearest").collect()}
    assert len(own) > 50 and by == own


def test_tiles_of_a_cube(spark):
    wcs = Wcs((4.5, 4.5, 1.0), (-2.0, 2.0, 2e9), (30.0, 10.0, 1e9), ("RA---TAN", "DEC--TAN", "FREQ"))
    raster = Raster(spark.range(8 * 8 * 5).select(F.expr("id div 64").alias("plane"), F.expr("id div 8 % 8").alias("y"), (F.col("id") % 8).alias("x"), F.expr("cast(id div 64 as double)").alias("value")), wcs, (5, 8, 8))
    made = hips.to_tiles_3d(raster, "icrs", 4, 8, 2, 6, "nearest")
    rows = made.withColumn("hz", hips.spectral.index_to_coord(6, F.col("fpix") + (F.col("z") + 0.5) / 8)).collect()
    assert {r.value for r in rows} >= {2.0, 3.0, 4.0} and all(abs((r.hz - 1e9) / 2e9 - r.value) <= 0.5 + 1e-9 for r in rows)
    up = hips.pyramid_3d(made, 4, 8, 2, 6)
    assert {r.norder for r in up.select("norder").distinct().collect()} == {0, 1, 2}


def test_tables_are_updated_in_place(spark, tmp_path):
    path = str(tmp_path / "t")
    old = spark.range(64).selectExpr("0L as plane", "id div 8 as y", "id % 8 as x", "1.0D as value")
    tiles.write(old, path, 2)
    tiles.update(spark.range(3).selectExpr("0L as plane", "5L as y", "id as x", "7.0D as value"), path, 2)
    got = {(r.y, r.x): r.value for r in tiles.read(spark, path).collect()}
    assert len(got) == 64 and {k for k, v in got.items() if v == 7} == {(5, 0), (5, 1), (5, 2)}


def test_images_over_each_other(spark):
    rows = [(k, c, float(v)) for k, px in enumerate([(200, 100, 0, 255), (0, 50, 100, 128)]) for c, v in enumerate(px)]
    make = lambda k, x: spark.createDataFrame([(1, 2, 0, x, c, v) for i, c, v in rows if i == k], "norder int, npix long, y long, x long, plane long, value double")
    out = {(r.x, r.plane): r.value for r in hips.blend([make(1, 0).union(make(1, 1)), make(0, 0)]).collect()}
    a = 128 / 255
    assert np.allclose([out[0, c] for c in range(4)], [200 * (1 - a), 50 * a + 100 * (1 - a), 100 * a, 255])
    assert np.allclose([out[1, c] for c in range(4)], [0, 50, 100, 128])


def test_description_in_a_png():
    import struct
    import zlib

    xmp = b'<x avm:Spatial.Rotation="30" avm:Spatial.CoordinateFrame="ICRS"><avm:Spatial.ReferenceValue><rdf:Seq><rdf:li>10.5</rdf:li><rdf:li>-3</rdf:li></rdf:Seq></avm:Spatial.ReferenceValue><avm:Spatial.ReferencePixel><rdf:Seq><rdf:li>4</rdf:li><rdf:li>5</rdf:li></rdf:Seq></avm:Spatial.ReferencePixel><avm:Spatial.Scale><rdf:Seq><rdf:li>-0.1</rdf:li><rdf:li>0.1</rdf:li></rdf:Seq></avm:Spatial.Scale></x>'
    plain = png.encode(np.zeros((3, 8, 9), np.uint8))
    assert png.description(plain) is None
    for packed in (0, 1):
        body = b"XML:com.adobe.xmp\0" + bytes([packed, 0]) + b"\0\0" + (zlib.compress(xmp) if packed else xmp)
        chunk = struct.pack(">I", len(body)) + b"iTXt" + body + struct.pack(">I", zlib.crc32(b"iTXt" + body))
        wcs = png.description(plain[:33] + chunk + plain[33:])
        assert wcs.crval == (10.5, -3.0) and wcs.crpix == (4.0, 5.0) and wcs.ctype == ("RA---TAN", "DEC--TAN") and abs(wcs.pc[1][0] - 0.5) < 1e-12


def test_files_by_address(spark, tmp_path):
    path = f"file://{tmp_path}/a.fits"
    fits.write_image(path, np.arange(12.0).reshape(3, 4), SIMPLE.to_header())
    with pytest.raises(FileExistsError):
        fits.write_image(path, np.zeros((2, 2)))
    assert fits.raster(spark, path).pixels.where("value = 7 and y = 1 and x = 3").count() == 1


def test_own_coordinates(spark):
    """A user's two functions give what the description they imitate gives, as source and as target."""
    own = OwnWcs(lambda x, y: SIMPLE.pixel_to_world(x, y), lambda a, b: SIMPLE.world_to_pixel(a, b), ("RA", "DEC"), scale=0.04)
    far = Wcs((1.0, 1.0), (0.04, 0.04), (0.0, 0.0), ("GLON-CAR", "GLAT-CAR"))
    lon, lat = change_frame(30.0, 40.0, "icrs", "galactic")
    grid = Grid(far.shifted(round(float(lon) / 0.04) - 20, round(float(lat) / 0.04) - 20), (40, 40))
    a = np.random.default_rng(2).random((30, 40))
    value = lambda wcs: to_array(interpolate.interpolate(Raster.from_array(spark, a, wcs), grid), (40, 40))[0]
    one, two = value(SIMPLE), value(own)
    assert np.isfinite(one).sum() > 100 and np.allclose(one, two, atol=1e-9, equal_nan=True)
    back = to_array(interpolate.interpolate(Raster.from_array(spark, a, SIMPLE), Grid(own.shifted(3, 2), (20, 25))), (20, 25))[0]
    assert np.allclose(back, a[2:22, 3:28], atol=1e-6)


def test_paths_of_tiles_have_the_columns_of_their_sql(spark):
    import duckdb
    from skygrid.plans import queries

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{sf}/orders.parquet'")
    expected = con.execute(queries.ORACLE_SQL["hips_paths"])
    names = [d[0] for d in expected.description]
    got = queries.QUERIES["hips_paths"](spark, sf)
    assert got.columns == names
    assert sorted(map(tuple, got.collect())) == sorted(expected.fetchall())


def test_parsed_paths_in_two_and_three_dimensions(spark):
    paths = spark.createDataFrame([("Norder7/Dir10000/Npix12345.fits",), ("Norder7_4/Dir10000_10/Npix12345_17.fits",)], "path string")
    got = paths.select(*[v.alias(k) for k, v in hips.parse_path(F.col("path")).items()]).collect()
    assert [(r.norder, r.npix, r.forder, r.fpix) for r in got] == [(7, 12345, None, None), (7, 12345, 4, 17)]


@pytest.mark.parametrize("name", ["image_to_hpx_nearest", "image_to_hpx_bilinear"])
def test_map_of_the_events_begins_at_longitude_zero(spark, name):
    """Cells just below 360 degrees are not in the image's first column, as in SQL."""
    import duckdb

    from skygrid.plans import queries

    sf = "/root/testdata/sf0.1"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{sf}/events.parquet'")
    expected = con.execute(f"SELECT ipix FROM ({queries.ORACLE_SQL[name]}) WHERE footprint = 1").fetchall()
    got = queries.QUERIES[name](spark, sf).where("footprint = 1").select("ipix").collect()
    assert len(expected) > 10000 and sorted(r[0] for r in got) == sorted(r[0] for r in expected)
