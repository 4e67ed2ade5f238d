"""Tiles as a partitioned table: the sink for mosaics and pyramids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import cut


def assign(pixels: DataFrame, tile: int) -> DataFrame:
    """Pixels with their tile (ty, tx)."""
    return pixels.withColumns({"ty": F.expr(f"y div {tile}"), "tx": F.expr(f"x div {tile}")})


def to_arrays(pixels: DataFrame, shape: tuple[int, int], tile: int) -> DataFrame:
    """One row a tile: plane, ty, tx, h, w and its values in C order; border tiles keep their true size."""
    ny, nx = shape
    rows = assign(pixels, tile).groupBy("plane", "ty", "tx").agg(F.sort_array(F.collect_list(F.struct("y", "x", "value"))).alias("cells"))
    h, w = F.least(F.lit(tile), ny - F.col("ty") * tile), F.least(F.lit(tile), nx - F.col("tx") * tile)
    known = F.map_from_entries(F.transform("cells", lambda c: F.struct(((c["y"] - F.col("ty") * tile) * w + c["x"] - F.col("tx") * tile).alias("k"), c["value"].alias("v"))))
    dense = F.when(F.size("cells") == h * w, F.col("cells.value")).otherwise(F.transform(F.sequence(F.lit(0).cast("long"), h * w - 1), lambda k: F.try_element_at(known, k)))
    return rows.select("plane", "ty", "tx", h.cast("int").alias("h"), w.cast("int").alias("w"), dense.alias("data"))


def from_arrays(tiles: DataFrame, tile: int) -> DataFrame:
    """Pixels of tile rows."""
    rows = tiles.select("plane", "ty", "tx", "w", F.posexplode("data").alias("k", "value"))
    return rows.select("plane", (F.col("ty") * tile + F.expr("k div w")).alias("y"), (F.col("tx") * tile + F.expr("k % w")).alias("x"), "value")


def write(pixels: DataFrame, path: str, tile: int = 256, by: tuple[str, ...] = ("ty",)) -> None:
    """Write pixels by tile; the path must not exist.  Rows of a tile meet in one file, so readers can prune."""
    rows = assign(pixels, tile)
    rows.repartitionByRange(*by, "tx").sortWithinPartitions(*by, "tx", "y", "x").write.mode("errorifexists").partitionBy(*by).parquet(path)


def update(pixels: DataFrame, path: str, tile: int = 256, by: tuple[str, ...] = ("ty",)) -> None:
    """Put pixels into a table that is there: rows of tiles (``by``) that they touch are replaced as a whole, others stay.

    Stored pixels of those rows that the new ones do not cover are kept.
    """
    spark = pixels.sparkSession
    new = cut(assign(pixels, tile))
    keys = [k for k in ("image_id", "plane", "y", "x") if k in new.columns]
    old = spark.read.schema(new.schema).parquet(path).join(F.broadcast(new.select(*by).distinct()), list(by), "left_semi").join(new.select(*keys), keys, "left_anti")
    rows = cut(new.unionByName(old.select(*new.columns)))
    rows.repartitionByRange(*by, "tx").sortWithinPartitions(*by, "tx", "y", "x").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
