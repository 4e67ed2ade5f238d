"""Matching of image backgrounds: pairwise offsets and the corrections that explain them best."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def offsets(layers: DataFrame) -> DataFrame:
    """(i, j, offset, n): the median of value_i - value_j over pixels that both images cover, i < j.

    The differences of a pair are sorted, which spills, instead of being gathered in one aggregation buffer.
    """
    rows = layers.where("footprint > 0 and value is not null")
    a = rows.select("plane", "y", "x", F.col("image_id").alias("i"), F.col("value").alias("vi"))
    b = rows.select("plane", "y", "x", F.col("image_id").alias("j"), F.col("value").alias("vj"))
    both = a.join(b, ["plane", "y", "x"]).where("i < j")
    diff = both.select("i", "j", (F.col("vi") - F.col("vj")).alias("d"))
    pair = Window.partitionBy("i", "j")
    ranked = diff.select("i", "j", "d", F.row_number().over(pair.orderBy("d")).alias("rank"), F.count(F.lit(1)).over(pair.orderBy("d").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("n"))
    middle = ranked.where("rank = (n + 1) div 2 or rank = n div 2 + 1")
    return middle.groupBy("i", "j").agg(F.avg("d").alias("offset"), F.first("n").alias("n"))


def matrix(pairs: list[tuple[int, int, float]], n: int) -> np.ndarray:
    """Antisymmetric matrix of offsets; NaN where images do not meet."""
    out = np.full((n, n), np.nan)
    np.fill_diagonal(out, 0.0)
    for i, j, value in pairs:
        out[i, j], out[j, i] = value, -value
    return out


def solve(offset: np.ndarray) -> np.ndarray:
    """Corrections of a whole matrix of offsets; see ``solve_pairs``."""
    i, j = np.nonzero(np.triu(np.isfinite(offset), 1))
    return solve_pairs(i, j, offset[i, j], len(offset))


def solve_pairs(i: np.ndarray, j: np.ndarray, offset: np.ndarray, n: int) -> np.ndarray:
    """Corrections c with c_i - c_j close to the offsets, by least squares; their mean is zero in each connected set.

    The normal equations are the graph Laplacian of the known pairs, solved by conjugate gradients: memory and a step
    grow with the pairs.  Isolated images get zero.
    """
    scale = float(np.abs(offset).max()) if len(offset) else 0.0
    if scale == 0:
        return np.zeros(n)
    d = offset / scale
    degree = np.bincount(i, minlength=n) + np.bincount(j, minlength=n).astype(float)
    of = np.maximum(degree, 1)
    times = lambda v: degree * v - np.bincount(i, v[j], n) - np.bincount(j, v[i], n)
    set_of = _connected(i, j, n)
    size = np.bincount(set_of, minlength=n)
    centred = lambda v: v - (np.bincount(set_of, v, n) / np.maximum(size, 1))[set_of]
    c, r = np.zeros(n), np.bincount(i, d, n) - np.bincount(j, d, n)
    z = r / of
    p, rz, least = z.copy(), float(r @ z), 1e-30 * float(r @ (r / of))
    for _ in range(4 * n + 50):
        if rz <= least or rz == 0:
            break
        q = times(p)
        step = rz / float(p @ q)
        c, r = c + step * p, r - step * q
        z = r / of
        rz, before = float(r @ z), rz
        p = z + rz / before * p
    return centred(c) * scale


def _connected(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """The least member of each image's connected set."""
    out = np.arange(n)
    while True:
        least = np.minimum(out[i], out[j])
        new = out.copy()
        np.minimum.at(new, i, least)
        np.minimum.at(new, j, least)
        new = new[new]
        if (new == out).all():
            return out
        out = new


def match(layers: DataFrame, n: int, reference: int | None = None) -> DataFrame:
    """Layers with their corrections subtracted; a reference image keeps its values.

    Only the offsets, one row for each pair of overlapping images, reach the driver.
    """
    pairs = [(r.i, r.j, r.offset) for r in offsets(layers).collect()]
    i, j = (np.array([p[k] for p in pairs], np.int64) for k in (0, 1))
    c = solve_pairs(i, j, np.array([p[2] for p in pairs], float), n)
    if reference is not None:
        c = c - c[reference]
    spark = layers.sparkSession
    table = spark.createDataFrame([(k, float(v)) for k, v in enumerate(c)], "image_id long, correction double")
    out = layers.join(F.broadcast(table), "image_id") if n <= 100_000 else layers.join(table, "image_id")
    return out.withColumn("value", F.col("value") - F.col("correction")).drop("correction")
