"""HEALPix indices as integer column expressions (Gorski et al. 2005)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .backend import ColumnMath as M
from .backend import bind

R2D = 180 / math.pi


def check_nside(nside: int) -> int:
    if nside < 1 or nside & (nside - 1):
        raise ValueError("nside must be a power of two")
    return nside


def level_to_nside(level: int) -> int:
    return 1 << level


def nside_to_level(nside: int) -> int:
    return check_nside(nside).bit_length() - 1


def npix(nside: int) -> int:
    return 12 * nside * nside


def pixel_resolution(nside: int) -> float:
    """Root of a pixel's area, in degrees."""
    return math.sqrt(4 * math.pi / npix(nside)) * R2D


def nside_for_resolution(degrees: float) -> int:
    """The least nside whose pixels are no larger than the resolution."""
    need = math.sqrt(math.pi / 3) * R2D / degrees
    return 1 << max(0, math.ceil(math.log2(need)))


_SPREAD = ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555))


def spread_bits(x: Column) -> Column:
    """Bit i to bit 2 i."""
    for shift, mask in _SPREAD:
        x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(mask))
    return x


def gather_bits(x: Column) -> Column:
    """Bit 2 i to bit i."""
    x = x.bitwiseAND(F.lit(0x5555555555555555))
    for shift, mask in ((1, 0x3333333333333333), (2, 0x0F0F0F0F0F0F0F0F), (4, 0x00FF00FF00FF00FF), (8, 0x0000FFFF0000FFFF), (16, 0x00000000FFFFFFFF)):
        x = x.bitwiseOR(F.shiftright(x, shift)).bitwiseAND(F.lit(mask))
    return x


def interleave(x: Column, y: Column) -> Column:
    """x to the even, y to the odd bits."""
    return spread_bits(x).bitwiseOR(F.shiftleft(spread_bits(y), 1))


def _div(a: Column, b) -> Column:
    return F.floor(a / b).cast("long")


def _long(x) -> Column:
    return F.floor(x).cast("long")


def face_xy(lon: Column, lat: Column, nside: int) -> tuple[Column, Column, Column]:
    """Base face and the position in it."""
    z, t, n = F.sin(F.radians(lat)), F.pmod(lon, F.lit(360.0)) / 90, nside
    jp, jm = _long(n * (0.5 + t - 0.75 * z)), _long(n * (0.5 + t + 0.75 * z))
    fp, fm = _div(jp, n), _div(jm, n)
    belt_face = F.when(fp == fm, F.pmod(fp, F.lit(4)) + 4).when(fp < fm, F.pmod(fp, F.lit(4))).otherwise(F.pmod(fm, F.lit(4)) + 8)
    bx, by = F.pmod(jm, F.lit(n)), n - 1 - F.pmod(jp, F.lit(n))
    q = F.least(_long(t), F.lit(3).cast("long"))
    tau, sigma = t - q, n * F.sqrt(F.greatest(3 * (1 - F.abs(z)), F.lit(0.0)))
    cp, cm = F.least(_long(tau * sigma), F.lit(n - 1).cast("long")), F.least(_long((1 - tau) * sigma), F.lit(n - 1).cast("long"))
    belt, north = F.abs(z) <= 2 / 3, z > 0
    face = F.when(belt, belt_face).when(north, q).otherwise(q + 8)
    x = F.when(belt, bx).when(north, n - 1 - cm).otherwise(cp)
    y = F.when(belt, by).when(north, n - 1 - cp).otherwise(cm)
    return face.cast("long"), x.cast("long"), y.cast("long")


def lonlat_to_nested(lon: Column, lat: Column, nside: int) -> Column:
    face, x, y = face_xy(lon, lat, check_nside(nside))
    return face * (nside * nside) + interleave(x, y)


def lonlat_to_ring(lon: Column, lat: Column, nside: int) -> Column:
    n = nside
    z, t = F.sin(F.radians(lat)), F.pmod(lon, F.lit(360.0)) / 90
    jp, jm = _long(n * (0.5 + t - 0.75 * z)), _long(n * (0.5 + t + 0.75 * z))
    ir = n + 1 + jp - jm
    k = 1 - F.pmod(ir, F.lit(2))
    ip = F.pmod(_div(jp + jm - n + k + 1, 2), F.lit(4 * n))
    belt = 2 * n * (n - 1) + 4 * n * (ir - 1) + ip
    tau = t - F.floor(t)
    sigma = n * F.sqrt(F.greatest(3 * (1 - F.abs(z)), F.lit(0.0)))
    cp, cm = F.least(_long(tau * sigma), F.lit(n - 1).cast("long")), F.least(_long((1 - tau) * sigma), F.lit(n - 1).cast("long"))
    r = cp + cm + 1
    p = F.pmod(_long(t * r), 4 * r)
    cap = F.when(z > 0, 2 * r * (r - 1) + p).otherwise(npix(n) - 2 * r * (r + 1) + p)
    return F.when(F.abs(z) <= 2 / 3, belt).otherwise(cap).cast("long")


def lonlat_to_pix(lon: Column, lat: Column, nside: int, nested: bool) -> Column:
    return lonlat_to_nested(lon, lat, nside) if nested else lonlat_to_ring(lon, lat, nside)


def ring_position(pix: Column, nside: int) -> tuple[Column, Column]:
    """Longitude and latitude of ring-ordered pixel centres."""
    n, total = nside, npix(nside)
    cap = 2 * n * (n - 1)
    south = pix >= total - cap
    p = F.when(south, total - 1 - pix).otherwise(pix)
    # the root may be off by one for very large indices: correct it with integers
    r0 = _long((1 + F.sqrt(1.0 + 2 * p)) / 2)
    r = r0 - (2 * r0 * (r0 - 1) > p).cast("long") + (2 * r0 * (r0 + 1) <= p).cast("long")
    ip = p - 2 * r * (r - 1)
    ip = F.when(south, 4 * r - 1 - ip).otherwise(ip)
    z_cap = 1 - r * r / (3.0 * n * n)
    q = pix - cap
    br, bi = _div(q, 4 * n) + n, F.pmod(q, F.lit(4 * n))
    shift = F.when(F.pmod(br + n, F.lit(2)) == 0, 0.5).otherwise(0.0)
    polar = (pix < cap) | south
    z = F.when(polar, F.when(south, -z_cap).otherwise(z_cap)).otherwise(2.0 * (2 * n - br) / (3 * n))
    lon = F.when(polar, 90 * (ip + 0.5) / r).otherwise(90 * (bi + shift) / n)
    return lon, F.degrees(F.asin(z))


def _ring_info(r: Column, n: int) -> tuple[Column, Column, Column, Column]:
    """Of ring r = 1 .. 4 n - 1: first pixel, pixels, shift of the first centre, z."""
    north, south = r < n, r > 3 * n
    s = 4 * n - r
    size = F.when(north, 4 * r).when(south, 4 * s).otherwise(4 * n)
    first = F.when(north, 2 * r * (r - 1)).when(south, npix(n) - 2 * s * (s + 1)).otherwise(2 * n * (n - 1) + (r - n) * 4 * n)
    shift = F.when(north | south, 0.5).when(F.pmod(r + n, F.lit(2)) == 0, 0.5).otherwise(0.0)
    z = F.when(north, 1 - r * r / (3.0 * n * n)).when(south, s * s / (3.0 * n * n) - 1).otherwise((2 * n - r) * 2.0 / (3 * n))
    return first, size, shift, z


def bilinear_taps(df: DataFrame, nside: int) -> DataFrame:
    """For positions (lon, lat): add ``taps``, an array of (pix, weight) in ring order.

    Two neighbours on each of the two rings around the position.  Above the first and below the last ring, the position
    lies between that ring and the pole, which stands for the mean of the ring's four pixels.
    """
    n = nside
    columns = df.columns
    df = bind(df, {"_z": F.sin(F.radians("lat")), "_phi": F.pmod("lon", F.lit(360.0)) / 360})
    z = F.col("_z")
    cap = _long(n * F.sqrt(F.greatest(3 * (1 - F.abs(z)), F.lit(0.0))))
    above = F.when(F.abs(z) <= 2 / 3, _long(n * (2 - 1.5 * z))).when(z > 0, cap).otherwise(4 * n - 1 - cap).cast("long")
    df = bind(df, {"_above": above})
    df = bind(df, {"_ra": F.greatest(F.col("_above"), F.lit(1)).cast("long"), "_rb": F.least(F.col("_above") + 1, F.lit(4 * n - 1)).cast("long")})
    info = {}
    for k in "ab":
        first, size, shift, zr = _ring_info(F.col(f"_r{k}"), n)
        info |= {f"_{k}f": first.cast("long"), f"_{k}n": size.cast("long"), f"_{k}s": F.col("_phi") * size - shift, f"_{k}t": F.acos(M.clip(zr, -1.0, 1.0))}
    df = bind(df, info | {"_t": F.acos(M.clip(z, -1.0, 1.0))})
    places = {}
    for k in "ab":
        i = _long(F.col(f"_{k}s"))
        places |= {f"_{k}1": F.col(f"_{k}f") + F.pmod(i, F.col(f"_{k}n")), f"_{k}2": F.col(f"_{k}f") + F.pmod(i + 1, F.col(f"_{k}n")), f"_{k}w": F.col(f"_{k}s") - i}
    edge = math.acos(1 - 1 / (3.0 * n * n))
    t = F.when(F.col("_above") < 1, F.col("_t") / edge).when(F.col("_above") >= 4 * n - 1, (math.pi - F.col("_t")) / edge)
    df = bind(df, places | {"_u": t.otherwise(M.clip(M.div(F.col("_t") - F.col("_at"), F.col("_bt") - F.col("_at")), 0.0, 1.0))})
    entry = lambda p, w: F.struct(p.cast("long").alias("pix"), w.cast("double").alias("weight"))
    u, pair = F.col("_u"), lambda k, share: [entry(F.col(f"_{k}1"), (1 - F.col(f"_{k}w")) * share), entry(F.col(f"_{k}2"), F.col(f"_{k}w") * share)]
    pole = lambda start, share: [entry(F.lit(start + k), share / 4) for k in range(4)]
    taps = F.when(F.col("_above") < 1, F.array(*pole(0, 1 - u), *pair("b", u))).when(F.col("_above") >= 4 * n - 1, F.array(*pole(npix(n) - 4, 1 - u), *pair("a", u)))
    return bind(df, {"taps": taps.otherwise(F.array(*pair("a", 1 - u), *pair("b", u)))}).select(*columns, "taps")


def nested_positions(df: DataFrame, pix: Column, nside: int) -> DataFrame:
    """Add lon and lat of nested pixel centres."""
    n = check_nside(nside)
    df = bind(df, {"_face": _div(pix, n * n), "_inner": F.pmod(pix, F.lit(n * n))})
    x, y = gather_bits(F.col("_inner")), gather_bits(F.shiftright("_inner", 1))
    df = bind(df, {"_x": x + 0.5, "_y": y + 0.5})
    row, col = _div(F.col("_face"), 4), F.pmod("_face", F.lit(4))
    df = bind(df, {"_jr": (row + 2) * n - F.col("_x") - F.col("_y"), "_base": 2 * col + F.when(row == 1, 0).otherwise(1)})
    jr = F.col("_jr")
    df = bind(df, {"_nr": F.when(jr < n, jr).when(jr > 3 * n, 4 * n - jr).otherwise(F.lit(float(n)))})
    nr = F.col("_nr")
    z = F.when(jr < n, 1 - nr * nr / (3.0 * n * n)).when(jr > 3 * n, nr * nr / (3.0 * n * n) - 1).otherwise((2 * n - jr) * 2.0 / (3 * n))
    lon = F.when(nr > 0, M.div((F.col("_base") * nr + F.col("_x") - F.col("_y")) * 45, nr)).otherwise(0.0)
    out = bind(df, {"lon": F.pmod(lon, F.lit(360.0)), "lat": F.degrees(F.asin(M.clip(z, -1.0, 1.0)))})
    return out.drop("_face", "_inner", "_x", "_y", "_jr", "_base", "_nr")


def ring_positions(df: DataFrame, pix: Column, nside: int) -> DataFrame:
    """Add lon and lat of ring-ordered pixel centres."""
    lon, lat = ring_position(pix, nside)
    return bind(df, {"lon": lon, "lat": lat})


def positions(df: DataFrame, pix: Column, nside: int, nested: bool) -> DataFrame:
    return nested_positions(df, pix, nside) if nested else ring_positions(df, pix, nside)


def renumbered(df: DataFrame, pix: str, nside: int, nested: bool) -> DataFrame:
    """Replace the column ``pix`` of one ordering by the other one's index: from nested to ring, or back."""
    columns = df.columns
    df = positions(df.withColumnsRenamed({"lon": "_keep_lon", "lat": "_keep_lat"}), F.col(pix), nside, nested)
    df = bind(df, {pix: lonlat_to_pix(F.col("lon"), F.col("lat"), nside, not nested)}).drop("lon", "lat")
    return df.withColumnsRenamed({"_keep_lon": "lon", "_keep_lat": "lat"}).select(*columns)
