"""Areas of overlap of convex spherical polygons, vectorised over arrays of pairs.

Polygons are clipped against the half-spaces of the other's sides.  Small ones are clipped in the tangent
plane at their first corner; where the largest chord is not small, clipping and area (Girard) are done on
the sphere.
"""

from __future__ import annotations

import numpy as np

#: Squared chord up to which a pair is treated in the tangent plane.
PLANAR_CHORD2 = 1e-8


def unit(lon: np.ndarray, lat: np.ndarray) -> np.ndarray:
    c = np.cos(lat)
    return np.stack([c * np.cos(lon), c * np.sin(lon), np.sin(lat)], axis=-1)


def _shoelace(p: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Signed area of polygons p (pairs, corners, 2), of which the first n corners count."""
    k = np.arange(p.shape[1])
    nxt = np.where(k + 1 < n[:, None], k + 1, 0)
    q = np.take_along_axis(p, nxt[..., None].repeat(2, -1), 1)
    cross = p[..., 0] * q[..., 1] - p[..., 1] * q[..., 0]
    return np.where(k < n[:, None], cross, 0).sum(1) / 2


def _compact(points: np.ndarray, keep: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Move kept corners to the front."""
    order = np.argsort(~keep, axis=1, kind="stable")[:, :size]
    return np.take_along_axis(points, order[..., None].repeat(points.shape[-1], -1), 1), np.minimum(keep.sum(1), size)


def _clip(p: np.ndarray, n: np.ndarray, side, crossing) -> tuple[np.ndarray, np.ndarray]:
    """One half-space of every pair: keep corners inside and add the crossings of the sides."""
    m = p.shape[1]
    k = np.arange(m)
    live = k < n[:, None]
    nxt = np.where(k + 1 < n[:, None], k + 1, 0)
    q = np.take_along_axis(p, nxt[..., None].repeat(p.shape[-1], -1), 1)
    a, b = side(p), side(q)
    out = np.empty((len(p), 2 * m, p.shape[-1]))
    out[:, 0::2], out[:, 1::2] = p, crossing(p, q, a, b)
    keep = np.empty((len(p), 2 * m), bool)
    keep[:, 0::2], keep[:, 1::2] = live & (a >= 0), live & ((a > 0) & (b < 0) | (a < 0) & (b > 0))
    return _compact(out, keep, m + 1)


def planar_overlap(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Area shared by convex quadrilaterals (pairs, 4, 2) of any winding."""
    four = np.full(len(a), 4)
    b = np.where((_shoelace(b, four) < 0)[:, None, None], b[:, ::-1], b)
    p, n = a, four
    for i in range(4):
        s, e = b[:, i, None], b[:, (i + 1) % 4, None]
        side = lambda x, s=s, e=e: (e[..., 0] - s[..., 0]) * (x[..., 1] - s[..., 1]) - (e[..., 1] - s[..., 1]) * (x[..., 0] - s[..., 0])

        def crossing(x, y, u, v):
            with np.errstate(all="ignore"):
                t = np.where(u != v, u / (u - v), 0.0)
            return x + t[..., None] * (y - x)

        p, n = _clip(p, n, side, crossing)
    return np.abs(_shoelace(p, n))


def _girard(p: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Area of spherical polygons: sum of triangles from the first corner, by their corner vectors."""
    total = np.zeros(len(p))
    a = p[:, 0]
    for k in range(1, p.shape[1] - 1):
        b, c = p[:, k], p[:, k + 1]
        triple = np.einsum("ij,ij->i", a, np.cross(b, c))
        dot = 1 + (a * b).sum(1) + (b * c).sum(1) + (c * a).sum(1)
        total += np.where(k + 1 < n, 2 * np.arctan2(triple, dot), 0)
    return np.abs(total)


def spherical_overlap(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Area shared by convex spherical quadrilaterals given by unit vectors (pairs, 4, 3), in steradians."""
    centre = b.sum(1)
    first = np.cross(b[:, 0], b[:, 1]) + np.cross(b[:, 1], b[:, 2]) + np.cross(b[:, 2], b[:, 3]) + np.cross(b[:, 3], b[:, 0])
    b = np.where(((first * centre).sum(1) < 0)[:, None, None], b[:, ::-1], b)
    p, n = a, np.full(len(a), 4)
    for i in range(4):
        normal = np.cross(b[:, i], b[:, (i + 1) % 4])[:, None]
        side = lambda x, normal=normal: (x * normal).sum(-1)

        def crossing(x, y, u, v):
            with np.errstate(all="ignore"):
                z = x * np.abs(v)[..., None] + y * np.abs(u)[..., None]
                return np.nan_to_num(z / np.linalg.norm(z, axis=-1, keepdims=True))

        p, n = _clip(p, n, side, crossing)
    near = np.where(((a.sum(1)) * centre).sum(1) > 0, 1.0, 0.0)
    return np.where(n >= 3, _girard(p, n), 0.0) * near


def tangent(v: np.ndarray, origin: np.ndarray) -> np.ndarray:
    """Gnomonic plane coordinates (pairs, corners, 2) about unit vectors."""
    helper = np.where(np.abs(origin[:, 2:3]) < 0.9, [[0.0, 0.0, 1.0]], [[1.0, 0.0, 0.0]])
    e = np.cross(helper, origin)
    e /= np.linalg.norm(e, axis=1, keepdims=True)
    f = np.cross(origin, e)
    # differences to the origin keep precision for tiny polygons
    d = v - origin[:, None]
    depth = 1 + (d * origin[:, None]).sum(-1)
    return np.stack([(d * e[:, None]).sum(-1), (d * f[:, None]).sum(-1)], -1) / depth[..., None]


def overlap(lon1, lat1, lon2, lat2) -> np.ndarray:
    """Overlap in steradians of quadrilaterals (pairs, 4), corners in radians in either winding."""
    a, b = unit(np.asarray(lon1, float), np.asarray(lat1, float)), unit(np.asarray(lon2, float), np.asarray(lat2, float))
    if not len(a):
        return np.zeros(0)
    chord = lambda p: ((p - p[:, :1]) ** 2).sum(-1).max(1)
    apart = ((a[:, 0] - b[:, 0]) ** 2).sum(-1)
    small = (np.maximum(chord(a), chord(b)) < PLANAR_CHORD2) & (apart < 16 * PLANAR_CHORD2)
    out = np.zeros(len(a))
    if small.any():
        o = b[small, 0]
        out[small] = planar_overlap(tangent(a[small], o), tangent(b[small], o))
    if (~small).any():
        out[~small] = spherical_overlap(a[~small], b[~small])
    return out
