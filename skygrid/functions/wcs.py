"""World coordinate descriptions and their compilation to expressions.

The formulas follow Greisen & Calabretta (2002) and Calabretta & Greisen (2002).  A ``Wcs`` is a small
driver-side value; ``pixel_to_world`` and ``world_to_pixel`` turn it into column expressions, so that a
coordinate map is part of the plan and runs inside generated code.  Pixels count from 0 at the centre of
the first pixel.  Angles are degrees.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .backend import ColumnMath, bind, math_of

D2R = math.pi / 180
R2D = 180 / math.pi
#: Degrees below a cut that count as rounding.
CUT_WIDTH = 1e-9
LON = ("RA", "GLON", "ELON", "LON", "TLON")
LAT = ("DEC", "GLAT", "ELAT", "LAT", "TLAT")

# Rotations from ICRS. Galactic: pole (192.85948, 27.12825), longitude of the celestial pole 122.93192.
# FK5 is taken as ICRS (their axes differ by about 0.02 arcsec); ecliptic: mean obliquity of J2000.
_POLE = (192.85948 * D2R, 27.12825 * D2R, 122.93192 * D2R)
OBLIQUITY = 23.4392911111 * D2R


def _galactic() -> np.ndarray:
    a, d, lon = _POLE
    rz = lambda t: np.array([[math.cos(t), math.sin(t), 0], [-math.sin(t), math.cos(t), 0], [0, 0, 1]])
    ry = lambda t: np.array([[math.cos(t), 0, -math.sin(t)], [0, 1, 0], [math.sin(t), 0, math.cos(t)]])
    return rz(math.pi - lon) @ ry(math.pi / 2 - d) @ rz(a)


def _ecliptic() -> np.ndarray:
    c, s = math.cos(OBLIQUITY), math.sin(OBLIQUITY)
    return np.array([[1, 0, 0], [0, c, s], [0, -s, c]])


FROM_ICRS = {"icrs": np.eye(3), "fk5": np.eye(3), "galactic": _galactic(), "ecliptic": _ecliptic()}
FRAME_CODES = {"g": "galactic", "c": "icrs", "e": "ecliptic", "equatorial": "icrs"}


def frame_name(name: str) -> str:
    """'g', 'c', 'e' or a frame's name."""
    out = FRAME_CODES.get(name.lower(), name.lower())
    if out not in FROM_ICRS:
        raise ValueError(f"unknown coordinate frame: {name}")
    return out


def unit_vector(lon, lat):
    m = math_of(lon, lat)
    return m.cos(lat * D2R) * m.cos(lon * D2R), m.cos(lat * D2R) * m.sin(lon * D2R), m.sin(lat * D2R)


def from_vector(x, y, z):
    """Longitude in [0, 360) and latitude."""
    m = math_of(x, y, z)
    return m.mod(m.atan2(y, x) * R2D, 360), m.atan2(z, m.sqrt(x * x + y * y)) * R2D


def change_frame(lon, lat, source: str, target: str):
    """Longitude and latitude of another frame."""
    source, target = frame_name(source), frame_name(target)
    r = FROM_ICRS[target] @ FROM_ICRS[source].T
    if source == target or np.array_equal(r, np.eye(3)):
        return lon, lat
    v = unit_vector(lon, lat)
    return from_vector(*[sum(float(r[i, j]) * v[j] for j in range(3)) for i in range(3)])


def separation(lon1, lat1, lon2, lat2):
    """Angle between two directions, accurate at all scales."""
    m = math_of(lon1, lat1, lon2, lat2)
    dl = (lon2 - lon1) * D2R
    c1, s1, c2, s2 = m.cos(lat1 * D2R), m.sin(lat1 * D2R), m.cos(lat2 * D2R), m.sin(lat2 * D2R)
    a, b = c2 * m.sin(dl), c1 * s2 - s1 * c2 * m.cos(dl)
    return m.atan2(m.sqrt(a * a + b * b), s1 * s2 + c1 * c2 * m.cos(dl)) * R2D


# --- projections: native (phi, theta) in degrees <-> plane (x, y) in degrees ---------------------


def _zenithal(radius: Callable, angle: Callable):
    def to_plane(m, phi, theta):
        r = radius(m, theta)
        return r * m.sin(phi * D2R), -r * m.cos(phi * D2R)

    def to_native(m, x, y):
        r = m.sqrt(x * x + y * y)
        return m.atan2(x, -y) * R2D, angle(m, r)

    return to_native, to_plane


def _tan_r(m, t):
    return m.valid(t > 0, m.div(R2D * m.cos(t * D2R), m.sin(t * D2R)))


def _mol_gamma(m, theta):
    """The angle g with 2 g + sin 2 g = pi sin theta, in radians."""
    target = math.pi * m.sin(theta * D2R)

    def step(g):
        slope = 2 + 2 * m.cos(2 * g)
        return m.where(m.abs(slope) < 1e-9, g, g - m.div(2 * g + m.sin(2 * g) - target, m.where(m.abs(slope) < 1e-9, m.lit(1.0), slope)))

    return m.iterate(m.clip(theta * D2R, -1.57, 1.57), step, 25)


def _sfl_native(m, x, y):
    c = m.cos(y * D2R)
    return m.where(m.abs(c) < 1e-12, m.lit(0.0), m.div(x, m.where(m.abs(c) < 1e-12, m.lit(1.0), c))), y


def _mol_native(m, x, y):
    s = y * (D2R / math.sqrt(2))
    c = m.sqrt(m.clip(2 - y * y * D2R * D2R, 0.0, 2.0))
    ok = m.abs(s) <= 1
    s1 = m.clip(s, -1.0, 1.0)
    phi = m.where(c < 1e-12, m.lit(0.0), m.div(math.pi * x, 2 * m.where(c < 1e-12, m.lit(1.0), c)))
    theta = m.asin(m.clip(m.asin(s1) * (2 / math.pi) + s1 * m.sqrt(m.clip(1 - s1 * s1, 0.0, 1.0)) * (2 / math.pi), -1.0, 1.0)) * R2D
    ok = ok & (m.abs(phi) <= 180 + 1e-9)
    return m.valid(ok, phi), m.valid(ok, theta)


def _mol_plane(m, phi, theta):
    g = _mol_gamma(m, theta)
    return (2 * math.sqrt(2) / math.pi) * phi * m.cos(g), math.sqrt(2) * R2D * m.sin(g)


def _ait_native(m, x, y):
    u, v = x * (D2R / 4), y * (D2R / 2)
    z2 = 1 - u * u - v * v
    ok = z2 >= 0.5 - 1e-12
    z = m.sqrt(m.clip(z2, 0.0, 1.0))
    return m.valid(ok, 2 * m.atan2(2 * z * u, 2 * z * z - 1) * R2D), m.valid(ok, m.asin(m.clip(2 * v * z, -1.0, 1.0)) * R2D)


def _ait_plane(m, phi, theta):
    c = m.cos(theta * D2R)
    g = R2D * m.sqrt(m.div(m.lit(2.0), 1 + c * m.cos(phi * (D2R / 2))))
    return 2 * g * c * m.sin(phi * (D2R / 2)), g * m.sin(theta * D2R)


def _hpx_native(m, x, y):
    cap = m.abs(y) > 45
    s = 2 - m.abs(y) * (1 / 45)
    ok = (m.abs(y) <= 90) & ((~cap if not isinstance(cap, bool) else not cap) | (s > 0))
    facet = -180 + (2 * m.floor((x + 180) * (1 / 90)) + 1) * 45
    safe = m.where(m.abs(s) < 1e-12, m.lit(1.0), s)
    phi = m.where(cap, facet + m.div(x - facet, safe), x)
    theta_cap = m.asin(m.clip(1 - s * s * (1 / 3), -1.0, 1.0)) * R2D
    theta = m.where(cap, m.where(y > 0, theta_cap, -theta_cap), m.asin(m.clip(y * (2 / 3 / 45), -1.0, 1.0)) * R2D)
    ok = ok & (~cap | (m.abs(x - facet) <= 45 * s + 1e-9))
    return m.valid(ok, phi), m.valid(ok, theta)


def _hpx_plane(m, phi, theta):
    z = m.sin(theta * D2R)
    cap = m.abs(z) > 2 / 3
    s = m.sqrt(m.clip(3 * (1 - m.abs(z)), 0.0, 3.0))
    facet = -180 + (2 * m.floor((phi + 180) * (1 / 90)) + 1) * 45
    y_cap = 45 * (2 - s)
    return m.where(cap, facet + (phi - facet) * s, phi), m.where(cap, m.where(z > 0, y_cap, -y_cap), 67.5 * z)


#: code: (plane -> native, native -> plane, native latitude of the reference point)
PROJECTIONS = {
    "TAN": (*_zenithal(_tan_r, lambda m, r: m.atan2(m.lit(R2D) + 0 * r, r) * R2D), 90.0),
    "SIN": (*_zenithal(lambda m, t: m.valid(t >= 0, R2D * m.cos(t * D2R)), lambda m, r: m.valid(r <= R2D, m.acos(m.clip(r * D2R, 0.0, 1.0)) * R2D)), 90.0),
    "ARC": (*_zenithal(lambda m, t: 90 - t, lambda m, r: m.valid(r <= 180, 90 - r)), 90.0),
    "ZEA": (*_zenithal(lambda m, t: 2 * R2D * m.sin((90 - t) * (D2R / 2)), lambda m, r: m.valid(r <= 2 * R2D, 90 - 2 * m.asin(m.clip(r * (D2R / 2), 0.0, 1.0)) * R2D)), 90.0),
    "STG": (*_zenithal(lambda m, t: m.valid(t > -90, 2 * R2D * m.tan((90 - t) * (D2R / 2))), lambda m, r: 90 - 2 * m.atan2(r * (D2R / 2), m.lit(1.0) + 0 * r) * R2D), 90.0),
    "CAR": (lambda m, x, y: (x, m.valid(m.abs(y) <= 90 + 1e-9, y)), lambda m, p, t: (p, t), 0.0),
    "CEA": (lambda m, x, y: (x, m.valid(m.abs(y) <= R2D, m.asin(m.clip(y * D2R, -1.0, 1.0)) * R2D)), lambda m, p, t: (p, R2D * m.sin(t * D2R)), 0.0),
    "MER": (lambda m, x, y: (x, 2 * m.atan2(m.exp(y * D2R), m.lit(1.0) + 0 * y) * R2D - 90), lambda m, p, t: (p, m.valid(m.abs(t) < 90, R2D * m.log(m.tan((90 + t) * (D2R / 2))))), 0.0),
    "SFL": (_sfl_native, lambda m, p, t: (p * m.cos(t * D2R), t), 0.0),
    "MOL": (_mol_native, _mol_plane, 0.0),
    "AIT": (_ait_native, _ait_plane, 0.0),
    "HPX": (_hpx_native, _hpx_plane, 0.0),
}


@dataclass(frozen=True)
class Wcs:
    """A coordinate description in FITS terms; axis 1 is x.  Reference pixels count from 1."""

    crpix: tuple[float, ...]
    cdelt: tuple[float, ...]
    crval: tuple[float, ...]
    ctype: tuple[str, ...] = ("", "")
    pc: tuple[tuple[float, ...], ...] | None = None
    cunit: tuple[str, ...] | None = None
    lonpole: float | None = None
    latpole: float | None = None
    frame: str | None = None
    shape: tuple[int, ...] | None = field(default=None, compare=False)

    def __post_init__(self):
        n = len(self.crpix)
        if not len(self.cdelt) == len(self.crval) == len(self.ctype) == n:
            raise ValueError("crpix, cdelt, crval and ctype must have one entry for each axis")
        if any(d == 0 for d in self.cdelt):
            raise ValueError("cdelt must not be zero")
        if abs(np.linalg.det(self.matrix)) == 0:
            raise ValueError("the linear transformation is singular")
        code = {self.projection(i) for i in self.celestial} if self.has_celestial else set()
        if len(code) > 1 or code - set(PROJECTIONS):
            raise ValueError(f"unsupported projection: {', '.join(sorted(code))}")

    # -- axes ------------------------------------------------------------------------------------

    @property
    def naxis(self) -> int:
        return len(self.crpix)

    @property
    def matrix(self) -> np.ndarray:
        return np.array(self.pc if self.pc is not None else np.eye(self.naxis), float)

    def kind(self, i: int) -> str:
        return self.ctype[i].split("-")[0]

    def projection(self, i: int) -> str:
        return self.ctype[i][5:8]

    def _axis(self, names: tuple[str, ...]) -> int | None:
        return next((i for i in range(self.naxis) if self.kind(i) in names), None)

    @property
    def celestial(self) -> tuple[int, ...]:
        """(longitude axis, latitude axis), in whatever order the axes come."""
        lon, lat = self._axis(LON), self._axis(LAT)
        return () if lon is None or lat is None else (lon, lat)

    @property
    def has_celestial(self) -> bool:
        return bool(self.celestial)

    @property
    def spectral(self) -> int | None:
        return next((i for i in range(self.naxis) if self.ctype[i][:4] in ("FREQ", "WAVE", "VOPT", "VRAD", "VELO", "ENER", "WAVN", "AWAV", "ZOPT", "BETA")), None)

    @property
    def has_spectral(self) -> bool:
        return self.spectral is not None

    @property
    def sky(self) -> str:
        if self.frame:
            return frame_name(self.frame)
        kind = self.kind(self.celestial[0]) if self.has_celestial else ""
        return {"GLON": "galactic", "ELON": "ecliptic"}.get(kind, "icrs")

    # -- geometry --------------------------------------------------------------------------------

    def _pole(self) -> tuple[float, float, float]:
        """Celestial longitude and latitude of the native pole, native longitude of the celestial pole."""
        i, j = self.celestial
        theta0 = PROJECTIONS[self.projection(i)][2]
        a0, d0 = self.crval[i], self.crval[j]
        lonpole = self.lonpole if self.lonpole is not None else (180.0 if d0 < theta0 else 0.0)
        if theta0 == 90:
            return a0, d0, (self.lonpole if self.lonpole is not None else (180.0 if d0 < 90 else 0.0))
        latpole = self.latpole if self.latpole is not None else 90.0
        dp, d0r = (lonpole - 0.0) * D2R, d0 * D2R
        # theta0 = 0, phi0 = 0: sin d0 = cos(dp) cos(delta_p)
        cosv = math.sin(d0r) / math.cos(dp) if abs(math.cos(dp)) > 1e-15 else 0.0
        span = math.acos(max(-1.0, min(1.0, cosv)))
        base = 0.0 if math.cos(dp) >= 0 else math.pi
        options = [x for x in (base + span - (math.pi if base else 0), base - span - (math.pi if base else 0), span, -span) if abs(x) <= math.pi / 2 + 1e-12]
        good = [x for x in options if abs(math.cos(x) * math.cos(dp) - math.sin(d0r)) < 1e-9] or options
        pole = min(good, key=lambda x: abs(x - latpole * D2R))
        if abs(abs(pole) - math.pi / 2) < 1e-12:
            ap = a0 + (lonpole - 180.0 if pole > 0 else -lonpole)
        else:
            y, x = math.sin(dp) / math.cos(d0r), -math.sin(pole) * math.sin(d0r) / (math.cos(pole) * math.cos(d0r))
            ap = a0 - math.atan2(y, x) * R2D
        return ap, pole * R2D, lonpole

    def pixel_to_world(self, *pixels):
        """World coordinates of pixel coordinates, in axis order."""
        m = math_of(*pixels)
        plane = self.pixel_to_plane(*pixels)
        out = [self.axis_world(i, v) for i, v in enumerate(plane)]
        if self.has_celestial:
            i, j = self.celestial
            phi, theta = PROJECTIONS[self.projection(i)][0](m, plane[i], plane[j])
            out[i], out[j] = self._to_sky(m, phi, theta)
        return out

    def pixel_to_plane(self, *pixels) -> list:
        """Intermediate coordinates: the linear part of the map."""
        pc = self.matrix
        shifted = [p + (1 - self.crpix[j]) for j, p in enumerate(pixels)]
        plane = []
        for i in range(self.naxis):
            terms = [shifted[j] * float(self.cdelt[i] * pc[i, j]) for j in range(self.naxis) if pc[i, j] != 0]
            plane.append(sum(terms[1:], terms[0]))
        return plane

    def plane_to_pixel(self, *plane) -> list:
        inverse = np.linalg.inv(np.diag(self.cdelt) @ self.matrix)
        out = []
        for i in range(self.naxis):
            terms = [plane[j] * float(inverse[i, j]) for j in range(self.naxis) if inverse[i, j] != 0]
            out.append(sum(terms[1:], terms[0]) + (self.crpix[i] - 1))
        return out

    def axis_world(self, i: int, v):
        """World coordinate of an axis without a projection."""
        if self.ctype[i].endswith("-LOG"):
            return self.crval[i] * math_of(v).exp(v * (1 / self.crval[i]))
        return v + float(self.crval[i])

    def axis_plane(self, i: int, w):
        if self.ctype[i].endswith("-LOG"):
            return self.crval[i] * math_of(w).log(w * (1 / self.crval[i]))
        return w - float(self.crval[i])

    def _turn(self, a, t):
        """Spherical rotation about the native pole, as a vector; a and t in degrees."""
        m = math_of(a, t)
        dp = self._pole()[1] * D2R
        s, c = m.sin(t * D2R), m.cos(t * D2R)
        sd, cd = math.sin(dp), math.cos(dp)
        return s * cd - c * m.cos(a * D2R) * sd, -c * m.sin(a * D2R), s * sd + c * m.cos(a * D2R) * cd

    def _to_sky_vector(self, phi, theta):
        return self._turn(phi - self._pole()[2], theta)

    def _to_native_vector(self, lon, lat):
        return self._turn(lon - self._pole()[0], lat)

    def _to_sky(self, m, phi, theta):
        x, y, z = self._to_sky_vector(phi, theta)
        return m.mod(m.atan2(y, x) * R2D + self._pole()[0], 360), m.atan2(z, m.sqrt(x * x + y * y)) * R2D

    def _to_native(self, m, lon, lat):
        x, y, z = self._to_native_vector(lon, lat)
        return m.mod(m.atan2(y, x) * R2D + (self._pole()[2] + 180), 360) - 180, m.atan2(z, m.sqrt(x * x + y * y)) * R2D

    def world_to_pixel(self, *world):
        m = math_of(*world)
        plane = [self.axis_plane(i, w) for i, w in enumerate(world)]
        if self.has_celestial:
            i, j = self.celestial
            phi, theta = self._to_native(m, world[i], world[j])
            plane[i], plane[j] = PROJECTIONS[self.projection(i)][1](m, phi, theta)
        return self.plane_to_pixel(*plane)

    # -- derived descriptions --------------------------------------------------------------------

    def shifted(self, *starts: float) -> Wcs:
        """The description of a cutout that begins at these pixels (x first)."""
        return replace(self, crpix=tuple(c - s for c, s in zip(self.crpix, starts)))

    def without_axis(self, i: int) -> Wcs:
        """Drop an axis that is not coupled to the others."""
        pc = self.matrix
        if np.any(np.delete(pc[i], i)) or np.any(np.delete(pc[:, i], i)):
            raise ValueError("the axis is coupled to others")
        drop = lambda v: None if v is None else tuple(x for k, x in enumerate(v) if k != i)
        keep = np.delete(np.delete(pc, i, 0), i, 1)
        return replace(self, crpix=drop(self.crpix), cdelt=drop(self.cdelt), crval=drop(self.crval), ctype=drop(self.ctype), cunit=drop(self.cunit), pc=tuple(map(tuple, keep)))

    def pixel_scale(self) -> float:
        """The least pixel scale of the celestial axes at the reference point, else of all axes."""
        scales = np.sqrt(((np.diag(self.cdelt) @ self.matrix) ** 2).sum(axis=0))
        pick = self.celestial or range(self.naxis)
        return float(min(abs(scales[i]) for i in pick))

    @staticmethod
    def from_header(header: dict) -> Wcs:
        """From FITS keywords; NAXISn gives the shape, CDi_j or PCi_j the matrix."""
        n = int(header.get("WCSAXES", header.get("NAXIS", 2)))
        get = lambda k, d: [header.get(f"{k}{i + 1}", d) for i in range(n)]
        pc = np.array([[float(header.get(f"PC{i + 1}_{j + 1}", i == j)) for j in range(n)] for i in range(n)])
        cdelt = [float(x) for x in get("CDELT", 1.0)]
        if any(f"CD{i + 1}_{j + 1}" in header for i in range(n) for j in range(n)):
            pc = np.array([[float(header.get(f"CD{i + 1}_{j + 1}", 0.0)) for j in range(n)] for i in range(n)])
            cdelt = [1.0] * n
        elif "CROTA2" in header and n == 2:
            t = float(header["CROTA2"]) * D2R
            pc = np.array([[math.cos(t), -math.sin(t) * cdelt[1] / cdelt[0]], [math.sin(t) * cdelt[0] / cdelt[1], math.cos(t)]])
        shape = tuple(int(header[f"NAXIS{i + 1}"]) for i in reversed(range(n))) if all(f"NAXIS{i + 1}" in header for i in range(n)) else None
        radesys = str(header.get("RADESYS", header.get("RADECSYS", ""))).strip().lower()
        return Wcs(
            tuple(float(x) for x in get("CRPIX", 0.0)), tuple(cdelt), tuple(float(x) for x in get("CRVAL", 0.0)), tuple(str(x).strip() for x in get("CTYPE", "")),
            None if np.array_equal(pc, np.eye(n)) else tuple(map(tuple, pc.tolist())), tuple(str(x).strip() for x in get("CUNIT", "")),
            float(header["LONPOLE"]) if "LONPOLE" in header else None, float(header["LATPOLE"]) if "LATPOLE" in header else None,
            radesys if radesys in FROM_ICRS and str(header.get("CTYPE1", "")).startswith(("RA", "DEC")) else None, shape,
        )

    def to_header(self) -> dict:
        out: dict = {"WCSAXES": self.naxis}
        pc = self.matrix
        for i in range(self.naxis):
            out |= {f"CRPIX{i + 1}": self.crpix[i], f"CDELT{i + 1}": self.cdelt[i], f"CRVAL{i + 1}": self.crval[i], f"CTYPE{i + 1}": self.ctype[i]}
            if self.cunit:
                out[f"CUNIT{i + 1}"] = self.cunit[i]
            out |= {f"PC{i + 1}_{j + 1}": float(pc[i, j]) for j in range(self.naxis) if pc[i, j] != (i == j)}
        if self.lonpole is not None:
            out["LONPOLE"] = self.lonpole
        if self.latpole is not None:
            out["LATPOLE"] = self.latpole
        if self.frame:
            out["RADESYS"] = self.frame.upper()
        return out


@dataclass(frozen=True)
class OwnWcs:
    """A user's own coordinate system: two functions, from pixels to world and back, in axis order.

    The functions take and return columns, or numpy arrays on the driver, so formulas in plain operators and
    ``functions.backend.math_of`` serve both; what only numpy can do goes into a ``pandas_udf`` for the columns.  ``kinds``
    names the axes as ctypes do (for the sky: degrees of ``frame``).
    """

    forward: Callable
    backward: Callable
    kinds: tuple[str, ...] = ("", "")
    frame: str | None = None
    scale: float = 1.0
    shape: tuple[int, ...] | None = field(default=None, compare=False)

    @property
    def naxis(self) -> int:
        return len(self.kinds)

    @property
    def ctype(self) -> tuple[str, ...]:
        return self.kinds

    kind, _axis = Wcs.kind, Wcs._axis
    celestial, has_celestial, spectral, has_spectral, sky = Wcs.celestial, Wcs.has_celestial, Wcs.spectral, Wcs.has_spectral, Wcs.sky

    def pixel_to_world(self, *pixels) -> list:
        return list(self.forward(*pixels))

    def world_to_pixel(self, *world) -> list:
        return list(self.backward(*world))

    def pixel_scale(self) -> float:
        return self.scale

    def shifted(self, *starts: float) -> OwnWcs:
        """The system of a cutout that begins at these pixels (x first)."""
        there, back = self.forward, self.backward
        return replace(self, forward=lambda *p: there(*[v + s for v, s in zip(p, starts)]), backward=lambda *w: [v - s for v, s in zip(back(*w), starts)])


def transform(source: Wcs, target: Wcs, *pixels):
    """Pixels of ``source`` as pixels of ``target``, through the sky where both have one; for arrays (columns: ``move``)."""
    world = source.pixel_to_world(*pixels)
    if source.has_celestial and target.has_celestial:
        i, j = source.celestial
        lon, lat = change_frame(world[i], world[j], source.sky, target.sky)
        world = _arrange(target, lon, lat, [w for a, w in enumerate(world) if a not in (i, j)])
    return target.world_to_pixel(*world)


def _arrange(target: Wcs, lon, lat, rest: list) -> list:
    """World coordinates in the target's axis order."""
    k, n = target.celestial
    rest = iter(rest)
    return [lon if a == k else lat if a == n else next(rest) for a in range(target.naxis)]


def transform_roundtrip(source: Wcs, target: Wcs, *pixels):
    """As ``transform``, but undefined where transforming back misses the start by more than one pixel on any axis."""
    out = transform(source, target, *pixels)
    back = transform(target, source, *out)
    m = math_of(*out)
    ok = m.abs(back[0] - pixels[0]) <= 1
    for b, p in zip(back[1:], pixels[1:]):
        ok = ok & (m.abs(b - p) <= 1)
    return [m.valid(ok, v) for v in out]


def to_sky(df: DataFrame, source: Wcs, points: dict[str, tuple], frame: str | None = None) -> DataFrame:
    """Add world coordinates of pixel positions: columns ``<name>_w0``, ``<name>_w1``, ... for each named point.

    Celestial axes are given in ``frame``.  Every stage of the map is bound before the next one uses it, so the plan grows
    with the number of stages and not with their product.
    """
    n = source.naxis
    if isinstance(source, OwnWcs):
        df = bind(df, {f"{p}_w{i}": v for p, at in points.items() for i, v in enumerate(source.pixel_to_world(*at))})
        return _in_frame(df, source, list(points), frame) if source.has_celestial else df
    df = bind(df, {f"{p}_w{i}": v for p, at in points.items() for i, v in enumerate(source.pixel_to_plane(*at))})
    if not source.has_celestial:
        return bind(df, {f"{p}_w{i}": source.axis_world(i, F.col(f"{p}_w{i}")) for p in points for i in range(n)})
    i, j = source.celestial
    out = {}
    for p in points:
        out[f"{p}_w{i}"], out[f"{p}_w{j}"] = PROJECTIONS[source.projection(i)][0](ColumnMath, F.col(f"{p}_w{i}"), F.col(f"{p}_w{j}"))
        out |= {f"{p}_w{a}": source.axis_world(a, F.col(f"{p}_w{a}")) for a in range(n) if a not in (i, j)}
    df = bind(df, out)
    df = _bound_rotation(df, [p for p in points], i, j, source._to_sky_vector, source._pole()[0])
    return _in_frame(df, source, list(points), frame)


def _in_frame(df: DataFrame, source: Wcs, names: list[str], frame: str | None) -> DataFrame:
    """Celestial axes of the source's frame in another one."""
    i, j = source.celestial
    if frame is None or np.array_equal(FROM_ICRS[frame_name(frame)], FROM_ICRS[source.sky]):
        return df
    r = FROM_ICRS[frame_name(frame)] @ FROM_ICRS[source.sky].T

    def turned(lon, lat):
        v = unit_vector(lon, lat)
        return [sum(float(r[a, b]) * v[b] for b in range(3)) for a in range(3)]

    return _bound_rotation(df, names, i, j, turned, 0.0)


def _bound_rotation(df: DataFrame, names: list[str], i: int, j: int, vector, shift: float, low: float = 0.0) -> DataFrame:
    """Angles (axes i, j) through a bound vector to angles: the first in [low, low + 360)."""
    cells = {}
    for p in names:
        cells |= dict(zip((f"{p}_vx", f"{p}_vy", f"{p}_vz"), vector(F.col(f"{p}_w{i}"), F.col(f"{p}_w{j}"))))
    df = bind(df, cells)
    out = {}
    for p in names:
        x, y, z = (F.col(f"{p}_v{k}") for k in "xyz")
        out[f"{p}_w{i}"] = F.pmod(F.degrees(F.atan2(y, x)) + (shift - low), F.lit(360.0)) + low
        out[f"{p}_w{j}"] = F.degrees(F.atan2(z, F.sqrt(x * x + y * y)))
    return bind(df, out).drop(*cells)


def from_sky(df: DataFrame, target: Wcs, names: list[str], frame: str | None = None, cut: float | None = None) -> DataFrame:
    """Replace world coordinates (``<name>_w*``, in the target's axis order) by pixel positions, in place.

    The target's native longitudes begin at -180 degrees, or at ``cut``; what rounding leaves just below ``cut`` lies on it.
    """
    n = target.naxis
    if cut is not None and (isinstance(target, OwnWcs) or not target.has_celestial):
        raise ValueError("only a description with a projection can be cut at a longitude")
    low = -180.0 if cut is None else cut - CUT_WIDTH
    if isinstance(target, OwnWcs) and not target.has_celestial:
        return _own_pixels(df, target, names)
    if not target.has_celestial:
        plane = {p: [target.axis_plane(a, F.col(f"{p}_w{a}")) for a in range(n)] for p in names}
        return bind(df, {f"{p}_w{a}": v for p in names for a, v in enumerate(target.plane_to_pixel(*plane[p]))})
    i, j = target.celestial
    if frame is not None and not np.array_equal(FROM_ICRS[frame_name(frame)], FROM_ICRS[target.sky]):
        r = FROM_ICRS[target.sky] @ FROM_ICRS[frame_name(frame)].T

        def turned(lon, lat):
            v = unit_vector(lon, lat)
            return [sum(float(r[a, b]) * v[b] for b in range(3)) for a in range(3)]

        df = _bound_rotation(df, names, i, j, turned, 0.0)
    if isinstance(target, OwnWcs):
        return _own_pixels(df, target, names)
    if cut is not None and PROJECTIONS[target.projection(i)][2] == 0 and target._pole()[1] == 90:
        # the poles agree: a shift of the longitude, without the rounding of a rotation
        at = {p: F.col(f"{p}_w{i}") - float(target.crval[i]) for p in names}
        df = bind(df, {f"{p}_w{i}": F.when((x >= low) & (x < low + 360), x).otherwise(F.pmod(x - low, F.lit(360.0)) + low) for p, x in at.items()})
    else:
        df = _bound_rotation(df, names, i, j, target._to_native_vector, target._pole()[2], low=low)
    out = {}
    for p in names:
        out[f"{p}_w{i}"], out[f"{p}_w{j}"] = PROJECTIONS[target.projection(i)][1](ColumnMath, F.col(f"{p}_w{i}"), F.col(f"{p}_w{j}"))
        out |= {f"{p}_w{a}": target.axis_plane(a, F.col(f"{p}_w{a}")) for a in range(n) if a not in (i, j)}
    df = bind(df, out)
    return bind(df, {f"{p}_w{a}": v for p in names for a, v in enumerate(target.plane_to_pixel(*[F.col(f"{p}_w{b}") for b in range(n)]))})


def _own_pixels(df: DataFrame, target: OwnWcs, names: list[str]) -> DataFrame:
    return bind(df, {f"{p}_w{a}": v for p in names for a, v in enumerate(target.world_to_pixel(*[F.col(f"{p}_w{b}") for b in range(target.naxis)]))})


def move(df: DataFrame, source: Wcs, target: Wcs, points: dict[str, tuple], roundtrip: bool = False, cut: float | None = None) -> DataFrame:
    """Add pixel positions in ``target`` of pixel positions in ``source``: ``<name>_w0`` (x), ``<name>_w1`` (y), ...

    Undefined positions are NULL.  With ``roundtrip``, so are those that do not come back within one pixel.  ``cut``: the
    native longitude of ``target`` at which its range of 360 degrees begins, instead of -180.
    """
    names = list(points)
    df = _there(df, source, target, points, cut)
    if roundtrip:
        back = {f"{p}_back": tuple(F.col(f"{p}_w{a}") for a in range(target.naxis)) for p in names}
        df = _there(df, target, source, back)
        ok = {p: None for p in names}
        for p in names:
            for a in range(source.naxis):
                near = F.abs(F.col(f"{p}_back_w{a}") - points[p][a]) <= 1
                ok[p] = near if ok[p] is None else ok[p] & near
        df = bind(df, {f"{p}_w{a}": F.when(ok[p], F.col(f"{p}_w{a}")) for p in names for a in range(target.naxis)})
        df = df.drop(*[f"{p}_back_w{a}" for p in names for a in range(source.naxis)])
    valid = {p: None for p in names}
    for p in names:
        for a in range(target.naxis):
            c = F.col(f"{p}_w{a}")
            good = c.isNotNull() & ~F.isnan(c)
            valid[p] = good if valid[p] is None else valid[p] & good
    return bind(df, {f"{p}_w{a}": F.when(valid[p], F.col(f"{p}_w{a}")) for p in names for a in range(target.naxis)})


def _there(df: DataFrame, source: Wcs, target: Wcs, points: dict[str, tuple], cut: float | None = None) -> DataFrame:
    both = source.has_celestial and target.has_celestial
    df = to_sky(df, source, points, target.sky if both else None)
    if both and source.celestial != target.celestial:
        i, j = source.celestial
        cells = {}
        for p in points:
            rest = [F.col(f"{p}_w{a}") for a in range(source.naxis) if a not in (i, j)]
            cells |= {f"{p}_w{a}": v for a, v in enumerate(_arrange(target, F.col(f"{p}_w{i}"), F.col(f"{p}_w{j}"), rest))}
        df = bind(df, cells)
    return from_sky(df, target, list(points), cut=cut)
