"""Coordinate transforms as column expressions, for a closed list of systems.

Supported: EPSG:4326, EPSG:3857, the UTM zones EPSG:32601-32660, 32701-32760 and
25828-25838. Transverse Mercator uses the Krueger series to the fourth order in the
third flattening, which is good to well below a millimetre inside a zone.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridtide.errors import GridError
from gridtide.functions.periods import let

WGS84 = "EPSG:4326"
WEB_MERCATOR = "EPSG:3857"

# Ellipsoid (semi-major axis, inverse flattening) and UTM constants.
WGS84_ELLIPSOID = (6378137.0, 298.257223563)
GRS80_ELLIPSOID = (6378137.0, 298.257222101)
UTM_SCALE = 0.9996
UTM_FALSE_EASTING = 500000.0
UTM_FALSE_NORTHING_SOUTH = 10000000.0

# Fixed value: points per box edge when a box is projected.
EDGE_STEPS = 21


@dataclass(frozen=True)
class Utm:
    zone: int
    south: bool
    ellipsoid: tuple[float, float]

    @property
    def central_meridian(self) -> float:
        return self.zone * 6.0 - 183.0

    @property
    def false_northing(self) -> float:
        return UTM_FALSE_NORTHING_SOUTH if self.south else 0.0


def _utm(code: str) -> Utm:
    match = re.fullmatch(r"EPSG:(326|327|258)(\d\d)", code)
    if match:
        family, zone = match[1], int(match[2])
        if family == "258" and 28 <= zone <= 38:
            return Utm(zone, False, GRS80_ELLIPSOID)
        if family != "258" and 1 <= zone <= 60:
            return Utm(zone, family == "327", WGS84_ELLIPSOID)
    raise GridError(f"Unsupported CRS '{code}'")


def normalise_crs(code: str) -> str:
    """Upper-case EPSG code, checked against the closed list."""
    text = code.strip().upper()
    text = WGS84 if text in ("CRS84", "OGC:CRS84") else text
    if text not in (WGS84, WEB_MERCATOR):
        _utm(text)
    return text


@dataclass(frozen=True)
class _Series:
    """Krueger coefficients of one ellipsoid."""

    radius: float
    eccentricity: float
    forward: tuple[float, ...]
    inverse: tuple[float, ...]
    latitude: tuple[float, ...]


def _series(ellipsoid: tuple[float, float]) -> _Series:
    a, inverse_f = ellipsoid
    f = 1.0 / inverse_f
    n = f / (2.0 - f)
    n2, n3, n4 = n * n, n**3, n**4
    return _Series(
        radius=a / (1 + n) * (1 + n2 / 4 + n4 / 64),
        eccentricity=2 * math.sqrt(n) / (1 + n),
        forward=(
            n / 2 - 2 * n2 / 3 + 5 * n3 / 16 + 41 * n4 / 180,
            13 * n2 / 48 - 3 * n3 / 5 + 557 * n4 / 1440,
            61 * n3 / 240 - 103 * n4 / 140,
            49561 * n4 / 161280,
        ),
        inverse=(
            n / 2 - 2 * n2 / 3 + 37 * n3 / 96 - n4 / 360,
            n2 / 48 + n3 / 15 - 437 * n4 / 1440,
            17 * n3 / 480 - 37 * n4 / 840,
            4397 * n4 / 161280,
        ),
        latitude=(
            2 * n - 2 * n2 / 3 - 2 * n3 + 116 * n4 / 45,
            7 * n2 / 3 - 8 * n3 / 5 - 227 * n4 / 45,
            56 * n3 / 15 - 136 * n4 / 35,
            4279 * n4 / 630,
        ),
    )


def _total(terms: list[Column]) -> Column:
    result = terms[0]
    for term in terms[1:]:
        result = result + term
    return result


def _pair(a: Column, b: Column) -> Column:
    return F.struct(a.alias("x"), b.alias("y"))


def _lonlat_to_utm(at: Column, utm: Utm) -> Column:
    s = _series(utm.ellipsoid)
    scale = UTM_SCALE * s.radius

    def conformal(sin_lat: Column) -> Column:
        return F.sinh(F.atanh(sin_lat) - s.eccentricity * F.atanh(s.eccentricity * sin_lat))

    def sphere(turn: Column) -> Column:
        return _pair(F.atan2(turn.y, F.cos(turn.x)), F.atanh(F.sin(turn.x) / F.sqrt(1 + turn.y * turn.y)))

    def plane(p: Column) -> Column:
        xi, eta = p.x, p.y
        east = eta + _total([c * F.cos(2 * j * xi) * F.sinh(2 * j * eta) for j, c in enumerate(s.forward, 1)])
        north = xi + _total([c * F.sin(2 * j * xi) * F.cosh(2 * j * eta) for j, c in enumerate(s.forward, 1)])
        return _pair(F.lit(UTM_FALSE_EASTING) + scale * east, F.lit(utm.false_northing) + scale * north)

    dlon = F.radians(at.x - F.lit(utm.central_meridian))
    turned = _pair(dlon, let(F.sin(F.radians(at.y)), conformal))
    return let(let(turned, sphere), plane)


def _utm_to_lonlat(at: Column, utm: Utm) -> Column:
    s = _series(utm.ellipsoid)
    scale = UTM_SCALE * s.radius

    def sphere(p: Column) -> Column:
        xi, eta = p.x, p.y
        return _pair(
            xi - _total([c * F.sin(2 * j * xi) * F.cosh(2 * j * eta) for j, c in enumerate(s.inverse, 1)]),
            eta - _total([c * F.cos(2 * j * xi) * F.sinh(2 * j * eta) for j, c in enumerate(s.inverse, 1)]),
        )

    def latitude(chi: Column) -> Column:
        return F.degrees(chi + _total([c * F.sin(2 * j * chi) for j, c in enumerate(s.latitude, 1)]))

    def place(p: Column) -> Column:
        lon = F.lit(utm.central_meridian) + F.degrees(F.atan2(F.sinh(p.y), F.cos(p.x)))
        return _pair(lon, let(F.asin(F.sin(p.x) / F.cosh(p.y)), latitude))

    scaled = _pair((at.y - F.lit(utm.false_northing)) / scale, (at.x - F.lit(UTM_FALSE_EASTING)) / scale)
    return let(let(scaled, sphere), place)


def _lonlat_to_mercator(at: Column) -> Column:
    radius = WGS84_ELLIPSOID[0]
    return _pair(radius * F.radians(at.x), radius * F.log(F.tan(F.radians(at.y) / 2 + math.pi / 4)))


def _mercator_to_lonlat(at: Column) -> Column:
    radius = WGS84_ELLIPSOID[0]
    return _pair(F.degrees(at.x / radius), F.degrees(2 * F.atan(F.exp(at.y / radius)) - math.pi / 2))


def transform_point(at: Column, source_crs: str, target_crs: str) -> Column:
    """A ``struct<x,y>`` of one system in another; x is east or longitude, y north or latitude."""
    source, target = normalise_crs(source_crs), normalise_crs(target_crs)
    if source == target:
        return at
    if source == WEB_MERCATOR:
        at = let(at, _mercator_to_lonlat)
    elif source != WGS84:
        at = let(at, lambda p: _utm_to_lonlat(p, _utm(source)))
    if target == WEB_MERCATOR:
        return let(at, _lonlat_to_mercator)
    if target != WGS84:
        return let(at, lambda p: _lonlat_to_utm(p, _utm(target)))
    return at


def transform_xy(x: Column, y: Column, source_crs: str, target_crs: str) -> tuple[Column, Column]:
    """Point coordinates of one system in another."""
    if normalise_crs(source_crs) == normalise_crs(target_crs):
        return x, y
    moved = transform_point(_pair(x.cast("double"), y.cast("double")), source_crs, target_crs)
    return moved["x"], moved["y"]


def transform_bounds(
    xmin: Column, ymin: Column, xmax: Column, ymax: Column, source_crs: str, target_crs: str
) -> Column:
    """Box around a projected box, as struct xmin, ymin, xmax, ymax.

    All four edges are sampled, since a straight edge is usually curved in the target system.
    """
    share = F.sequence(F.lit(0), F.lit(EDGE_STEPS))

    def along(i: Column, low: Column, high: Column) -> Column:
        return low + (high - low) * i / F.lit(float(EDGE_STEPS))

    outline = F.concat(
        F.transform(share, lambda i: _pair(along(i, xmin, xmax), ymin)),
        F.transform(share, lambda i: _pair(along(i, xmin, xmax), ymax)),
        F.transform(share, lambda i: _pair(xmin, along(i, ymin, ymax))),
        F.transform(share, lambda i: _pair(xmax, along(i, ymin, ymax))),
    )

    def box(points: Column) -> Column:
        return F.struct(
            F.array_min(points["x"]).alias("xmin"),
            F.array_min(points["y"]).alias("ymin"),
            F.array_max(points["x"]).alias("xmax"),
            F.array_max(points["y"]).alias("ymax"),
        )

    return let(F.transform(outline, lambda p: transform_point(p, source_crs, target_crs)), box)


def bounds_wgs84(xmin: Column, ymin: Column, xmax: Column, ymax: Column, crs: str) -> Column:
    """Longitude/latitude box of a native box; NULL when the box is already in that system."""
    if normalise_crs(crs) == WGS84:
        return F.lit(None).cast("struct<xmin:double,ymin:double,xmax:double,ymax:double>")
    return transform_bounds(xmin, ymin, xmax, ymax, crs, WGS84)
