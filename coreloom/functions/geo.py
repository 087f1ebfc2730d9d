"""National Grid and WGS84 by closed formulas as column expressions: transverse Mercator on the Airy ellipsoid and a
seven-parameter shift. To a few metres of the official grid-shift model, and consistent with itself to a centimetre."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Published ellipsoids (semi-axes in metres), the grid's origin, and the shift from WGS84.
AIRY, WGS84 = (6377563.396, 6356256.909), (6378137.0, 6356752.314245)
SCALE, LAT0, LON0, E0, N0 = 0.9996012717, math.radians(49), math.radians(-2), 400000.0, -100000.0
SHIFT, TURN, GROW = (-446.448, 125.157, -542.060), tuple(math.radians(s / 3600) for s in (-0.1502, -0.2470, -0.8421)), 20.4894e-6

BBox = tuple[float, float, float, float]


def _e2(ellipsoid: tuple[float, float]) -> float:
    a, b = ellipsoid
    return 1 - (b / a) ** 2


def let(values: list[Column], body) -> Column:
    """body(*values), each computed once."""
    named = F.struct(*(v.alias(f"v{i}") for i, v in enumerate(values)))
    return F.element_at(F.transform(F.array(named), lambda s: body(*(s[f"v{i}"] for i in range(len(values))))), 1)


def _arc(lat: Column) -> Column:
    """Length of the meridian from the grid's true origin."""
    a, b = AIRY
    n = (a - b) / (a + b)
    d, s = lat - LAT0, lat + LAT0
    return b * SCALE * (
        (1 + n + 1.25 * n**2 + 1.25 * n**3) * d - (3 * n + 3 * n**2 + 2.625 * n**3) * F.sin(d) * F.cos(s)
        + (1.875 * n**2 + 1.875 * n**3) * F.sin(2 * d) * F.cos(2 * s) - 35 / 24 * n**3 * F.sin(3 * d) * F.cos(3 * s)
    )


def _radii(lat: Column) -> tuple[Column, Column, Column]:
    a, e2 = AIRY[0], _e2(AIRY)
    w = 1 - e2 * F.pow(F.sin(lat), 2)
    nu, rho = a * SCALE / F.sqrt(w), a * SCALE * (1 - e2) / F.pow(w, 1.5)
    return nu, rho, nu / rho - 1


def _grid_to_geodetic(e: Column, n: Column) -> Column:
    def step(lat: Column) -> Column:
        return lat + (n - N0 - _arc(lat)) / (AIRY[0] * SCALE)

    lat = F.aggregate(F.sequence(F.lit(1), F.lit(8)), LAT0 + (n - N0) / (AIRY[0] * SCALE), lambda acc, _: step(acc))

    def of(lat: Column) -> Column:
        nu, rho, eta2 = _radii(lat)
        t, sec, d = F.tan(lat), 1 / F.cos(lat), e - E0
        phi = lat - F.pow(d, 2) * t / (2 * rho * nu) + F.pow(d, 4) * t / (24 * rho * F.pow(nu, 3)) * (5 + 3 * t * t + eta2 - 9 * t * t * eta2) - F.pow(d, 6) * t / (720 * rho * F.pow(nu, 5)) * (61 + 90 * t * t + 45 * F.pow(t, 4))
        lam = LON0 + d * sec / nu - F.pow(d, 3) * sec / (6 * F.pow(nu, 3)) * (nu / rho + 2 * t * t) + F.pow(d, 5) * sec / (120 * F.pow(nu, 5)) * (5 + 28 * t * t + 24 * F.pow(t, 4))
        return F.struct(phi.alias("lat"), lam.alias("lon"))

    return let([lat], of)


def _geodetic_to_grid(lat: Column, lon: Column) -> Column:
    def of(lat: Column, d: Column) -> Column:
        nu, rho, eta2 = _radii(lat)
        s, c, t2 = F.sin(lat), F.cos(lat), F.pow(F.tan(lat), 2)
        n = _arc(lat) + N0 + nu / 2 * s * c * F.pow(d, 2) + nu / 24 * s * F.pow(c, 3) * (5 - t2 + 9 * eta2) * F.pow(d, 4) + nu / 720 * s * F.pow(c, 5) * (61 - 58 * t2 + t2 * t2) * F.pow(d, 6)
        e = E0 + nu * c * d + nu / 6 * F.pow(c, 3) * (nu / rho - t2) * F.pow(d, 3) + nu / 120 * F.pow(c, 5) * (5 - 18 * t2 + t2 * t2 + 14 * eta2 - 58 * t2 * eta2) * F.pow(d, 5)
        return F.struct(e.alias("easting"), n.alias("northing"))

    return let([lat, lon - LON0], of)


def _shifted(lat: Column, lon: Column, source: tuple[float, float], target: tuple[float, float], sign: int) -> Column:
    """struct(lat, lon) on the target ellipsoid, at height 0."""
    a, e2 = source[0], _e2(source)
    tx, ty, tz = (sign * v for v in SHIFT)
    rx, ry, rz = (sign * v for v in TURN)
    m = 1 + sign * GROW

    def cartesian(lat: Column, lon: Column) -> Column:
        nu = a / F.sqrt(1 - e2 * F.pow(F.sin(lat), 2))
        x, y, z = nu * F.cos(lat) * F.cos(lon), nu * F.cos(lat) * F.sin(lon), nu * (1 - e2) * F.sin(lat)
        return let([tx + m * x - rz * y + ry * z, ty + rz * x + m * y - rx * z, tz - ry * x + rx * y + m * z], geodetic)

    def geodetic(x: Column, y: Column, z: Column) -> Column:
        b, f2 = target[0], _e2(target)
        p = F.hypot(x, y)
        lat = F.aggregate(F.sequence(F.lit(1), F.lit(6)), F.atan2(z, p * (1 - f2)), lambda t, _: F.atan2(z + f2 * b / F.sqrt(1 - f2 * F.pow(F.sin(t), 2)) * F.sin(t), p))
        return F.struct(lat.alias("lat"), F.atan2(y, x).alias("lon"))

    return let([lat, lon], cartesian)


def to_wgs84(easting: Column, northing: Column) -> Column:
    """struct(lon, lat) in degrees."""
    def out(s: Column) -> Column:
        return F.struct(F.degrees(s["lon"]).alias("lon"), F.degrees(s["lat"]).alias("lat"))

    return let([_grid_to_geodetic(easting, northing)], lambda g: let([_shifted(g["lat"], g["lon"], AIRY, WGS84, -1)], out))


def to_grid(lon: Column, lat: Column) -> Column:
    """struct(easting, northing) in metres."""
    return let([_shifted(F.radians(lat), F.radians(lon), WGS84, AIRY, 1)], lambda g: _geodetic_to_grid(g["lat"], g["lon"]))


def in_bbox(x: Column, y: Column, box: BBox) -> Column:
    """Inside or on any of the four sides."""
    return x.between(box[0], box[2]) & y.between(box[1], box[3])


def envelope(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """struct(west, south, east, north) in degrees that holds the corners of a grid box; it takes in a little more."""
    def of(*c: Column) -> Column:
        lon, lat = [p["lon"] for p in c], [p["lat"] for p in c]
        return F.struct(F.least(*lon).alias("west"), F.least(*lat).alias("south"), F.greatest(*lon).alias("east"), F.greatest(*lat).alias("north"))

    return let([to_wgs84(x, y) for x in (x0, x1) for y in (y0, y1)], of)
