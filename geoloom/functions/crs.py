"""Reprojection as column arithmetic: EPSG:4326, EPSG:3857 and the UTM zones (EPSG:326zz north, 327zz south)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# The sphere of EPSG:3857 and the WGS 84 ellipsoid.
RADIUS = 6378137.0
FLATTENING = 1 / 298.257223563
DEGREE = RADIUS * math.pi / 180
SCALE, FALSE_EASTING, FALSE_NORTHING = 0.9996, 500000.0, 10000000.0


def is_utm(srid: int) -> bool:
    return 32601 <= srid <= 32660 or 32701 <= srid <= 32760


def known(srid: int) -> bool:
    return srid in (4326, 3857) or is_utm(srid)


def lonlat_to_mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Null outside the domain (the poles and beyond)."""
    y = F.lit(RADIUS) * F.ln(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2))
    return lon * DEGREE, F.when(F.abs(lat) < 90, y)


def mercator_to_lonlat(x: Column, y: Column) -> tuple[Column, Column]:
    return x / DEGREE, F.degrees(2 * F.atan(F.exp(y / RADIUS)) - F.lit(math.pi / 2))


def _series() -> tuple[float, float, list[float], list[float]]:
    """Eccentricity, rectifying radius and the series of the transverse Mercator projection to the third order in n."""
    n = FLATTENING / (2 - FLATTENING)
    e = math.sqrt(FLATTENING * (2 - FLATTENING))
    radius = RADIUS / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240]
    beta = [n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480]
    return e, radius, alpha, beta


def _atanh(c: Column) -> Column:
    return F.ln((1 + c) / (1 - c)) / 2


def _conformal(lat: Column) -> Column:
    e = _series()[0]
    phi = F.radians(lat)
    return F.sinh(_atanh(F.sin(phi)) - e * _atanh(e * F.sin(phi)))


def _on_sphere(lon: Column, t: Column, srid: int) -> tuple[Column, Column]:
    lam = F.radians(lon - (srid % 100 * 6 - 183))
    return F.atan2(t, F.cos(lam)), _atanh(F.sin(lam) / F.sqrt(1 + t * t))


def _on_plane(xi: Column, eta: Column, lat: Column, srid: int) -> tuple[Column, Column]:
    _, radius, alpha, _ = _series()
    east, north = eta, xi
    for j, a in enumerate(alpha, 1):
        east = east + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    x = F.lit(FALSE_EASTING) + SCALE * radius * east
    y = F.lit(FALSE_NORTHING if srid >= 32700 else 0.0) + SCALE * radius * north
    inside = F.abs(lat) < 90
    return F.when(inside, x), F.when(inside, y)


def lonlat_to_utm(lon: Column, lat: Column, srid: int) -> tuple[Column, Column]:
    """Good to about a millimetre within a zone."""
    return _on_plane(*_on_sphere(lon, _conformal(lat), srid), lat, srid)


def _off_plane(x: Column, y: Column, srid: int) -> tuple[Column, Column]:
    _, radius, _, beta = _series()
    xi = (y - (FALSE_NORTHING if srid >= 32700 else 0.0)) / (SCALE * radius)
    eta = (x - FALSE_EASTING) / (SCALE * radius)
    xi1, eta1 = xi, eta
    for j, b in enumerate(beta, 1):
        xi1 = xi1 - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        eta1 = eta1 - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    return xi1, eta1


def _off_sphere(xi1: Column, eta1: Column, chi: Column, srid: int) -> tuple[Column, Column]:
    """From the conformal latitude back by its series."""
    n = FLATTENING / (2 - FLATTENING)
    delta = [2 * n - 2 * n**2 / 3 - 2 * n**3, 7 * n**2 / 3 - 8 * n**3 / 5, 56 * n**3 / 15]
    phi = chi
    for j, d in enumerate(delta, 1):
        phi = phi + d * F.sin(2 * j * chi)
    return F.lit(float(srid % 100 * 6 - 183)) + F.degrees(F.atan2(F.sinh(eta1), F.cos(xi1))), F.degrees(phi)


def utm_to_lonlat(x: Column, y: Column, srid: int) -> tuple[Column, Column]:
    xi1, eta1 = _off_plane(x, y, srid)
    return _off_sphere(xi1, eta1, F.asin(F.sin(xi1) / F.cosh(eta1)), srid)


def reprojected(x: Column, y: Column, source: int, target: int) -> tuple[Column, Column]:
    """Coordinates of one system in another; null where a point lies outside the target's domain."""
    for srid in (source, target):
        if not known(srid):
            raise ValueError(f"EPSG:{srid} is not supported")
    if source == target:
        return x, y
    lon, lat = (x, y) if source == 4326 else mercator_to_lonlat(x, y) if source == 3857 else utm_to_lonlat(x, y, source)
    if target == 4326:
        return lon, lat
    return lonlat_to_mercator(lon, lat) if target == 3857 else lonlat_to_utm(lon, lat, target)


#: Parts into which an edge is cut to find how far it bulges.
EDGE_PARTS = 32


def straight(source: int, target: int) -> bool:
    """Whether edges along the axes of one system are such edges in the other, so that corners bound a box."""
    return source == target or {source, target} == {4326, 3857}


def _fields(**columns: Column) -> Column:
    return F.struct(*[c.alias(name) for name, c in columns.items()])


def _point(xy: tuple[Column, Column]) -> Column:
    return _fields(x=xy[0], y=xy[1])


def in_steps(array: Column, *steps) -> Column:
    """Each element taken through `steps`. Within a function of an array Spark works out a value anew wherever it is
    named; a step of its own works it out once."""
    for step in steps:
        array = F.transform(array, step)
    return array


def point_steps(source: int, target: int) -> list:
    """`reprojected` as steps from struct<x, y> to struct<x, y>, for `in_steps`."""
    steps = []
    if source == target:
        return steps
    if source == 3857:
        steps += [lambda q: _point(mercator_to_lonlat(q["x"], q["y"]))]
    elif source != 4326:
        steps += [
            lambda q: _point(_off_plane(q["x"], q["y"], source)),
            lambda q: _fields(x=q["x"], y=q["y"], chi=F.asin(F.sin(q["x"]) / F.cosh(q["y"]))),
            lambda q: _point(_off_sphere(q["x"], q["y"], q["chi"], source)),
        ]
    if target == 3857:
        steps += [lambda q: _point(lonlat_to_mercator(q["x"], q["y"]))]
    elif target != 4326:
        steps += [
            lambda q: _fields(lon=q["x"], lat=q["y"], t=_conformal(q["y"])),
            lambda q: _fields(lat=q["lat"], at=_point(_on_sphere(q["lon"], q["t"], target))),
            lambda q: _point(_on_plane(q["at"]["x"], q["at"]["y"], q["lat"], target)),
        ]
    return steps


def edges(xmin: Column, ymin: Column, xmax: Column, ymax: Column, source: int, target: int) -> Column:
    """The four edges of a box in another system: arrays of EDGE_PARTS + 1 points (x, y), null outside its domain."""
    at = F.array(*[F.lit(i / EDGE_PARTS) for i in range(EDGE_PARTS + 1)])
    steps = point_steps(source, target)

    def flat(y: Column) -> Column:
        return in_steps(at, lambda t: _point((xmin + (xmax - xmin) * t, y)), *steps)

    def upright(x: Column) -> Column:
        return in_steps(at, lambda t: _point((x, ymin + (ymax - ymin) * t)), *steps)

    return F.array(flat(ymin), flat(ymax), upright(xmin), upright(xmax))


def least_of_edges(edges: Column) -> Column:
    """The least value that each of some smooth edges takes, from its values at equal steps: the lowest point of the
    parabola through the three values around the least, and below it what the third differences leave open; else the
    least value."""

    def around(e: Column) -> Column:
        v, i = e["v"], F.least(F.greatest(e["at"], F.lit(1)), F.lit(EDGE_PARTS - 1))
        return _fields(lowest=e["lowest"], p=F.transform(F.array(*[F.lit(k) for k in range(-2, 3)]), lambda k: F.get(v, i + k)))

    def bent(e: Column) -> Column:
        before, a, b, c, after = (F.get(e["p"], k) for k in range(5))
        third = F.greatest(F.abs(F.coalesce(after - 3 * c + 3 * b - a, F.lit(0.0))), F.abs(F.coalesce(c - 3 * b + 3 * a - before, F.lit(0.0))))
        return _fields(lowest=e["lowest"], b=b, tilt=a - c, bend=a - 2 * b + c, third=third)

    def least(e: Column) -> Column:
        inner = e["b"] - e["tilt"] ** 2 / (8 * e["bend"]) - e["third"] * (1 / (9 * math.sqrt(3)))
        return F.when((e["bend"] > 0) & (F.abs(e["tilt"]) < 2 * e["bend"]), F.least(e["lowest"], inner)).otherwise(e["lowest"])

    return in_steps(
        edges, lambda v: _fields(v=v, lowest=F.array_min(v)), lambda e: _fields(v=e["v"], lowest=e["lowest"], at=F.array_position(e["v"], e["lowest"]).cast("int") - 1), around, bent, least
    )
