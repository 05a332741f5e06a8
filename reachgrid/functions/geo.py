"""Grid codes, distances, ring measures and the map projection as expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

EARTH_KM = 6371.0
CELL_SIZE = 250


def haversine_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle distance in kilometres."""
    half_lat = F.sin(F.radians(lat2 - lat1) / 2)
    half_lon = F.sin(F.radians(lon2 - lon1) / 2)
    h = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    return F.lit(2 * EARTH_KM) * F.atan2(F.sqrt(h), F.sqrt(1 - h))


def snapped(value: Column, size: int) -> Column:
    return F.floor(value / size).cast("bigint") * size


def code_of(east: Column, north: Column) -> Column:
    return F.concat(F.lit("E"), east.cast("bigint").cast("string"), F.lit("_N"), north.cast("bigint").cast("string"))


def cell_code(x: Column, y: Column, size: int = CELL_SIZE) -> Column:
    """Code of the grid cell that holds a projected point."""
    return code_of(snapped(x, size), snapped(y, size))


def cell_xy(code: Column) -> tuple[Column, Column]:
    """South-west corner read back from a cell code."""
    pattern = r"^E(-?\d+)_N(-?\d+)$"
    return tuple(F.regexp_extract(code, pattern, i).try_cast("bigint") for i in (1, 2))


def signed_area(points: Column) -> Column:
    """Shoelace area of one ring (array of x,y structs); positive if counter-clockwise, 0 if it has no inside."""
    area = F.aggregate(
        F.sequence(F.lit(1), F.size(points)),
        F.lit(0.0),
        lambda acc, i: acc + _cross(points, i),
        lambda acc: acc / 2,
    )
    return F.when(F.size(points) > 2, area).otherwise(F.lit(0.0))


def ring_moments(points: Column) -> Column:
    """(area, area * cx, area * cy) of a ring as a struct."""
    zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("mx"), F.lit(0.0).alias("my"))

    def step(acc: Column, i: Column) -> Column:
        p, q = F.element_at(points, i), F.element_at(points, i % F.size(points) + 1)
        cross = p["x"] * q["y"] - q["x"] * p["y"]
        return F.struct(
            (acc["a"] + cross / 2).alias("a"),
            (acc["mx"] + cross * (p["x"] + q["x"]) / 6).alias("mx"),
            (acc["my"] + cross * (p["y"] + q["y"]) / 6).alias("my"),
        )

    return F.aggregate(F.sequence(F.lit(1), F.size(points)), zero, step)


def _cross(points: Column, i: Column) -> Column:
    p, q = F.element_at(points, i), F.element_at(points, i % F.size(points) + 1)
    return p["x"] * q["y"] - q["x"] * p["y"]


# --- transverse Mercator ---------------------------------------------------
# GRS80 ellipsoid, zone 30 (central meridian -3, scale 0.9996,
# false easting 500 km). The series are Krueger's, to fourth order in n.
_A, _F = 6378137.0, 1 / 298.257222101
_LON0, _K0, _E0 = -3.0, 0.9996, 500000.0
_N = _F / (2 - _F)
_R = _A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_FWD = (
    _N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180,
    13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440,
    61 * _N**3 / 240 - 103 * _N**4 / 140,
    49561 * _N**4 / 161280,
)
_INV = (
    _N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360,
    _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440,
    17 * _N**3 / 480 - 37 * _N**4 / 840,
    4397 * _N**4 / 161280,
)
_LAT = (
    2 * _N - 2 * _N**2 / 3 - 2 * _N**3 + 116 * _N**4 / 45,
    7 * _N**2 / 3 - 8 * _N**3 / 5 - 227 * _N**4 / 45,
    56 * _N**3 / 15 - 136 * _N**4 / 35,
    4279 * _N**4 / 630,
)
_ECC = 2 * math.sqrt(_N) / (1 + _N)


def project(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Degrees to metres (zone 30)."""
    sin_lat = F.sin(F.radians(lat))
    t = F.sinh(F.atanh(sin_lat) - _ECC * F.atanh(_ECC * sin_lat))
    dlon = F.radians(lon - F.lit(_LON0))
    xi = F.atan2(t, F.cos(dlon))
    eta = F.atanh(F.sin(dlon) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for j, a in enumerate(_FWD, 1):
        east = east + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return F.lit(_E0) + _K0 * _R * east, _K0 * _R * north


def unproject(x: Column, y: Column) -> tuple[Column, Column]:
    """Metres (zone 30) to degrees."""
    xi, eta = y / (_K0 * _R), (x - _E0) / (_K0 * _R)
    xi1, eta1 = xi, eta
    for j, b in enumerate(_INV, 1):
        xi1 = xi1 - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        eta1 = eta1 - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(xi1) / F.cosh(eta1))
    lat = chi
    for j, d in enumerate(_LAT, 1):
        lat = lat + d * F.sin(2 * j * chi)
    return F.lit(_LON0) + F.degrees(F.atan2(F.sinh(eta1), F.cos(xi1))), F.degrees(lat)


def project_rings(rings: Column) -> Column:
    """Apply :func:`project` to every point of a rings column."""

    def point(p: Column) -> Column:
        x, y = project(p["x"], p["y"])
        return F.struct(x.alias("x"), y.alias("y"))

    return F.transform(
        rings,
        lambda r: F.struct(
            r["part"].alias("part"), r["ring"].alias("ring"), F.transform(r["pts"], point).alias("pts")
        ),
    )
