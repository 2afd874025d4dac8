"""UTM zones of WGS 84 and degrees, both ways, by Krueger's series in the third flattening.

The same formulas serve single numbers (``math``) and columns (``pyspark.sql.functions``), whose functions go by the same
names: columns never leave the JVM.
"""

from __future__ import annotations

import math
from types import ModuleType

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veldt.errors import AnalysisError


# WGS 84 and the scale and false origin of UTM. Fixed values.
SEMI_MAJOR, FLATTENING, SCALE, EAST, NORTH = 6378137.0, 1 / 298.257223563, 0.9996, 500000.0, 10_000_000.0
_N = FLATTENING / (2 - FLATTENING)
_RADIUS = SCALE * SEMI_MAJOR / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
# Coefficients of the series to the third power: to the plane, from it, and from the conformal to the geodetic latitude.
_ALPHA = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16, 13 * _N**2 / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240)
_BETA = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96, _N**2 / 48 + _N**3 / 15, 17 * _N**3 / 480)
_DELTA = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3, 7 * _N**2 / 3 - 8 * _N**3 / 5, 56 * _N**3 / 15)
DEGREES = 4326


def code_of(crs: str | None) -> int:
    """The EPSG code of a reference system that can be reckoned with here: degrees, or a UTM zone."""
    try:
        code = int((crs or "").rsplit(":", 1)[-1])
    except ValueError:
        code = 0
    if code != DEGREES and not (32601 <= code <= 32660 or 32701 <= code <= 32760):
        raise AnalysisError(f"{crs} is neither WGS 84 in degrees nor one of its UTM zones")
    return code


def to_zone(lon, lat, code: int, m: ModuleType = math):
    """Degrees to metres east and north in a zone."""
    phi, lam = m.radians(lat), m.radians(lon - ((code % 100) * 6 - 183))
    k = 2 * math.sqrt(_N) / (1 + _N)
    t = m.sinh(m.atanh(m.sin(phi)) - k * m.atanh(k * m.sin(phi)))
    xi, eta = m.atan2(t, m.cos(lam)), m.asinh(m.sin(lam) / m.sqrt(t * t + m.cos(lam) * m.cos(lam)))
    east, north = eta, xi
    for j, c in enumerate(_ALPHA, 1):
        east = east + c * m.cos(2 * j * xi) * m.sinh(2 * j * eta)
        north = north + c * m.sin(2 * j * xi) * m.cosh(2 * j * eta)
    return EAST + _RADIUS * east, (NORTH if code > 32700 else 0.0) + _RADIUS * north


def to_degrees(x, y, code: int, m: ModuleType = math):
    """Metres east and north in a zone to degrees."""
    xi, eta = (y - (NORTH if code > 32700 else 0.0)) / _RADIUS, (x - EAST) / _RADIUS
    up, across = xi, eta
    for j, c in enumerate(_BETA, 1):
        up = up - c * m.sin(2 * j * xi) * m.cosh(2 * j * eta)
        across = across - c * m.cos(2 * j * xi) * m.sinh(2 * j * eta)
    chi = m.asin(m.sin(up) / m.cosh(across))
    phi = chi
    for j, c in enumerate(_DELTA, 1):
        phi = phi + c * m.sin(2 * j * chi)
    return m.degrees(m.atan2(m.sinh(across), m.cos(up))) + ((code % 100) * 6 - 183), m.degrees(phi)


def between(x, y, source: str, target: str, m: ModuleType = math):
    """A point of one reference system in another."""
    a, b = code_of(source), code_of(target)
    if a == b:
        return x, y
    lon, lat = (x, y) if a == DEGREES else to_degrees(x, y, a, m)
    return (lon, lat) if b == DEGREES else to_zone(lon, lat, b, m)


def moved(df: DataFrame, source: str | None, target: str | None, x: str = "x", y: str = "y") -> DataFrame:
    """The columns ``x`` and ``y`` in another reference system. Degrees are columns of their own in between, so that no
    step of the formulas is written out more than once."""
    if source == target:
        return df
    a, b = code_of(source), code_of(target)
    if a != DEGREES:
        lon, lat = to_degrees(F.col(x), F.col(y), a, F)
        df = df.withColumns({"_lon": lon, "_lat": lat}).drop(x, y).withColumnsRenamed({"_lon": x, "_lat": y})
    if b != DEGREES:
        east, north = to_zone(F.col(x), F.col(y), b, F)
        df = df.withColumns({"_east": east, "_north": north}).drop(x, y).withColumnsRenamed({"_east": x, "_north": y})
    return df


def in_degrees(shape: Column, source: str) -> Column:
    """Polygons of rings of points (x, y), as of ``overlay.shapes``, as the coordinates of a GeoJSON MultiPolygon."""

    def point(p: Column) -> Column:
        return F.array(*between(p["x"], p["y"], source, f"EPSG:{DEGREES}", F))

    def ring(r: Column) -> Column:
        return F.transform(F.concat(r["points"], F.slice(r["points"], 1, 1)), point)

    return F.transform(shape, lambda polygon: F.transform(polygon["rings"], ring))
