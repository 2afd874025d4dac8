"""Areas of interest: the polygons of GeoJSON."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from veldt.errors import AnalysisError
from veldt.sources import crs


class AoiError(AnalysisError):
    """An area of interest that cannot be used; ``code`` says why."""

    def __init__(self, code: str, message: str) -> None:
        super().__init__(message)
        self.code = code


def _geometries(node: dict) -> Iterator[dict]:
    """The polygons' coordinates in any GeoJSON object: a collection, a feature, or a bare geometry."""
    kind = node.get("type")
    if kind == "FeatureCollection":
        for f in node.get("features") or []:
            yield from _geometries(f)
    elif kind == "Feature":
        if node.get("geometry"):  # features without a geometry are left out
            yield from _geometries(node["geometry"])
    elif kind == "GeometryCollection":
        for g in node.get("geometries") or []:
            yield from _geometries(g)
    elif kind == "Polygon":
        yield node["coordinates"]
    elif kind == "MultiPolygon":
        yield from node["coordinates"]


def reference_system(spark: SparkSession, path: str) -> str:
    """What the file's member ``crs`` names or writes out as WKT; degrees where it has none, as the format says."""
    found = json.loads(spark.read.text(path, wholetext=True).first()[0]).get("crs") or {}
    name = str((found.get("properties") or {}).get("name", ""))
    if "[" in name:
        code = crs.of_wkt(name)
        if code is None:
            raise AnalysisError("the reference system of the area of interest has no code that is known here")
        return code
    code = name.rsplit(":", 1)[-1]
    return f"EPSG:{code}" if code.isdigit() else "EPSG:4326"


def polygons(spark: SparkSession, path: str) -> list[list[list[tuple[float, float]]]]:
    """The polygons of a GeoJSON file, each a list of rings, the outer one first: closed, without repeated points."""
    try:
        text = spark.read.text(path, wholetext=True).first()
    except Exception as e:  # noqa: BLE001  whatever the file system says of a path that can't be read
        raise AoiError("aoi_missing", f"{path}: {str(e).splitlines()[0]}") from e
    try:
        found = list(_geometries(json.loads(text[0] if text else "")))
        out = []
        for rings in found:
            kept = []
            for ring in rings:
                points = [tuple(map(float, x[:2])) for x in ring]
                points = [a for a, b in zip(points, points[1:] + points[:1], strict=True) if a != b]
                if len(points) >= 3:
                    kept.append(points)
            if kept:
                out.append(kept)
    except (ValueError, TypeError, KeyError, AttributeError, IndexError) as e:
        raise AoiError("aoi_unreadable", f"{path}: {e}") from e
    if not out:
        raise AoiError("aoi_empty", "the area of interest has no polygon")
    return out


def crosses_itself(ring: list[tuple[float, float]]) -> bool:
    """Whether two sides of a ring that aren't neighbours cross."""

    def side(a, b, c) -> float:
        return (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])

    sides = list(zip(ring, ring[1:] + ring[:1], strict=True))
    for i, (a, b) in enumerate(sides):
        for j in range(i + 2, len(sides) - (i == 0)):
            c, d = sides[j]
            if side(a, b, c) * side(a, b, d) < 0 and side(c, d, a) * side(c, d, b) < 0:
                return True
    return False


def meets_box(shape: list[list[list[tuple[float, float]]]], box: tuple[float, float, float, float]) -> bool:
    """Whether an area has a point in common with a box (x0, y0, x1, y1)."""
    x0, y0, x1, y1 = box
    for rings in shape:
        odd = False
        for ring in rings:
            for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1], strict=True):
                lo, hi = 0.0, 1.0  # the part of the side that is inside
                for p, d, least, most in ((ax, bx - ax, x0, x1), (ay, by - ay, y0, y1)):
                    if d:
                        s, t = sorted(((least - p) / d, (most - p) / d))
                        lo, hi = max(lo, s), min(hi, t)
                    elif not least <= p <= most:
                        lo, hi = 1.0, 0.0
                if lo <= hi:
                    return True
                if (ay > y0) != (by > y0) and x0 < ax + (y0 - ay) * (bx - ax) / (by - ay):
                    odd = not odd
        if odd:
            return True
    return False


def edges(spark: SparkSession, shape: list[list[list[tuple[float, float]]]]) -> DataFrame:
    """(part, ring, x1, y1, x2, y2): the sides of each polygon, outer rings (0) all one way round and holes the other."""
    rows = []
    for part, rings in enumerate(shape):
        for i, ring in enumerate(rings):
            twice = sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1], strict=True))
            ring = ring if (twice > 0) == (i == 0) else ring[::-1]
            rows += [(part, i, *map(float, a), *map(float, b)) for a, b in zip(ring, ring[1:] + ring[:1], strict=True)]
    return spark.createDataFrame(rows, "part int, ring int, x1 double, y1 double, x2 double, y2 double")
