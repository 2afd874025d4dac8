"""Reference systems that are written out, not named: WKT or a TIFF's own parameters, snapped to an EPSG code.

A text that names its code is taken at its word. One that doesn't is compared by what it says: ellipsoid, prime meridian,
projection, its parameters and units. It becomes WGS 84 in degrees, or the UTM zone on WGS 84 that has these values; what
has other values, leaves one out, or stands on another datum of the same ellipsoid has no code here (None).
"""

from __future__ import annotations

import math
import re

#: WGS 84: its semi-major axis in metres and inverse flattening; UTM's scale, false easting and the south's northing.
#: Fixed values.
AXIS, FLATTENING, SCALE, EASTING, SOUTH = 6378137.0, 298.257223563, 0.9996, 500000.0, 10000000.0
#: Keys of a TIFF's parameters: projected and geographic code, projection, method, citation, ellipsoid's axis and inverse
#: flattening, longitude and latitude of origin, easting, northing, scale, unit. Fixed values.
KEYS = {
    "code": 3072, "geographic": 2048, "projection": 3074, "method": 3075, "axis": 2057, "flattening": 2059, "meridian": 3080, "latitude": 3081,
    "easting": 3082, "northing": 3083, "scale": 3092, "unit": 3076,
}
#: Codes in a TIFF: user-defined, transverse Mercator, metre, WGS 84 in degrees; UTM's projections by hemisphere. Fixed values.
OWN, MERCATOR, METRE, DEGREES, NORTH_ZONES, SOUTH_ZONES = 32767, 1, 9001, 4326, 16000, 16100
#: What the parameters of WKT are called, and what they are here. Fixed values.
NAMES = {
    "central_meridian": "meridian", "longitude_of_natural_origin": "meridian", "latitude_of_origin": "latitude", "latitude_of_natural_origin": "latitude",
    "scale_factor": "scale", "scale_factor_at_natural_origin": "scale", "false_easting": "easting", "false_northing": "northing",
}
NEEDED = ("meridian", "latitude", "scale", "easting", "northing")


def _near(a: float | None, b: float, within: float) -> bool:
    return a is not None and abs(a - b) <= within


def zone(p: dict[str, float]) -> str | None:
    """The UTM zone on WGS 84 whose transverse Mercator has these parameters, in degrees and metres."""
    if not (_near(p.get("axis"), AXIS, 1e-3) and _near(p.get("flattening"), FLATTENING, 1e-7)):
        return None
    if not (_near(p.get("latitude"), 0.0, 1e-9) and _near(p.get("scale"), SCALE, 1e-9) and _near(p.get("easting"), EASTING, 1e-3)):
        return None
    at = (p.get("meridian", math.nan) + 183) / 6
    south = _near(p.get("northing"), SOUTH, 1e-3)
    if not (south or _near(p.get("northing"), 0.0, 1e-3)) or not _near(at, round(at) if at == at else 0, 1e-9) or not 1 <= round(at) <= 60:
        return None
    return f"EPSG:{(32700 if south else 32600) + round(at)}"


def _nodes(text: str) -> list:
    """WKT as nested lists: [KEYWORD, argument, ...], arguments being texts, numbers and nodes."""
    stack: list[list] = [[]]
    for quoted, opening, closing, plain in re.findall(r'"((?:[^"]|"")*)"|([A-Za-z_0-9]+)\s*[\[(]|([\])])|([^\s,\[\]()"]+)', text):
        if opening:
            stack.append([opening.upper()])
        elif closing:
            if len(stack) < 2:
                return []
            done = stack.pop()
            stack[-1].append(done)
        elif plain:
            try:
                stack[-1].append(float(plain))
            except ValueError:
                stack[-1].append(plain)
        else:
            stack[-1].append(quoted)
    return stack[0][0] if len(stack) == 1 and stack[0] and isinstance(stack[0][0], list) else []


def _all(node: list, *names: str) -> list[list]:
    """Nodes of these keywords anywhere under a node."""
    own = [node] if node and node[0] in names else []
    return own + [x for child in node if isinstance(child, list) for x in _all(child, *names)]


def _first(node: list, *names: str) -> list | None:
    return next(iter(_all(node, *names)), None)


def _child(node: list, *names: str) -> list | None:
    return next((x for x in node if isinstance(x, list) and x[0] in names), None)


def _datum_is_wgs84(node: list) -> bool:
    """Whether the datum is WGS 84 by name, or has no name of its own: another datum may share the ellipsoid."""
    datum = _first(node, "DATUM", "ENSEMBLE", "GEODETICDATUM")
    name = re.sub(r"[^a-z0-9]", "", str(datum[1]).lower()) if datum and len(datum) > 1 else ""
    return datum is not None and (name in ("", "unknown", "unnamed", "dunknown") or name in ("wgs84", "wgs1984", "dwgs1984", "worldgeodeticsystem1984", "worldgeodeticsystem1984ensemble"))


def of_wkt(text: str | None) -> str | None:
    """The EPSG code of a reference system in WKT, of either version; None for other systems and texts."""
    root = _nodes(text or "")
    if not root:
        return None
    told = _child(root, "AUTHORITY", "ID")
    if told and len(told) > 2 and str(told[1]).upper() == "EPSG":
        code = told[2]
        return f"EPSG:{int(code)}" if str(code).replace(".0", "").isdigit() else None
    ellipsoid, prime = _first(root, "SPHEROID", "ELLIPSOID"), _first(root, "PRIMEM", "PRIMEMERIDIAN")
    numbers = [x for x in (ellipsoid or [])[2:] if isinstance(x, float)]
    if len(numbers) < 2 or not _datum_is_wgs84(root) or (prime and not (len(prime) > 2 and prime[2] == 0.0)):
        return None
    p = {"axis": numbers[0], "flattening": numbers[1]}
    if root[0] in ("GEOGCS", "GEOGCRS", "GEODCRS"):
        unit = _child(root, "UNIT", "ANGLEUNIT") or _first(root, "ANGLEUNIT")
        degrees = unit and len(unit) > 2 and _near(unit[2], math.pi / 180, 1e-12)
        return f"EPSG:{DEGREES}" if degrees and _near(p["axis"], AXIS, 1e-3) and _near(p["flattening"], FLATTENING, 1e-7) else None
    method = _first(root, "PROJECTION", "METHOD")
    if root[0] not in ("PROJCS", "PROJCRS") or not method or str(method[1]).lower().replace(" ", "_") != "transverse_mercator":
        return None
    # Lengths are in the system's own unit in the first version, in each parameter's in the second.
    own = _child(root, "UNIT", "LENGTHUNIT")
    for x in _all(root, "PARAMETER"):
        name = NAMES.get(str(x[1]).lower().replace(" ", "_"))
        if name and len(x) > 2 and isinstance(x[2], float):
            unit = _child(x, "LENGTHUNIT", "UNIT") or own
            p[name] = x[2] * (unit[2] if name in ("easting", "northing") and unit and len(unit) > 2 else 1.0)
    units = [u[2] for u in ([own] if own else _all(root, "LENGTHUNIT")) if len(u) > 2]
    if not units or any(not _near(u, 1.0, 1e-12) for u in units):
        return None
    return zone(p) if all(k in p for k in NEEDED) else None


def of_tiff(keys: tuple, doubles: tuple = (), text: str = "") -> str | None:
    """The EPSG code that a TIFF's keys give, name a zone by, or describe by parameters."""
    found: dict[int, float | str] = {}
    for i in range(4, len(keys) - 3, 4):
        key, where, count, value = keys[i : i + 4]
        found[key] = value if where == 0 else doubles[value] if where == 34736 and value < len(doubles) else text[value : value + count] if where == 34737 else math.nan
    get = {name: found.get(key) for name, key in KEYS.items()}
    for name in ("code", "geographic"):
        if isinstance(get[name], int) and get[name] not in (0, OWN) and (name == "code" or get["code"] is None):
            return f"EPSG:{get[name]}"
    geodetic = get["geographic"] == DEGREES or (_near(get["axis"], AXIS, 1e-3) and _near(get["flattening"], FLATTENING, 1e-7))
    if geodetic and isinstance(get["projection"], int):
        for base, code in ((NORTH_ZONES, 32600), (SOUTH_ZONES, 32700)):
            if 1 <= get["projection"] - base <= 60:
                return f"EPSG:{code + get['projection'] - base}"
    if geodetic and get["method"] == MERCATOR and get["unit"] in (None, METRE):
        return zone({k: v for k, v in get.items() if isinstance(v, (int, float))} | {"axis": AXIS, "flattening": FLATTENING})
    # Some writers put WKT into a citation.
    return next((code for x in found.values() if isinstance(x, str) and "[" in x and (code := of_wkt(x[x.find("PROJC") if "PROJC" in x else x.find("GEO") :].rstrip("|\0 ")))), None)
