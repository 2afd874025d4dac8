"""Reference systems without a code: what they say decides, and what they leave open has no code."""

import json
import struct

import numpy as np
import pytest

from veldt.operators.change import AnalysisError
from veldt.sources import crs, tiff, vectors

GEO = 'GEOGCS["{name}",DATUM["{datum}",SPHEROID["{ball}",{axis},{flat}]],PRIMEM["Greenwich",{prime}],UNIT["degree",0.0174532925199433]]'
PROJECTED = (
    'PROJCS["custom",{geo},PROJECTION["Transverse_Mercator"],PARAMETER["latitude_of_origin",0],PARAMETER["central_meridian",{meridian}],'
    'PARAMETER["scale_factor",{scale}],PARAMETER["false_easting",500000],PARAMETER["false_northing",{northing}],UNIT["{unit}",{metres}]]'
)


def wkt(**kw):
    v = {"name": "x", "datum": "WGS_1984", "ball": "WGS 84", "axis": 6378137, "flat": 298.257223563, "prime": 0, "meridian": 27, "scale": 0.9996, "northing": 10000000, "unit": "metre", "metres": 1} | kw
    return PROJECTED.format(geo=GEO.format(**v), **v)


def test_wkt_without_a_code():
    assert crs.of_wkt(wkt()) == "EPSG:32735"
    assert crs.of_wkt(wkt(northing=0)) == "EPSG:32635"
    assert crs.of_wkt(wkt(meridian=-177, northing=0)) == "EPSG:32601" and crs.of_wkt(wkt(meridian=177)) == "EPSG:32760"
    assert crs.of_wkt(wkt(datum="unknown")) == "EPSG:32735"
    geo = GEO.format(name="x", datum="D_WGS_1984", ball="b", axis=6378137.0, flat=298.257223563, prime=0)
    assert crs.of_wkt(geo) == "EPSG:4326"
    two = (
        'PROJCRS["custom",BASEGEOGCRS["WGS 84",ENSEMBLE["World Geodetic System 1984 ensemble",MEMBER["World Geodetic System 1984 (G730)"],'
        'ELLIPSOID["WGS 84",6378137,298.257223563,LENGTHUNIT["metre",1]]],PRIMEM["Greenwich",0,ANGLEUNIT["degree",0.0174532925199433]]],'
        'CONVERSION["c",METHOD["Transverse Mercator"],PARAMETER["Latitude of natural origin",0,ANGLEUNIT["degree",0.0174532925199433]],'
        'PARAMETER["Longitude of natural origin",27,ANGLEUNIT["degree",0.0174532925199433]],PARAMETER["Scale factor at natural origin",0.9996,SCALEUNIT["unity",1]],'
        'PARAMETER["False easting",500,LENGTHUNIT["kilometre",1000]],PARAMETER["False northing",10000000,LENGTHUNIT["metre",1]]],'
        'CS[Cartesian,2],AXIS["(E)",east],AXIS["(N)",north],LENGTHUNIT["metre",1]]'
    )
    assert crs.of_wkt(two) == "EPSG:32735"


@pytest.mark.parametrize(
    "other",
    [{"meridian": 28}, {"scale": 1}, {"northing": 5}, {"flat": 298.257222101}, {"datum": "European_Terrestrial_Reference_System_1989"}, {"prime": 2.33}, {"unit": "foot", "metres": 0.3048}, {"axis": 6378135}],
)
def test_other_and_ambiguous_systems_have_none(other):
    assert crs.of_wkt(wkt(**other)) is None


def test_named_and_broken():
    assert crs.of_wkt(wkt()[:-1] + ',AUTHORITY["EPSG","25835"]]') == "EPSG:25835"
    assert crs.of_wkt(wkt().replace('PARAMETER["scale_factor",0.9996],', "")) is None
    assert crs.of_wkt(wkt().replace(',UNIT["metre",1]', "")) is None
    for text in (None, "", "no brackets", "]]", 'PROJCS["open"', 'LOCAL_CS["x"]', "()"):
        assert crs.of_wkt(text) is None


def keys(*entries):
    return (1, 1, 0, len(entries), *[x for e in entries for x in e])


def test_keys_of_a_tiff():
    assert crs.of_tiff(()) is None
    assert crs.of_tiff(keys((3072, 0, 1, 32735))) == "EPSG:32735"
    assert crs.of_tiff(keys((2048, 0, 1, 4326))) == "EPSG:4326"
    own = (3072, 0, 1, 32767), (2048, 0, 1, 4326)
    assert crs.of_tiff(keys(*own, (3074, 0, 1, 16135))) == "EPSG:32735"
    doubles = (27.0, 0.0, 500000.0, 10000000.0, 0.9996)
    parameters = [(k, 34736, 1, i) for i, k in enumerate((3080, 3081, 3082, 3083, 3092))]
    assert crs.of_tiff(keys(*own, (3075, 0, 1, 1), *parameters), doubles) == "EPSG:32735"
    assert crs.of_tiff(keys(*own, (3075, 0, 1, 1), *parameters), (28.0, *doubles[1:])) is None
    assert crs.of_tiff(keys(*own, (3075, 0, 1, 1), *parameters[:-1]), doubles) is None
    assert crs.of_tiff(keys((3072, 0, 1, 32767), (3075, 0, 1, 1), *parameters), doubles) is None
    text = "ESRI PE String = " + wkt() + "|"
    assert crs.of_tiff(keys((3072, 0, 1, 32767), (3073, 34737, len(text), 0)), (), text) == "EPSG:32735"


def test_files(spark, tmp_path):
    """A band whose keys describe a zone, and an area of interest whose system is written out."""
    raw = tiff.encode(np.ones((4, 4), "u2"), tiff.Grid(4, 4, 10.0, 500000.0, -10.0, 8600000.0, "EPSG:32735"))
    code = struct.pack("<HHHH", 3072, 0, 1, 32735)
    assert raw.count(code) == 1
    (tmp_path / "b.tif").write_bytes(raw.replace(code, struct.pack("<HHHH", 3072, 0, 1, 32767)))
    assert tiff.grids(spark, {"b": str(tmp_path / "b.tif")})["b"].crs is None
    (tmp_path / "c.tif").write_bytes(raw.replace(code, struct.pack("<HHHH", 3072, 0, 1, 32734)))
    assert tiff.grids(spark, {"b": str(tmp_path / "c.tif")})["b"].crs == "EPSG:32734"
    area = {"type": "Polygon", "coordinates": [], "crs": {"type": "name", "properties": {"name": wkt()}}}
    (tmp_path / "a.geojson").write_text(json.dumps(area))
    assert vectors.reference_system(spark, str(tmp_path / "a.geojson")) == "EPSG:32735"
    area["crs"]["properties"]["name"] = wkt(meridian=28)
    (tmp_path / "d.geojson").write_text(json.dumps(area))
    with pytest.raises(AnalysisError):
        vectors.reference_system(spark, str(tmp_path / "d.geojson"))
