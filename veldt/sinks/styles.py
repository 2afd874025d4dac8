"""Layer styles of the outputs: colour ramps, palettes, classes and ranges."""

from __future__ import annotations

from xml.sax.saxutils import quoteattr

# What each style shows, with its colours and labels as users of these layers know them.
RAMP = ((0.0, "#ffffcc"), (0.33, "#fd8d3c"), (0.66, "#e31a1c"), (1.0, "#800026"))
INTENSITY = ((0.0, "#ffffff00", 0, "No change"), (0.33, "#ffff6600", 180, "Moderate"), (0.66, "#ff0000", 230, "Strong"), (1.0, "#800026", 255, "Very strong"))
BINARY = ((0, "#ffffff", 0, "No change"), (1, "#ff00ff", 255, "Changed"))
CONFIDENCE = (
    (0.0, 0.3, "Low confidence (0.0-0.3)", "255,255,0,90"),
    (0.3, 0.6, "Medium confidence (0.3-0.6)", "255,140,0,120"),
    (0.6, 1.01, "High confidence (0.6-1.0)", "220,20,20,150"),
)
HOTSPOTS = (
    ("hot_99", "99% Hotspot", "103,0,13,220"),
    ("hot_95", "95% Hotspot", "215,48,31,220"),
    ("hot_90", "90% Hotspot", "252,146,114,220"),
    ("not_significant", "Not significant", "240,240,240,90"),
    ("cold_90", "90% Coldspot", "158,202,225,220"),
    ("cold_95", "95% Coldspot", "49,130,189,220"),
    ("cold_99", "99% Coldspot", "8,48,107,220"),
)
CLUSTERS = (
    ("High-High", "High-High", "215,48,31,200"),
    ("Low-Low", "Low-Low", "49,130,189,200"),
    ("High-Low", "High-Low", "253,174,97,200"),
    ("Low-High", "Low-High", "166,189,219,200"),
    ("Not significant", "Not significant", "240,240,240,120"),
)
ANOMALIES = (
    (0.0, 0.5, "Below median anomaly rank", "247,251,255,60"),
    (0.5, 0.9, "Above median (top 50%)", "107,174,214,140"),
    (0.9, 1.01, "Top 10% anomaly rank", "8,48,107,200"),
)


def _tag(name: str, inside: str = "", /, **attributes: object) -> str:
    told = "".join(f" {k}={quoteattr(str(v))}" for k, v in attributes.items())
    return f"<{name}{told}>{inside}</{name}>"


def _document(inside: str) -> str:
    return f"<!DOCTYPE qgis>{_tag('qgis', inside)}"


def _ramp(items: str) -> str:
    shader = _tag("rastershader", _tag("colorrampshader", items, colorRampType="INTERPOLATED"))
    return _document(_tag("pipe", _tag("rasterrenderer", shader, type="singlebandpseudocolor", band=1)))


def _fills(colours: list[str]) -> str:
    option = lambda c: _tag("Option", _tag("Option", name="color", value=c))
    return _tag("symbols", "".join(_tag("symbol", _tag("layer", option(c), **{"class": "SimpleFill"}), type="fill", name=i) for i, c in enumerate(colours)))


def intensity(top: float) -> str:
    """A ramp with its stops at shares of ``top``."""
    return _ramp("".join(_tag("item", value=f"{top * s:.6f}", label=f"{top * s:.3f}", color=c) for s, c in RAMP))


def categories(column: str, rows: tuple) -> str:
    told = "".join(_tag("category", value=v, label=label, symbol=i) for i, (v, label, _) in enumerate(rows))
    return _document(_tag("renderer-v2", _tag("categories", told) + _fills([r[-1] for r in rows]), type="categorizedSymbol", attr=column))


def ranges(column: str, rows: tuple) -> str:
    told = "".join(_tag("range", lower=a, upper=b, label=label, symbol=i) for i, (a, b, label, _) in enumerate(rows))
    return _document(_tag("renderer-v2", _tag("ranges", told) + _fills([r[-1] for r in rows]), type="graduatedSymbol", attr=column, graduatedMethod="GraduatedColor"))


def every(top: float | None) -> dict[str, str]:
    """Styles by layer; that of change vectors only where their ``top`` is known."""
    palette = _tag("colorPalette", "".join(_tag("paletteEntry", value=v, color=c, alpha=a, label=label) for v, c, a, label in BINARY))
    out = {
        "baseline_intensity": _ramp("".join(_tag("item", value=v, color=c, alpha=a, label=label) for v, c, a, label in INTENSITY)),
        "change_binary": _document(_tag("pipe", _tag("rasterrenderer", palette, type="paletted", band=1))),
        "change_polygons": ranges("confidence", CONFIDENCE),
        "gi_hotspots": categories("hotspot_class", HOTSPOTS),
        "lisa_clusters": categories("lisa_cluster", CLUSTERS),
        "ml_anomalies": ranges("ml_anomaly_quantile", ANOMALIES),
    }
    return out if top is None else out | {"cva_intensity": intensity(top)}
