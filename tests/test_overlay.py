"""Unions, repairs, clips and outlines against plain versions of themselves."""

import math
import struct

import numpy as np
import pytest

from veldt import scratch
from veldt.operators import overlay
from veldt.sources import vectors
from veldt.sources.tiff import Grid


def square(x0, y0, x1, y1):
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]


def clipped(spark, pixels, shape):
    labels = spark.createDataFrame(pixels, "label long, row int, col int")
    return scratch.kept(overlay.clip(overlay.runs(labels), vectors.edges(spark, shape)), "clipped")


def measured(spark, pixels, shape):
    sides = overlay.boundary(clipped(spark, pixels, shape))
    return {r["label"]: (r["area_m2"], r["perimeter_m"]) for r in overlay.measures(sides).collect()}


def frame(n=20, label=1):
    return [(label, r, c) for r in range(n) for c in range(n)]


def test_unions_and_repairs(spark):
    cases = [
        ([[square(0, 0, 6, 6)], [square(3, 3, 9, 9)]], 63, 36),
        ([[square(0, 0, 1, 1)], [square(0, 0, 1, 1)]], 1, 4),  # equal polygons count once
        ([[square(0, 0, 9, 9), square(2, 2, 5, 5)]], 72, 48),
        ([[square(0, 0, 4, 4)], [square(4, 0, 8, 4)]], 32, 24),  # a common border is inside
        ([[square(0, 0, 4, 4)], [square(4, 4, 8, 8)]], 32, 32),
        ([[[(0, 0), (4, 4), (4, 0), (0, 4)]]], 8, 8 + 4 * math.hypot(2, 2)),  # a crossing ring: both its lobes
        ([[square(0.25, 0.5, 2.75, 1.5)]], 2.5, 7),
        ([[square(-5, -5, 50, 30)]], 400, 80),
        ([[square(30, 30, 40, 40)]], None, None),
        ([[square(0, 0, 9, 9), square(2, 2, 5, 5)], [square(3, 3, 4, 4)]], 73, 52),  # an island in a hole
        ([[[(1, 1), (5, 1), (5, 5), (1, 5), (1, 1), (5, 1), (5, 5), (1, 5)]]], 16, 16),  # twice round
    ]
    far = lambda shape, k: [[[(x, y + 100 * k) for x, y in ring] for ring in rings] for rings in shape]
    pixels = [(k, r + 100 * k, c) for k in range(len(cases)) for _, r, c in frame()]
    got = measured(spark, pixels, [p for k, (shape, _, _) in enumerate(cases) for p in far(shape, k)])
    for k, (shape, area, perimeter) in enumerate(cases):
        assert got.get(k) == (None if area is None else (pytest.approx(area, abs=1e-6), pytest.approx(perimeter, abs=1e-6))), shape


def _inside(x, y, ring):
    w = 0
    for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
        if (ay > y) != (by > y) and x < ax + (y - ay) * (bx - ax) / (by - ay):
            w += 1 if by > ay else -1
    return w != 0


def test_clips_of_random_shapes(spark):
    """Areas against a fine grid of points; the complement's area adds up; perimeters against a convex closed form."""
    rng = np.random.default_rng(5)
    pixels = [(1 + (c >= 6), r, c) for r in range(12) for c in range(12) if rng.random() < 0.8]
    for _ in range(3):
        shape = [[[tuple(map(float, rng.uniform(-2, 14, 2))) for _ in range(rng.integers(3, 8))]] for _ in range(4)]
        got = measured(spark, pixels, shape)
        for label in (1, 2):
            n, hits = 12, 0
            for _, r, c in (p for p in pixels if p[0] == label):
                for i in range(n):
                    for j in range(n):
                        hits += any(_inside(c + (i + 0.5) / n, r + (j + 0.5) / n, p[0]) for p in shape)
            assert got.get(label, (0.0,))[0] == pytest.approx(hits / n**2, abs=0.8)
    tilted = [[[(0.5, 0.5), (7.25, 1.0), (3.0, 8.5)]]]
    area, perimeter = measured(spark, frame(), tilted)[1]
    assert area == pytest.approx(abs((7.25 - 0.5) * (8.5 - 0.5) - (3.0 - 0.5) * (1.0 - 0.5)) / 2)
    ring = tilted[0][0]
    assert perimeter == pytest.approx(sum(math.dist(a, b) for a, b in zip(ring, ring[1:] + ring[:1])))


def trace(pixels: set[tuple[int, int]], grid: Grid) -> bytes:
    """The outline of a set of pixels, as a WKB polygon or multipolygon."""
    sides: dict[tuple, list] = {}
    for r, c in pixels:
        for (dr, dc), a, b in (((-1, 0), (r, c), (r, c + 1)), ((0, 1), (r, c + 1), (r + 1, c + 1)), ((1, 0), (r + 1, c + 1), (r + 1, c)), ((0, -1), (r + 1, c), (r, c))):
            if (r + dr, c + dc) not in pixels:
                sides.setdefault(a, []).append(b)
    rings = []
    while sides:
        start = min(sides)
        ring, at, before = [start], start, None
        while True:
            ways = sides[at]
            # Where two outlines touch, turn so as to keep the pixel's own side.
            k = 0 if len(ways) == 1 or before is None else max(range(len(ways)), key=lambda i: (before[0] * (ways[i][1] - at[1]) - before[1] * (ways[i][0] - at[0])) * -1)
            to = ways.pop(k)
            if not ways:
                del sides[at]
            before, at = (to[0] - at[0], to[1] - at[1]), to
            if at == start:
                break
            ring.append(at)
        rings.append(ring)
    area = lambda ring: sum(a[1] * b[0] - b[1] * a[0] for a, b in zip(ring, ring[1:] + ring[:1], strict=True)) / 2
    outer, inner = [[x] for x in rings if area(x) > 0], [x for x in rings if area(x) < 0]
    for hole in inner:
        best = [p for p in outer if _within(hole[0], p[0])]
        (best or outer)[0].append(hole)

    def polygon(parts: list) -> bytes:
        out = struct.pack("<BII", 1, 3, len(parts))
        for ring in parts:
            corners = [p for a, p, b in zip(ring[-1:] + ring[:-1], ring, ring[1:] + ring[:1], strict=True) if (a[0] - p[0], a[1] - p[1]) != (p[0] - b[0], p[1] - b[1])]
            xy = [(grid.c + c * grid.a, grid.f + r * grid.e) for r, c in [*corners, corners[0]]]
            out += struct.pack("<I", len(xy)) + b"".join(struct.pack("<dd", *p) for p in xy)
        return out

    parts = [polygon(p) for p in outer]
    return parts[0] if len(parts) == 1 else struct.pack("<BII", 1, 6, len(parts)) + b"".join(parts)


def _within(p: tuple, ring: list) -> bool:
    r, c = p[0] + 1e-6, p[1] + 1e-6
    return sum((a[0] > r) != (b[0] > r) and a[1] + (r - a[0]) * (b[1] - a[1]) / (b[0] - a[0]) > c for a, b in zip(ring, ring[1:] + ring[:1], strict=True)) % 2 == 1


def read(wkb):
    """The polygons of a well-known binary, as lists of rings."""
    at = 0

    def take(form):
        nonlocal at
        out = struct.unpack_from("<" + form, wkb, at)
        at += struct.calcsize("<" + form)
        return out

    def polygon():
        _, kind, n = take("BII")
        assert kind == 3
        return [[take("dd") for _ in range(take("I")[0])] for _ in range(n)]

    kind = struct.unpack_from("<BI", wkb, 0)[1]
    if kind == 3:
        return [polygon()]
    _, _, n = take("BII")
    return [polygon() for _ in range(n)]


def turned(ring):
    """A closed ring from its least point, either way round being one."""
    assert ring[0] == ring[-1]
    ring = ring[:-1]
    both = [ring, ring[::-1]]
    return min(tuple(x[i:] + x[:i]) for x in both for i in range(len(x)))


def test_outlines_equal_traced_ones(spark):
    rng = np.random.default_rng(11)
    g = Grid(40, 40, 10.0, 500.0, -10.0, 900.0)
    masks = {k: {(r, c) for r in range(14) for c in range(14) if rng.random() < p} for k, p in ((1, 0.5), (2, 0.75), (3, 0.95))}
    masks[4] = {(r, c) for r in range(9) for c in range(9)} - {(r, c) for r in range(2, 7) for c in range(2, 7)} | {(4, 4)}
    masks[5] = {(0, 0)}
    pixels = [(k, r, c) for k, m in masks.items() for r, c in m]
    labels = spark.createDataFrame(pixels, "label long, row int, col int")
    traps = scratch.kept(overlay.pieces(overlay.runs(labels)), "traps")
    got = {r["label"]: bytes(r["geometry"]) for r in overlay.geometries(traps, g.c, g.a, g.f, g.e).collect()}
    for k, m in masks.items():
        want = read(trace(m, g))
        told = read(got[k])
        assert sorted(turned(r) for p in told for r in p) == sorted(turned(r) for p in want for r in p), k
        assert sorted(sorted(turned(r) for r in p) for p in told) == sorted(sorted(turned(r) for r in p) for p in want), k


def test_a_large_component_is_many_tasks(spark):
    """One component, a comb with a long outline: its sides and its rings stand in several partitions."""
    pixels = [(7, r, c) for r in range(60) for c in range(300) if r == 0 or c % 2 == 0]
    labels = spark.createDataFrame(pixels, "label long, row int, col int")
    sides = scratch.kept(overlay.boundary(scratch.kept(overlay.pieces(overlay.runs(labels)), "traps")), "sides")
    linked = scratch.kept(overlay.rings(sides), "linked")
    rows = linked.collect()
    assert {r["ring"] for r in rows} == {rows[0]["ring"]} and sorted(r["pos"] for r in rows) == list(range(len(rows)))
    by = sorted(rows, key=lambda r: r["pos"])
    assert all((a["x2"], a["y2"]) == (b["x1"], b["y1"]) for a, b in zip(by, by[1:] + by[:1]))
    assert all(r["corner"] for r in rows if r["x1"] == r["x2"])
    area, perimeter = overlay.measures(sides).select("area_m2", "perimeter_m").first()
    assert area == len(pixels) and perimeter == sum(math.dist((r["x1"], r["y1"]), (r["x2"], r["y2"])) for r in rows)
    assert overlay.rings(sides.limit(0)).count() == 0


def test_clipped_outlines(spark):
    """Rings of a clip close, and have the area and length of its boundary."""
    shape = [[[(1.3, 0.7), (10.2, 2.1), (8.8, 11.4), (0.4, 9.9)], square(4.5, 4.5, 6.25, 7)], [[(9, 9), (14, 9.5), (12, 15)]]]
    traps = clipped(spark, [p for p in frame(16) if (p[1] + p[2]) % 7], shape)
    told = {r["label"]: r for r in overlay.measures(overlay.boundary(traps)).collect()}
    for r in overlay.geometries(traps).collect():
        area = length = 0.0
        for polygon in read(bytes(r["geometry"])):
            for ring in polygon:
                assert ring[0] == ring[-1] and len(ring) > 3
                area += sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:])) / 2
                length += sum(math.dist(a, b) for a, b in zip(ring, ring[1:]))
        assert area == pytest.approx(told[r["label"]]["area_m2"], abs=1e-6) and length == pytest.approx(told[r["label"]]["perimeter_m"], abs=1e-5)
