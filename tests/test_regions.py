import random

import pytest

from wayfold.operators.near import near_lines, near_points
from wayfold.operators.regions import containing_regions, double_area, triangulate
from wayfold.functions.geo import RADIUS
import math


def test_triangulate_area_and_holes():
    outer = [(0, 0), (100, 0), (100, 100), (50, 40), (0, 100), (0, 0)]
    holes = [[(10, 10), (20, 10), (20, 20), (10, 20)], [(60, 10), (60, 20), (70, 20), (70, 10), (60, 10)]]
    for o in (outer, outer[::-1]):
        t = triangulate(o, holes)
        assert sum(double_area(list(x)) for x in t) == abs(double_area(outer[:-1])) - 2 * 100 - 2 * 100
    assert triangulate([]) == [] and triangulate([(1, 1), (2, 2)]) == [] and triangulate([(0, 0), (1, 1), (2, 2), None]) == []


def star(rnd, cx, cy, n, r):
    angles = sorted(rnd.random() * 2 * math.pi for _ in range(n))
    radii = [r * (0.3 + rnd.random() * 0.7) for _ in angles]
    return [(int(cx + q * math.cos(a)), int(cy + q * math.sin(a))) for a, q in zip(angles, radii)]


def even_odd(ring, x, y):
    c = False
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
        if (y1 > y) != (y2 > y) and (x - x1) * (y2 - y1) * (1 if y2 > y1 else -1) < (y - y1) * (x2 - x1) * (1 if y2 > y1 else -1):
            c = not c
    return c


@pytest.mark.parametrize("local,sample", [(10**6, 10**6), (0, 10**6), (0, 50)])
def test_regions_against_even_odd(spark, local, sample):
    rnd = random.Random(3)
    ps = lambda ring: [{"lat_e7": y, "lng_e7": x} for x, y in ring]
    areas, rings = [], {}
    for i in range(60):
        cx, cy = rnd.randint(-10**9, 10**9), rnd.randint(-5 * 10**8, 5 * 10**8)
        outer = star(rnd, cx, cy, rnd.randint(5, 30), 4 * 10**8)
        inner = [(cx - 1000, cy - 999), (cx + 1001, cy - 998), (cx + 997, cy + 1003)]
        has_hole = all(even_odd(outer, *p) for p in inner)
        rings[i] = (outer, [inner] if has_hole else [])
        areas.append((i, [{"outer": ps(outer), "inners": [ps(inner)] if has_hole else None}], "x"))
    areas += [areas[0], (99, None, "x"), (98, [], "x"), (97, [None], "x"), (None, [], "x")]
    schema = "id long, polygons array<struct<outer:array<struct<lat_e7:int,lng_e7:int>>,inners:array<array<struct<lat_e7:int,lng_e7:int>>>>>, leaf string"
    points = [(k, rnd.randint(-6 * 10**8, 6 * 10**8), rnd.randint(-12 * 10**8, 12 * 10**8)) for k in range(800)]
    for i, (o, _) in rings.items():
        cx, cy = sum(p[0] for p in o) // len(o), sum(p[1] for p in o) // len(o)
        points.append((1000 + i, cy, cx))
    rows = [(k, lat, lng, 1.0) for k, lat, lng in points] + [(5000, None, 1, 1.0), (None, 1, 1, 1.0), (0, *points[0][1:], 1.0)]
    df = spark.createDataFrame(rows, "hid long, lat_e7 int, lng_e7 int, x double")
    got = {tuple(r) for r in containing_regions(df, "hid", spark.createDataFrame(areas, schema), "id", local=local, sample=sample, leaf=4).collect()}
    want = {(k, i) for k, lat, lng in points for i, (o, h) in rings.items() if even_odd(o, lng, lat) and not any(even_odd(r, lng, lat) for r in h)}
    # a star may touch itself after rounding; then its area is not the ring's and even-odd is no reference
    bad = {i for i, (o, h) in rings.items() if sum(double_area(list(t)) for t in triangulate(o, h)) != abs(double_area(o)) - sum(abs(double_area(r)) for r in h)}
    assert len(bad) < 15
    assert {p for p in got if p[1] not in bad} == {p for p in want if p[1] not in bad}
    assert containing_regions(df.limit(0), "hid", spark.createDataFrame(areas, schema), "id", local=local).count() == 0


def dist(a, b):
    la, lb = math.radians(a[0] / 1e7), math.radians(b[0] / 1e7)
    h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin(math.radians((b[1] - a[1]) / 1e7) / 2) ** 2
    return 2 * RADIUS * math.asin(min(1, math.sqrt(h)))


def test_near_points(spark):
    rnd = random.Random(4)
    rows = [(i, 500000000 + rnd.randint(-9000, 9000), 80000000 + rnd.randint(-9000, 9000)) for i in range(300)]
    rows += [(1000, 899999999, 0), (1001, 899999999, 1800000000), (1002, 100, 1799999990), (1003, 100, -1799999990), (1004, -900000000, 5), (1005, -900000000, 1700000000)]
    df = spark.createDataFrame([(*r, 1) for r in rows + rows[:5]] + [(2000, None, 5, 1), (None, 5, 5, 1)], "hid long, lat_e7 int, lng_e7 int, k int")
    got = {tuple(r) for r in near_points(df, "hid", 30.0).collect()}
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and dist(a[1:], b[1:]) < 30}
    assert got == want and {(1000, 1001), (1002, 1003), (1004, 1005)} <= got


def test_near_lines(spark):
    lines = [(1, [(500000000, 80000000), (500000000, 80100000)]), (2, [(500000000, 1799999000), (500000000, -1799999000)]), (3, [(500010000, 80050000)]), (4, []), (5, None)]
    df = spark.createDataFrame([(i, None if p is None else [{"lat_e7": a, "lng_e7": b} for a, b in p], 0) for i, p in lines + lines[:1]], "sid long, line array<struct<lat_e7:int,lng_e7:int>>, k int")
    pts = spark.createDataFrame([(10, 500001700, 80050000), (11, 500001900, 80050000), (12, 500000000, 80102700), (13, 500000000, 80103000), (14, 500000100, -1799999999), (15, 500010000, 80050000)], "hid long, lat_e7 int, lng_e7 int")
    assert {tuple(r) for r in near_lines(pts, "hid", df, "sid", 20.0).collect()} == {(10, 1), (12, 1), (14, 2), (15, 3)}


def test_reverse_at_poles_and_across_180(spark):
    from wayfold.operators.reverse import nearest_lines, nearest_points

    pts = spark.createDataFrame([(1, 90.0, 0.0), (2, 89.99999, 10.0), (3, 0.0, 180.0), (4, 10.0, -179.999), (5, None, 1.0)], "point_id long, lat double, lng double")
    things = spark.createDataFrame([(10, 89.9999, -120.0), (11, 0.0, -179.999), (12, 10.0, 179.9995), (13, 45.0, 0.0)], "entity_id long, lat double, lng double")
    assert {(r.point_id, r.entity_id) for r in nearest_points(pts, things).collect()} == {(1, 10), (2, 10), (3, 11), (4, 12)}
    line = lambda *p: [{"lat_e7": int(a * 1e7), "lng_e7": int(b * 1e7)} for a, b in p]
    lines = spark.createDataFrame([(20, line((89.9999, 0.0), (89.9999, 90.0))), (21, line((0.0, 179.999), (0.0, -179.998)))], "entity_id long, line array<struct<lat_e7:int,lng_e7:int>>")
    got = {(r.point_id, r.entity_id): r for r in nearest_lines(pts, lines).collect()}
    assert set(got) == {(1, 20), (2, 20), (3, 21)} and got[3, 21].score < 1e-2 and abs(abs(got[3, 21].lng) - 180) < 1e-6


def test_large_and_crossing_rings():
    rnd = random.Random(5)
    ring = [(int(4e8 * (1 + 0.1 * rnd.random()) * math.cos(2 * math.pi * i / 20000)), int(4e8 * (1 + 0.1 * rnd.random()) * math.sin(2 * math.pi * i / 20000))) for i in range(20000)]
    ring = [(int(math.hypot(*p) * math.cos(2 * math.pi * i / 20000)), int(math.hypot(*p) * math.sin(2 * math.pi * i / 20000))) for i, p in enumerate(ring)]
    assert sum(double_area(list(t)) for t in triangulate(ring)) == abs(double_area(ring))
    assert 0 < len(triangulate([(rnd.randint(-(10**8), 10**8), rnd.randint(-(10**8), 10**8)) for _ in range(1000)])) < 1000
