import math
import random

import pytest

from fieldledger.operators import spatial

SCHEMA = "id string, lat double, lon double, note string"
KX = 69.0 * math.cos(math.radians(37.7))


def near(a, b, r):
    return math.hypot((a[1] - b[1]) * 69.0, (a[2] - b[2]) * KX) <= r


def pairs(df):
    return sorted((r[0], r[1]) for r in df.collect())


def points(rng, n, p, hot=0):
    out = [(f"{p}{i}", 37 + rng.random(), -77 + rng.random(), "x") for i in range(n)]
    return out + [(f"{p}h{i}", 37.5, -76.5, "x") for i in range(hot)]


@pytest.mark.parametrize("radius", [0.0, 1.5, 30.0])
def test_distance_equals_brute_force(spark, radius, monkeypatch):
    monkeypatch.setattr(spatial, "LEAF_ROWS", 4)
    monkeypatch.setattr(spatial, "SLICE_ROWS", 5)
    rng = random.Random(1)
    a, b = points(rng, 80, "a", hot=12), points(rng, 50, "b", hot=9)
    got = pairs(spatial.within_distance(spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, SCHEMA), radius, "id", "id"))
    assert got == sorted((x[0], y[0]) for x in a for y in b if near(x, y, radius))


def test_nulls_and_empty(spark):
    a = spark.createDataFrame([("a", None, -77.0, ""), (None, 37.0, -77.0, ""), ("n", float("nan"), -77.0, "")], SCHEMA)
    b = spark.createDataFrame([("b", 37.0, -77.0, "")], SCHEMA)
    assert pairs(spatial.within_distance(a, b, 5, "id", "id")) == []
    assert pairs(spatial.within_distance(b, a.limit(0), 5, "id", "id")) == []
    assert pairs(spatial.within_distance(b, b, 5, "id", "id")) == [("b", "b")]


def inside(ring, lat, lon):
    hit = False
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
        if (y1 > lat) != (y2 > lat) and lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1:
            hit = not hit
    return hit


def test_regions_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(spatial, "LEAF_ROWS", 4)
    rng = random.Random(2)
    pts = points(rng, 150, "p", hot=20)
    rings = []
    for k in range(9):
        cx, cy = -77 + rng.random(), 37 + rng.random()
        ring = [(cx + rng.uniform(0.05, 0.4) * math.cos(t * math.pi / 4), cy + rng.uniform(0.05, 0.4) * math.sin(t * math.pi / 4)) for t in range(8)]
        rings.append((f"z{k}", ring))
    zones = spark.createDataFrame([(z, [{"lon": x, "lat": y} for x, y in r]) for z, r in rings] + [("bad", None), ("short", [{"lon": 0.0, "lat": 0.0}])], "zone string, ring array<struct<lon:double,lat:double>>")
    got = pairs(spatial.within_region(spark.createDataFrame(pts, SCHEMA), zones, "id", "zone"))
    assert got == sorted((p[0], z) for p in pts for z, r in rings if inside(r, p[1], p[2]))
