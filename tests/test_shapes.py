import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from test_layers import area, box, distance, stars, winds

from tessera.operators import shapes as S

RINGS = "id int, ring array<struct<x:double,y:double>>"


def struct_ring(ring, close=True):
    return [{"x": float(x), "y": float(y)} for x, y in (ring + ring[:1] if close else ring)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 8), st.integers(0, 8)), min_size=1, max_size=25))
def test_hull_is_convex_and_holds_all(points):
    got = S.hull(np.array(points, float))
    cross = lambda a, b, p: (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])
    assert {tuple(p) for p in got.tolist()} <= set(points)
    if len(got) > 2:
        for a, b in zip(got, np.roll(got, -1, axis=0), strict=True):
            assert all(cross(a, b, p) >= 0 for p in points) and sum(cross(a, b, p) == 0 for p in got) == 2
    else:
        a, b = got[0], got[-1]
        assert all(cross(a, b, p) == 0 for p in points)


def test_hulls_by_key(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), rng.gauss(0, 5), rng.gauss(0, 9)) for _ in range(3000)] + [("line", float(i), 2.0 * i) for i in range(50)] + [("one", 1.0, 1.0)] * 3 + [("none", None, 1.0), ("none", float("nan"), 2.0)]
    found = {r["k"]: [(p["x"], p["y"]) for p in r["ring"]] for r in S.convex_hulls(spark.createDataFrame(rows, "k string, x double, y double").repartition(7), "k").collect()}
    assert set(found) == {"a", "b", None, "line", "one"}
    for k, ring in found.items():
        want = S.hull(np.array([(x, y) for key, x, y in rows if key == k], float)).tolist()
        assert ring == [tuple(p) for p in want + want[:1]]
    assert S.convex_hulls(spark.createDataFrame([], "k int, x double, y double"), "k").collect() == []


def test_simplified_rings_stay_near(spark):
    rng = random.Random(6)
    rings = stars(rng, 20, 50, 30, 40) + [box(0, 0, 4, 4), [(0, 0), (1, 0.01), (2, 0), (2, 2), (0, 2)]]
    df = spark.createDataFrame([(i, struct_ring(r)) for i, r in enumerate(rings)] + [(90, None), (91, []), (92, struct_ring([(1, 1)]))], RINGS)
    got = {r["id"]: r["s"] for r in df.select("id", S.simplify(F.col("ring"), 2.0).alias("s")).collect()}
    for i, ring in enumerate(rings):
        kept = [(p["x"], p["y"]) for p in got[i]]
        assert kept[0] == kept[-1] == tuple(map(float, ring[0])) and set(kept) <= {tuple(map(float, p)) for p in ring}
        segments = np.array([[*a, *b] for a, b in zip(kept[:-1], kept[1:], strict=True)])
        assert max(distance(*p, segments) for p in ring) <= 2.0 + 1e-9
    assert len(got[20]) == 5 and got[90] is None and got[91] == [] and len(got[92]) == 2
    fine = df.where("id < 20").select(S.simplify(F.col("ring"), 0.0).alias("s"), "ring").collect()
    assert all(r["s"] == r["ring"] for r in fine)
    open_line = spark.createDataFrame([(1, struct_ring([(0, 0), (5, 0.1), (10, 0), (10, 9)], False))], RINGS)
    assert [tuple(p) for p in open_line.select(S.simplify(F.col("ring"), 1.0)).first()[0]] == [(0, 0), (10, 0), (10, 9)]


def test_inner_points_lengths_and_centroids(spark):
    rng = random.Random(8)
    rings = stars(rng, 40, 50, 30)
    polygons = [[r] for r in rings] + [[box(0, 0, 10, 10), box(1, 1, 9, 9)], [[(0, 0), (10, 0), (10, 10), (9, 10), (9, 1), (0, 1)]]]
    df = spark.createDataFrame([(i, [struct_ring(r) for r in p]) for i, p in enumerate(polygons)] + [(90, None), (91, []), (92, [struct_ring([(0, 0), (1, 0), (2, 0)])])], "id int, rings array<array<struct<x:double,y:double>>>")
    points = {r["id"]: r["p"] for r in df.select("id", S.inner_point(F.col("rings")).alias("p")).collect()}
    for i, p in enumerate(polygons):
        assert sum(abs(winds(points[i]["x"], points[i]["y"], [r])) for r in p) == 1, i
    assert points[90] is points[91] is points[92] is None
    flat = df.where("id < 40").select("id", F.get("rings", F.lit(0)).alias("ring")).select("id", S.length(F.col("ring")).alias("l"), S.centroid(F.col("ring")).alias("c")).collect()
    for r in flat:
        ring = rings[r["id"]]
        steps = list(zip(ring, ring[1:] + ring[:1], strict=True))
        assert r["l"] == pytest.approx(sum(math.dist(a, b) for a, b in steps))
        cx = sum((a[0] + b[0]) * (a[0] * b[1] - b[0] * a[1]) for a, b in steps) / (6 * area(ring))
        cy = sum((a[1] + b[1]) * (a[0] * b[1] - b[0] * a[1]) for a, b in steps) / (6 * area(ring))
        assert (r["c"]["x"], r["c"]["y"]) == pytest.approx((cx, cy))
    odd = spark.createDataFrame([(1, None), (2, []), (3, struct_ring([(0, 0)], False)), (4, struct_ring([(0, 0), (3, 4)], False))], RINGS)
    assert [tuple(r) for r in odd.select(S.length(F.col("ring")), S.centroid(F.col("ring"))).collect()] == [(None, None), (0.0, None), (0.0, None), (5.0, None)]
