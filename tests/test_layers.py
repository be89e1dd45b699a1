import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import arrangement as A
from tessera.operators import layers as L

RING = "ring array<struct<x:double,y:double>>, hole boolean"


def winds(x, y, rings):
    """Winding number of a point, ring by ring, by a ray to the right."""
    n = 0
    for ring in rings:
        for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1], strict=True):
            if (ay <= y) != (by <= y) and x < ax + (y - ay) / (by - ay) * (bx - ax):
                n += 1 if by > ay else -1
    return n


def area(ring):
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1], strict=True)) / 2


def turned(ring, hole=False):
    return ring if (area(ring) > 0) != hole else ring[::-1]


def distance(x, y, segments):
    p, q = segments[:, :2], segments[:, 2:]
    d = q - p
    t = np.clip(((x - p[:, 0]) * d[:, 0] + (y - p[:, 1]) * d[:, 1]) / np.maximum((d**2).sum(axis=1), 1e-300), 0, 1)
    return float(np.hypot(x - p[:, 0] - t * d[:, 0], y - p[:, 1] - t * d[:, 1]).min())


def frame(spark, rings):
    """Rings as rows, every other one closed and every third turned around."""
    rows = []
    for n, (ring, hole) in enumerate(rings):
        ring = [{"x": float(x), "y": float(y)} for x, y in (ring[::-1] if n % 3 == 0 else ring)]
        rows.append((ring + ring[:1] if n % 2 else ring, hole))
    return L.ring_segments(spark.createDataFrame(rows, RING), hole="hole")


def stars(rng, n, spread, size, corners=9):
    """Simple rings: corners by angle around a place."""
    out = []
    for _ in range(n):
        cx, cy = rng.uniform(0, spread), rng.uniform(0, spread)
        out.append([(cx + (r := rng.uniform(size / 3, size)) * np.cos(a), cy + r * np.sin(a)) for a in np.sort([rng.uniform(0, 2 * np.pi) for _ in range(corners)])])
    return [turned([tuple(map(float, p)) for p in ring]) for ring in out]


def edge_array(layer):
    return np.array([tuple(r) for r in layer.edges().collect()], float).reshape(-1, 4)


def agree(spark, layer, points, wanted, slack):
    """``holds`` says what is wanted for all points that aren't on the border."""
    edges = edge_array(layer)
    got = {r["id"]: r["inside"] for r in layer.holds(spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(points)], "id int, x double, y double")).collect()}
    assert len(got) == len(points)
    wrong = [i for i, p in enumerate(points) if got[i] != wanted[i] and (not len(edges) or distance(*p, edges) > slack)]
    assert not wrong
    rings = [([(q["x"], q["y"]) for q in r["ring"][:-1]], r["area"]) for r in layer.rings().collect()]
    assert not [i for i, p in enumerate(points) if (winds(*p, [r for r, _ in rings]) > 0) != wanted[i] and (not len(edges) or distance(*p, edges) > slack)]
    total, length = layer.measure().first()
    assert abs(sum(a for _, a in rings) - total) <= slack * (length + 1)
    return total


@pytest.mark.parametrize(("seed", "cell", "rule"), [(0, 7.3, "union"), (1, 40.0, "difference"), (2, 1000.0, "intersection"), (3, 15.0, "symmetric")])
def test_random_layers(spark, seed, cell, rule):
    rng = random.Random(seed)
    a, b = stars(rng, 25, 100, 18), stars(rng, 12, 100, 25)
    layer = L.overlay(frame(spark, [(r, False) for r in a]), frame(spark, [(r, False) for r in b]), rule, cell)
    points = [(rng.uniform(-30, 130), rng.uniform(-30, 130)) for _ in range(300)]
    wa, wb = (np.array([winds(*p, rings) > 0 for p in points]) for rings in (a, b))
    wanted = {"union": wa | wb, "intersection": wa & wb, "difference": wa & ~wb, "symmetric": wa != wb}[rule]
    agree(spark, layer, points, wanted.tolist(), 0.01)


def box(x0, y0, x1, y1):
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]


@pytest.mark.parametrize("cell", [3.0, 10.0])
def test_touching_nested_and_repeated_rings(spark, cell):
    grid = [box(10 * i, 10 * j, 10 * i + 10, 10 * j + 10) for i in range(4) for j in range(3)]  # shared borders go
    rings = [(r, False) for r in grid + grid[:5]] + [(box(60, 0, 90, 30), False), (box(70, 10, 80, 20), True), (box(73, 13, 77, 17), False)] + [(box(90, 30, 95, 35), False), (box(100, 0, 100, 30), False)]
    layer = L.overlay(frame(spark, rings), None, "union", cell)
    found = layer.measure().first()
    assert found["area"] == pytest.approx(1200 + 900 - 100 + 16 + 25, abs=1e-6) and found["length"] == pytest.approx(140 + 120 + 40 + 16 + 20, abs=1e-6)
    areas = sorted(r["area"] for r in layer.rings().collect())
    assert areas == pytest.approx([-100, 16, 25, 900, 1200])  # the corner that two boxes share joins none
    rng = random.Random(4)
    points = [(rng.uniform(-5, 110), rng.uniform(-5, 40)) for _ in range(300)]
    inside = [winds(x, y, [turned(r, h) for r, h in rings if len({p[0] for p in r}) > 1]) > 0 for x, y in points]
    agree(spark, layer, points, inside, 0.002)


def test_a_ring_that_touches_itself(spark):
    bow = [(0, 0), (10, 0), (5, 5), (10, 10), (0, 10), (5, 5)]
    layer = L.overlay(frame(spark, [(bow, False)]), frame(spark, [(box(2, -5, 8, 2), False)]), "difference", 4.0)
    assert layer.measure().first()["area"] == pytest.approx(50 - 12, abs=0.01)  # slanted edges of 50 units of length, rounded to a thousandth


def test_near_degenerate_crossings(spark):
    """Thin triangles through one point, on a coarse grid: nothing is left open."""
    rng = random.Random(9)
    rings = [turned([(50 + 0.01 * rng.random(), 50), (50 + 40 * np.cos(a), 50 + 40 * np.sin(a)), (50 + 40 * np.cos(a + 0.05), 50 + 40 * np.sin(a + 0.05))]) for a in np.linspace(0, 6.2, 60)]
    layer = L.overlay(frame(spark, [(r, False) for r in rings]), None, "union", 13.0, 0.01)
    edges = edge_array(layer)
    starts, ends = np.unique(np.round(edges[:, :2] * 200), axis=0, return_counts=True), np.unique(np.round(edges[:, 2:] * 200), axis=0, return_counts=True)
    assert (starts[0] == ends[0]).all() and (starts[1] == ends[1]).all()
    points = [(rng.uniform(5, 95), rng.uniform(5, 95)) for _ in range(300)]
    agree(spark, layer, points, [winds(*p, rings) > 0 for p in points], 0.1)


def test_buffer_is_all_within_reach(spark):
    reach, cell = 6.0, 17.0
    rng = random.Random(5)
    rings = stars(rng, 8, 80, 12) + [turned(box(90, 0, 110, 20)), turned(box(95, 5, 105, 15), True)]
    layer = L.overlay(frame(spark, [(r, area(r) < 0) for r in rings]), None, "union", cell)
    wide, narrow = L.dilate(layer, reach), L.erode(layer, reach)
    border = edge_array(layer)
    points = [(rng.uniform(-15, 125), rng.uniform(-15, 100)) for _ in range(400)]
    held = [winds(*p, rings) > 0 for p in points]
    far = [distance(*p, border) for p in points]
    slack = L.shortfall(reach) + 0.01
    agree(spark, wide, points, [h or d <= reach for h, d in zip(held, far, strict=True)], slack)
    agree(spark, narrow, points, [h and d > reach for h, d in zip(held, far, strict=True)], slack)


def test_opening_drops_what_is_narrow(spark):
    layer = L.overlay(frame(spark, [(box(0, 0, 40, 40), False), (box(40, 18, 80, 22), False), (box(80, 0, 120, 40), False)]), None, "union", 25.0)
    opened = L.opening(layer, 5.0, 32)
    rings = opened.rings().collect()
    round_corner = (4 - np.pi) * 25 / 4
    assert len(rings) == 2 and opened.measure().first()["area"] == pytest.approx(2 * (1600 - 4 * round_corner), rel=2e-3)


def test_whole_tiles_inside_and_empty_layers(spark):
    layer = L.overlay(frame(spark, [(box(0, 0, 100, 100), False), (box(40, 40, 60, 60), True)]), None, "union", 5.0)
    rng = random.Random(1)
    points = [(rng.uniform(-20, 120), rng.uniform(-20, 120)) for _ in range(200)] + [(50.0, 50.0), (30.0, 30.2), (-7.0, 50.0)]
    agree(spark, layer, points, [0 < x < 100 and 0 < y < 100 and not (40 < x < 60 and 40 < y < 60) for x, y in points], 0.01)
    nulls = spark.createDataFrame([(1, None, 5.0), (2, 5.0, None), (None, 5.0, 5.0)], "id int, x double, y double")
    assert sorted(str(tuple(r)) for r in layer.holds(nulls).collect()) == ["(1, False)", "(2, False)", "(None, True)"]
    none = L.ring_segments(spark.createDataFrame([(None, None), ([], False), ([{"x": 1.0, "y": 1.0}] * 4, True), ([{"x": 0.0, "y": 0.0}, None, {"x": 1.0, "y": 1.0}], None)], RING), hole="hole")
    empty = L.overlay(none, layer.edges().limit(0))
    assert empty.rings().collect() == [] and tuple(empty.measure().first()) == (0.0, 0.0)
    assert not any(r["inside"] for r in empty.holds(nulls).collect()) and L.dilate(empty, 3.0).measure().first()["area"] == 0
    gone = L.overlay(layer.edges(), layer.edges(), "difference", 5.0)
    assert tuple(gone.measure().first()) == (0.0, 0.0)
    with pytest.raises(ValueError):
        L.overlay(none, cell=1e9)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(*[st.integers(0, 9)] * 4), min_size=1, max_size=14))
def test_arranged_segments_meet_in_ends_alone(rows):
    s = np.array(rows, np.int64) * 2 + 1
    got, w = A.arranged(s, np.ones((len(s), 1), np.int64))
    assert not len(A._cuts(got)[0]) and (w != 0).any(axis=1).all()
    flow = {}
    for seg, k in [*zip(s.tolist(), [1] * len(s), strict=True), *((g, -v) for g, v in zip(got.tolist(), w[:, 0].tolist(), strict=True))]:
        flow[tuple(seg[:2])] = flow.get(tuple(seg[:2]), 0) + k
        flow[tuple(seg[2:])] = flow.get(tuple(seg[2:]), 0) - k
    assert not any(flow.values())  # chains still lead from where they began to where they ended


def test_ring_area(spark):
    df = spark.createDataFrame([([{"x": 1e7, "y": 1e7}, {"x": 1e7 + 2, "y": 1e7}, {"x": 1e7 + 2, "y": 1e7 + 1}, {"x": 1e7, "y": 1e7}],)], "ring array<struct<x:double,y:double>>")
    assert df.select(L.ring_area(F.col("ring"))).first()[0] == 1.0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.tuples(st.integers(0, 9), st.integers(0, 9)), min_size=3, max_size=6), min_size=1, max_size=6))
def test_sides_handed_on_are_those_walked_to(rings):
    s = np.array([[*a, *b] for r in rings for a, b in zip(r, r[1:] + r[:1], strict=True)], np.int64) * 2 + 1
    got, w = A.arranged(s, np.ones((len(s), 1), np.int64))
    if len(got):
        right, left = A.sides(got, w, np.zeros(1, np.int64))
        assert (right == A._walked(got, w, np.zeros(1, np.int64), np.arange(len(got)))).all() and (left == right + w).all()


@pytest.mark.parametrize("size", [60, 200, 2000])
def test_crowded_grids_come_to_an_end(size):
    """Many rings on few grid points: snapping ends, nothing crosses, and both ways to the sides agree."""
    rng = np.random.default_rng(size)
    for _ in range(5):
        rings = []
        for _ in range(60):
            n, c, r = int(rng.integers(3, 20)), rng.uniform(0.2, 0.8, 2) * size, rng.uniform(0.02, 0.2) * size
            a = np.sort(rng.uniform(0, 2 * np.pi, n))
            p = 2 * (np.clip(np.stack([c[0] + r * np.cos(a), c[1] + r * np.sin(a)], axis=1), 1, size - 1) // 2).astype(np.int64) + 1
            rings.append(np.concatenate([p, np.roll(p, -1, axis=0)], axis=1))
        s = np.concatenate(rings)
        got, w = A.arranged(s, np.ones((len(s), 1), np.int64))
        assert not len(A._cuts(got)[0])
        assert (A.sides(got, w, np.zeros(1, np.int64))[0] == A._walked(got, w, np.zeros(1, np.int64), np.arange(len(got)))).all()


def squares_in_a_tile(n, half, size, seed, slant):
    """Directed sides of squares that lie within a tile, on odd coordinates."""
    rng = np.random.default_rng(seed)
    middle = rng.integers(int(1.5 * half) // 2, (size - int(1.5 * half)) // 2, (n, 2)) * 2 + 1
    angle = rng.uniform(0, np.pi / 2, n) * slant + np.pi / 4
    corners = [middle + 2 * np.round(half / np.sqrt(2) * np.stack([np.cos(angle + k * np.pi / 2), np.sin(angle + k * np.pi / 2)], axis=1)).astype(np.int64) for k in range(4)]
    return np.concatenate([np.concatenate([corners[k], corners[(k + 1) % 4]], axis=1) for k in range(4)])


def shoelace(s):
    return float((s[:, 0].astype(float) * s[:, 3] - s[:, 2].astype(float) * s[:, 1]).sum() / 2)


@pytest.mark.parametrize("slant", [False, True])
@pytest.mark.parametrize("rule", list(L.RULES))
def test_divided_tile_equals_the_whole_one(rule, slant):
    size = 2 * 800_000
    a, b = squares_in_a_tile(150, 80_000, size, 1, slant), squares_in_a_tile(60, 120_000, size, 2, slant)
    s, w = np.concatenate([a, b]), np.repeat(np.eye(2, dtype=np.int64), [len(a), len(b)], axis=0)
    corner = np.zeros(2, np.int64)
    whole, parts = A.boundary(s, w, corner, L.RULES[rule]), A.divided(s, w, corner, size, L.RULES[rule])
    length = np.hypot(*(whole[:, 2:] - whole[:, :2]).T).sum()
    assert abs(shoelace(parts) - shoelace(whole)) <= slant * length  # cuts at slanted lines are rounded, others are exact
    paths = [A.straightened(p) for p in A.chains(parts, size)]
    assert all((p[0] == p[-1]).all() for p in paths)
    if not slant:
        assert len(paths) == len(A.chains(whole, size))


def test_squares_lying_thickly_are_not_compared_in_pairs(monkeypatch):
    size, met, near = 2 * 800_000, [0], A.near_pairs

    def counted(segments):
        for i, j in near(segments):
            met[0] += len(i)
            yield i, j

    monkeypatch.setattr(A, "near_pairs", counted)
    compared = []
    for n in (1500, 6000):
        s, met[0] = squares_in_a_tile(n, 80_000, size, 3, False), 0
        w = np.repeat(np.array([[1, 0]]), len(s), axis=0)
        A.divided(s, w, np.zeros(2, np.int64), size, L.RULES["union"])
        compared.append(met[0] / n)
    assert max(compared) < 500 and compared[1] < 2 * compared[0]  # all pairs: more than 2,000 and 8,000 a square
