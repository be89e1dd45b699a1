import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import rays as R

POINT = "struct<x:double,y:double,z:double>"


def p(v):
    return None if v is None else {k: None if c is None else float(c) for k, c in zip("xyz", v, strict=True)}


def frames(spark, segments, triangles):
    return (
        spark.createDataFrame([(i, p(a), p(b)) for i, (a, b) in enumerate(segments)], f"id int, start {POINT}, end {POINT}"),
        spark.createDataFrame([tuple(map(p, t)) for t in triangles], f"a {POINT}, b {POINT}, c {POINT}"),
    )


def hits(s, t, tri):
    """Sides of the plane, then of the three planes through the segment and the edges."""
    volume = lambda a, b, c, d: np.dot(b - a, np.cross(c - a, d - a))
    a, b, c = tri
    if volume(a, b, c, s) * volume(a, b, c, t) >= 0:
        return False
    v = [volume(s, t, a, b), volume(s, t, b, c), volume(s, t, c, a)]
    return all(x >= 0 for x in v) or all(x <= 0 for x in v)


@pytest.mark.parametrize(("seed", "cell"), [(0, 3.0), (1, 40.0), (2, 0.9)])
def test_equals_testing_all_triangles(spark, seed, cell):
    rng = np.random.default_rng(seed)
    segments = rng.uniform(-20, 20, (120, 2, 3))
    segments[:10, 1, :2] = segments[:10, 0, :2]  # upright ones
    triangles = rng.uniform(-20, 20, (60, 1, 3)) + rng.uniform(-6, 6, (60, 3, 3))
    rays, tris = frames(spark, segments.tolist(), triangles.tolist())
    got = {r["id"] for r in R.blocked(rays, tris, cell).collect()}
    want = {i for i, (s, t) in enumerate(segments) if any(hits(s, t, tri) for tri in triangles)}
    assert got == want and 0 < len(want) < 120
    assert {r["id"] for r in R.visible(rays, tris, cell).collect()} == set(range(120)) - want


def test_borders_ends_and_unknowns(spark):
    wall = [((4, -4, 0), (4, 4, 0), (4, 4, 8)), ((4, -4, 0), (4, 4, 8), (4, -4, 8))]  # on a border between cells
    segments = [
        ((0, 0, 1), (8, 0, 1)), ((0, 0, 9), (8, 0, 9)), ((0, 0, 1), (4, 0, 1)), ((4, 0, 1), (8, 0, 1)), ((4, -9, 1), (4, 9, 1)), ((8, 0, 1), (0, 0, 1)),
        ((0, 0, 1), (0, 0, 1)), (None, (0, 0, 0)), ((0, None, 0), (8, 0, 0)), ((0, float("nan"), 0), (8, 0, 0)), ((0, 0, 4), (8, 0, 4)),
    ]
    rays, tris = frames(spark, segments, [*wall, ((None, 0, 0), (1, 1, 1), (2, 2, 2))])
    assert {r["id"] for r in R.blocked(rays, tris, 4.0).collect()} == {0, 5, 10}
    assert {r["id"] for r in R.visible(rays, tris, 4.0).collect()} == {1, 2, 3, 4, 6}
    assert R.blocked(rays.limit(0), tris, 4.0).collect() == [] and R.visible(rays, tris.limit(0), 4.0).count() == 8


def test_box(spark):
    box = spark.range(1).select(F.explode(R.box_triangles(*[F.lit(float(v)) for v in (0, 0, 0, 2, 3, 5)])).alias("t")).select("t.*")
    rng = np.random.default_rng(3)
    segments = rng.uniform(-4, 8, (150, 2, 3))
    rays, _ = frames(spark, segments.tolist(), [])
    inside = lambda q: all(0 < v < m for v, m in zip(q, (2, 3, 5), strict=True))
    got = {r["id"] for r in R.blocked(rays, box, 2.5).collect()}
    for i, (s, t) in enumerate(segments):
        near, far = 0.0, 1.0
        for k, m in enumerate((2, 3, 5)):
            a, b = sorted((-s[k] / (t[k] - s[k]), (m - s[k]) / (t[k] - s[k])))
            near, far = max(near, a), min(far, b)
        assert (i in got) == (near < far and not (inside(s) and inside(t)))


def test_parts_of_a_walk_make_the_whole(spark):
    """Blocked segments stop after a part, so the parts must hold each cell of the walk."""
    row = ((0.5, 0.5, 0.5), (39.0, 17.0, 4.0))
    kind = "struct<x:double,y:double,z:double>"
    segment = spark.createDataFrame([(1, *row)], f"id int, start {kind}, end {kind}")
    cells = lambda *part: {tuple(r) for r in R._walk(segment, 1.0, *part).select("cx", "cy", "cz").collect()}
    parts = [cells(0, 2), cells(2, 16), cells(16, None)]
    assert set().union(*parts) == cells() and len(cells()) > 50 and len(parts[0]) <= 2


def test_boxes_whole_and_on_borders(spark):
    """Slabs on plain numbers; segments wholly inside a box, along its face and upright ones; boxes reach over several cells."""
    rng = np.random.default_rng(9)
    low = rng.integers(-20, 20, (50, 3)).astype(float)
    boxes = [(r[0], r[0] + w[0], r[1], r[1] + w[1], r[2], r[2] + w[2]) for r, w in zip(low.tolist(), rng.integers(2, 11, (50, 3)).astype(float).tolist(), strict=True)]
    segments = [*(rng.uniform(-28, 28, (150, 2, 3))).tolist(), *rng.integers(-28, 28, (150, 2, 3)).astype(float).tolist()]
    middle = [(a + b) / 2 for a, b in zip(boxes[0][::2], boxes[0][1::2], strict=True)]
    segments += [(middle, [v + 0.25 for v in middle]), (middle, middle), ([-90.0, 0.0, 0.0], [90.0, 0.0, 0.0])]
    segments += [([boxes[1][0], -90.0, 0.5], [boxes[1][0], 90.0, 0.5]), ([1.0, 2.0, -50.0], [1.0, 2.0, 50.0])]

    def through(s, t, box):
        near, far = 0.0, 1.0
        for k in range(3):
            if t[k] != s[k]:
                a, b = sorted((v - s[k]) / (t[k] - s[k]) for v in box[2 * k : 2 * k + 2])
                near, far = max(near, a), min(far, b)
            elif not box[2 * k] < s[k] < box[2 * k + 1]:
                return False
        return near < far

    want = {i for i, (s, t) in enumerate(segments) if not any(through(s, t, b) for b in boxes)}
    assert 20 < len(want) < len(segments) - 20 and not {300, 301} & want
    rays, _ = frames(spark, [*segments, ((0, None, 0), (8, 0, 0))], [])
    walls = spark.createDataFrame([*boxes, (None, *boxes[0][1:])], ", ".join(f"{k}{e} double" for k in "xyz" for e in (0, 1)))
    for cell in (3.0, 7.5):
        assert {r["id"] for r in R.past_boxes(rays, walls, cell).collect()} == want
