"""Joins over all nodes against plain counts."""

import numpy as np
from conftest import SF
from pyspark.sql import functions as F

from tessera.plans import registry, relational
from tessera.plans.fixtures import Context


def test_facing_points_of_all_nodes(spark):
    nodes = Context(spark, SF).nodes.select("node", "x", "y").toPandas()
    x, y = nodes["x"].to_numpy(float), nodes["y"].to_numpy(float)
    angle = np.radians(nodes["node"].to_numpy() * 37 % 360)
    dx, dy = x[None] - x[:, None], y[None] - y[:, None]
    toward = dx * np.cos(angle)[:, None] + dy * np.sin(angle)[:, None] > 0
    met = toward & toward.T & (np.hypot(dx, dy) <= 1500)
    hidden = np.zeros_like(met)
    with np.errstate(all="ignore"):
        for x0, y0, x1, y1 in relational.WALLS:
            if x0 == x1:
                at = y[:, None] + dy * (x0 - x[:, None]) / dx
                hidden |= ((x[:, None] - x0) * (x[None] - x0) < 0) & (at >= y0) & (at <= y1)
            else:
                at = x[:, None] + dx * (y0 - y[:, None]) / dy
                hidden |= ((y[:, None] - y0) * (y[None] - y0) < 0) & (at >= x0) & (at <= x1)
    want = {int(k): (int(m.sum()), int((m & ~h).sum())) for k, m, h in zip(nodes["node"], met, hidden, strict=True) if m.any()}
    assert {r["a"]: (r["facing"], r["visible"]) for r in registry.QUERIES["j24_facing_points"](spark, SF).collect()} == want
    assert any(a != b for a, b in want.values())


def test_sweep_looks_at_an_edge_once_for_all_thresholds(spark, monkeypatch):
    from tessera.operators import components as C
    from tessera.operators import linkage as L

    rng, seen, real = np.random.default_rng(3), [], C.star_components

    def counted(edges, *rest):
        seen.append(edges.count())
        return real(edges, *rest)

    rows = [(int(i), int(rng.integers(0, i)), float(rng.integers(1, 10)) / 10) for i in range(1, 60)]  # a tree
    weights = spark.createDataFrame(rows, "i long, j long, w double")
    nodes, steps = spark.range(62).select(F.col("id").alias("node")), [0.2, 0.5, 0.3, 0.4, 0.8]
    expected = sorted(L.sweep(nodes, weights, steps).collect())
    monkeypatch.setattr(L, "maximum_spanning_forest", lambda w, small: w)
    monkeypatch.setattr(L, "star_components", counted)
    monkeypatch.setattr(C, "star_components", counted)
    found = L.sweep(nodes, weights, steps, 5)
    assert sorted(found.select("node", "component_id", "component_size", "threshold").collect()) == expected
    assert sum(seen) == sum(r[2] >= 0.2 for r in rows)


def test_forest_on_arrays_is_that_of_edges_in_order():
    """Ties, repeated edges and self loops; a large chunk is reduced at once, which edge by edge took too long."""
    from tessera.operators import components as C

    rng = np.random.default_rng(0)
    for _ in range(60):
        n = int(rng.integers(0, 60))
        i, j, w = rng.integers(0, 25, n), rng.integers(0, 25, n), rng.integers(1, 5, n) / 4
        for weights in (None, w):
            order = range(n) if weights is None else sorted(range(n), key=lambda r: (-w[r], i[r], j[r]))
            sets = C.Union()
            assert C.forest_of(i, j, weights).tolist() == [r for r in order if sets.join(int(i[r]), int(j[r]))]
