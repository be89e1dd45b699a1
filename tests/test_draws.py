"""The registered resampling queries take the reference's numbers of draws and cutoffs."""

import numpy as np
import pandas as pd
import pytest
from conftest import SF

from tessera.functions import models as M
from tessera.plans import registry, statistics
from tessera.plans import statistics as T
from tessera.plans.fixtures import Context


def test_counts(spark):
    assert (statistics.DRAWS, statistics.PAIR_DRAWS, statistics.MARGIN_DRAWS, statistics.CLASS_DRAWS, statistics.SHUFFLES) == (200, 2000, 2000, 9999, 499)
    share = registry.QUERIES["m15_predictive_margins"](spark, SF).first()["share_positive"]
    assert abs(share * 2000 - round(share * 2000)) < 1e-6
    for row in registry.QUERIES["m33_class_shuffle"](spark, "/root/testdata/sf0.01").collect():
        assert row["p"] * 10_000 >= 1 - 1e-6 and abs(row["p"] * 10_000 - round(row["p"] * 10_000)) < 1e-6


def test_shared_fate_has_all_cutoffs(spark):
    rows = registry.QUERIES["m35_shared_fate"](spark, SF).collect()
    assert len({r["cutoff"] for r in rows}) == len(rows) == 35
    assert all(r["null_lo"] <= r["null_mid"] <= r["null_hi"] for r in rows if r["null_lo"] is not None)


def test_curves_and_intervals_mean_something(spark):
    """The fixture's outcome rises with dose, so fits cross one half and resampled ends hold the estimate."""
    sf = "/root/testdata/sf0.01"
    row = registry.QUERIES["m04_threshold_table"](spark, sf).first()
    assert row["p_min"] < 0.2 and row["p_max"] > 0.8 and 0.5 < row["threshold"] < 1.5
    for r in registry.QUERIES["m05_block_bootstrap"](spark, sf).collect():
        assert r["converged"] >= 160 and r["lo"] < r["estimate"] < r["hi"]
    for r in registry.QUERIES["m08_distance_equivalence"](spark, sf).collect():
        assert r["lo"] <= r["distance"] <= r["hi"]
    at = {r["definition"]: r["threshold"] for r in registry.QUERIES["m37_mean_threshold"](spark, sf).collect()}
    assert at["mean"] == (at["direct"] + at["mapped"]) / 2 and abs(at["direct"] - at["mapped"]) < 0.3
    again = registry.QUERIES["m36_rescaled_curve"](spark, sf).first()
    assert abs(again["reached"] - again["target"]) < 1e-9
    assert all(1e-3 < r["exposure"] < 1.9 for r in registry.QUERIES["m06_partial_peak"](spark, sf).collect())


def test_neighbors_hold_the_matches(spark):
    sf = "/root/testdata/sf0.01"
    tried = {(r["treated"], r["control"]) for r in registry.QUERIES["j16_propensity_neighbors"](spark, sf).collect()}
    assert {(r["treated"], r["control"]) for r in registry.QUERIES["m22_caliper_match"](spark, sf).collect()} <= tried


def test_spearman_ranks_complete_rows(spark):
    import pandas as pd

    from tessera.operators.summaries import spearman

    rows = [(float(i * 7 % 23), None if i % 5 == 2 else float(i * i % 11)) for i in range(60)] + [(None, 1.0)] * 9
    want = pd.DataFrame(rows, columns=["a", "b"]).dropna().corr("spearman").iloc[0, 1]
    assert abs(spearman(spark.createDataFrame(rows, "a double, b double"), "a", "b").first()[0] - want) < 1e-12


def test_fates_dealt_by_parts_are_those_of_shuffled_rows():
    """Mean and spread of the entropy over two parts, dealt apart, beside shuffles of all rows."""
    rng = np.random.default_rng(0)
    component, group = np.arange(80) ** 2 % 79 % 12, rng.integers(0, 2, 80)
    component[:10] = np.arange(100, 110)  # nodes by themselves
    hits = [int((group == g).sum()) // 3 for g in (0, 1)]
    labels = M.shared_groups(component)
    shuffled = []
    for _ in range(4000):
        y = np.zeros(80)
        for g in (0, 1):
            y[rng.permutation(np.flatnonzero(group == g))[: hits[g]]] = 1
        shuffled.append(M.entropy_of_groups(labels, y))
    members = np.array([[(group[component == k] == g).sum() for g in (0, 1)] for k in range(12)])
    parts = [members[:5], members[5:]]
    sizes = np.array([p.sum(axis=0) for p in parts] + [[(group[:10] == g).sum() for g in (0, 1)]])
    sums = sum(T.deal_fates(pd.DataFrame(p), sizes, k, hits, 4000, [0, 1]) for k, p in enumerate(parts))
    dealt = sums / members.sum()
    assert dealt.mean() == pytest.approx(np.mean(shuffled), abs=4e-3)
    assert np.quantile(dealt, [0.025, 0.975]) == pytest.approx(np.quantile(shuffled, [0.025, 0.975]), abs=0.015)


def test_isolation_compares_no_pairs_of_treated_nodes(spark, monkeypatch):
    c = Context(spark, "/root/testdata/sf0.01")
    a, pairs = T._rematched(c)
    treated = np.flatnonzero(a["defended"] == 1)
    near = np.array([np.sort(np.hypot(a["x"][treated] - a["x"][t], a["y"][treated] - a["y"][t]))[1] for t, _ in pairs])
    d, _, whole = T._pair_differences(a, pairs)
    lone = near[whole] > np.median(near[whole])

    real = np.hypot

    def forbidden(*sides):
        assert not any(map(np.ndim, sides)), "distances of all treated nodes on the driver"
        return real(*sides)

    monkeypatch.setattr(np, "hypot", forbidden)
    row = T._isolation(c, 50).first()
    assert row["isolated_pairs"] == lone.sum() and row["isolated"] == pytest.approx((d[lone, 1] - d[lone, 2]).mean())
