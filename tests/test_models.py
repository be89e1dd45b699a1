"""Curves, models and nulls against closed forms."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.functions import curves as C
from tessera.functions import models as M


def test_curve_recovers_its_own_data():
    true = C.Curve(0.05, 0.9, 0.3, 2.0, 1.0)
    x = np.geomspace(0.01, 10, 300)
    fit = C.fit_curve(x, true.at(x))
    assert np.abs(fit.at(x) - true.at(x)).max() < 1e-3
    assert fit.exposure_at(0.5) == pytest.approx(true.exposure_at(0.5), rel=1e-2)


@settings(max_examples=60, deadline=None)
@given(st.floats(0.01, 0.3), st.floats(0.5, 0.99), st.floats(0.01, 5), st.floats(0.5, 6), st.floats(0.3, 4), st.floats(0.05, 0.95))
def test_inverse_undoes_the_curve(a, b, k, h, s, u):
    curve = C.Curve(a, b, k, h, s)
    p = a + u * (b - a)
    assert float(curve.at(curve.exposure_at(p))) == pytest.approx(p, rel=1e-6)


def test_inverse_outside_the_asymptotes():
    with pytest.raises(ValueError):
        C.Curve(0.1, 0.8, 1, 1, 1).exposure_at(0.9)


def test_scaling_reaches_the_target():
    assert C.Curve(0.1, 0.9, 1, 2, 1).scaled_to(0.5, 3.0).exposure_at(0.5) == pytest.approx(3.0)


def test_lowess_keeps_a_line_and_pchip_its_points():
    x = np.arange(20.0)
    assert np.allclose(C.lowess(x, 2 * x + 1, 0.5)[1], 2 * x + 1)
    y = np.array([0.0, 1.0, 1.5, 4.0])
    assert np.allclose(C.pchip(np.arange(4.0), y, np.arange(4.0)), y)
    assert np.all(np.diff(C.pchip(np.arange(4.0), y, np.linspace(0, 3, 50))) >= -1e-12)


def test_binned_inverse_uses_the_falling_part():
    assert C.inverse_of_bins([1, 2, 3, 4], [1.0, 4.0, 3.0, 1.0], [3.0])[0] == pytest.approx(3.0)


def test_logit_of_a_two_by_two_table():
    x = np.array([0] * 10 + [1] * 10)
    y = np.array([1] * 2 + [0] * 8 + [1] * 6 + [0] * 4)
    fit = M.logit(np.c_[np.ones(20), x], y, ["const", "x"])
    assert fit.beta[1] == pytest.approx(math.log(6 / 4) - math.log(2 / 8), rel=1e-6)
    assert fit.se[1] == pytest.approx(math.sqrt(1 / 2 + 1 / 8 + 1 / 6 + 1 / 4), rel=1e-5)


def test_singleton_clusters_equal_hc1_for_ols():
    rng = np.random.default_rng(0)
    x = np.c_[np.ones(50), rng.normal(size=50)]
    y = x @ [1, 2] + rng.normal(size=50)
    a, b = M.ols(x, y, ["c", "x"], np.arange(50)), M.ols(x, y, ["c", "x"], robust=True)
    assert np.allclose(a.se, b.se, rtol=1e-2)


def test_tails():
    assert M.chi2_tail(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-9)
    assert M.chi2_tail(5.991464547107979, 2) == pytest.approx(0.05, abs=1e-9)
    assert M.chi2_tail(7.814727903251179, 3) == pytest.approx(0.05, abs=1e-9)
    assert M.normal_two_sided(1.959963984540054) == pytest.approx(0.05)


def test_mediation_adds_up():
    rng = np.random.default_rng(1)
    z = rng.normal(size=400)
    m = 0.7 * z + rng.normal(size=400)
    y = (rng.random(400) < 1 / (1 + np.exp(-(0.5 * z + m)))).astype(float)
    out = M.mediation(np.c_[np.ones(400), z], ["const", "z"], y, "z", m)
    assert out["total"] == pytest.approx(out["direct"] + out["indirect"], abs=1e-6)
    assert out["loglik_total"] == pytest.approx(out["loglik_direct"])


def test_matching_is_one_to_one_within_the_caliper():
    score = np.array([0.0, 0.1, 0.12, 5.0, 0.0])
    treated, group = np.array([1, 1, 0, 0, 0]), np.array(["a", "a", "a", "a", "b"])
    assert M.greedy_caliper_match(score, treated, group, 0.5) == [(0, 2)]


def test_nearest_scores_are_those_of_a_stable_sort():
    """Without a look at all values for each row asked for."""
    rng = np.random.default_rng(3)
    for values, asked in (
        (rng.integers(0, 9, 400).astype(float), rng.integers(-3, 12, 60) / 2),
        (rng.normal(size=500), rng.normal(size=60)),
        (np.r_[1e-17 * rng.integers(0, 50, 200), 3.0], np.array([1.0, 2.0, -5.0, 0.0])),
        (np.array([1.0, 0.0]), np.array([0.5])),
    ):
        for s, (near, gap) in zip(asked, M.nearest_scores(values, asked, 30), strict=True):
            d = np.abs(values - s)
            want = np.argsort(d, kind="stable")[:30]
            assert near.tolist() == want.tolist() and gap.tolist() == d[want].tolist()
    looked = 0

    class Counted(np.ndarray):
        def __sub__(self, other):
            nonlocal looked
            looked += self.size
            return np.asarray(self) - other

    score = rng.normal(size=4000).view(Counted)
    M.greedy_caliper_match(score, np.arange(4000) % 4 // 3, np.array(["A"] * 4000), 0.2)
    assert looked < 4000 * 30


def test_shuffle_null_keeps_totals():
    null = M.shuffle_null(np.array([5, 3, 2]), 4, 200, 1)
    assert (null.sum(axis=1) == 4).all() and (null <= [5, 3, 2]).all()
    assert M.one_sided_p(np.zeros(99), 1.0) == 0.01


def test_entropy_bounds():
    assert M.entropy_by_label(np.array([1, 1, 2, 2]), np.array([0, 1, 1, 1])) == 0.5
    assert math.isnan(M.entropy_by_label(np.array([1, 2]), np.array([0, 1])))


def test_reweighting_gives_the_other_shares():
    w = M.reweighting(np.array(["a", "a", "b", "c"]), np.array(["a", "b", "b", "b"]))
    assert w.tolist() == [0.5, 0.5, 3.0, 0.0]


def test_intervals_need_enough_draws(spark):
    from tessera.plans import statistics as S

    some = spark.range(30).selectExpr("id as draw", "if(id < 23, double(id), null) as v")
    with pytest.raises(RuntimeError):
        S.interval(some, "v", 30)
    assert S.interval(some, "v", 28).first()["draws"] == 23


def test_curve_equals_its_formula_and_never_overflows():
    x = np.geomspace(1e-3, 1e3, 50)
    got = C.Curve(0.1, 0.9, 0.5, 3.0, 2.0).at(x)
    assert np.allclose(got, 0.1 + 0.8 / (1 + (0.5 / x) ** 3) ** 2)
    assert np.isfinite(C.Curve(0.0, 1.0, 1.0, 20.0, 10.0).at([0.0, 1e-300, 1e300])).all()


def test_markdown():
    assert M.markdown([{"a": 1, "b": 0.25}]).splitlines()[2] == "| 1 | 0.25 |"
