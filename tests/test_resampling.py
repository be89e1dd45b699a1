"""Fits and block bootstraps from bins against those on rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.functions.curves import Curve, fit_curve, scores
from tessera.operators import resampling as Z


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(4)
    n = 3000
    x = rng.lognormal(-1, 0.8, n)
    y = (rng.random(n) < Curve(0.05, 0.9, 0.4, 3.0, 1.0).at(x)).astype(int)
    return pd.DataFrame({"grp": rng.choice(["A", "B"], n), "block": rng.integers(0, 25, n).astype(str), "x": x, "y": y})


def test_fit_of_bins_is_that_of_rows(spark, rows):
    df = spark.createDataFrame(rows).repartition(6)
    bins = Z.exposure_bins(df, [], "x", {"hits": F.col("y")}).toPandas()
    got, want = Z.fit_bins(bins), fit_curve(rows["x"], rows["y"])
    grid = np.quantile(rows["x"], np.linspace(0, 1, 200))  # single parameters are less sure than the curve
    assert np.abs(got.at(grid) - want.at(grid)).max() < 1e-5 and int(bins["n"].sum()) == len(rows) and len(bins) <= Z.BINS
    assert np.allclose(Z.bin_scores(got, bins), scores(want, rows["x"], rows["y"]), rtol=1e-6)


def test_draws_of_blocks_equal_drawn_rows(spark, rows):
    df = spark.createDataFrame(rows)
    table = Z.exposure_bins(df, ["grp", "block"], "x", {"hits": F.col("y")}, 64)
    counts = Z.block_counts(table.select("grp", "block").distinct(), 12, 5)
    taken = counts.toPandas()
    sizes = rows.groupby("grp")["block"].nunique()
    assert (taken.groupby(["draw", "grp"])["times"].sum().unstack() == sizes).all(axis=None) and taken["draw"].nunique() == 12 and taken["times"].min() >= 1
    again = Z.block_counts(table.repartition(3).select("grp", "block").distinct(), 12, 5).toPandas()
    order = ["draw", "grp", "block"]
    assert taken.sort_values(order).reset_index(drop=True).equals(again.sort_values(order).reset_index(drop=True))
    found = Z.drawn(table, counts, ["bin"], ["n", "lx", "hits"]).groupBy("draw", "grp").agg(F.sum("n").alias("n"), F.sum("lx").alias("lx"), F.sum("hits").alias("hits")).toPandas()
    for r in found.itertuples():
        part = taken[(taken["draw"] == r.draw) & (taken["grp"] == r.grp)]
        met = part.merge(rows[rows["grp"] == r.grp], on="block")
        assert r.n == met["times"].sum() and r.hits == (met["times"] * met["y"]).sum() and r.lx == pytest.approx((met["times"] * np.log(met["x"])).sum())


def test_odd_exposures(spark):
    df = spark.createDataFrame([(0.0, 1), (-1.0, 1), (None, 0), (float("nan"), 0), (float("inf"), 1), (2.0, 1), (2.0, None)], "x double, y int")
    assert [tuple(r) for r in Z.exposure_bins(df, [], "x", {"hits": F.col("y")}).select("bin", "n", "hits").collect()] == [(0, 2, 1)]
    assert Z.exposure_bins(df.limit(0), [], "x", {"hits": F.col("y")}).collect() == []
