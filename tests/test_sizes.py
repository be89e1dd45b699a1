"""Shared steps whose work and memory grow no faster than the input."""

import os

import duckdb
import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

from tessera import session
from tessera.operators import exposure as X
from tessera.plans import statistics as T
from tessera.plans.fixtures import SQL, Context


@pytest.fixture
def odd(tmp_path):
    """The smallest tables with repeated lines, lines without order or part, and an unknown part."""
    os.symlink(f"{SF}/part.parquet", tmp_path / "part.parquet")
    con = duckdb.connect()
    lines = f"(SELECT l_orderkey, l_partkey FROM '{SF}/lineitem.parquet')"
    more = "UNION ALL SELECT NULL, p_partkey FROM (SELECT p_partkey FROM part LIMIT 9) UNION ALL SELECT * FROM (VALUES (1, NULL), (1, 999999), (1, 7), (1, 7), (2, 999999))"
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{SF}/part.parquet'")
    con.execute(f"CREATE TABLE lineitem AS SELECT CAST(l_orderkey AS BIGINT) AS l_orderkey, CAST(l_partkey AS BIGINT) AS l_partkey FROM (SELECT * FROM {lines} {more})")
    con.execute(f"COPY lineitem TO '{tmp_path}/lineitem.parquet' (FORMAT parquet)")
    return str(tmp_path), con


def test_assessed_and_links_equal_sql_on_odd_lines_and_assessed_needs_no_pairs(spark, odd):
    folder, con = odd
    c = Context(spark, folder)
    want = con.sql(f"WITH {SQL} SELECT node, is_destroyed, any_damage FROM assessed").fetchall()
    assert sorted(map(tuple, c.assessed.select("node", "is_destroyed", "any_damage").collect())) == sorted(want) and any(r[1] for r in want)
    assert {k[2] for k in Context._kept if k[1] == folder} == {"baskets", "assessed"}
    want = con.sql(f"WITH {SQL} SELECT i, j, f_ij, f_ji, contact FROM edges").fetchall()
    assert sorted(map(tuple, c.edges.collect())) == sorted(want)


def test_case_bootstrap_takes_no_rows_as_arrays(spark, monkeypatch):
    c = Context(spark, "/root/testdata/sf0.01")
    a = T.model_arrays(c)
    cell = np.array([f"{k}|{d}" for k, d in zip(a["kind"].tolist(), np.digitize(a["year"], [1992, 2009]).tolist(), strict=True)])
    bins = T._case_bins(c)
    assert bins["n"].sum() == len(cell) and len(set(bins["cell"].tolist())) == len(set(cell.tolist()))
    assert T.swap_of_bins(bins, bins["n"].astype(float)) == pytest.approx(T.swap_factor(a, cell), rel=1e-3)
    monkeypatch.setattr(T, "MOST_ROWS", 100)
    found = {r["quantity"]: r for r in T._case_bootstrap(c, 40).collect()}
    assert set(found) == {"raw", "factor", "residual"} and all(r["lo"] < r["mid"] < r["hi"] for r in found.values())


def operators(df):
    return [line.strip(" +-:*()0123456789") for line in df._jdf.queryExecution().executedPlan().toString().split("\n")]


def test_pairs_are_dealt_once_and_join_nothing(spark):
    c = Context(spark, SF)
    plan = operators(c.build_links(c.baskets))
    assert sum("Exchange" in p for p in plan) == 1 and not any("Join" in p for p in plan)


def test_dose_sorts_no_edges_and_sums_none_before_they_are_dealt(spark):
    """Neither the join of the edges with their emitters sorts them, nor do texts of groups and outcomes fill a map of all edges."""
    assessed = spark.range(2000).select(F.col("id").alias("node"), F.lit("A").alias("grp"), F.lit("destroyed").alias("outcome"))
    edges = spark.range(1000).select(F.col("id").alias("i"), (F.col("id") + 1000).alias("j"), F.lit(0.5).alias("f_ij"), F.lit(0.25).alias("f_ji"))
    plan = operators(X.dose(assessed, edges))
    at = next(k for k, p in enumerate(plan) if "ShuffledHashJoin" in p)
    above = next(k for k in range(at, 0, -1) if "Exchange" in plan[k])
    assert not any("Aggregate" in p for p in plan[above:at]) and not any(p.startswith("Sort ") for p in plan[at:])


def test_shuffles_have_partitions_by_the_size_of_the_input(spark):
    keys = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes")
    before = {k: spark.conf.get(k) for k in keys}
    try:
        for given in ("64MB", "67108864b", "1g"):
            spark.conf.set(keys[1], given)
            session.dealt_by_size(spark, 36_000_000)
            assert [spark.conf.get(k) for k in keys] == ["72", f"{16 << 20}b"]
        spark.conf.set(keys[1], "16k")
        session.dealt_by_size(spark, 10)
        assert [spark.conf.get(k) for k in keys] == ["72", "16k"]  # nothing is made coarser
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
