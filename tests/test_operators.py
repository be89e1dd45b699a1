"""Hand-checked micro-tables for the hazards of the operators."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.operators import binning as B
from tessera.operators import components as C
from tessera.operators import edges as E
from tessera.operators import exposure as X
from tessera.operators import joins as J
from tessera.operators import linkage as L
from tessera.operators import summaries as S
from tessera.sources import readers as R
from tessera.sources import sinks as K


def edges(spark, rows):
    return spark.createDataFrame(rows, "i bigint, j bigint, f_ij double, f_ji double")


def bonds(spark, rows):
    return spark.createDataFrame(rows, "i bigint, j bigint, f double")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_bond_skips_nulls_and_clamps(spark):
    found = E.with_bond(edges(spark, [(1, 2, 0.3, 0.1), (1, 3, 0.3, None), (2, 3, None, None), (2, 4, 1.7, 0.2)]))
    assert rows(found.select("i", "j", F.coalesce("f", F.lit(-1.0)))) == [(1, 2, 0.3), (1, 3, 0.3), (2, 3, -1.0), (2, 4, 1.0)]


def test_threshold_is_inclusive_and_null_safe(spark):
    found = E.at_least(edges(spark, [(1, 2, 0.3, None), (1, 3, None, 0.29), (2, 3, None, None)]), 0.3)
    assert rows(found.select("i", "j")) == [(1, 2)]


def test_missing_pair_is_zero_not_the_strongest(spark):
    pairs = spark.createDataFrame([(0, 2, 1), (1, 1, 9)], "position int, a bigint, b bigint")
    assert rows(E.pair_lookup(pairs, edges(spark, [(1, 2, 0.4, None)])).select("position", "f")) == [(0, 0.4), (1, 0.0)]


def test_tie_break_by_neighbor_and_by_position(spark):
    b = spark.createDataFrame([(1, 9, 0.5, 0), (1, 3, 0.5, 1), (1, 5, 0.5, 2)], "i bigint, j bigint, f double, edge_id int")
    top = lambda how: {r["neighbor"] for r in E.ranked_incidence(b, 2, how).where("node = 1").collect()}
    assert top("neighbor") == {3, 5}
    assert top("edge_id") == {9, 3}


def test_components_keep_single_nodes_and_ignore_foreign_edges(spark):
    nodes = spark.range(1, 7).withColumnRenamed("id", "node")
    found = C.connected_components(nodes, bonds(spark, [(1, 2, 1.0), (2, 2, 1.0), (2, 3, 1.0), (5, 99, 1.0), (2, 1, 1.0)]), "node", "i", "j")
    assert rows(found) == [(1, 1, 3), (2, 1, 3), (3, 1, 3), (4, 4, 1), (5, 5, 1), (6, 6, 1)]


def test_components_of_nothing(spark):
    assert rows(C.star_components(bonds(spark, []), "i", "j")) == []


@pytest.mark.parametrize("small", [0, 1_000_000])
def test_both_component_paths_agree_with_union_find(spark, small):
    rng = np.random.default_rng(4)
    pairs = [(int(a), int(b), 1.0) for a, b in rng.integers(0, 120, (70, 2))] + [(i, i + 1, 1.0) for i in range(200, 230)]
    sets = C.Union()
    for a, b, _ in pairs:
        if a != b:
            sets.join(a, b)
    found = {r["node"]: r["component"] for r in C.star_components(bonds(spark, pairs).repartition(3), "i", "j", small=small).collect()}
    assert found == {n: sets.find(n) for n in sets.up}


@settings(max_examples=50, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 20), st.integers(0, 20)), max_size=40), st.randoms())
def test_union_is_blind_to_order(pairs, random):
    shuffled = list(pairs)
    random.shuffle(shuffled)
    a, b = C.Union(), C.Union()
    for x, y in pairs:
        a.join(x, y)
    for x, y in shuffled:
        b.join(y, x)
    assert all(a.find(n) == b.find(n) for n in range(21))


def test_anchored_links_next_to_strong_edges(spark):
    b = bonds(spark, [(1, 2, 0.5), (2, 3, 0.4), (3, 4, 0.4), (5, 6, 0.4)])
    either = L.active(L.anchored_weights(b, 0.75), 0.5, 0.75)
    both = L.active(L.anchored_weights(b, 0.75, both=True), 0.5, 0.75)
    assert rows(either.select("i", "j")) == [(1, 2), (2, 3)]
    assert rows(both.select("i", "j")) == [(1, 2)]
    assert rows(L.active(L.anchored_weights(b, 1.0), 0.5, 1.0).select("i", "j")) == [(1, 2)]


def test_cumulative_rule_needs_n_bonds_and_both_ends(spark):
    b = bonds(spark, [(1, 2, 0.3), (2, 3, 0.3), (1, 3, 0.3), (3, 4, 0.9)])
    assert rows(L.active(L.cumulative_top_n_weights(b, 2, 0.25), 0.55, 0.25).select("i", "j")) == [(1, 2), (1, 3), (2, 3)]


@pytest.mark.parametrize("small", [0, 1_000_000])
def test_sweep_is_nested_and_equals_direct_states(spark, small):
    rng = np.random.default_rng(2)
    seen = {}
    for a, b in rng.integers(0, 40, (90, 2)).tolist():
        if a != b:
            seen[(min(a, b), max(a, b))] = float(rng.choice([0.1, 0.2, 0.3]))
    w = L.eeat_weights(bonds(spark, [(a, b, f) for (a, b), f in seen.items()]))
    nodes = spark.range(40).withColumnRenamed("id", "node")
    swept = L.sweep(nodes, w, [0.1, 0.2, 0.3], small)
    for t in (0.1, 0.2, 0.3):
        direct = L.states(nodes, w.where(F.col("w") >= t))
        assert rows(swept.where(F.col("threshold") == t).drop("threshold")) == rows(direct)


def test_minimum_neighbors(spark):
    nodes = spark.range(1, 5).withColumnRenamed("id", "node")
    found = {r["node"]: r for r in L.minimum_neighbors(nodes, bonds(spark, [(1, 2, 0.25), (1, 3, 0.5)]), 0.75).collect()}
    assert (found[1]["needed"], found[1]["f_at"], found[2]["needed"], found[4]["available"], found[4]["reachable"]) == (2, 0.75, None, 0, False)


def test_dose_keeps_lonely_nodes_and_compares_groups(spark):
    assessed = spark.createDataFrame([(1, "A", "no_damage"), (2, "A", "destroyed"), (3, "B", "destroyed"), (5, "A", "partial")], "node bigint, grp string, outcome string")
    e = edges(spark, [(1, 2, 0.2, 0.9), (1, 3, 0.4, 0.1), (1, 4, 0.1, 0.1)])
    found = {r["node"]: r for r in X.dose(assessed, e).collect()}
    assert (found[1]["dose_sum"], found[1]["neighbors"], found[1]["known_neighbors"], found[1]["n_destroyed"]) == (0.2, 3, 1, 1)
    assert (found[5]["dose_sum"], found[5]["neighbors"], found[5]["log_dose"]) == (0.0, 0, None)


def test_dose_conventions_differ(spark):
    assessed = spark.createDataFrame([("a", 0), ("b", 1)], "source_id string, is_destroyed int")
    ids = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b")], "node bigint, source_id string")
    found = {r["graph_id"]: r for r in X.dose_by_source(assessed, ids, edges(spark, [(1, 2, 0.2, 0.9), (1, 3, 0.3, 0.5)])).collect()}
    assert found[1]["dose_sum"] == pytest.approx(1.4) and found[1]["n_destroyed"] == 2


def test_quantile_bins_match_numpy(spark):
    x = np.random.default_rng(1).integers(0, 9, 200).astype(float)
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    cuts = np.unique(np.quantile(x, np.linspace(0, 1, 6)))
    left = np.clip(np.digitize(x, cuts) - 1, 0, len(cuts) - 2)
    right = np.maximum(np.searchsorted(cuts, x, "left") - 1, 0)
    for flag, want in ((False, left), (True, right)):
        got = {r["x"]: r["bin"] for r in B.quantile_bins(df, "x", 5, right=flag).collect()}
        assert got == dict(zip(x.tolist(), want.tolist(), strict=True))


def test_doubling_bins_at_powers_of_two(spark):
    df = spark.createDataFrame([(v,) for v in (1, 2, 3, 4, 5, 8, 9, 2**40, 2**40 + 1)], "v bigint")
    assert [r[0] for r in df.select(B.doubling_bin(F.col("v"))).collect()] == [0, 1, 2, 2, 3, 3, 4, 40, 41]


def test_collapsed_size_classes_raise(spark):
    df = spark.createDataFrame([("A", 2, True)] * 9, "grp string, component_size int, assessed boolean")
    with pytest.raises(ValueError, match="collapsed"):
        B.size_classes(df)


def test_wilson_contains_the_share(spark):
    df = spark.createDataFrame([(0.0, 5.0), (5.0, 5.0), (1.0, 2.0)], "k double, n double")
    lo, hi = S.wilson(F.col("k"), F.col("n"))
    for r in df.select("k", "n", lo.alias("lo"), hi.alias("hi")).collect():
        assert r["lo"] <= r["k"] / r["n"] <= r["hi"]


def test_entropy_ends(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (0.5,)], "p double")
    assert [r[0] for r in df.select(S.entropy(F.col("p"))).collect()] == [0.0, 0.0, 1.0]


def test_unknown_values(spark):
    df = spark.createDataFrame([(v,) for v in (None, "", " Unknown ", "NaN", "none", "boxed")], "v string")
    assert [r[0] for r in df.select(S.unknown_value(F.col("v"))).collect()] == [True] * 5 + [False]


def test_checked_join_refuses_repeated_keys(spark):
    left, right = spark.createDataFrame([(1,)], "k int"), spark.createDataFrame([(1, 2), (1, 3)], "k int, v int")
    with pytest.raises(ValueError, match="right side"):
        J.checked_join(left, right, ["k"])


def test_mutual_nearest_is_strict(spark):
    schema = "id bigint, x double, y double"
    a = spark.createDataFrame([(1, 0.0, 0.0), (2, 4.0, 0.0), (3, 50.0, 0.0)], schema)
    b = spark.createDataFrame([(7, 3.0, 0.0), (8, 50.0, 5.1)], schema)
    assert rows(J.mutual_nearest(a, b, 5.0)) == [(2, 7, 1.0)]


def test_nearest_other_counts_places_not_ids(spark):
    p = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.0, 0.0), (3, 9.0, 0.0)], "id bigint, x double, y double")
    assert rows(J.nearest_other(p, p, 1.0)) == [(1, 0.0), (2, 0.0), (3, 9.0)]


def test_point_in_ring_and_segment_distance(spark):
    ring = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (4, 0), (4, 4), (2, 1), (0, 4), (0, 0))])
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 3.0), (5.0, 1.0)], "x double, y double")
    assert [r[0] for r in df.select(J.inside(F.col("x"), F.col("y"), ring)).collect()] == [True, False, False]
    d = [r[0] for r in df.select(J.segment_distance(F.col("x"), F.col("y"), F.lit(0.0), F.lit(0.0), F.lit(4.0), F.lit(0.0))).collect()]
    assert d == [1.0, 3.0, pytest.approx(math.sqrt(2))]


def test_atomic_write_and_parameter_cache(spark, tmp_path):
    path, calls = str(tmp_path / "cache"), []

    def build():
        calls.append(1)
        return {"t": spark.range(len(calls))}

    assert K.cached(spark, path, {"a": 1, "b": 0.1 + 0.2}, build)["t"].count() == 1
    assert K.cached(spark, path, {"a": 1, "b": 0.3}, build)["t"].count() == 1
    assert K.cached(spark, path, {"a": 2, "b": 0.3}, build)["t"].count() == 2
    assert K.cached(spark, path, {"a": 2, "b": 0.3}, build, force=True)["t"].count() == 3


def test_inventory_finds_problems(spark, tmp_path):
    (tmp_path / "a").write_text("x")
    found = R.inventory(spark, str(tmp_path))
    want = found.select("path", "bytes", F.lit("0").alias("sha256"))
    assert [r["problem"] for r in R.check_inventory(found, want).collect()] == ["checksum"]


def test_geo_footer(tmp_path):
    import json

    import pyarrow as pa
    import pyarrow.parquet as pq

    meta = {"primary_column": "g", "columns": {"g": {"encoding": "WKB", "crs": {"id": 26911}}}}
    pq.write_table(pa.table({"g": [b""]}).replace_schema_metadata({"geo": json.dumps(meta)}), tmp_path / "f.parquet")
    assert R.geo_metadata(str(tmp_path / "f.parquet"))["crs"] == {"id": 26911}


def test_wkb_points(spark):
    import struct

    data = [(bytearray(struct.pack("<BIdd", 1, 1, x, y)),) for x, y in ((1.5, -2.25), (0.0, 12345.678))]
    x, y = R.point_from_wkb("g")
    assert [tuple(r) for r in spark.createDataFrame(data, "g binary").select(x, y).collect()] == [(1.5, -2.25), (0.0, 12345.678)]


def test_tiles_and_missing_columns(spark):
    assert R.tiles_for(0, 0, 150, 90, 100) == [(0, 0), (1, 0)]
    with pytest.raises(ValueError, match="lacks columns: b"):
        J.require_columns(spark.range(1), ["id", "b"])


def test_nan_becomes_null(spark):
    df = J.nan_to_null(spark.createDataFrame([(float("nan"), "a"), (1.0, "b")], "v double, s string"))
    assert rows(df.select(F.coalesce("v", F.lit(-1.0)))) == [(-1.0,), (1.0,)]


def test_import_closure():
    from conftest import ROOT

    found = R.import_closure(ROOT, "tessera", "tessera.plans.registry")
    assert "tessera.operators.components" in found and not any(n.startswith("tessera.llm") for n in found)
