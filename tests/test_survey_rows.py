"""Parts of the survey's rows that are queries of their own or more rows of one."""

from conftest import SF

from tessera.plans import registry


def rows(spark, name):
    return registry.QUERIES[name](spark, SF).collect()


def test_ladder_has_the_four_samples(spark):
    want = {r["sample"]: r["n"] for r in rows(spark, "d07_construction_samples")}
    assert {r["sample"]: r["n"] for r in rows(spark, "m21_sample_ladder")} == want and len(want) == 4


def test_doubling_null_is_around_the_share_of_its_group(spark):
    found = rows(spark, "m34_doubling_null")
    seen = {(r["grp"], r["bin"]): (r["assessed"], r["destroyed"]) for r in rows(spark, "m34_doubling_bins")}
    assert {(r["grp"], r["bin"]): (r["assessed"], r["destroyed"]) for r in found} == seen
    for g in {r["grp"] for r in found} - {"POOLED"}:
        own = [r for r in found if r["grp"] == g]
        share = sum(r["destroyed"] for r in own) / sum(r["assessed"] for r in own)
        assert all(abs(r["null_mean"] - share) < 0.05 and r["null_lo"] <= r["null_mean"] <= r["null_hi"] for r in own)


def test_stage_table_has_any_damage(spark):
    found = registry.QUERIES["m29_stage_table"](spark, "/root/testdata/sf0.01").collect()
    assert [(r["outcome"], r["grp"]) for r in found] == [(o, g) for o in ("any damage", "destruction", "given damage") for g in ("POOLED", "A", "B")]
    for o in ("any damage", "destruction", "given damage"):
        n = {r["grp"]: r["pairs"] for r in found if r["outcome"] == o}
        assert n["POOLED"] == n["A"] + n["B"]


def test_case_bootstrap_is_around_the_estimate(spark):
    own = {r["step"]: r for r in registry.QUERIES["m21_standardisation"](spark, "/root/testdata/sf0.01").collect()}["materials"]
    for r in registry.QUERIES["m21_case_bootstrap"](spark, "/root/testdata/sf0.01").collect():
        assert r["converged"] >= 160 and r["lo"] < own[r["quantity"]] < r["hi"]


def test_polygon_distance(spark):
    from pyspark.sql import functions as F

    from tessera.operators.joins import polygon_distance

    ring = lambda *p: [{"x": float(x), "y": float(y)} for x, y in (*p, p[0])]
    square = ring((0, 0), (4, 0), (4, 4), (0, 4))
    cases = [
        (ring((6, 0), (8, 0), (8, 4)), 2.0), (ring((7, 8), (9, 8), (9, 9)), 5.0), (ring((1, 1), (2, 1), (2, 2)), 0.0), (ring((-9, -9), (9, -9), (9, 9), (-9, 9)), 0.0),
        (ring((-1, 1), (5, 1), (5, 2), (-1, 2)), 0.0), (ring((4, 0), (6, 0), (6, 4)), 0.0), (ring((5, 2), (9, -3), (9, 7)), 1.0),
    ]
    kind = "array<struct<x:double,y:double>>"
    df = spark.createDataFrame([(square, b, d) for b, d in cases], f"a {kind}, b {kind}, want double")
    for r in df.select("want", polygon_distance(F.col("a"), F.col("b")).alias("d"), polygon_distance(F.col("b"), F.col("a")).alias("e")).collect():
        assert abs(r["d"] - r["want"]) < 1e-12 and abs(r["e"] - r["want"]) < 1e-12
