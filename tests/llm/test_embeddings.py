import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import embeddings as E

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def clustered(n, dim, seed, spread=0.15):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    for i in range(n):
        if i % 3 and i > 4:
            x[i] = x[rng.integers(0, i)] + spread * rng.normal(size=dim)
    return x.astype(np.float32)


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10_000), st.integers(1, 60), st.integers(1, 60), st.sampled_from([0.3, 0.8, 0.93, 0.999]))
def test_traversal_finds_all_pairs(seed, n, m, cosine):
    x = clustered(n + m, 5, seed).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    a, b = x[:n], x[n:]
    assert {p for p in zip(*(k.tolist() for k in E.near_pairs(a, b, cosine)), strict=True)} == set(zip(*(k.tolist() for k in np.nonzero(a @ b.T >= cosine - 1e-9)), strict=True))
    assert {(min(p), max(p)) for p in zip(*(k.tolist() for k in E.near_pairs(a, None, cosine)), strict=True)} == set(zip(*(k.tolist() for k in np.nonzero(np.triu(a @ a.T, 1) >= cosine - 1e-9)), strict=True))


def test_tree_is_nested_and_covers():
    x = clustered(200, 8, 1).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    todo = [E.cover_tree(x)]
    assert sorted(todo[0].members.tolist()) == list(range(200))
    while todo:
        node = todo.pop()
        assert np.sqrt(((x[node.members] - x[node.centre]) ** 2).sum(axis=1)).max() <= node.radius + 1e-9
        if node.children:
            assert node.children[0].centre == node.centre
            assert sorted(m for c in node.children for m in c.members.tolist()) == sorted(node.members.tolist())
        todo += node.children


def brute(rows):
    def usable(v, label):
        return label is not None and v is not None and len(v) and all(a is not None and np.isfinite(a) for a in v) and any(v)

    n = len(rows)
    up, links = list(range(n)), [0] * n

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(n):
        for j in range(i):
            (a, x, k), (b, y, m) = rows[i], rows[j]
            if usable(x, k) and usable(y, m) and k == m and len(x) == len(y):
                x, y = np.array(x, np.float32).astype(float), np.array(y, np.float32).astype(float)
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.93:
                    links[i], links[j] = links[i] + 1, links[j] + 1
                    up[root(i)] = root(j)
    least = {}
    for i in range(n):
        least.setdefault(root(i), []).append(rows[i][0])
    return sorted((rows[i][0], links[i], min(least[root(i)])) for i in range(n))


@pytest.mark.parametrize(("block", "fanout"), [(7, 16), (20, 3), (3, 2), (None, 16)])
def test_rows_equal_brute_force(spark, block, fanout):
    x = clustered(150, 6, 9)
    rows = [(500 - i, v.tolist(), i % 3) for i, v in enumerate(x)]
    rows += [(1000 + i, x[3].tolist(), 0) for i in range(20)] + [(2000, None, 0), (2001, [], 0), (2002, [0.0] * 6, 0), (2003, [float("nan")] * 6, 0), (2004, [float("inf")] * 6, 0), (2005, [None] * 6, 0), (2006, x[3].tolist(), None), (2007, [1.0, 2.0], 0), (2008, [0.0, -0.0, 1.0, 0.0, 0.0, 0.0], 0), (2009, [-0.0, 0.0, 1.0, 0.0, 0.0, 0.0], 0), (2010, [1e30] * 6, 1), (2011, [1e-30] * 6, 1)]
    found = E.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3), block=block, fanout=fanout).collect()
    assert sorted((r["id"], r["n_links"], r["component_id"]) for r in found) == brute(rows)
    assert all(r["kept"] == (r["id"] == r["component_id"]) for r in found)


def test_repeats_null_ids_and_foreign_columns(spark):
    v = spark.createDataFrame([(None, [1.0, 0.0], 1), (4, [1.0, 0.0], 1), (4, [1.0, 0.0], 1), (None, [0.0, 1.0], 1)], SCHEMA).withColumns({"n": F.lit("x"), "cid": F.lit(0), "id": F.lit("y")})
    found = sorted(((r["id"], r["n_links"], r["component_id"], r["kept"]) for r in E.near_duplicates(v).collect()), key=str)
    assert found == sorted([(None, 2, 4, None), (4, 2, 4, True), (4, 2, 4, True), (None, 0, None, None)], key=str)
    assert E.near_duplicates(v.limit(0)).collect() == []


def test_pairs_of_cells_follow_the_clusters(spark):
    rng = np.random.default_rng(4)
    middles = rng.normal(size=(12, 16))
    rows = [(int(i), (middles[i % 12] + 0.02 * rng.normal(size=16)).astype(np.float32).tolist(), 1) for i in range(1200)]
    classes = spark.createDataFrame(rows, "cid bigint, embedding array<float>, label int")
    placed, pairs = E.cells(classes, block=150)
    n = placed.select("cell").distinct().count()
    assert placed.count() == 1200 and placed.select("cid").distinct().count() == 1200
    assert 8 <= n and pairs.count() < 0.4 * n * (n + 1) / 2


def test_query_equals_its_sql(spark):
    import duckdb
    from conftest import SF

    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{SF}/embeddings.parquet')")
    got = E.query(spark, SF).select("vec_id", "n_links", "component_id", "kept").collect()
    assert sorted(map(tuple, got)) == sorted(con.sql(f"SELECT vec_id, n_links, component_id, kept FROM ({E.ORACLE_SQL})").fetchall())
