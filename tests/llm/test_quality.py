import zlib

import numpy as np
from conftest import SF
from pyspark.sql import functions as F

from tessera.llm import quality as Q


def auc(score, label):
    good, bad = score[label == 1], score[label == 0]
    return (good[:, None] > bad[None]).mean() + 0.5 * (good[:, None] == bad[None]).mean()


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in Q.query(spark, sf).collect() if r["doc_id"] in labels]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    out = [r for r in rows if r["held_out"]]
    label, score = np.array([labels[r["doc_id"]] for r in out]), np.array([r["score"] for r in out])
    assert auc(score, label) > 0.98
    assert np.mean([r["predicted"] == labels[r["doc_id"]] for r in out]) > 0.97
    assert all(r["predicted"] == (r["score"] >= 0.7) for r in rows)


def data(n=600, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.random((n, len(Q.STATISTICS)))
    return x, ((x[:, 3] < 0.5) & (x[:, 7] < 0.6)).astype(int)


def test_column_equals_arrays(spark):
    x, y = data()
    model = Q.fit(x, y)
    assert model.rules and all(len(rule) <= Q.DEPTH for rule, _ in model.rules)
    raw = np.full(len(x), model.bias)
    for rule, weight in model.rules:
        raw += weight * Q._holds(rule, x)
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], ["n", *Q.STATISTICS])
    got = np.array([r[0] for r in df.orderBy("n").select(model.score()).collect()])
    assert np.allclose(got, 1 / (1 + np.exp(-raw)))
    assert auc(got, y) > 0.97


def test_fit_is_blind_to_row_order_and_sparse():
    x, y = data()
    order = np.random.default_rng(1).permutation(len(y))
    a, b = Q.fit(x, y), Q.fit(x[order], y[order])
    assert dict(a.rules) == dict(b.rules) and a.bias == b.bias
    assert len(Q.fit(x, y, penalty=0.05).rules) < len(Q.fit(x, y, penalty=0.0005).rules)


def test_leaves_part_the_rows_and_paths_lead_to_all_nodes():
    x, y = data()
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, 20)[1:-1])) for c in x.T]
    paths = []
    leaves = Q._grow(x, cuts, y - y.mean(), np.full(len(y), 0.25), 3, 5, paths)
    assert (sum(Q._holds(rule, x).astype(int) for rule, _ in leaves) == 1).all()
    assert {rule for rule, _ in leaves} <= set(paths) and len(paths) == 2 * (len(leaves) - 1)
    for rule, value in leaves:
        own = Q._holds(rule, x)
        assert np.isclose(value, (y - y.mean())[own].sum() / (0.25 * own.sum() + 1))
    for rule in paths:  # a node's rows are those of the leaves below it
        below = [r for r, _ in leaves if rule <= r]
        assert (Q._holds(rule, x) == sum(Q._holds(r, x).astype(int) for r in below)).all()


def test_lasso_meets_its_conditions():
    rng = np.random.default_rng(5)
    z = rng.normal(size=(400, 12))
    y = (z[:, 0] - 2 * z[:, 1] + rng.normal(size=400) > 0).astype(float)
    penalty = 0.03
    w, b = Q._lasso_logistic(z, y, penalty, steps=4000)
    slope = z.T @ (1 / (1 + np.exp(-(z @ w + b))) - y) / len(y)
    assert abs((1 / (1 + np.exp(-(z @ w + b))) - y).mean()) < 1e-5
    assert np.allclose(slope[w != 0], -penalty * np.sign(w[w != 0]), atol=1e-5) and (np.abs(slope[w == 0]) <= penalty + 1e-6).all()
    assert 2 <= (w != 0).sum() < 12 and np.flatnonzero(w)[:2].tolist() == [0, 1]


def test_one_class_gives_its_share():
    model = Q.fit(np.zeros((8, len(Q.STATISTICS))), np.ones(8))
    assert not model.rules and np.isclose(1 / (1 + np.exp(-model.bias)), 0.9)


def test_held_out_labels_are_not_learnt(spark):
    features = spark.createDataFrame([(i, 0, *[float(i % 7)] * len(Q.STATISTICS)) for i in range(400)], ["id", "digest", *Q.STATISTICS])
    labels = spark.range(400).select(F.col("id").alias("doc_id"), (F.col("id") % 2).alias("quality"))
    flipped = labels.withColumn("quality", F.when(Q.held_out("doc_id"), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert Q.learn(features, Q.sampled(labels)) == Q.learn(features, Q.sampled(flipped))


def test_ids_with_both_labels_and_repeated_rows(spark):
    labels = spark.createDataFrame([(1, 0), (1, 1), (3, 1), (3, 1), (4, 0), (None, 1), (5, None)], "doc_id bigint, quality int")
    assert sorted(map(tuple, Q.sampled(labels).collect())) == [(k, y) for k, y in ((3, 1), (4, 0)) if zlib.crc32(str(k).encode()) % 4 != 2]
    features = spark.createDataFrame([(i % 100, d, *[float(d + i)] * len(Q.STATISTICS)) for i in range(200) for d in (1, 2)], ["id", "digest", *Q.STATISTICS])
    sample = Q.sampled(spark.range(100).select(F.col("id").alias("doc_id"), (F.col("id") % 2).alias("quality")))
    assert Q.learn(features, sample) == Q.learn(features.repartition(7).orderBy(F.desc("digest")), sample)


def test_statistics_of_edge_texts():
    for text in (None, "", " \n "):
        assert Q.statistics(text) == [0.0] * len(Q.STATISTICS)
    for text in ("a", "!", "\n.\n", "é" * 300_000, "x " * 200_000, "word\n" * 50_000):
        assert np.isfinite(Q.statistics(text)).all()


def test_edge_rows_and_stage(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    own = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(None, "Plain words of a text."), (1, None), (1, ""), (1, "")], "doc_id bigint, text string")
    docs = own.union(odd).withColumns({"score": F.lit("s"), "y": F.lit(0), "digest": F.lit("d"), "log_chars": F.lit("t")})
    found = Q.scored(docs, labels).collect()
    assert len(found) == docs.count() and all(0 <= r["score"] <= 1 for r in found)
    good = {r["id"] for r in found if r["predicted"] == 1}
    kept = Q.keep_good(docs, labels)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == good
    assert Q.scored(docs.limit(0), labels).collect() == [] and Q.keep_good(docs.limit(0), labels).collect() == []
    assert Q.scored(docs, labels.limit(0)).select("score").distinct().collect()[0][0] == 0.5
