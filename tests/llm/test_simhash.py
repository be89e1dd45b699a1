import numpy as np
import pytest
import xxhash
from conftest import SF
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import simhash


def plain_fingerprint(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="aB é\n\t\xa0.", max_size=60))
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_edge_texts():
    assert simhash.fingerprint(None) == simhash.fingerprint("") == simhash.fingerprint(" \n") == 0
    assert simhash.fingerprint("a b c d " * 60_000) == plain_fingerprint("a b c d " * 60_000)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**12 - 1), max_size=60), st.integers(0, 2**12 - 1), st.integers(0, 5))
def test_tree_finds_all_within_the_radius(words, asked, radius):
    tree = simhash.BKTree()
    for w in words:
        tree.insert(w)
    assert sorted(tree.words[i] for i in tree.within(asked, radius)) == sorted(w for w in set(words) if (w ^ asked).bit_count() <= radius)


def components(fps):
    ids = sorted(fps)
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    words = np.array([fps[i] for i in ids], np.uint64)
    for n, i in enumerate(ids):
        for m in np.flatnonzero(np.bitwise_count(words[n + 1 :] ^ words[n]) <= 4):
            a, b = root(i), root(ids[n + 1 + m])
            up[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


@pytest.mark.parametrize("tree_nodes", [simhash.TREE_NODES, 3])
def test_components_equal_brute_force(spark, tree_nodes):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = simhash.near_duplicates(docs, tree_nodes=tree_nodes).collect()
    fps = {r["doc_id"]: plain_fingerprint(r["text"]) for r in docs.collect()}
    assert {r["id"]: r["fp"] & (2**64 - 1) for r in found} == fps
    assert {r["id"]: r["component_id"] for r in found} == components(fps)


@pytest.mark.parametrize("tree_nodes", [4, 4096])
def test_dense_cluster_in_many_trees(spark, tree_nodes):
    rng = np.random.default_rng(3)
    base = int(rng.integers(0, 2**63))
    fps = {base}
    for _ in range(150):
        bits = rng.choice(64, rng.integers(1, 6), replace=False)
        fps.add(base ^ sum(1 << int(b) for b in bits))
    fps |= {int(x) for x in rng.integers(0, 2**63, 50)}
    words = sorted(fps)
    df = spark.createDataFrame([(simhash._signed(w),) for w in words], "fp bigint")
    from tessera.operators.components import Union

    sets = Union()
    for r in simhash.links(df, tree_nodes=tree_nodes).collect():
        a, b = r["a"] & (2**64 - 1), r["b"] & (2**64 - 1)
        assert (a ^ b).bit_count() <= 4 or sets.find(a) is not None
        sets.join(a, b)
    want = components(dict(enumerate(words)))
    groups = {}
    for i, w in enumerate(words):
        groups.setdefault(want[i], set()).add(w)
    got = {}
    for w in words:
        got.setdefault(sets.find(w), set()).add(w)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, got.values()))


def test_nulls_ties_repeats_and_foreign_columns(spark):
    rows = [(None, "x y z", 1), (5, None, 2), (3, "", 3), (7, "a b c d e", 4), (7, "a b c d e", 5), (9, "A B C D E", 6), (None, "q r s t u v", 7)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, fp int").withColumn("component_id", F.lit("no"))
    found = [(r["id"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()]
    assert sorted(found, key=str) == sorted([(None, None), (5, 3), (3, 3), (7, 7), (7, 7), (9, 7), (None, None)], key=str)
    kept = [r["doc_id"] for r in simhash.keep_one(docs).collect()]
    assert sorted(kept, key=str) == sorted([3, 7, None, None], key=str)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert simhash.near_duplicates(docs).collect() == [] and simhash.keep_one(docs).collect() == []
