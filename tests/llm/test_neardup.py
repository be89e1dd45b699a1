from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import pytest

from tessera.llm import simhash

SF = "/root/testdata/sf0.01"


def plain_groups(rows):
    """Least row of each row's group, by an index of all shingles."""
    sets = [frozenset(simhash.shingle_hashes(t, 5).tolist()) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    index, blank = defaultdict(list), []
    for i, own in enumerate(sets):
        met = Counter(j for h in own for j in index[h])
        near = [j for j, k in met.items() if k >= 0.8 * (len(own) + len(sets[j]) - k) - 1e-9] if own else blank
        for j in list(near):
            a, b = root(i), root(j)
            up[max(a, b)] = min(a, b)
        for h in own:
            index[h].append(i)
        if not own:
            blank.append(i)
    return [root(i) for i in range(len(rows))]


@pytest.mark.parametrize("part_classes", [simhash.PART_CLASSES, 2])
def test_stage_keeps_one_of_each_group(spark, part_classes):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    want = sorted(rows[i][0] for i in set(plain_groups(rows)))
    kept = corpus_pipeline.dedup_stage(spark, docs, SF) if part_classes > 2 else simhash.keep_one(docs, part_classes=2, broadcast_rows=0)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == want


def test_near_copies_beyond_four_bits_go(spark):
    rng = np.random.default_rng(5)
    rows = []
    for k in range(40):
        words = [f"w{x}" for x in rng.integers(0, 10**6, 120)]
        edited = [*words]
        edited[60] = edited[20] = "edit"
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(edited))]  # 106 of 126 shingles are common: 0.84
    kept = corpus_pipeline.dedup_stage(spark, spark.createDataFrame(rows, "doc_id bigint, text string"), "")
    assert sorted(r["doc_id"] for r in kept.collect()) == list(range(0, 80, 2))


def test_empty_table(spark):
    assert simhash.keep_one(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []
