import zlib
from collections import Counter

import numpy as np
import pytest
from conftest import SF
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import sharding as S


def plain_capacity(sizes, shards):
    c = max(sizes)
    while True:
        used, room = 1, c
        for s in sizes:
            if s > room:
                used, room = used + 1, c
            room -= s
        if used <= shards:
            return c
        c += 1


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 30), min_size=1, max_size=50), st.integers(1, 9))
def test_capacity_is_the_smallest(sizes, shards):
    assert S.minimax_cuts(sizes, shards)[0] == plain_capacity(sizes, shards)


@pytest.mark.parametrize(("n", "shards", "bits"), [(5, 3, 4), (300, 24, 4), (3000, 24, 8), (1, 24, 14)])
def test_ranges_give_the_cuts_of_single_groups(spark, n, shards, bits):
    rng = np.random.default_rng(n)
    keys = sorted({int(k) for k in rng.integers(-(2**63), 2**63 - 1, n)} | ({7, 8, 9, -(2**63), 2**63 - 1} if n > 5 else set()))
    sizes = [int(x) for x in rng.choice([8, 20, 500, 9000], len(keys))]
    cuts = S.contiguous_cuts(spark.createDataFrame(list(zip(keys, sizes, strict=True)), "key bigint, size bigint"), shards, bits)
    total = Counter()
    for k, s in zip(keys, sizes, strict=True):
        total[sum(k > c for c in cuts)] += s
    assert max(total.values()) == plain_capacity(sizes, shards) and max(total) < shards


def test_all_documents(spark):
    text = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = S.query(spark, SF).collect()
    assert len(rows) == len(text)
    place, used, slots, group = {}, Counter(), {}, Counter()
    for r in rows:
        raw = text[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 8, zlib.crc32(raw), "bytes", None)
        assert place.setdefault(raw, r["shard"]) == r["shard"] and 0 <= r["shard"] < 24
        used[r["shard"]] += r["size"]
        group[raw] += r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(used.values()) <= sum(used.values()) / 24 + max(group.values())


def test_edge_rows_and_foreign_columns(spark):
    rows = [(1, None), (2, ""), (None, "a"), (3, "a"), (3, "a"), (4, "b" * 100_000)]
    docs = spark.createDataFrame(rows, "doc_id int, text string").withColumns({"size": F.lit("s"), "key": F.lit("k"), "part": F.lit(0), "shard": F.lit(9)})
    found = S.shard(docs).collect()
    assert len(found) == 6 and len({r["shard"] for r in found if r["text_crc32"] == zlib.crc32(b"a")}) == 1
    assert sorted(r["size"] for r in found) == [8, 8, 9, 9, 9, 100_008]
    assert S.shard(docs.limit(0)).collect() == []
    assert {(r["shard"]) for r in S.shard(docs, shards=1).collect()} == {0}
