import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from conftest import SF
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import packing


def plain_rooms(lengths, capacity):
    """Piece-by-piece best fit on decreasing lengths; the rooms left in each sequence."""
    bins = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, r in enumerate(bins) if r >= n]
        if fits:
            bins[min(fits, key=lambda i: bins[i])] -= n
        else:
            bins.append(capacity - n)
    return sorted(bins)


@settings(max_examples=150, deadline=None)
@given(st.integers(3, 40).flatmap(lambda c: st.tuples(st.just(c), st.lists(st.integers(1, c), max_size=70))))
def test_runs_equal_piece_by_piece(case):
    capacity, lengths = case
    fill, seats = {}, Counter()
    for x in packing.best_fit_decreasing(dict(Counter(lengths)), capacity):
        for i in range(x.bins * x.per_bin):
            fill.setdefault(x.sequence + i // x.per_bin, []).append((x.offset + i % x.per_bin * x.length, x.length))
            seats[x.length] += 1
    assert seats == Counter(lengths)
    for pieces in fill.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= capacity
    assert sorted(capacity - sum(n for _, n in p) for p in fill.values()) == plain_rooms(lengths, capacity)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 40)), st.integers(0, 40))
def test_room_tree(rooms, least):
    tree = packing.RoomTree(40)
    for r in rooms:
        tree.add(r, 1)
    assert tree.tightest(least) == min((r for r in rooms if r >= least), default=None)


def test_plan_does_not_grow_with_the_documents():
    rng = np.random.default_rng(0)
    few = Counter(np.clip(rng.lognormal(5.5, 1, 200_000).astype(int), 1, 1024).tolist())
    assert len(packing.best_fit_decreasing({k: 1000 * v for k, v in few.items()})) < 3 * len(packing.best_fit_decreasing(few))


def test_ids_equal_the_json_vocabulary():
    encode, plain = packing._Encoder(packing.VOCABULARY), Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pools = ["abc DEF'st re 12 ½² \n\t.,;!", "éàß 日本語 한국 рус ़ा́", " \u2003\u200b\u0085\x1c\x0b\xa0", "😀👍🏽‍♀️ a", "Ⅷ٣४𝟙 ʰǅ ªº"]
    rng = random.Random(5)
    for _ in range(3000):
        text = "".join(rng.choice(rng.choice(pools)) for _ in range(rng.randint(0, 30)))
        assert encode(text).tolist() == [*plain.encode(text, add_special_tokens=False).ids, 2]
    text = "a <|endoftext|> b"
    assert encode(text).tolist() == [*plain.encode(text, add_special_tokens=False).ids, 2]


PLAIN = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
SMALL = packing._Encoder(packing.VOCABULARY, most=3)  # words leave the cache all the time


@settings(max_examples=1500, deadline=None)
@given(st.text(st.sampled_from("ab1 \n\t'\x1c\xa0\u2003.,;_sé½日"), max_size=25))
def test_cuts_do_not_change_ids(text):
    assert SMALL(text).tolist() == [*PLAIN.encode(text, add_special_tokens=False).ids, 2]
    assert len(SMALL) <= 3


def test_cuts_hold_for_all_kinds_of_characters():
    encode = packing._Encoder(packing.VOCABULARY)
    for code in [*range(0x3100), *range(0x3100, 0xD800, 37), *range(0xE000, 0x110000, 37)]:
        c = chr(code)
        text = f"a{c}b {c} 1{c} 2 .{c}!\n {c}  {c}{c}'{c} s{c}{c}  x \n{c}\n{c}, {c}; {c}a. "
        assert encode(text).tolist() == [*PLAIN.encode(text, add_special_tokens=False).ids, 2], hex(code)


def check(docs, rows, capacity=1024):
    encode = packing._Encoder(packing.VOCABULARY)
    own = {}
    for r in rows:
        own.setdefault(r[0], []).append(r)
    for key, text in docs.items():
        ids, at = encode(text or ""), 0
        pieces = sorted(own[key], key=lambda r: r["piece"])
        for k, r in enumerate(pieces):
            assert (r["piece"], r["start"]) == (k, at) and zlib.crc32(ids[at : at + r["length"]].tobytes()) == r["ids_crc32"]
            at += r["length"]
        assert at == len(ids) and all(r["length"] == capacity for r in pieces[1:])
    seats = {}
    for r in rows:
        seats.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in seats.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= capacity
    assert len(seats) == len(plain_rooms([r["length"] for r in rows], capacity))


def test_round_trip_of_all_documents(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    check(docs, packing.query(spark, SF).collect())


def test_edge_rows_and_foreign_columns(spark):
    texts = {1: None, 2: "", 3: "word " * 5000, 4: "short"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id int, text string").withColumns({"length": F.lit("x"), "rid": F.lit("y"), "seats": F.lit(1)})
    check(texts, packing.pack(docs.repartition(3), capacity=64).collect(), 64)
    twice = packing.pack(docs.union(docs)).collect()
    assert len(twice) == 2 * packing.pack(docs).count()
    assert packing.pack(docs.limit(0)).collect() == []


@pytest.mark.parametrize("n", [63, 64, 65, 128])
def test_cuts_at_the_capacity(spark, n):
    docs = spark.createDataFrame([(1, "a" + " a" * (n - 2))], "doc_id int, text string")
    assert [r["length"] for r in packing.pack(docs, capacity=64).orderBy("piece").collect()] == ([n % 64] if n % 64 else []) + [64] * (n // 64)
