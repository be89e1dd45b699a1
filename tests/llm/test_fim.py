import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import fim

SCHEMA = "doc_id bigint, text string"
PIECES = ["\n", "\n\n", "line", "é", "😀", "<", "<P", "P>", "<P>", "<S>", "<M>", "<<", " ", "x" * 40, "\r", "\x00"]
MACHINE = fim.Automaton.of([fim.PREFIX, fim.SUFFIX, fim.MIDDLE])


def plain(key, text, seed=7, rate=100, spm=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    x, y, z = ("".join(u) for u in (units[:a], units[a:b], units[b:]))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return len(units), "plain", None, None, text
    if h[3] % 100 < spm:
        return len(units), "spm", len(x), len(y), f"<S>{z}<P>{x}<M>{y}"
    return len(units), "psm", len(x), len(y), f"<P>{x}<S>{z}<M>{y}"


@pytest.mark.parametrize(("chunk", "rate", "spm", "seed"), [(4, 100, 50, 7), (7, 60, 100, 1), (64, 100, 0, 2), (1 << 15, 100, 50, 7)])
def test_equals_cutting_whole_texts(spark, chunk, rate, spm, seed):
    rng = random.Random(chunk)
    quiet = [p for p in PIECES if p not in ("<P>", "<S>", "<M>", "P>")]
    rows = [(i if i % 10 else None, "".join(rng.choices(PIECES if i % 3 == 0 else quiet, k=rng.randint(0, 25)))) for i in range(200)] + [(900, None), (901, ""), (902, "\n" * 50), (5, "same"), (5, "same"), (903, "<P" + ">")]
    made = fim.transform(spark.createDataFrame(rows, SCHEMA).repartition(3), seed, rate, spm, chunk)
    got = sorted(map(str, (tuple(r) for r in made.withColumn("back", fim.restore(F.col("output"), F.col("form"))).collect())))
    assert got == sorted(str((key, *plain(key, text, seed, rate, spm), text or "")) for key, text in rows)


def run(data, state):
    begun = 0
    for byte in data:
        c = MACHINE.classes[byte]
        begun += MACHINE.begins[c, state]
        state = MACHINE.step[c, state]
    return state, begun


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["\n", "<", "P", "M", "S", ">", "x", "é", "<P>"]), max_size=40).map("".join), st.integers(0, 40))
def test_functions_compose_to_the_run_of_the_automaton(text, cut):
    data = np.frombuffer(text.encode(), np.uint8)
    cut = min(cut, len(data))
    whole = MACHINE.scan(data)
    assert [(int(t), int(u)) for t, u in zip(*whole, strict=True)] == [tuple(map(int, run(data, s))) for s in range(len(whole[0]))]
    parts = fim.compose(MACHINE.scan(data[:cut]), MACHINE.scan(data[cut:]))
    assert all((p == w).all() for p, w in zip(parts, whole, strict=True))
    assert whole[1][0] == len(re.findall(r"[^\n]*\n|[^\n]+", text)) and (whole[0][0] // 2 == MACHINE.found) == any(s in text for s in ("<P>", "<S>", "<M>"))


def test_running_functions(spark):
    rng = np.random.default_rng(1)
    chunks = [MACHINE.scan(rng.choice(np.frombuffer(b"\nx<PM>", np.uint8), n)) for n in (3, 1, 8, 2, 5, 7)]
    to, units = fim.running(np.stack([c[0] for c in chunks]), np.stack([c[1] for c in chunks]))
    total = chunks[0]
    for k, chunk in enumerate(chunks):
        total = fim.compose(total, chunk) if k else total
        assert (to[k] == total[0]).all() and (units[k] == total[1]).all()


def test_other_sentinels():
    machine = fim.Automaton.of(["aab", "ba"])
    for text in ["aaab", "abab", "aa", "bba", "xaxab", "aaxab"]:
        assert (machine.scan(np.frombuffer(text.encode(), np.uint8))[0][0] // 2 == machine.found) == ("aab" in text or "ba" in text)


def test_edge_rows_and_foreign_columns(spark):
    long = "öne line\n" * 30_000
    rows = [("a", long), ("", long + "<M>"), (None, long), (None, None)]
    df = spark.createDataFrame(rows, "doc_id string, text string").withColumns({c: F.lit(c) for c in ("id", "key", "rid", "no", "n", "cut", "form", "h1", "chunk")})
    got = sorted(map(str, (tuple(r) for r in fim.transform(df).collect())))
    assert got == sorted(str((key, *plain(key, text))) for key, text in rows)
    assert fim.transform(df.limit(0)).collect() == []
    with pytest.raises(ValueError):
        fim.transform(df, chunk_bytes=3)
