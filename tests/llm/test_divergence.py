import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tessera.llm import divergence as D

SCHEMA = "doc_id bigint, text string, lang string, source string"
WORD = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def share(count, total, terms):
    return 1 + 10**9 * (count + 2) // (total + 2 * terms)


def plain(rows, min_docs, top):
    """All terms times all pairs, on whole counts."""
    docs, count, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        terms = ["".join(c.lower() if "A" <= c <= "Z" else c for c in t) for t in WORD.findall(text or "")]
        docs[lang].update(set(terms))
        count[lang, source].update(terms)
    out = set()
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= min_docs]
        total = {s: sum(count[lang, s][t] for t in kept) for s in sources}
        p = {s: {t: share(count[lang, s][t], total[s], len(kept)) for t in kept} for s in sources}
        q = {t: share(sum(count[lang, s][t] for s in sources), sum(total.values()), len(kept)) for t in kept}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pair = sorted((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in sources if o != s)
            term = sorted((-f(p[s][t], q[t]), t.encode()) for t in kept if count[lang, s][t] and p[s][t] > q[t])[:top]
            out |= {(lang, s, part, item.decode(), -v, n) for part, found in (("pair", pair), ("term", term)) for n, (v, item) in enumerate(found, 1)}
    return out


def got(df):
    rows = [(r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize(("seed", "min_docs", "shard_rows", "task_rows"), [(0, 3, 7, 5), (1, 1, 40, 10**6), (2, 10, 3, 20), (3, 500, 10, 10)])
def test_equals_all_terms_times_all_pairs(spark, seed, min_docs, shard_rows, task_rows):
    rng = random.Random(seed)
    words = [f"w{c}" for c in "abcdefghijklmnopqrst"] + ["Éa", "éa", "ÉA", "ß", "x\x00y", "A'b", "1c2", "语言"]
    rows = [(i, rng.choice([None, "", " ".join(rng.choices(words[: rng.randint(2, len(words))], k=rng.randint(0, 30)))]), rng.choice(["en", "en", "en", "de", None]), rng.choice(["a", "a", "a", "b", "c", "Z", "é", None])) for i in range(300)]
    df = spark.createDataFrame(rows + rows[:40], SCHEMA).repartition(5)
    assert got(D.audit(df, min_docs, 4, shard_rows, task_rows)) == plain(rows + rows[:40], min_docs, 4)


def test_edge_rows_and_foreign_columns(spark):
    rows = [(1, "a " * 200_000, "en", "s"), (2, "b", "en", "t"), (3, None, "en", "u"), (4, "a", None, None), (5, "lone", "fr", "s")]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"term": F.lit("t"), "n": F.lit(5), "value": F.lit("v"), "rank": F.lit(0), "shard": F.lit(0)})
    assert got(D.audit(df, 1)) == plain(rows, 1, 10)
    assert {r[4] for r in got(D.audit(df, 2))} == {0}  # no term is kept: pairs of value 0, no terms
    assert D.audit(df.limit(0)).collect() == []


def test_ties_are_ranked_by_bytes(spark):
    rows = [(n, w, "en", s) for n in range(3) for w, s in [("é", "one"), ("z", "one"), ("a", "one"), ("q", "two"), ("q", "two"), ("q", "zwei")]]
    found = got(D.audit(spark.createDataFrame(rows, SCHEMA), 1))
    assert found == plain(rows, 1, 10)
    assert [i for *_, i, _, n in sorted((r for r in found if r[1] == "one" and r[2] == "term"), key=lambda r: r[5])] == ["a", "z", "é"]
