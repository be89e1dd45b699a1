import hashlib
import re

import numpy as np
import pytest
from conftest import SF
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import pii

PLAIN = [
    re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    re.compile(r"[0-9]([\x20-]?[0-9])+"),
    re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def plain_spans(text):
    out = []
    for kind, pattern in enumerate(PLAIN):
        for m in pattern.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == 1 and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == 2 and not (16 <= len(digits) <= 19 and pii.luhn(digits)):
                continue
            if kind == 3 and not 8 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab12.@+-_ ()%é0", max_size=50))
def test_scanners_equal_the_patterns(text):
    assert pii.base_spans(text) == plain_spans(text)


def test_known_values():
    text = "x 4111 1111 1111 1111, 4111-1111-1111-1112; 1.2.3.256 1.2.3.4.5 a.b@c.d.e +1 (555) 000-1111"
    assert [text[s:e] for _, s, e in pii.base_spans(text)] == ["a.b@c.d.e", "1.2.3.4", "4111 1111 1111 1111", "+1 (555) 000-1111"]


def test_query_on_all_documents(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in pii.query(spark, SF).collect():
        spans = plain_spans(docs[r["doc_id"]])
        listed = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for k, s, e in spans)
        assert r["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
        assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) == tuple(sum(k == i for k, _, _ in spans) for i in range(4))
        assert set(listed.split(",")) - {""} <= set(r["spans"].split(","))


def phone_docs(n):
    seeds = [(i, f"Hello. My phone number: +1 (555) 000-{i:04d} thanks") for i in range(n)]
    hidden = [(1000 + i, f"and my phone number: 555-123-{i:04d} thanks all") for i in range(4)]
    return seeds + hidden + [(2000, "your order 123456789 is late"), (2001, None), (2002, ""), (2002, "")]


SCHEMA = "doc_id int, text string"


def test_contexts_discover_identifiers(spark):
    found = {r["id"]: r for r in pii.find(spark.createDataFrame(phone_docs(20), SCHEMA)).collect()}
    text = dict(phone_docs(20))
    assert [text[1001][s:e] for _, s, e in found[1001]["spans"]] == ["555-123-0001"] and found[1001]["base"] == []
    assert found[2000]["spans"] == [] and found[2001]["spans"] == []
    assert len(found[3]["spans"]) == 1


def test_contexts_discover_spaced_short_and_long_identifiers(spark):
    written = ["555 123 4567", "(555) 123-4567", "555 - 123 - 4567", "555.123 4567", "(030) 1234567"]
    rows = [(i, f"Hello. My phone number: +1 (555) 000-{i:04d} thanks") for i in range(60)]
    rows += [(100 + i, f"and my phone number: {w} thanks all") for i, w in enumerate(written)]
    rows += [(200 + i, f"from ip address: 10.0.{i}.1 it came") for i in range(60)] + [(300, "from ip address: 10-0-0-1 it came")]
    rows += [(400 + i, f"write mail to: user{i}@example.com now") for i in range(60)] + [(500, f"write mail to: {'n' * 80}@{'h' * 80} now")]
    cards = [f"4111 1111 1111 {n:04d}" for n in range(1000)]
    rows += [(600 + i, f"paid with card no: {c} today") for i, c in enumerate([c for c in cards if pii.luhn(c.replace(" ", ""))][:60])]
    rows += [(700, "paid with card no: 4111 1111 1111 1112 today")]
    text = dict(rows)
    found = {r["id"]: r["spans"] for r in pii.find(spark.createDataFrame(rows, SCHEMA)).collect()}
    got = lambda i: [(k, text[i][s:e]) for k, s, e in found[i]]
    assert [got(100 + i) for i in range(len(written))] == [[(3, w)] for w in written]
    assert got(300) == [(1, "10-0-0-1")] and got(500) == [(0, f"{'n' * 80}@{'h' * 80}")]
    assert got(700) == [(2, "4111 1111 1111 1112")]


def plain_trusted(scanned, support, confidence, rounds):
    """The scoring by plain loops over all instances and patterns."""
    edges = {(p, i["value"], i["kind"] % 4 if i["kind"] >= 0 else -1, 0 <= i["kind"] < 4) for r in scanned for i in r["seen"] for p in i["patterns"]}
    every = {}
    for p, v, _, _ in edges:
        every.setdefault(p, set()).add(v)
    seeds = {(v, k): 1.0 for _, v, k, seed in edges if seed}
    scores, trusted = dict(seeds), None
    for _ in range(rounds):
        held = {}
        for p, v, k, _ in edges:
            if (v, k) in scores:
                held.setdefault((p, k), {})[v] = scores[v, k]
        now = {key: sum(own.values()) / (len(every[key[0]]) + 1) for key, own in held.items() if len(own) >= support}
        now = {key: c for key, c in now.items() if c >= confidence}
        if not now:
            return trusted
        trusted, scores = now, dict(seeds)
        for p, v, k, seed in edges:
            if not seed and k >= 0 and (p, k) in now and (v, k) not in seeds:
                scores[v, k] = max(scores.get((v, k), 0.0), now[p, k])
    return trusted


@pytest.mark.parametrize(("support", "confidence"), [(3, 0.5), (5, 0.7), (10, 0.8)])
def test_scores_equal_plain_loops(spark, support, confidence):
    rng = np.random.default_rng(support)
    contexts = ["call me at {} now", "phone number: {} thanks", "mail to {} please", "your order {} is late", "from ip address: {} it", "the code {} of it"]
    things = [lambda n: f"+1 (555) 000-{n:04d}", lambda n: f"555-123-{n:04d}", lambda n: f"u{n}@example.com", lambda n: f"10.0.{n % 200}.1", lambda n: f"10-0-{n % 200}-1", lambda n: f"{n}77777{n}"]
    rows = [(i, " and ".join(contexts[int(c)].format(things[int(t)](int(rng.integers(0, 60)))) for c, t in zip(rng.choice(6, 3, p=[0.3, 0.3, 0.1, 0.1, 0.1, 0.1]), rng.choice(6, 3, p=[0.6, 0.1, 0.1, 0.1, 0.05, 0.05]), strict=True))) for i in range(400)]
    scanned = pii.scan(spark.createDataFrame(rows, SCHEMA)).withColumn("rid", F.monotonically_increasing_id()).persist()
    got = pii.trusted_patterns(scanned, support, confidence)
    want = plain_trusted(scanned.collect(), support, confidence, pii.ROUNDS)
    assert (got is None) == (want is None)
    if want is not None:
        found = {(r["pattern"], r["kind"]): r["confidence"] for r in got.collect()}
        assert found.keys() == want.keys() and all(abs(found[k] - want[k]) < 1e-9 for k in want)


def test_few_seeds_discover_nothing(spark):
    assert all(r["spans"] == r["base"] for r in pii.find(spark.createDataFrame(phone_docs(4), SCHEMA)).collect())


def test_redaction(spark):
    docs = spark.createDataFrame(phone_docs(20), SCHEMA).withColumns({"n_chars": F.lit(0).cast("bigint"), "digest": F.lit("keep")})
    for rows in (pii.BROADCAST_ROWS, 0):
        done = pii.redact(docs, broadcast_rows=rows).collect()
        by_id = {r["doc_id"]: r for r in done}
        assert len(done) == docs.count() and by_id[2001]["text"] is None and by_id[2000]["text"] == "your order 123456789 is late"
        assert by_id[1001]["text"] == "and my phone number: [PHONE] thanks all" and by_id[1001]["n_chars"] == 39 and by_id[1001]["digest"] == "keep"
        assert not pii.base_spans(by_id[3]["text"])


def test_overlapping_spans_are_replaced_once():
    assert pii.redacted("ab 12 34 cd", [(2, 3, 8), (3, 6, 8)]) == "ab [CARD] cd"


def test_long_texts_stay_linear():
    import time

    began = time.time()
    for text in ("a" * 400_000, "1" * 400_000, "@" * 400_000, "1.2." * 100_000, "+1" * 200_000, "+1" + "(" * 400_000, "9 " * 200_000):
        spans = pii.base_spans(text)
        pii.candidates(text, spans)
    assert time.time() - began < 20


def test_long_rows_stay_linear():
    import time

    began = time.time()
    for text in ("1x" * 200_000, "a1@" * 100_000, "12 " * 100_000, "(12) - " * 60_000, "1-1-1-1 " * 50_000, "9" + " " * 400_000 + "9"):
        assert all(s < e for s, e, _, _ in pii.candidates(text, []))
    assert time.time() - began < 20


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id int, text string, n_chars bigint")
    assert pii.find(docs).collect() == [] and pii.redact(docs).collect() == []
