import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

from tessera.llm import urls as U

SCHEMA = "page_id bigint, url string, html string"


def plain(url, rules=U.RULES):
    """Host, path, rule and the rule's verdict of one url."""
    at = (url or "").find("://")
    rest = url[at + 3 :] if at >= 0 else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, tail = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
    path = tail[: min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]
    best = None
    for verdict, rule in rules:
        h, slash, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith(slash + p) and (best is None or len(rule) > len(best[1])):
            best = (verdict, rule)
    return host, path, best[1] if best else None, best[0] if best else None


def test_all_pages_follow_the_rules(spark):
    url = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    found = U.query(spark, SF).collect()
    assert len(found) == len(url)
    for r in found:
        host, path, rule, verdict = plain(url[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule) and r["verdict"] in ({verdict} if verdict else {"allow", "block"})


ODD = ["http://EXAMPLE.org/en/1x", "https://a.example.org/es/?q#f", "ftp://org/", "http://org", "http://xorg/", "x://a.com/fr/#", "http://com/de/a?b", "http://a.com?x=/fr/", "nohost", "", None, "://", "http://ÉX.org/A", "http://u:p@h.org:80/p#a?b", "a://b://c.org/", "http://a.org\n/x"]


@pytest.mark.parametrize("url", ODD)
def test_odd_urls(url):
    assert plain(url)[0] is not None


def test_odd_urls_in_spark(spark):
    pages = spark.createDataFrame([(i, u, None) for i, u in enumerate(ODD)], SCHEMA).withColumns({"host": F.lit("h"), "rule": F.lit("r"), "said": F.lit(0)})
    for r in U.judge(pages).collect():
        host, path, rule, verdict = plain(ODD[r["id"]])
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, rule, verdict or "allow")


def test_distrust_runs_against_links_and_trust_along_them(spark):
    rows = [
        (1, "http://good.org/", '<a href="http://friend.net/a">x</a>'), (2, "http://friend.net/", None), (3, "http://shop.com/de/", ""), (4, "http://farm.net/", "<A class=x HREF='//shop.com/de/1'>"), (5, "http://far.net/", "<a href=http://farm.net/>"),
        (6, "http://both.net/", '<a href="http://shop.com/x">'), (7, "http://hub.org/", '<a href="http://both.net/">'), (8, "http://alone.net/", '<a href="/home">'),
    ]
    verdict = {r["host"]: r["verdict"] for r in U.judge(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert verdict == {"good.org": "allow", "friend.net": "allow", "shop.com": "block", "farm.net": "block", "far.net": "block", "both.net": "allow", "hub.org": "allow", "alone.net": "allow"}


def test_walk_equals_matrix_iteration(spark):
    rng = np.random.default_rng(3)
    n, links = 12, {}
    for a, b in rng.integers(0, 12, (30, 2)).tolist():
        if a != b:
            links[a, b] = float(rng.integers(1, 4))
    s = np.zeros(n)
    s[[0, 5]] = 0.5
    m = np.zeros((n, n))
    for (a, b), w in links.items():
        m[a, b] = w
    out = m.sum(axis=1, keepdims=True)
    step = np.divide(m, out, out=np.zeros_like(m), where=out > 0)
    x = s
    for _ in range(U.ROUNDS):
        moved = U.DAMPING * x @ step
        x = moved + (1 - moved.sum()) * s
    df = spark.createDataFrame([("t", f"h{a}", f"h{b}", int(w)) for (a, b), w in links.items()], "walk string, src string, dst string, n bigint")
    seeds = spark.createDataFrame([("t", "h0", 0.5), ("t", "h5", 0.5)], "walk string, host string, mass double")
    got = {r["host"]: r["mass"] for r in U.walk(df, seeds).collect()}
    assert all(abs(got.get(f"h{i}", 0.0) - x[i]) < 1e-9 for i in range(n)) and abs(sum(got.values()) - 1) < 1e-9


def duck(sql, rows):
    import duckdb
    import pandas as pd

    con = duckdb.connect()
    pages = pd.DataFrame(rows, columns=["page_id", "url", "html"])
    con.register("pages", pages)
    return sorted(con.sql(f"SELECT page_id, host, path, rule, verdict FROM ({sql})").fetchall())


def test_linked_hosts_equal_the_sql(spark):
    rng = np.random.default_rng(8)
    hosts = [f"h{i}.{t}" for i, t in enumerate(["org", "com", "net"] * 10)]
    bad = [h for h in hosts[:15] if h.endswith(".com")]
    farms = [h for h in hosts[15:] if h.endswith(".net")]
    others = [h for h in hosts if h not in farms]
    rows = []
    for i in range(150):
        own = hosts[i % 30]
        to = "".join(f"<a href='{p}{h}/x'>" for h, p in zip(rng.choice(bad if own in farms else others, 3), ["http://", "//", "HTTPS://"], strict=True))
        rows.append((i, f"http://{own}{'/de/' if own in bad else rng.choice(['/fr/', '/x'])}?q", to))
    rows += [(1000 + i, u, None) for i, u in enumerate(ODD)]
    got = sorted(tuple(r[c] for c in ("id", "host", "path", "rule", "verdict")) for r in U.judge(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == duck(U.ORACLE_SQL, rows)
    unruled = [r[4] for r in got if r[3] is None and r[1]]
    assert {"allow", "block"} == set(unruled)


def test_empty_table_and_native_plan(spark):
    pages = spark.createDataFrame([], SCHEMA)
    assert U.judge(pages).collect() == []
    plan = U.query(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
