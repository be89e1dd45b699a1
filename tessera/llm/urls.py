"""URL verdicts from rules and from the link graph, in DataFrame functions only.

A rule names a host and the start of a path and fits that host and its subdomains; the longest
fitting rule decides. Hosts whose pages are mostly allowed by rules are trusted seeds, those
mostly blocked are distrusted seeds. Trust flows along links (personalised PageRank from the
trusted seeds), distrust against them (the same walk over reversed links from the blocked
seeds); a host without a rule's verdict is blocked where distrust prevails. Links are summed to
host pairs before anything iterates, so the walk's tables grow with hosts and host pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.session import durable

RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
DAMPING = 0.85
ROUNDS = 20
#: Share of a host's pages that a rule must allow or block to make the host a seed.
SEED_SHARE = 0.5
#: Share of distrust in trust and distrust from which a host is blocked.
BLOCK_SHARE = 0.8
#: Blocked hosts that may be broadcast: at 100 bytes each, 50 MB.
BROADCAST_ROWS = 500_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LINK = r"""(?i)<a\s[^>]*?\bhref\s*=\s*["']?((?:[a-z][a-z0-9+.-]*:)?//[^"'\s>]++)"""


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host and path of a url; both empty for null and for a url without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _chosen(rules: list[tuple[str, str]], of_rule) -> Column:
    """CASE over the rules, longest first (of equally long ones the first listed)."""
    out = F.lit(None).cast("string")
    for verdict, rule in sorted(reversed(rules), key=lambda r: len(r[1])):
        host, slash, path = rule.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(slash + path)
        out = F.when(fits, F.lit(of_rule(verdict, rule))).otherwise(out)
    return out


def host_links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(src, dst, n)``: links from pages of one host to another host; relative links stay at home."""
    host, _ = host_and_path(F.col(url_col).cast("string"))
    links = pages.select(host.alias("src"), F.explode(F.array_distinct(F.regexp_extract_all(F.col(html_col).cast("string"), F.lit(_LINK), 1))).alias("to"))
    target = F.when(F.col("to").startswith("//"), F.concat(F.lit("x:"), F.col("to"))).otherwise(F.col("to"))
    dst, _ = host_and_path(target)
    return links.select("src", dst.alias("dst")).where("src <> '' and dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


def walk(links: DataFrame, seeds: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """Personalised PageRank for a few walks at once.

    ``links`` is ``(walk, src, dst, n)`` and ``seeds`` is ``(walk, host, mass)`` with masses that
    sum to one in each walk. Returns ``(walk, host, mass)``. What reaches a host without links
    returns to the seeds. A walk without seeds has no rows. Each round is one join and one
    grouped sum, cut by a checkpoint; the driver gets one number for each walk.
    """
    out = links.groupBy("walk", "src").agg(F.sum("n").alias("all"))
    steps = durable(links.join(out, ["walk", "src"]).select("walk", F.col("src").alias("host"), "dst", (F.col("n") / F.col("all") * damping).alias("share")))
    if steps.isEmpty():
        return seeds
    now = seeds
    for _ in range(rounds):
        sent = now.join(steps, ["walk", "host"]).groupBy("walk", F.col("dst").alias("host")).agg(F.sum(F.col("mass") * F.col("share")).alias("mass"))
        sent = durable(sent)
        back = F.lit(1.0)
        for r in sent.groupBy("walk").agg(F.sum("mass").alias("moved")).collect():
            back = F.when(F.col("walk") == r["walk"], F.lit(1.0 - r["moved"])).otherwise(back)
        now = sent.unionByName(seeds.select("walk", "host", (F.col("mass") * back).alias("mass"))).groupBy("walk", "host").agg(F.sum("mass").alias("mass"))
    return durable(now)


def judge(pages: DataFrame, rules: list[tuple[str, str]] = RULES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", block_share: float = BLOCK_SHARE, **params) -> DataFrame:
    """``(id, host, path, rule, verdict)`` for every row of ``pages``.

    Null urls and urls without a host have an empty host, fit no rule and are allowed. Hosts that
    neither trust nor distrust reaches are allowed. Null html has no links. Rows are judged one by
    one, so repeated and null ids do no harm; an empty table gives an empty result.
    """
    host, path = host_and_path(F.col(url_col).cast("string"))
    split = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    ruled = split.select("*", _chosen(rules, lambda v, r: r).alias("rule"), _chosen(rules, lambda v, r: v).alias("said"))
    hosts = ruled.where("host <> ''").groupBy("host").agg(F.avg((F.col("said").eqNullSafe("allow")).cast("int")).alias("allowed"), F.avg((F.col("said").eqNullSafe("block")).cast("int")).alias("blocked"))
    hosts = durable(hosts)
    kinds = F.array(F.struct(F.lit("trust").alias("walk"), (F.col("allowed") >= SEED_SHARE).alias("seed")), F.struct(F.lit("distrust").alias("walk"), (F.col("blocked") >= SEED_SHARE).alias("seed")))
    seeds = hosts.select("host", F.explode(kinds).alias("k")).where("k.seed").select("k.walk", "host")
    seeds = durable(seeds.join(F.broadcast(seeds.groupBy("walk").agg(F.count("*").alias("n"))), "walk").select("walk", "host", (1 / F.col("n")).alias("mass")))
    links = host_links(pages, url_col, html_col)
    both = links.select(F.explode(F.array(F.struct(F.lit("trust").alias("walk"), "src", "dst", "n"), F.struct(F.lit("distrust").alias("walk"), F.col("dst").alias("src"), F.col("src").alias("dst"), "n"))).alias("e")).select("e.*")
    mass = walk(both, seeds, **params)
    share = mass.groupBy("host").agg(F.sum(F.when(F.col("walk") == "trust", F.col("mass")).otherwise(0.0)).alias("t"), F.sum(F.when(F.col("walk") == "distrust", F.col("mass")).otherwise(0.0)).alias("d"))
    bad = durable(share.where((F.col("d") > 0) & (F.col("d") >= block_share * (F.col("t") + F.col("d")))).select("host", F.lit("block").alias("method")))
    if bad.count() <= BROADCAST_ROWS:
        bad = F.broadcast(bad)
    return ruled.join(bad, "host", "left").select("id", "host", "path", "rule", F.coalesce("said", "method", F.lit("allow")).alias("verdict"))


def query(spark, sf_dir: str) -> DataFrame:
    """Verdicts on all pages."""
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet")).withColumnRenamed("id", "page_id")


def _oracle_sql() -> str:
    """The rules, the links and the rounds of both walks, one common table for each round."""
    host = lambda rest: f"translate(regexp_extract({rest}, '^([^/?#]*)', 1), '{_UPPER}', '{_LOWER}')"
    cases = {"rule": "", "said": ""}
    for verdict, rule in sorted(RULES, key=lambda r: -len(r[1])):
        name, slash, path = rule.partition("/")
        fits = f"WHEN (host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '{slash + path}') THEN "
        cases["rule"] += fits + f"'{rule}' "
        cases["said"] += fits + f"'{verdict}' "
    rounds, last = [], "seeds"
    for n in range(1, ROUNDS + 1):
        rounds.append(f"sent{n} AS MATERIALIZED (SELECT walk, dst AS host, sum(mass * share) AS mass FROM {last} JOIN steps USING (walk, host) GROUP BY ALL)")
        back = f"SELECT walk, host, mass * (1 - coalesce(moved, 0)) AS mass FROM seeds LEFT JOIN (SELECT walk, sum(mass) AS moved FROM sent{n} GROUP BY walk) USING (walk)"
        rounds.append(f"walk{n} AS MATERIALIZED (SELECT walk, host, sum(mass) AS mass FROM (SELECT * FROM sent{n} UNION ALL {back}) GROUP BY ALL)")
        last = f"walk{n}"
    return rf"""
WITH split AS (
  SELECT page_id, html, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, html, {host("rest")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM split),
ruled AS MATERIALIZED (SELECT page_id, html, host, path, CASE {cases["rule"]}END AS rule, CASE {cases["said"]}END AS said FROM parts),
hosts AS (
  SELECT host, avg(CASE WHEN said = 'allow' THEN 1 ELSE 0 END) AS allowed, avg(CASE WHEN said = 'block' THEN 1 ELSE 0 END) AS blocked
  FROM ruled WHERE host <> '' GROUP BY host),
chosen AS (SELECT 'trust' AS walk, host FROM hosts WHERE allowed >= {SEED_SHARE} UNION ALL SELECT 'distrust', host FROM hosts WHERE blocked >= {SEED_SHARE}),
seeds AS MATERIALIZED (SELECT walk, host, 1.0::DOUBLE / count(*) OVER (PARTITION BY walk) AS mass FROM chosen),
found AS (
  SELECT host AS src, unnest(list_distinct(regexp_extract_all(html, '(?i)<a\s[^>]*?\bhref\s*=\s*["'']?((?:[a-z][a-z0-9+.-]*:)?//[^"''\s>]+)', 1))) AS target FROM ruled),
links AS (
  SELECT src, dst, count(*) AS n FROM (SELECT src, {host("substr(target, strpos(target, '//') + 2)")} AS dst FROM found)
  WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY ALL),
both_ways AS (SELECT 'trust' AS walk, src AS host, dst, n FROM links UNION ALL SELECT 'distrust', dst, src, n FROM links),
steps AS MATERIALIZED (SELECT walk, host, dst, n / sum(n) OVER (PARTITION BY walk, host) * {DAMPING} AS share FROM both_ways),
{", ".join(rounds)},
shares AS (
  SELECT host, sum(CASE WHEN walk = 'trust' THEN mass ELSE 0 END) AS t, sum(CASE WHEN walk = 'distrust' THEN mass ELSE 0 END) AS d FROM {last} GROUP BY host)
SELECT page_id, ruled.host AS host, path, rule, coalesce(said, CASE WHEN d > 0 AND d >= {BLOCK_SHARE} * (t + d) THEN 'block' END, 'allow') AS verdict
FROM ruled LEFT JOIN shares ON shares.host = ruled.host
"""


ORACLE_SQL = _oracle_sql()
