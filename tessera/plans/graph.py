"""Components under the link rules, their summaries, and sweeps over thresholds."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import binning as B
from tessera.operators import edges as E
from tessera.operators import joins as J
from tessera.operators import linkage as L
from tessera.operators import summaries as S
from tessera.plans.base import query
from tessera.plans.relational import _r, _rounded

TAU = 0.08


def _points(c):
    return c.nodes.select(F.col("node").alias("id"), "x", "y")


def state(c, tau: float = TAU):
    return L.states(c.nodes, L.active(L.eeat_weights(c.bonds), tau))


def _labels(df):
    return df.select("node", "component_id", "component_size")


_EEAT = f"SELECT i, j FROM bonds WHERE f >= {TAU}"
_ALL = "SELECT node, component_id, component_size FROM state"
_NODES = "nodes JOIN state USING (node)"
query("g01_components", lambda c: _labels(state(c)), _ALL, _EEAT)
query("g02_components_loose", lambda c: state(c, 0.1).groupBy("component_size").agg(F.count("*").alias("n")), "SELECT component_size, count(*) AS n FROM state GROUP BY 1", "SELECT i, j FROM bonds WHERE f >= 0.1")
query("g03_stable_id", lambda c: state(c).groupBy("component_id").agg(F.min(F.coalesce("source_id", F.concat(F.lit("~"), F.col("node").cast("string")))).alias("stable")), f"SELECT component_id, min(coalesce(source_id, concat('~', CAST(node AS VARCHAR)))) AS stable FROM {_NODES} GROUP BY 1", _EEAT)
query(
    "g04_eeat_outcomes",
    lambda c: state(c).join(c.assessed.select("node", "is_destroyed"), "node").groupBy("component_id").agg(F.count("*").alias("n"), _r(F.avg("is_destroyed")).alias("share")),
    "SELECT component_id, count(*) AS n, round(avg(is_destroyed), 6) AS share FROM state JOIN assessed USING (node) GROUP BY 1",
    _EEAT,
)
_TOP = "SELECT node, neighbor, f, row_number() OVER (PARTITION BY node ORDER BY f DESC, neighbor) AS rank FROM {inc}"
query("g05_top_n_profile", lambda c: _rounded(L.top_n_profile(c.bonds, 2), "s"), f"SELECT node, count(*) AS k, round(sum(f), 6) AS s FROM ({_TOP.format(inc='inc')}) WHERE rank <= 2 GROUP BY node")


def _cumulative(tau: float, alpha: float, inc: str = "inc") -> str:
    return f"""SELECT DISTINCT least(node, neighbor) AS i, greatest(node, neighbor) AS j FROM (WITH rk AS ({_TOP.format(inc=inc)}),
  q AS (SELECT node AS n FROM rk WHERE rank <= 2 GROUP BY node HAVING count(*) = 2 AND sum(f) >= {tau})
  SELECT node, neighbor FROM rk WHERE rank <= 2 AND f >= {alpha * tau!r} AND node IN (SELECT n FROM q) AND neighbor IN (SELECT n FROM q))"""


query("g06_cumulative_top_n", lambda c: _labels(L.states(c.nodes, L.active(L.cumulative_top_n_weights(c.bonds, 2, 0.25), 0.14, 0.25))), _ALL, _cumulative(0.14, 0.25))
query(
    "g07_restricted_top_n",
    lambda c: L.active(L.cumulative_top_n_weights(E.induced(c.bonds, c.nodes.where("grp = 'A'")), 2, 0.75), 0.12, 0.75).select("i", "j"),
    _cumulative(0.12, 0.75, "(SELECT * FROM inc WHERE node IN (SELECT node FROM nodes WHERE grp = 'A') AND neighbor IN (SELECT node FROM nodes WHERE grp = 'A'))"),
)
query(
    "g08_ranked_incidence",
    lambda c: L.active(L.cumulative_top_n_weights(E.with_bond(c.edges, clamp=False), 2, 0.75), 0.16, 0.75).select("i", "j"),
    _cumulative(0.16, 0.75, "(SELECT i AS node, j AS neighbor, greatest(f_ij, f_ji) AS f FROM edges UNION ALL SELECT j, i, greatest(f_ij, f_ji) FROM edges)"),
)
query(
    "g09_top_n_pruned",
    lambda c: _labels(L.states(c.nodes, L.active(L.top_n_pruned_weights(c.bonds, 2), 0.07))),
    _ALL,
    f"SELECT DISTINCT least(node, neighbor) AS i, greatest(node, neighbor) AS j FROM ({_TOP.format(inc='inc')}) WHERE rank <= 2 AND f >= 0.07",
)
_ANCHOR = "SELECT e.i, e.j FROM bonds e WHERE e.f >= 0.1 OR (e.f >= {floor!r} AND (e.i IN (SELECT node FROM inc WHERE f >= 0.1) {op} e.j IN (SELECT node FROM inc WHERE f >= 0.1)))"
query("g10_anchored_either", lambda c: L.active(L.anchored_weights(c.bonds, 0.75), 0.1, 0.75).select("i", "j"), _ANCHOR.format(floor=0.75 * 0.1, op="OR"))
query("g10_anchored_both", lambda c: L.active(L.anchored_weights(c.bonds, 0.75, both=True), 0.1, 0.75).select("i", "j"), _ANCHOR.format(floor=0.75 * 0.1, op="AND"))
_RUN = "SELECT node, rank, f, total FROM (SELECT node, f, row_number() OVER w AS rank, sum(f) OVER (PARTITION BY node ORDER BY f DESC, neighbor ROWS UNBOUNDED PRECEDING) AS total FROM inc WINDOW w AS (PARTITION BY node ORDER BY f DESC, neighbor))"
_MIN = f"""SELECT n.node, coalesce(k, 0) AS available, round(coalesce(s, 0), 6) AS total_f, needed, round(f_at, 6) AS f_at, needed IS NOT NULL AS reachable FROM nodes n LEFT JOIN (
  SELECT node, count(*) AS k, sum(f) AS s, CAST(min(rank) FILTER (WHERE total >= 3.9001) AS INTEGER) AS needed, min(total) FILTER (WHERE total >= 3.9001) AS f_at FROM ({_RUN}) GROUP BY node) USING (node)"""
query("g11_minimum_neighbors", lambda c: _rounded(L.minimum_neighbors(c.nodes, c.bonds, 3.9001), "total_f", "f_at"), _MIN)
query("w04_first_rank", lambda c: L.minimum_neighbors(c.nodes, c.bonds, 0.2001).select("node", "needed"), f"SELECT n.node, needed FROM nodes n LEFT JOIN (SELECT node, CAST(min(rank) FILTER (WHERE total >= 0.2001) AS INTEGER) AS needed FROM ({_RUN}) GROUP BY node) USING (node)")
_CLOSE = "SELECT p.node AS i, q.node AS j FROM nodes p JOIN nodes q ON p.node < q.node AND sqrt((p.x - q.x) ** 2 + (p.y - q.y) ** 2) <= {}"


def _close(c, reach: float):
    return J.within_distance(_points(c), _points(c), reach).where("a < b").select(F.col("a").alias("i"), F.col("b").alias("j"), "d")


def _near_components(c, reach: float):
    return J.distance_components(_points(c), reach)


def _separation(c, reach: float):
    """Mean distance of linked nodes in a component, on average over the components; sums by node before components are met."""
    sums = _close(c, reach).groupBy("i").agg(F.sum("d").alias("s"), F.count("d").alias("k"))
    met = sums.hint("merge").join(_near_components(c, reach).select(F.col("id").alias("i"), "component_id"), "i")
    return met.groupBy("component_id").agg((F.sum("s") / F.sum("k")).alias("m")).agg(_r(F.avg("m")).alias("separation"), F.count("*").alias("n"))


query("g12_distance_components", lambda c: _near_components(c, 150.0).select(F.col("id").alias("node"), "component_id", "component_size"), _ALL, _CLOSE.format(150))
query("g13_inverse_square", lambda c: _close(c, 150.0).where("d > 0").select("i", "j", _r(F.least(F.lit(1.0), F.pow(30 / F.col("d"), F.lit(2)))).alias("f")), "SELECT p.node AS i, q.node AS j, round(least(1.0, 900 / ((p.x - q.x) ** 2 + (p.y - q.y) ** 2)), 6) AS f FROM nodes p JOIN nodes q ON p.node < q.node AND sqrt((p.x - q.x) ** 2 + (p.y - q.y) ** 2) <= 150 AND (p.x <> q.x OR p.y <> q.y)")
query(
    "g14_mean_separation",
    lambda c: _separation(c, 150.0),
    f"SELECT round(avg(m), 6) AS separation, count(*) AS n FROM (SELECT component_id, avg(d) AS m FROM state JOIN (SELECT p.node, sqrt((p.x - q.x) ** 2 + (p.y - q.y) ** 2) AS d FROM nodes p JOIN nodes q ON p.node < q.node AND sqrt((p.x - q.x) ** 2 + (p.y - q.y) ** 2) <= 150) USING (node) GROUP BY 1)",
    _CLOSE.format(150),
)
_PERIMETER = "grp = 'A' AND x >= 500 AND x < 6000 AND y >= 500 AND y < 6000"


def _network(c):
    ring = F.broadcast(c.zones.where("priority = 1").select("ring"))
    members = c.nodes.where("grp = 'A'").join(ring).where(J.inside(F.col("x"), F.col("y"), F.col("ring"))).drop("ring")
    return members, E.induced(c.bonds, members)


query("g15_network", lambda c: _network(c)[1].select("i", "j", _r(F.col("f")).alias("f")), f"SELECT i, j, round(f, 6) AS f FROM bonds WHERE i IN (SELECT node FROM nodes WHERE {_PERIMETER}) AND j IN (SELECT node FROM nodes WHERE {_PERIMETER})")


def _legacy(c):
    place = lambda k: c.nodes.select(F.col("node").alias(k), F.col("x").alias(f"x_{k}"), F.col("y").alias(f"y_{k}"))
    d = E.symmetrised(c.edges).join(place("receiver"), "receiver").join(place("emitter"), "emitter")
    d = d.withColumn("d", J.distance(F.col("x_receiver"), F.col("y_receiver"), F.col("x_emitter"), F.col("y_emitter"))).where("d > 0 and d <= 800")
    return E.collapse_pairs(d.withColumn("vf", E.floor_zero(F.col("vf"))), "receiver", "emitter", "vf", "d")


query(
    "g16_legacy_network",
    lambda c: _rounded(_legacy(c), "weight", "distance"),
    "SELECT least(receiver, emitter) AS i, greatest(receiver, emitter) AS j, round(max(vf), 6) AS weight, round(min(d), 6) AS distance FROM (SELECT receiver, emitter, vf, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS d FROM directed JOIN nodes a ON a.node = receiver JOIN nodes b ON b.node = emitter) WHERE d > 0 AND d <= 800 GROUP BY 1, 2",
)
_SUMMARY = f"""SELECT component_id, count(*) AS size, CAST(sum(CAST(is_interface AS INTEGER)) AS BIGINT) AS interface_members, round(avg(x), 4) AS cx, round(avg(y), 4) AS cy, round(sqrt((max(x) - min(x)) ** 2 + (max(y) - min(y)) ** 2), 4) AS diagonal,
  CASE WHEN count(*) = 1 THEN 'isolated' WHEN sum(CAST(is_interface AS INTEGER)) BETWEEN 1 AND count(*) - 1 THEN 'spanning' WHEN sum(CAST(is_interface AS INTEGER)) > 0 THEN 'interface' ELSE 'outside' END AS category,
  round(1 - sum(CAST(is_interface AS INTEGER)) / count(*), 6) AS outside_share FROM {_NODES} GROUP BY component_id"""


def summary(c):
    return S.component_summary(state(c))


query("g25_component_summary", lambda c: _rounded(_rounded(summary(c), "cx", "cy", "diagonal", n=4), "outside_share"), _SUMMARY, _EEAT)
query("a09_component_rollup", lambda c: summary(c).select("component_id", "size", "interface_members", _r(F.col("diagonal"), 4).alias("diagonal")), f"SELECT component_id, size, interface_members, diagonal FROM ({_SUMMARY})", _EEAT)
query(
    "g17_region",
    lambda c: summary(c).groupBy("category").agg(F.count("*").alias("components"), F.sum("size").alias("members"), F.max("size").alias("largest")),
    f"SELECT category, count(*) AS components, CAST(sum(size) AS BIGINT) AS members, max(size) AS largest FROM ({_SUMMARY}) GROUP BY category",
    _EEAT,
)
query(
    "g18_corridor",
    lambda c: _text_components(c),
    "SELECT concat('S', CAST(node AS VARCHAR)) AS node, min(concat('S', CAST(node AS VARCHAR))) OVER (PARTITION BY component_id) AS component_id, component_size FROM state",
    _EEAT,
)


def _text_components(c):
    from tessera.operators.components import connected_components

    name = lambda k: F.concat(F.lit("S"), F.col(k).cast("string")).alias(k)
    links = L.active(L.eeat_weights(c.bonds), TAU).select(name("i"), name("j"))
    return connected_components(c.nodes.select(name("node")), links, "node", "i", "j")


_STEPS = [0.08, 0.09, 0.1, 0.12]
_SWEEP = f"""th(t) AS (SELECT unnest([{', '.join(map(str, _STEPS))}])), sl AS (SELECT t, i AS node, j AS neighbor FROM bonds, th WHERE f >= t UNION ALL SELECT t, j, i FROM bonds, th WHERE f >= t),
sweep(t, node, label) AS (SELECT t, node, node FROM nodes, th UNION SELECT s.t, l.neighbor, s.label FROM sweep s JOIN sl l ON l.t = s.t AND l.node = s.node),
swept AS (SELECT t, node, min(label) AS component_id FROM sweep GROUP BY 1, 2), sized AS (SELECT *, count(*) OVER (PARTITION BY t, component_id) AS component_size FROM swept)"""


def _sweep_sql(body: str) -> str:
    from tessera.plans.fixtures import SQL

    return f"WITH RECURSIVE {SQL}, {_SWEEP}\n{body}"


query(
    "g19_sweep",
    lambda c: L.sweep(c.nodes, L.eeat_weights(c.bonds), _STEPS).groupBy("threshold").agg(F.count_distinct("component_id").alias("components"), F.max("component_size").alias("largest"), F.sum(F.col("component_id")).alias("checksum")),
    _sweep_sql("SELECT CAST(t AS DOUBLE) AS threshold, count(DISTINCT component_id) AS components, max(component_size) AS largest, CAST(sum(component_id) AS BIGINT) AS checksum FROM sized GROUP BY t"),
    raw=True,
)
_CUMULATIVE_STEPS = [0.12, 0.14, 0.16, 0.2]


def _rule_sweeps(c):
    """Both top-2 rules over their thresholds: one spanning forest and one pass for each rule."""
    out = None
    for rule, weights, steps in (("pruned", L.top_n_pruned_weights(c.bonds, 2), _STEPS), ("cumulative", L.cumulative_top_n_weights(c.bonds, 2, 0.25), _CUMULATIVE_STEPS)):
        one = L.sweep(c.nodes, weights, steps).groupBy("threshold").agg(F.count_distinct("component_id").alias("components"), F.max("component_size").alias("largest"), F.sum("component_id").alias("checksum")).withColumn("rule", F.lit(rule))
        out = one if out is None else out.unionByName(one)
    return out


def _rule_sweeps_sql() -> str:
    from tessera.plans.fixtures import SQL

    parts = [f"SELECT DISTINCT 'pruned' AS rule, {t} AS t, least(node, neighbor) AS i, greatest(node, neighbor) AS j FROM ({_TOP.format(inc='inc')}) WHERE rank <= 2 AND f >= {t}" for t in _STEPS]
    parts += [f"SELECT 'cumulative', {t}, i, j FROM ({_cumulative(t, 0.25)})" for t in _CUMULATIVE_STEPS]
    steps = [f"('pruned', {t})" for t in _STEPS] + [f"('cumulative', {t})" for t in _CUMULATIVE_STEPS]
    return f"""WITH RECURSIVE {SQL}, th(rule, t) AS (VALUES {', '.join(steps)}), lk AS MATERIALIZED ({' UNION ALL '.join(parts)}),
sl AS MATERIALIZED (SELECT rule, t, i AS node, j AS neighbor FROM lk UNION ALL SELECT rule, t, j, i FROM lk),
walk(rule, t, node, label) AS (SELECT rule, t, node, node FROM nodes, th UNION SELECT w.rule, w.t, l.neighbor, w.label FROM walk w JOIN sl l ON l.rule = w.rule AND l.t = w.t AND l.node = w.node),
swept AS (SELECT rule, t, node, min(label) AS component_id FROM walk GROUP BY 1, 2, 3), sized AS (SELECT *, count(*) OVER (PARTITION BY rule, t, component_id) AS component_size FROM swept)
SELECT rule, CAST(t AS DOUBLE) AS threshold, count(DISTINCT component_id) AS components, max(component_size) AS largest, CAST(sum(component_id) AS BIGINT) AS checksum FROM sized GROUP BY 1, 2"""


query("g19_top_2_sweeps", _rule_sweeps, _rule_sweeps_sql(), raw=True)


def _region(c):
    """Components without an excluded set, with the flag of those near the screen's edge, by class."""
    kept = c.nodes.where("grp = 'A' or size > 10")
    found = L.states(kept, L.active(L.eeat_weights(E.induced(c.bonds, kept)), TAU))
    edge = (F.col("x") < 300) | (F.col("x") > 9700) | (F.col("y") < 300) | (F.col("y") > 9700)
    near = found.groupBy("component_id").agg(F.max(edge.cast("int")).alias("near_edge"))
    parts = S.component_summary(found).join(near, "component_id")
    return parts.groupBy("category").agg(F.count("*").alias("components"), F.sum("size").alias("members"), F.max("size").alias("largest"), F.sum("near_edge").alias("cut_by_the_edge"), F.lit(c.nodes.count() - kept.count()).alias("excluded"))


query(
    "g17_region_screen",
    _region,
    """SELECT category, count(*) AS components, CAST(sum(size) AS BIGINT) AS members, max(size) AS largest, CAST(sum(near_edge) AS BIGINT) AS cut_by_the_edge, (SELECT count(*) FROM nodes WHERE NOT (grp = 'A' OR size > 10)) AS excluded
FROM (SELECT count(*) AS size, max(CASE WHEN x < 300 OR x > 9700 OR y < 300 OR y > 9700 THEN 1 ELSE 0 END) AS near_edge,
    CASE WHEN count(*) = 1 THEN 'isolated' WHEN sum(CAST(is_interface AS INTEGER)) BETWEEN 1 AND count(*) - 1 THEN 'spanning' WHEN sum(CAST(is_interface AS INTEGER)) > 0 THEN 'interface' ELSE 'outside' END AS category
  FROM nodes JOIN state USING (node) WHERE grp = 'A' OR size > 10 GROUP BY component_id) GROUP BY category""",
    f"SELECT i, j FROM bonds WHERE f >= {TAU} AND i IN (SELECT node FROM nodes WHERE grp = 'A' OR size > 10) AND j IN (SELECT node FROM nodes WHERE grp = 'A' OR size > 10)",
)


def _spanning(c):
    swept = L.sweep(c.nodes, L.eeat_weights(c.bonds), _STEPS).join(c.nodes.select("node", "is_interface"), "node")
    parts = swept.groupBy("threshold", "component_id").agg(F.sum(F.col("is_interface").cast("int")).alias("k"), F.count("*").alias("n"))
    return swept.join(parts.where("k > 0 and k < n").select("threshold", "component_id"), ["threshold", "component_id"])


query(
    "w18_highest_level",
    lambda c: _spanning(c).groupBy("node").agg(F.max("threshold").alias("level"), F.max_by("component_size", "threshold").alias("size")),
    _sweep_sql("SELECT node, CAST(max(t) AS DOUBLE) AS level, arg_max(component_size, t) AS size FROM sized JOIN (SELECT t, component_id FROM sized JOIN nodes USING (node) GROUP BY 1, 2 HAVING sum(CAST(is_interface AS INTEGER)) BETWEEN 1 AND count(*) - 1) USING (t, component_id) GROUP BY node"),
    raw=True,
)
query(
    "a34_nested_labels",
    lambda c: L.sweep(c.nodes, L.eeat_weights(c.bonds), [0.08, 0.1]).groupBy("node").agg(*[F.max(F.when(F.col("threshold") == t, F.col("component_id"))).alias(k) for k, t in (("coarse", 0.08), ("fine", 0.1))]).groupBy("fine").agg(F.count_distinct("coarse").alias("k")).agg(F.count_if(F.col("k") > 1).alias("split"), F.count("*").alias("fine")),
    _sweep_sql("SELECT count(*) FILTER (WHERE k > 1) AS split, count(*) AS fine FROM (SELECT f.component_id, count(DISTINCT c.component_id) AS k FROM sized f JOIN sized c USING (node) WHERE f.t = 0.1 AND c.t = 0.08 GROUP BY 1)"),
    raw=True,
)
query(
    "g20_buffer_sensitivity",
    lambda c: _buffers(c),
    f"SELECT b AS buffer, count(DISTINCT component_id) AS components, count(*) AS members FROM (SELECT b, component_id FROM {_NODES}, (SELECT unnest([0.0, 500.0, 1500.0]) AS b) WHERE sqrt(greatest(4000 - x, 0, x - 7000) ** 2 + greatest(4000 - y, 0, y - 8000) ** 2) <= b) GROUP BY b",
    _EEAT,
)


def _buffers(c):
    gap = F.hypot(F.greatest(4000 - F.col("x"), F.lit(0.0), F.col("x") - 7000), F.greatest(4000 - F.col("y"), F.lit(0.0), F.col("y") - 8000))
    near = state(c).select("component_id", gap.alias("d"))  # measured once, then compared with each buffer
    buffers = F.broadcast(c.spark.createDataFrame([(0.0,), (500.0,), (1500.0,)], "buffer double"))
    return near.join(buffers, F.col("d") <= F.col("buffer")).groupBy("buffer").agg(F.count_distinct("component_id").alias("components"), F.count("*").alias("members"))


query(
    "g21_member_links",
    lambda c: E.induced(L.active(L.eeat_weights(c.bonds), TAU), state(c).where("component_size between 2 and 10")).select("i", "j"),
    f"SELECT i, j FROM bonds WHERE f >= {TAU} AND i IN (SELECT node FROM state WHERE component_size BETWEEN 2 AND 10) AND j IN (SELECT node FROM state WHERE component_size BETWEEN 2 AND 10)",
    _EEAT,
)
query(
    "g22_examples",
    lambda c: summary(c).where("size > 1 and interface_members > 0").groupBy("size").agg(F.min("component_id").alias("example")),
    f"SELECT size, min(component_id) AS example FROM ({_SUMMARY}) WHERE size > 1 AND interface_members > 0 GROUP BY size",
    _EEAT,
)


def _equivalence(c):
    pruned = L.states(c.nodes, L.active(L.top_n_pruned_weights(c.bonds, 2), 0.08)).select("node", F.col("component_id").alias("a"))
    direct = L.sweep(c.nodes, L.top_n_pruned_weights(c.bonds, 2), [0.08]).select("node", F.col("component_id").alias("b"))
    return pruned.join(direct, "node").agg(F.count("*").alias("nodes"), F.count_if(F.col("a") != F.col("b")).alias("different"))


query("g23_filtration_equivalence", _equivalence, "SELECT count(*) AS nodes, CAST(0 AS BIGINT) AS different FROM nodes")
query(
    "g24_mapped_size",
    lambda c: state(c).groupBy("component_id").agg(F.count_if("is_interface").alias("mapped"), F.count("*").alias("n")).where("mapped > 0"),
    f"SELECT component_id, count(*) FILTER (WHERE is_interface) AS mapped, count(*) AS n FROM {_NODES} GROUP BY 1 HAVING count(*) FILTER (WHERE is_interface) > 0",
    _EEAT,
)
query(
    "p21_interconnected",
    lambda c: L.interconnected(state(c).withColumn("outside", ~F.col("is_interface")), "is_interface", "outside").select("node", "interconnected"),
    f"SELECT node, NOT is_interface AND component_size >= 2 AND bool_or(is_interface) OVER (PARTITION BY component_id) AS interconnected FROM {_NODES}",
    _EEAT,
)
query(
    "a30_size_frequency",
    lambda c: _rounded(S.size_frequency(state(c)), "share_from_here"),
    "SELECT size, members, components, round(sum(members) OVER (ORDER BY size DESC ROWS UNBOUNDED PRECEDING) / sum(members) OVER (), 6) AS share_from_here FROM (SELECT component_size AS size, count(*) AS members, count(DISTINCT component_id) AS components FROM state GROUP BY 1)",
    _EEAT,
)


def _network_summary(c):
    """The network in one row: counts, shares and spans of all components, the linked ones and those that span the interface."""
    parts, nodes = summary(c), state(c)
    spans = F.col("category") == "spanning"
    of = lambda cond, value="size": F.coalesce(F.sum(F.when(cond, F.col(value))), F.lit(0))
    row = parts.agg(
        F.sum("size").alias("nodes"), F.count("*").alias("components"), F.max("size").alias("largest"), F.count_if(F.col("size") == 1).alias("isolated"), F.count_if(F.col("size") > 1).alias("connected"),
        of(F.col("size") > 1).alias("connected_nodes"), _r(of(F.col("size") > 1) / F.sum("size")).alias("connected_share"), F.sum("interface_members").alias("interface"), F.count_if(spans).alias("spanning"), of(spans).alias("spanning_nodes"),
        _r(of(spans) / F.sum("size")).alias("spanning_share"), F.max(F.when(spans, F.col("size"))).alias("largest_spanning"), _r(F.max(F.when(spans, F.col("diagonal"))), 4).alias("widest_spanning"),
        F.count_if(F.col("size") >= 100).alias("of_100"), of(F.col("size") >= 100).alias("nodes_of_100"), F.count_if(F.col("size") >= 1000).alias("of_1000"), of(F.col("size") >= 1000).alias("nodes_of_1000"),
    )
    linked = nodes.agg(F.count_if((F.col("component_size") > 1) & F.col("is_interface")).alias("linked_interface"), _r(F.avg("component_size")).alias("mean_size"), F.median("component_size").alias("median_size")).first()
    edges = c.bonds.agg(F.count("*").alias("candidate_pairs"), F.count_if(F.col("f") >= TAU).alias("active_bonds")).first()
    return row.select("*", F.lit(edges["candidate_pairs"]).alias("candidate_pairs"), F.lit(edges["active_bonds"]).alias("active_bonds"), F.lit(TAU).alias("threshold"), *[F.lit(linked[k]).alias(k) for k in ("linked_interface", "mean_size", "median_size")])


query(
    "a33_network_summary",
    _network_summary,
    f"""SELECT CAST(sum(size) AS BIGINT) AS nodes, count(*) AS components, max(size) AS largest, count(*) FILTER (WHERE size = 1) AS isolated, count(*) FILTER (WHERE size > 1) AS connected,
  CAST(coalesce(sum(size) FILTER (WHERE size > 1), 0) AS BIGINT) AS connected_nodes, round(coalesce(sum(size) FILTER (WHERE size > 1), 0) / sum(size), 6) AS connected_share, CAST(sum(interface_members) AS BIGINT) AS interface,
  count(*) FILTER (WHERE category = 'spanning') AS spanning, CAST(coalesce(sum(size) FILTER (WHERE category = 'spanning'), 0) AS BIGINT) AS spanning_nodes, round(coalesce(sum(size) FILTER (WHERE category = 'spanning'), 0) / sum(size), 6) AS spanning_share,
  max(size) FILTER (WHERE category = 'spanning') AS largest_spanning, round(max(diagonal) FILTER (WHERE category = 'spanning'), 4) AS widest_spanning, count(*) FILTER (WHERE size >= 100) AS of_100, CAST(coalesce(sum(size) FILTER (WHERE size >= 100), 0) AS BIGINT) AS nodes_of_100,
  count(*) FILTER (WHERE size >= 1000) AS of_1000, CAST(coalesce(sum(size) FILTER (WHERE size >= 1000), 0) AS BIGINT) AS nodes_of_1000, any_value(candidate_pairs) AS candidate_pairs, any_value(active_bonds) AS active_bonds, CAST({TAU} AS DOUBLE) AS threshold,
  any_value(linked_interface) AS linked_interface, any_value(mean_size) AS mean_size, any_value(median_size) AS median_size
FROM ({_SUMMARY}), (SELECT count(*) AS candidate_pairs, count(*) FILTER (WHERE f >= {TAU}) AS active_bonds FROM bonds),
  (SELECT count(*) FILTER (WHERE component_size > 1 AND is_interface) AS linked_interface, round(avg(component_size), 6) AS mean_size, median(component_size) AS median_size FROM {_NODES})""",
    _EEAT,
)

CELL = 1250


def clusters(c):
    """Components of the links within square cells of the plane, whose sizes vary far more than those of the whole graph."""
    place = lambda k: c.nodes.select(F.col("node").alias(k), F.floor(F.col("x") / CELL).alias(f"p{k}"), F.floor(F.col("y") / CELL).alias(f"q{k}"))
    links = c.bonds.join(place("i"), "i").join(place("j"), "j").where("pi = pj and qi = qj").select("i", "j")
    return L.states(c.nodes, links)


_CLUSTERS = f"SELECT e.i, e.j FROM bonds e JOIN nodes a ON a.node = e.i JOIN nodes b ON b.node = e.j WHERE floor(a.x / {CELL}) = floor(b.x / {CELL}) AND floor(a.y / {CELL}) = floor(b.y / {CELL})"


def _members(c):
    return clusters(c).select("node", "grp", "component_size", (F.col("node") % 7 != 0).alias("assessed"))


_Q6 = ", ".join(f"{i}.0 / 6" for i in range(1, 7))
query(
    "w15_size_classes",
    lambda c: B.size_classes(_members(c)).select("node", "size_class"),
    f"SELECT node, CASE WHEN component_size = 1 THEN 0 ELSE 1 + len(list_filter(u, lambda v: v < component_size)) END AS size_class FROM {_NODES} JOIN (SELECT grp, list_sort(list_distinct(list_transform(quantile_cont(CAST(component_size AS DOUBLE), [{_Q6}]), lambda v: ceil(v)))) AS u FROM {_NODES} WHERE node % 7 <> 0 AND component_size > 1 GROUP BY grp) USING (grp)",
    _CLUSTERS,
)
query(
    "a41_quartile_classes",
    lambda c: B.quartile_classes(_members(c)).groupBy("quartile").agg(F.count("*").alias("n")),
    "SELECT 1 + len(list_filter(e, lambda v: v <= component_size)) AS quartile, count(*) AS n FROM state, (SELECT list_distinct(quantile_cont(component_size, [0.25, 0.5, 0.75])) AS e FROM state) GROUP BY 1",
    _CLUSTERS,
)


def _quartile_examples(c):
    """For each member-weighted size quartile the component nearest to the quartile's median size, wholly inside the window; ties by id."""
    members = B.quartile_classes(_members(c)).join(clusters(c).select("node", "component_id"), "node").join(c.nodes.select("node", "x", "y"), "node")
    target = members.groupBy("quartile").agg(F.median("component_size").alias("target"))
    inside = (F.col("x").between(500, 9500) & F.col("y").between(500, 9500)).cast("int")
    parts = members.groupBy("quartile", "component_id").agg(F.first("component_size").alias("size"), F.min(inside).alias("inside")).where("inside = 1")
    near = parts.join(F.broadcast(target), "quartile")  # four rows
    return near.groupBy("quartile").agg(F.min(F.struct(F.abs(F.col("size") - F.col("target")).alias("gap"), "component_id", "size")).alias("e")).select("quartile", F.col("e.component_id").alias("example"), "e.size")


query(
    "g22_quartile_examples",
    _quartile_examples,
    """SELECT quartile, arg_min(component_id, struct_pack(gap := abs(size - target), id := component_id)) AS example, arg_min(size, struct_pack(gap := abs(size - target), id := component_id)) AS size
FROM (SELECT quartile, component_id, any_value(component_size) AS size FROM (SELECT 1 + len(list_filter(e, lambda v: v <= component_size)) AS quartile, component_id, component_size, x, y FROM nodes JOIN state USING (node), (SELECT list_distinct(quantile_cont(component_size, [0.25, 0.5, 0.75])) AS e FROM state))
  GROUP BY 1, 2 HAVING min(CASE WHEN x BETWEEN 500 AND 9500 AND y BETWEEN 500 AND 9500 THEN 1 ELSE 0 END) = 1)
JOIN (SELECT quartile, median(component_size) AS target FROM (SELECT 1 + len(list_filter(e, lambda v: v <= component_size)) AS quartile, component_size FROM state, (SELECT list_distinct(quantile_cont(component_size, [0.25, 0.5, 0.75])) AS e FROM state)) GROUP BY 1) USING (quartile)
GROUP BY quartile""",
    _CLUSTERS,
)
query(
    "a45_interface_display",
    lambda c: summary(c).where("interface_members > 0 and size >= 2").agg(F.sum("size").alias("members"), _r(1 - F.sum("interface_members") / F.sum("size")).alias("outside_share"), F.max("size").alias("largest")),
    f"SELECT CAST(sum(size) AS BIGINT) AS members, round(1 - sum(interface_members) / sum(size), 6) AS outside_share, max(size) AS largest FROM ({_SUMMARY}) WHERE interface_members > 0 AND size >= 2",
    _EEAT,
)
query(
    "a46_view_summary",
    lambda c: state(c).where("x between 1000 and 8000 and y between 1000 and 8000").agg(F.count("*").alias("in_view"), F.count_if((F.col("component_size") >= 2) & F.col("is_interface")).alias("plus"), F.max("component_size").alias("largest"), _r(F.avg((~F.col("is_interface")).cast("int"))).alias("outside_share")),
    f"SELECT count(*) AS in_view, count(*) FILTER (WHERE component_size >= 2 AND is_interface) AS plus, max(component_size) AS largest, round(avg(CAST(NOT is_interface AS INTEGER)), 6) AS outside_share FROM {_NODES} WHERE x BETWEEN 1000 AND 8000 AND y BETWEEN 1000 AND 8000",
    _EEAT,
)
query("a50_connected_share", lambda c: state(c).groupBy("is_interface").agg(_r(F.avg((F.col("component_size") > 1).cast("int"))).alias("share")), f"SELECT is_interface, round(avg(CAST(component_size > 1 AS INTEGER)), 6) AS share FROM {_NODES} GROUP BY 1", _EEAT)
query(
    "d11_zone_by_size",
    lambda c: state(c).withColumn("bin", B.doubling_bin(F.col("component_size"))).groupBy("is_interface", "bin").agg(F.count("*").alias("members"), F.count_distinct("component_id").alias("components")),
    f"SELECT is_interface, CAST(CASE WHEN component_size > 1 THEN ceil(log2(component_size)) ELSE 0 END AS INTEGER) AS bin, count(*) AS members, count(DISTINCT component_id) AS components FROM {_NODES} GROUP BY 1, 2",
    _EEAT,
)
query(
    "d08_crosswalk_summary",
    lambda c: J.mutual_nearest(_points(c).where("id % 2 = 0"), _points(c).where("id % 2 = 1"), 400.0).agg(F.count("*").alias("matches"), _r(F.median("d")).alias("median"), _r(F.percentile("d", 0.95)).alias("p95")),
    "SELECT count(*) AS matches, round(median(d), 6) AS median, round(quantile_cont(d, 0.95), 6) AS p95 FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY d, b) AS ra, row_number() OVER (PARTITION BY b ORDER BY d, a) AS rb FROM (SELECT p.node AS a, q.node AS b, sqrt((p.x - q.x) ** 2 + (p.y - q.y) ** 2) AS d FROM nodes p, nodes q WHERE p.node % 2 = 0 AND q.node % 2 = 1 AND sqrt((p.x - q.x) ** 2 + (p.y - q.y) ** 2) <= 400)) WHERE ra = 1 AND rb = 1",
)
query(
    "d09_matched_pairs",
    lambda c: B.quantile_bins(c.edges.where("f_ij > 0 and f_ji > 0"), "f_ij", 6).groupBy("bin").agg(F.count("*").alias("n"), _r(F.percentile("f_ji", 0.025)).alias("lo"), _r(F.median("f_ji")).alias("mid"), _r(F.percentile("f_ji", 0.975)).alias("hi")),
    "SELECT greatest(len(list_filter(e, lambda v: v < f_ij)) - 1, 0) AS bin, count(*) AS n, round(quantile_cont(f_ji, 0.025), 6) AS lo, round(median(f_ji), 6) AS mid, round(quantile_cont(f_ji, 0.975), 6) AS hi FROM edges, (SELECT list_sort(list_distinct(quantile_cont(f_ij, [0.0, 1.0 / 6, 2.0 / 6, 3.0 / 6, 4.0 / 6, 5.0 / 6, 1.0]))) AS e FROM edges) GROUP BY 1",
)
query(
    "d12_strongest_emitters",
    lambda c: E.symmetrised(c.edges).join(c.assessed.where("is_destroyed = 1").select(F.col("node").alias("emitter")), "emitter").where("receiver = 7").orderBy(F.desc("vf"), "emitter").limit(5).select("emitter", _r(F.col("vf")).alias("vf")),
    "SELECT emitter, round(vf, 6) AS vf FROM directed WHERE receiver = 7 AND emitter IN (SELECT node FROM assessed WHERE is_destroyed = 1) ORDER BY directed.vf DESC, emitter LIMIT 5",
)
