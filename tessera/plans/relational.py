"""Projections, predicates, joins, aggregates, windows, sorts and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import binning as B
from tessera.operators import edges as E
from tessera.operators import exposure as X
from tessera.operators import joins as J
from tessera.operators import summaries as S
from tessera.plans.base import query


def _r(c, n: int = 6):
    return F.round(c, n)


def _rounded(df, *columns: str, n: int = 6):
    return df.withColumns({c: F.round(F.col(c), n) for c in columns})


# Projections, filters, predicates.
query("p01_bond", lambda c: E.with_bond(c.edges).select("i", "j", "f"), "SELECT i, j, least(1.0, greatest(f_ij, f_ji)) AS f FROM edges")
query("p02_floor", lambda c: c.nodes.select("node", E.floor_zero(F.col("green") - 0.5).alias("v")), "SELECT node, greatest(coalesce(green - 0.5, 0.0), 0.0) AS v FROM nodes")
query(
    "p03_canonical_pair",
    lambda c: c.edges.select(E.first_of(F.col("i").cast("string"), F.col("j").cast("string")).alias("a"), E.last_of(F.col("i").cast("string"), F.col("j").cast("string")).alias("b")),
    "SELECT least(CAST(i AS VARCHAR), CAST(j AS VARCHAR)) AS a, greatest(CAST(i AS VARCHAR), CAST(j AS VARCHAR)) AS b FROM edges",
)


def _asked(c):
    return c.nodes.select(F.col("node").alias("position"), F.col("node").alias("a"), ((F.col("node") * 7 + 3) % 200).alias("b"))


_LOOKUP = """SELECT n.node AS position, n.node AS a, (n.node * 7 + 3) % 200 AS b, CASE WHEN e.i IS NULL THEN 0.0 ELSE least(1.0, greatest(e.f_ij, e.f_ji)) END AS f
FROM nodes n LEFT JOIN edges e ON e.i = least(n.node, (n.node * 7 + 3) % 200) AND e.j = greatest(n.node, (n.node * 7 + 3) % 200)"""
query("p04_no_edge_guard", lambda c: E.pair_lookup(_asked(c), c.edges).where("f = 0").agg(F.count("*").alias("n")), f"SELECT count(*) AS n FROM ({_LOOKUP}) WHERE f = 0")
query("p05_threshold", lambda c: E.at_least(c.edges, 0.06).select("i", "j"), "SELECT i, j FROM edges WHERE greatest(f_ij, f_ji) >= 0.06")
query(
    "p06_distance_range",
    lambda c: c.table("lineitem").where("l_quantity > 0 and l_quantity <= 5 and l_partkey <> l_suppkey").agg(F.count("*").alias("n")),
    "SELECT count(*) AS n FROM lineitem WHERE l_quantity > 0 AND l_quantity <= 5 AND l_partkey <> l_suppkey",
)
query("p07_bbox", lambda c: c.nodes.where(F.col("x").between(1000, 4000) & F.col("y").between(500, 6500)).select("node"), "SELECT node FROM nodes WHERE x BETWEEN 1000 AND 4000 AND y BETWEEN 500 AND 6500")
query("p08_in_list", lambda c: c.table("orders").where(F.col("o_orderstatus").isin("F", "P")).groupBy("o_orderstatus").agg(F.count("*").alias("n")), "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderstatus IN ('F', 'P') GROUP BY 1")
query("p09_touching", lambda c: E.touching(c.edges, c.nodes.where("size = 1")).select("i", "j"), "SELECT i, j FROM edges WHERE i IN (SELECT node FROM nodes WHERE size = 1) OR j IN (SELECT node FROM nodes WHERE size = 1)")
query(
    "p10_decode",
    lambda c: c.assessed.select("node", F.create_map(F.lit("destroyed"), F.lit(3), F.lit("partial"), F.lit(2))[F.col("outcome")].alias("level")).withColumn("level", F.coalesce("level", F.lit(0))),
    "SELECT node, CASE outcome WHEN 'destroyed' THEN 3 WHEN 'partial' THEN 2 ELSE 0 END AS level FROM assessed",
)
query(
    "p11_pooling",
    lambda c: c.nodes.select("node", F.when(S.unknown_value(F.col("eaves")), "Unknown").otherwise(F.col("eaves")).alias("pooled")),
    "SELECT node, CASE WHEN eaves IS NULL OR lower(trim(eaves)) IN ('', 'unknown', 'nan', 'none') THEN 'Unknown' ELSE eaves END AS pooled FROM nodes",
)
query("p12_flags", lambda c: c.nodes.select("node", (F.col("green") > 0).cast("int").alias("exposed"), _r(F.when(F.col("green") > 0, F.log("green"))).alias("log_green")), "SELECT node, CAST(green > 0 AS INTEGER) AS exposed, round(CASE WHEN green > 0 THEN ln(green) END, 6) AS log_green FROM nodes")
query(
    "p13_stable_id",
    lambda c: c.nodes.select(
        "node", F.when(F.col("source_id").isNotNull() & (F.col("source_id") != "None") & (F.count("*").over(Window.partitionBy("source_id")) == 1), F.col("source_id")).otherwise(F.concat(F.lit("graph:"), F.col("node").cast("string"))).alias("stable_id")
    ),
    "SELECT node, CASE WHEN source_id IS NOT NULL AND source_id <> 'None' AND count(*) OVER (PARTITION BY source_id) = 1 THEN source_id ELSE concat('graph:', CAST(node AS VARCHAR)) END AS stable_id FROM nodes",
)
query(
    "p14_grid_cell",
    lambda c: c.nodes.select("node", F.concat_ws("_", F.rint(F.col("y") / 250).cast("long").cast("string"), F.rint(F.col("x") / 250).cast("long").cast("string")).alias("cell")),
    "SELECT node, concat(CAST(CAST(round_even(y / 250, 0) AS BIGINT) AS VARCHAR), '_', CAST(CAST(round_even(x / 250, 0) AS BIGINT) AS VARCHAR)) AS cell FROM nodes",
)
query(
    "p15_block_key",
    lambda c: c.nodes.select("node", F.concat_ws(":", "grp", F.floor(F.col("x") / 250).cast("string"), F.floor(F.col("y") / 250).cast("string")).alias("block")),
    "SELECT node, concat(grp, ':', CAST(CAST(floor(x / 250) AS BIGINT) AS VARCHAR), ':', CAST(CAST(floor(y / 250) AS BIGINT) AS VARCHAR)) AS block FROM nodes",
)
query("p16_unknown", lambda c: c.nodes.where(S.unknown_value(F.col("eaves"))).select("node"), "SELECT node FROM nodes WHERE eaves IS NULL OR lower(trim(eaves)) IN ('', 'unknown', 'nan', 'none')")
query(
    "p17_scaling",
    lambda c: c.nodes.join(F.broadcast(c.nodes.agg(F.percentile("green", 0.75).alias("q3"), F.percentile("green", 0.25).alias("q1"), F.median("year_built").alias("m")))).select("node", _r(F.col("green") / (F.col("q3") - F.col("q1"))).alias("green_iqr"), _r((F.col("year_built") - F.col("m")) / 10).alias("decade")),
    "SELECT node, round(green / (SELECT quantile_cont(green, 0.75) - quantile_cont(green, 0.25) FROM nodes), 6) AS green_iqr, round((year_built - (SELECT median(year_built) FROM nodes)) / 10, 6) AS decade FROM nodes",
)
query(
    "p18_centering",
    lambda c: c.assessed.where("is_destroyed = 0").join(F.broadcast(c.assessed.where("is_destroyed = 1").agg(F.avg("price").alias("m")))).select("node", _r(F.col("price") - F.col("m"), 4).alias("centred")),
    "SELECT node, round(price - (SELECT avg(price) FROM assessed WHERE is_destroyed = 1), 4) AS centred FROM assessed WHERE is_destroyed = 0",
)
query("p19_complete_cases", lambda c: c.nodes.na.drop(subset=["green", "year_built", "arrival"]).select("node"), "SELECT node FROM nodes WHERE green IS NOT NULL AND year_built IS NOT NULL AND arrival IS NOT NULL")
query(
    "p20_sample_flow",
    lambda c: c.assessed.agg(F.count("*").alias("assessed"), F.count_if(F.col("green") > 0).alias("exposed"), F.count_if((F.col("green") > 0) & (F.col("defended") == 0)).alias("undefended"), F.count_if((F.col("green") > 0) & (F.col("defended") == 0) & F.col("year_built").isNotNull()).alias("complete")),
    "SELECT count(*) AS assessed, count(*) FILTER (WHERE green > 0) AS exposed, count(*) FILTER (WHERE green > 0 AND defended = 0) AS undefended, count(*) FILTER (WHERE green > 0 AND defended = 0 AND year_built IS NOT NULL) AS complete FROM assessed",
)
query(
    "p22_category",
    lambda c: c.nodes.select("node", F.when(F.col("size") == 1, "isolated").when(F.col("is_interface") & (F.col("size") > 20), "spanning").otherwise("other").alias("category")),
    "SELECT node, CASE WHEN size = 1 THEN 'isolated' WHEN is_interface AND size > 20 THEN 'spanning' ELSE 'other' END AS category FROM nodes",
)
query(
    "p23_roles",
    lambda c: c.nodes.join(c.assessed.where("is_destroyed = 1").select("node", F.lit(True).alias("hit")), "node", "left").select("node", F.when(F.col("defended") == 1, "defended").when(F.col("hit"), "control").when(F.col("defended") == 0, "unmatched").otherwise("other").alias("role")),
    "SELECT node, CASE WHEN defended = 1 THEN 'defended' WHEN node IN (SELECT node FROM assessed WHERE is_destroyed = 1) THEN 'control' WHEN defended = 0 THEN 'unmatched' ELSE 'other' END AS role FROM nodes",
)
query(
    "p24_strata",
    lambda c: c.nodes.where("green is not null").join(F.broadcast(B.quantile_edges(c.nodes.where("green > 0"), "green", [0.25, 0.5, 0.75]))).select("node", F.when(F.col("green") <= 0, 0).otherwise(1 + B.upto(F.col("edges"), F.col("green"))).alias("stratum")),
    "SELECT node, CASE WHEN green <= 0 THEN 0 ELSE 1 + len(list_filter((SELECT list_distinct(quantile_cont(green, [0.25, 0.5, 0.75])) FROM nodes WHERE green > 0), lambda e: e <= green)) END AS stratum FROM nodes WHERE green IS NOT NULL",
)

# Joins.
query("j01_induced", lambda c: E.induced(c.edges, c.nodes.where("grp = 'A'")).select("i", "j"), "SELECT i, j FROM edges WHERE i IN (SELECT node FROM nodes WHERE grp = 'A') AND j IN (SELECT node FROM nodes WHERE grp = 'A')")
query(
    "j02_mapped",
    lambda c: c.edges.join(c.nodes.select(F.col("node").alias("i"), F.col("grp").alias("gi")), "i").join(c.nodes.select(F.col("node").alias("j"), F.col("grp").alias("gj")), "j").groupBy("gi", "gj").agg(F.count("*").alias("n")),
    "SELECT a.grp AS gi, b.grp AS gj, count(*) AS n FROM edges e JOIN nodes a ON a.node = e.i JOIN nodes b ON b.node = e.j GROUP BY 1, 2",
)
_DOSE = """SELECT r.node, round(coalesce(sum(d.vf) FILTER (WHERE s.outcome = 'destroyed'), 0), 6) AS dose_sum, round(coalesce(max(d.vf) FILTER (WHERE s.outcome = 'destroyed'), 0), 6) AS dose_max,
  round(coalesce(sum(d.vf) FILTER (WHERE s.outcome = 'partial'), 0), 6) AS f_partial, round(coalesce(sum(d.vf) FILTER (WHERE s.outcome = 'no_damage'), 0), 6) AS f_none,
  round(coalesce(sum(d.vf), 0), 6) AS f_total, count(d.emitter) AS neighbors, count(s.node) AS known_neighbors, count(DISTINCT d.emitter) FILTER (WHERE s.outcome = 'destroyed') AS n_destroyed
FROM assessed r LEFT JOIN directed d ON d.receiver = r.node LEFT JOIN assessed s ON s.node = d.emitter AND s.grp = r.grp GROUP BY r.node"""


def dose(c):
    found = X.dose(c.assessed, c.edges)
    return _rounded(found.drop("exposed", "log_dose"), "dose_sum", "dose_max", "f_partial", "f_none", "f_total")


query("d01_dose", dose, _DOSE)
query("j03_dose_join", lambda c: dose(c).select("node", "neighbors", "known_neighbors", "n_destroyed"), f"SELECT node, neighbors, known_neighbors, n_destroyed FROM ({_DOSE})")
_DOSE2 = """SELECT m.graph_id, m.source_id, m.is_destroyed, coalesce(d.neighbors, 0) AS neighbors, coalesce(d.known_neighbors, 0) AS known_neighbors, coalesce(d.n_destroyed, 0) AS n_destroyed,
  round(coalesce(d.dose_sum, 0), 6) AS dose_sum, round(coalesce(d.dose_max, 0), 6) AS dose_max
FROM matched m LEFT JOIN (SELECT r.graph_id, count(d.emitter) AS neighbors, count(e.graph_id) AS known_neighbors, count(*) FILTER (WHERE e.is_destroyed = 1) AS n_destroyed,
    sum(CASE WHEN e.is_destroyed = 1 THEN d.vf ELSE 0 END) AS dose_sum, max(CASE WHEN e.is_destroyed = 1 THEN d.vf ELSE 0 END) AS dose_max
  FROM matched r LEFT JOIN (SELECT i AS emitter, j AS receiver, f_ij AS vf FROM edges UNION ALL SELECT j, i, f_ji FROM edges) d ON r.graph_id = d.receiver LEFT JOIN matched e ON d.emitter = e.graph_id GROUP BY r.graph_id) d USING (graph_id)"""
_MATCHED = "SELECT * FROM (WITH matched AS (SELECT m.node AS graph_id, a.source_id, a.is_destroyed FROM assessed a JOIN nodes m ON a.source_id = m.source_id AND m.source_id <> 'None') {})"
query("d02_dose_by_source", lambda c: _rounded(X.dose_by_source(c.assessed.select("source_id", "is_destroyed"), c.nodes.where("source_id <> 'None'").select("node", "source_id"), c.edges), "dose_sum", "dose_max"), _MATCHED.format(_DOSE2))
query(
    "j04_non_unique_map",
    lambda c: c.assessed.select("source_id", "is_destroyed").join(c.nodes.where("source_id <> 'None'").select("source_id", F.col("node").alias("graph_id")), "source_id").groupBy("graph_id").agg(F.count("*").alias("n")),
    "SELECT m.node AS graph_id, count(*) AS n FROM assessed a JOIN nodes m ON a.source_id = m.source_id AND m.source_id <> 'None' GROUP BY 1",
)
query(
    "j05_crosswalk",
    lambda c: _crosswalk(c),
    "SELECT m.a, m.b, round(m.f, 6) AS f2, round(g.f, 6) AS f3 FROM (SELECT least(e.i, e.j) * 2 AS a, greatest(e.i, e.j) * 2 AS b, f FROM bonds e WHERE e.i IN (SELECT node FROM nodes) AND e.j IN (SELECT node FROM nodes)) m JOIN bonds g ON g.i = m.a AND g.j = m.b",
)


def _crosswalk(c):
    cw = c.nodes.select(F.col("node").alias("one"), (F.col("node") * 2).alias("two"))
    moved = c.bonds.join(cw.withColumnsRenamed({"one": "i", "two": "a"}), "i").join(cw.withColumnsRenamed({"one": "j", "two": "b"}), "j").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.col("f").alias("f2"))
    return moved.join(c.bonds.withColumnsRenamed({"i": "a", "j": "b", "f": "f3"}), ["a", "b"]).select("a", "b", _r(F.col("f2")).alias("f2"), _r(F.col("f3")).alias("f3"))


query("j06_semi", lambda c: c.nodes.join(c.assessed.where("is_destroyed = 1"), "node", "left_semi").select("node"), "SELECT node FROM nodes WHERE node IN (SELECT node FROM assessed WHERE is_destroyed = 1)")
query("j07_anti", lambda c: c.nodes.join(c.assessed, "node", "left_anti").select("node"), "SELECT node FROM nodes n WHERE NOT EXISTS (SELECT 1 FROM assessed a WHERE a.node = n.node)")
query(
    "j08_full_outer",
    lambda c: c.nodes.where("source_id is not null").select("node", F.lit(1).alias("l")).join(c.assessed.select("node", F.lit(1).alias("r")), "node", "full").agg(F.count_if(F.col("r").isNull()).alias("only_left"), F.count_if(F.col("l").isNull()).alias("only_right"), F.count("*").alias("n")),
    "SELECT count(*) FILTER (WHERE r IS NULL) AS only_left, count(*) FILTER (WHERE l IS NULL) AS only_right, count(*) AS n FROM (SELECT node, 1 AS l FROM nodes WHERE source_id IS NOT NULL) FULL JOIN (SELECT node, 1 AS r FROM assessed) USING (node)",
)
query("j09_checked_join", lambda c: J.checked_join(c.nodes.select("node"), c.assessed.select("node", "outcome"), ["node"], "left", "one_to_one"), "SELECT n.node, a.outcome FROM nodes n LEFT JOIN assessed a USING (node)")
query(
    "j10_suffixes",
    lambda c: c.nodes.alias("l").join(c.assessed.alias("r"), "node").select("node", F.col("l.size").alias("size_x"), (F.col("r.size") * 2).alias("size_y")),
    "SELECT n.node, n.size AS size_x, a.size * 2 AS size_y FROM nodes n JOIN assessed a USING (node)",
)
query("j11_pair_lookup", lambda c: E.pair_lookup(_asked(c), c.edges), _LOOKUP)
_TIMED = "(SELECT f.node, s.node AS neighbor, f.grp, d.vf, s.arrival - f.arrival AS dt, s.defended, s.is_destroyed, s.any_damage FROM directed d JOIN assessed f ON f.node = d.receiver JOIN assessed s ON s.node = d.emitter AND s.grp = f.grp WHERE abs(s.arrival - f.arrival) <= 3 AND s.arrival <> f.arrival)"


def _timed(c):
    return X.timed_edges(c.assessed.select("node", "grp", "arrival", "defended", "is_destroyed", "any_damage"), c.edges, 3.0)


query("j12_time_band", lambda c: _rounded(_timed(c), "vf", "dt").select("node", "neighbor", "vf", "dt"), f"SELECT node, neighbor, round(vf, 6) AS vf, round(dt, 6) AS dt FROM {_TIMED}")


def _points(c, where: str):
    return c.nodes.where(where).select(F.col("node").alias("id"), "x", "y")


_NEAR = "SELECT p.node AS a, q.node AS b, sqrt((p.x - q.x) ** 2 + (p.y - q.y) ** 2) AS d FROM nodes p, nodes q WHERE p.node % 2 = 0 AND q.node % 2 = 1 AND sqrt((p.x - q.x) ** 2 + (p.y - q.y) ** 2) <= 400"
query(
    "j13_mutual_nearest",
    lambda c: _rounded(J.mutual_nearest(_points(c, "node % 2 = 0"), _points(c, "node % 2 = 1"), 400.0), "d"),
    f"SELECT a, b, round(d, 6) AS d FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY d, b) AS ra, row_number() OVER (PARTITION BY b ORDER BY d, a) AS rb FROM ({_NEAR})) WHERE ra = 1 AND rb = 1",
)
query(
    "j14_nearest_affected",
    lambda c: _rounded(J.nearest_other(_points(c, "true"), c.assessed.where("is_destroyed = 1").select(F.col("node").alias("id"), "x", "y"), 200.0), "d"),
    "SELECT n.node AS id, round(min(sqrt((n.x - a.x) ** 2 + (n.y - a.y) ** 2)), 6) AS d FROM nodes n LEFT JOIN assessed a ON a.is_destroyed = 1 AND a.node <> n.node GROUP BY 1",
)
query(
    "j15_nearest_other_treated",
    lambda c: _rounded(J.nearest_other(_points(c, "defended = 1"), _points(c, "defended = 1"), 200.0), "d"),
    "SELECT n.node AS id, round(min(sqrt((n.x - a.x) ** 2 + (n.y - a.y) ** 2)), 6) AS d FROM nodes n LEFT JOIN nodes a ON a.defended = 1 AND a.node <> n.node WHERE n.defended = 1 GROUP BY 1",
)
query(
    "j17_within_distance",
    lambda c: _rounded(J.within_distance(_points(c, "true"), _points(c, "true"), 150.0).where("a < b"), "d"),
    "SELECT p.node AS a, q.node AS b, round(sqrt((p.x - q.x) ** 2 + (p.y - q.y) ** 2), 6) AS d FROM nodes p JOIN nodes q ON p.node < q.node AND sqrt((p.x - q.x) ** 2 + (p.y - q.y) ** 2) <= 150",
)


def footprints(c):
    """Upright rectangles around the nodes' places, wider and higher with the size."""
    w, h = F.col("size") + 5.0, F.col("size") / 2 + 5.0
    corner = lambda i, j: F.struct((F.col("x") + i * w).alias("x"), (F.col("y") + j * h).alias("y"))
    return c.nodes.select(F.col("node").alias("id"), "x", "y", F.array(corner(-1, -1), corner(1, -1), corner(1, 1), corner(-1, 1), corner(-1, -1)).alias("ring"))


_GAP = "sqrt(greatest(0, abs(p.x - q.x) - p.size - q.size - 10) ** 2 + greatest(0, abs(p.y - q.y) - p.size / 2 - q.size / 2 - 10) ** 2)"
query(
    "j17_footprints",
    lambda c: _rounded(J.within_polygon_distance(footprints(c), footprints(c), 60.0).where("a < b"), "d"),
    f"SELECT p.node AS a, q.node AS b, round({_GAP}, 6) AS d FROM nodes p JOIN nodes q ON p.node < q.node AND {_GAP} <= 60",
)
query(
    "j22_footprint_distance",
    lambda c: c.bonds.where("f >= 0.06").join(footprints(c).select(F.col("id").alias("i"), F.col("ring").alias("ri")), "i").join(footprints(c).select(F.col("id").alias("j"), F.col("ring").alias("rj")), "j").select("i", "j", _r(J.polygon_distance(F.col("ri"), F.col("rj"))).alias("d")),
    f"SELECT i, j, round({_GAP}, 6) AS d FROM bonds JOIN nodes p ON p.node = i JOIN nodes q ON q.node = j WHERE f >= 0.06",
)
query(
    "j18_zone_by_priority",
    lambda c: J.zone_of(_points(c, "true"), c.zones, 1000.0).select("id", "zone"),
    "SELECT node AS id, CASE WHEN x >= 4000 AND x < 7000 AND y >= 4000 AND y < 8000 THEN 'Interface' WHEN x >= 3000 AND x < 9000 AND y >= 2000 AND y < 5000 THEN 'Intermix' WHEN x >= 500 AND x < 6000 AND y >= 500 AND y < 6000 THEN 'Influence' ELSE 'Outside' END AS zone FROM nodes",
)
query(
    "j19_zone_counts",
    lambda c: J.zone_of(_points(c, "true"), c.zones, 1000.0).groupBy("zone").agg(F.count("*").alias("n")),
    "SELECT CASE WHEN x >= 4000 AND x < 7000 AND y >= 4000 AND y < 8000 THEN 'Interface' WHEN x >= 3000 AND x < 9000 AND y >= 2000 AND y < 5000 THEN 'Intermix' WHEN x >= 500 AND x < 6000 AND y >= 500 AND y < 6000 THEN 'Influence' ELSE 'Outside' END AS zone, count(*) AS n FROM nodes GROUP BY 1",
)
query(
    "j20_inside_perimeter",
    lambda c: _points(c, "true").join(F.broadcast(c.zones.where("priority = 1").select("ring"))).where(J.inside(F.col("x"), F.col("y"), F.col("ring"))).select("id"),
    "SELECT node AS id FROM nodes WHERE x >= 500 AND x < 6000 AND y >= 500 AND y < 6000",
)
query(
    "j21_nearest_boundary",
    lambda c: _points(c, "true").select("id", _r(F.least(*[J.segment_distance(F.col("x"), F.col("y"), *[F.lit(float(v)) for v in s]) for s in ((500, 500, 6000, 500), (6000, 500, 6000, 6000), (6000, 6000, 500, 6000), (500, 6000, 500, 500))])).alias("d")),
    "SELECT node AS id, round(CASE WHEN x BETWEEN 500 AND 6000 AND y BETWEEN 500 AND 6000 THEN least(x - 500, 6000 - x, y - 500, 6000 - y) ELSE sqrt(greatest(500 - x, 0, x - 6000) ** 2 + greatest(500 - y, 0, y - 6000) ** 2) END, 6) AS d FROM nodes",
)
query(
    "j22_pair_distance",
    lambda c: c.bonds.where("f >= 0.06").join(c.nodes.select(F.col("node").alias("i"), F.col("x").alias("xi"), F.col("y").alias("yi")), "i").join(c.nodes.select(F.col("node").alias("j"), F.col("x").alias("xj"), F.col("y").alias("yj")), "j").select("i", "j", _r(J.distance(F.col("xi"), F.col("yi"), F.col("xj"), F.col("yj"))).alias("d")),
    "SELECT e.i, e.j, round(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2), 6) AS d FROM bonds e JOIN nodes a ON a.node = e.i JOIN nodes b ON b.node = e.j WHERE e.f >= 0.06",
)
query(
    "j23_left_aggregate",
    lambda c: c.nodes.join(c.bonds.where("f >= 0.08").groupBy(F.col("i").alias("node")).agg(F.count("*").alias("n")), "node", "left").select("node", F.coalesce("n", F.lit(0)).alias("n")),
    "SELECT node, coalesce(n, 0) AS n FROM nodes LEFT JOIN (SELECT i AS node, count(*) AS n FROM bonds WHERE f >= 0.08 GROUP BY 1) USING (node)",
)
#: Walls that block the view, as x0, y0, x1, y1: upright or level.
WALLS = ((3000.0, 2000.0, 3000.0, 7000.0), (5000.0, 5000.0, 9000.0, 5000.0))


def _facing(c):
    """For each node the nodes in range that face it as it faces them, and those of them in sight past all walls."""
    angle = F.radians((F.col("node") * 37 % 360).cast("double"))
    faces = c.nodes.select(F.col("node").alias("id"), "x", "y", F.cos(angle).alias("u"), F.sin(angle).alias("v"))
    return J.facing_within(faces, 1500.0, WALLS).withColumnRenamed("id", "a")


_W, _L = WALLS
query(
    "j24_facing_points",
    _facing,
    f"""SELECT a, count(*) AS facing, count(*) FILTER (WHERE NOT (((xa - {_W[0]}) * (xb - {_W[0]}) < 0 AND ya + (yb - ya) * ({_W[0]} - xa) / (CASE WHEN xb = xa THEN NULL ELSE xb - xa END) BETWEEN {_W[1]} AND {_W[3]}) IS TRUE
  OR ((ya - {_L[1]}) * (yb - {_L[1]}) < 0 AND xa + (xb - xa) * ({_L[1]} - ya) / (CASE WHEN yb = ya THEN NULL ELSE yb - ya END) BETWEEN {_L[0]} AND {_L[2]}) IS TRUE)) AS visible
FROM (SELECT p.node AS a, p.x AS xa, p.y AS ya, q.x AS xb, q.y AS yb, cos(radians(p.node * 37 % 360)) AS ua, sin(radians(p.node * 37 % 360)) AS va, cos(radians(q.node * 37 % 360)) AS ub, sin(radians(q.node * 37 % 360)) AS vb
  FROM nodes p JOIN nodes q ON q.node <> p.node AND sqrt((p.x - q.x) ** 2 + (p.y - q.y) ** 2) <= 1500)
WHERE (xb - xa) * ua + (yb - ya) * va > 0 AND (xa - xb) * ub + (ya - yb) * vb > 0 GROUP BY a""",
)


def _top_pairs(c):
    """The two strongest emitters of each receiver with the places of both ends; pairs without a stored place are left out."""
    place = lambda k: c.nodes.where("source_id is not null").select(F.col("node").alias(k), F.col("x").alias(f"x_{k}"), F.col("y").alias(f"y_{k}"))
    ranked = E.symmetrised(c.edges).withColumn("rank", F.row_number().over(Window.partitionBy("receiver").orderBy(F.desc("vf"), "emitter"))).where("rank <= 2")
    return ranked.join(place("emitter"), "emitter").join(place("receiver"), "receiver").select("receiver", "emitter", "rank", "x_emitter", "y_emitter", "x_receiver", "y_receiver")


query(
    "j26_top_pairs",
    _top_pairs,
    """SELECT receiver, emitter, rank, e.x AS x_emitter, e.y AS y_emitter, r.x AS x_receiver, r.y AS y_receiver FROM (SELECT *, row_number() OVER (PARTITION BY receiver ORDER BY vf DESC, emitter) AS rank FROM directed)
  JOIN nodes e ON e.node = emitter AND e.source_id IS NOT NULL JOIN nodes r ON r.node = receiver AND r.source_id IS NOT NULL WHERE rank <= 2""",
)

# Aggregates.
query(
    "a01_pair_collapse",
    lambda c: _rounded(E.collapse_pairs(c.table("lineitem"), "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"), "weight", "distance", n=4),
    "SELECT least(l_partkey, l_suppkey) AS i, greatest(l_partkey, l_suppkey) AS j, round(max(l_quantity), 4) AS weight, round(min(l_extendedprice), 4) AS distance FROM lineitem WHERE l_partkey <> l_suppkey GROUP BY 1, 2",
)
query(
    "a02_filtered_aggregates",
    lambda c: c.assessed.groupBy("grp").agg(F.expr("coalesce(sum(price) filter (where is_destroyed = 1), 0)").alias("s"), F.expr("count(distinct kind) filter (where any_damage = 1)").alias("kinds"), F.expr("max(size) filter (where defended = 1)").alias("m")).select("grp", _r(F.col("s"), 3).alias("s"), "kinds", "m"),
    "SELECT grp, round(coalesce(sum(price) FILTER (WHERE is_destroyed = 1), 0), 3) AS s, count(DISTINCT kind) FILTER (WHERE any_damage = 1) AS kinds, max(size) FILTER (WHERE defended = 1) AS m FROM assessed GROUP BY grp",
)
query(
    "a03_case_sums",
    lambda c: c.assessed.groupBy("kind").agg(_r(F.sum(F.when(F.col("is_destroyed") == 1, F.col("price")).otherwise(0.0)), 3).alias("s"), F.max(F.when(F.col("defended") == 1, F.col("size")).otherwise(0)).alias("m")),
    "SELECT kind, round(sum(CASE WHEN is_destroyed = 1 THEN price ELSE 0 END), 3) AS s, max(CASE WHEN defended = 1 THEN size ELSE 0 END) AS m FROM assessed GROUP BY kind",
)
query("a04_any_value", lambda c: c.nodes.groupBy("node").agg(F.any_value("grp", True).alias("grp"), F.min("size").alias("m")), "SELECT node, any_value(grp) AS grp, min(size) AS m FROM nodes GROUP BY node")
query("a05_bool_or", lambda c: E.incidence(c.edges.withColumn("f", F.lit(0.0)), "contact").groupBy("node").agg(F.bool_or("contact").alias("contact")), "SELECT node, bool_or(contact) AS contact FROM (SELECT i AS node, contact FROM edges UNION ALL SELECT j, contact FROM edges) GROUP BY node")
query(
    "a06_having",
    lambda c: E.ranked_incidence(c.bonds, 2).groupBy("node").agg(F.count("*").alias("k"), F.sum("f").alias("s")).where("k = 2 and s >= 0.12").select("node"),
    "SELECT node FROM (SELECT node, f, row_number() OVER (PARTITION BY node ORDER BY f DESC, neighbor) AS r FROM inc) WHERE r <= 2 GROUP BY node HAVING count(*) = 2 AND sum(f) >= 0.12",
)
query(
    "a07_regression_scalars",
    lambda c: c.edges.agg(F.count("*").alias("n"), _r(F.corr("f_ij", "f_ji")).alias("r"), _r(F.regr_slope("f_ji", "f_ij")).alias("slope"), _r(F.regr_intercept("f_ji", "f_ij")).alias("intercept"), _r(F.median("f_ij")).alias("median")),
    "SELECT count(*) AS n, round(corr(f_ij, f_ji), 6) AS r, round(regr_slope(f_ji, f_ij), 6) AS slope, round(regr_intercept(f_ji, f_ij), 6) AS intercept, round(median(f_ij), 6) AS median FROM edges",
)
query("a08_weighted_centroid", lambda c: c.nodes.groupBy("grp").agg(_r(F.sum(F.col("x") * F.col("size")) / F.sum("size"), 4).alias("cx"), _r(F.sum(F.col("y") * F.col("size")) / F.sum("size"), 4).alias("cy")), "SELECT grp, round(sum(x * size) / sum(size), 4) AS cx, round(sum(y * size) / sum(size), 4) AS cy FROM nodes GROUP BY grp")
query(
    "a10_population",
    lambda c: c.assessed.groupBy("grp").agg(F.count("*").alias("n"), F.count_if(F.col("is_destroyed") == 1).alias("destroyed"), F.count_if(F.col("green") > 0.5).alias("green"), F.median("year_built").alias("year")),
    "SELECT grp, count(*) AS n, count(*) FILTER (WHERE is_destroyed = 1) AS destroyed, count(*) FILTER (WHERE green > 0.5) AS green, median(year_built) AS year FROM assessed GROUP BY grp",
)
query(
    "a11_crosstab_margins",
    lambda c: c.assessed.cube("grp", "outcome").agg(F.count("*").alias("n")).select(F.coalesce("grp", F.lit("All")).alias("grp"), F.coalesce("outcome", F.lit("All")).alias("outcome"), "n"),
    "SELECT coalesce(grp, 'All') AS grp, coalesce(outcome, 'All') AS outcome, count(*) AS n FROM assessed GROUP BY CUBE (assessed.grp, assessed.outcome)",
)
query(
    "a12_pooled",
    lambda c: S.with_pooled(c.assessed, "grp", ["outcome"], [F.count("*").alias("n"), F.round(F.avg("price"), 8).alias("m")]),
    "SELECT CASE WHEN grouping(assessed.grp) = 1 THEN 'POOLED' ELSE assessed.grp END AS grp, outcome, count(*) AS n, round(avg(price), 8) AS m FROM assessed GROUP BY GROUPING SETS ((assessed.grp, outcome), (outcome))",
)
query(
    "a13_shares_unstacked",
    lambda c: c.assessed.groupBy("grp").pivot("outcome", ["destroyed", "partial", "no_damage"]).count().na.fill(0).withColumn("t", F.col("destroyed") + F.col("partial") + F.col("no_damage")).select("grp", *[_r(F.col(k) / F.col("t")).alias(k) for k in ("destroyed", "partial", "no_damage")]),
    "SELECT grp, round(avg(CAST(outcome = 'destroyed' AS INTEGER)), 6) AS destroyed, round(avg(CAST(outcome = 'partial' AS INTEGER)), 6) AS partial, round(avg(CAST(outcome = 'no_damage' AS INTEGER)), 6) AS no_damage FROM assessed GROUP BY grp",
)
query(
    "a14_category_product",
    lambda c: _rounded(S.category_counts(c.nodes.where("size <= 3"), c.nodes.select("kind").distinct(), c.nodes.select("eaves").where("eaves in ('open', 'boxed')").distinct(), "kind", "eaves"), "share"),
    "SELECT k.kind, e.eaves, count(n.node) AS n, round(coalesce(count(n.node) / nullif(sum(count(n.node)) OVER (PARTITION BY k.kind), 0), 0), 6) AS share FROM (SELECT DISTINCT kind FROM nodes) k CROSS JOIN (SELECT DISTINCT eaves FROM nodes WHERE eaves IN ('open', 'boxed')) e LEFT JOIN nodes n ON n.kind = k.kind AND n.eaves = e.eaves AND n.size <= 3 GROUP BY 1, 2",
)
query("a15_group_means", lambda c: c.assessed.groupBy("kind").agg(_r(F.avg("green")).alias("m"), F.count("*").alias("n"), F.count("green").alias("known")), "SELECT kind, round(avg(green), 6) AS m, count(*) AS n, count(green) AS known FROM assessed GROUP BY kind")
query(
    "a16_both_sides",
    lambda c: _timed(c).groupBy("node").agg(F.sum((F.col("dt") < 0).cast("int")).alias("up"), F.sum((F.col("dt") > 0).cast("int")).alias("down")).where("up > 0 and down > 0"),
    f"SELECT node, CAST(sum(CAST(dt < 0 AS INTEGER)) AS BIGINT) AS up, CAST(sum(CAST(dt > 0 AS INTEGER)) AS BIGINT) AS down FROM {_TIMED} GROUP BY node HAVING sum(CAST(dt < 0 AS INTEGER)) > 0 AND sum(CAST(dt > 0 AS INTEGER)) > 0",
)
query(
    "a17_quantiles",
    lambda c: c.nodes.agg(*[_r(F.percentile("price", p)).alias(f"q{int(1000 * p)}") for p in (0.025, 0.25, 0.5, 0.975)]),
    "SELECT round(quantile_cont(price, 0.025), 6) AS q25, round(quantile_cont(price, 0.25), 6) AS q250, round(quantile_cont(price, 0.5), 6) AS q500, round(quantile_cont(price, 0.975), 6) AS q975 FROM nodes",
)
query(
    "a18_spreads",
    lambda c: c.nodes.groupBy("grp").agg(_r(F.stddev_samp("price"), 4).alias("sd"), _r(F.var_pop("size"), 6).alias("vp"), _r(F.stddev_pop("green")).alias("sp"), _r(F.var_samp("size")).alias("vs")),
    "SELECT grp, round(stddev_samp(price), 4) AS sd, round(var_pop(size), 6) AS vp, round(stddev_pop(green), 6) AS sp, round(var_samp(size), 6) AS vs FROM nodes GROUP BY grp",
)
query("a19_geometric_mean", lambda c: c.nodes.groupBy("kind").agg(_r(F.exp(F.avg(F.log("price"))), 4).alias("g")), "SELECT kind, round(exp(avg(ln(price))), 4) AS g FROM nodes GROUP BY kind")


def _wilson(c):
    k = c.assessed.groupBy("kind").agg(F.sum("is_destroyed").alias("k"), F.count("*").alias("n"))
    lo, hi = S.wilson(F.col("k").cast("double"), F.col("n").cast("double"))
    return k.select("kind", _r(lo).alias("lo"), _r(hi).alias("hi"))


_W = "SELECT {g}, round(least((p + 3.841458820694124 / (2 * n)) / (1 + 3.841458820694124 / n) - h, p), 6) AS lo, round(greatest((p + 3.841458820694124 / (2 * n)) / (1 + 3.841458820694124 / n) + h, p), 6) AS hi FROM (SELECT *, 1.959963984540054 * sqrt(p * (1 - p) / n + 3.841458820694124 / (4.0 * n * n)) / (1 + 3.841458820694124 / n) AS h FROM (SELECT {g}, avg(is_destroyed) AS p, CAST(count(*) AS DOUBLE) AS n FROM assessed GROUP BY {g}))"
query("a20_wilson", _wilson, _W.format(g="kind"))
query(
    "a21_clustered_se",
    lambda c: _rounded(S.clustered_se(c.assessed.withColumn("v", F.col("is_destroyed").cast("double")), "v", "kind"), "mean", "se"),
    "SELECT round(any_value(m), 6) AS mean, count(*) AS clusters, round(sqrt(count(*) / (count(*) - 1.0) * sum(u * u) / (any_value(n) ** 2)), 6) AS se FROM (SELECT kind, sum(is_destroyed - m) AS u, any_value(m) AS m, any_value(n) AS n FROM assessed, (SELECT avg(is_destroyed) AS m, CAST(count(*) AS DOUBLE) AS n FROM assessed) GROUP BY kind)",
)
query(
    "a22_entropy",
    lambda c: _rounded(S.mean_entropy(c.assessed, "kind"), "entropy"),
    "SELECT CAST(sum(n) AS BIGINT) AS members, round(sum(n * CASE WHEN p <= 0 OR p >= 1 THEN 0 ELSE -(p * log2(p) + (1 - p) * log2(1 - p)) END) / sum(n), 6) AS entropy FROM (SELECT kind, count(*) AS n, avg(is_destroyed) AS p FROM assessed GROUP BY kind HAVING count(*) >= 2)",
)


def _binned(c):
    rows = B.quantile_bins(c.assessed.where("price > 0 and green > 0").withColumn("lx", F.log("price")).withColumn("ly", F.log("green")), "lx", 8)
    agg = rows.groupBy("bin", "is_destroyed").agg(F.avg("ly").alias("m"), F.stddev_samp("ly").alias("sd"), F.count("*").alias("n")).where("n >= 5")
    se = F.col("sd") / F.sqrt("n")
    return agg.select("bin", "is_destroyed", "n", _r(F.exp("m")).alias("g"), _r(F.exp(F.col("m") - 1.96 * se)).alias("lo"), _r(F.exp(F.col("m") + 1.96 * se)).alias("hi"))


_EDGES = "(SELECT list_sort(list_distinct(quantile_cont({x}, [{q}]))) AS e FROM {t})"
_EIGHT = ", ".join(str(i / 8) for i in range(9))
_BINNED = f"(SELECT a.*, ln(green) AS ly, greatest(len(list_filter(e, lambda v: v < ln(price))) - 1, 0) AS bin FROM assessed a, {_EDGES.format(x='ln(price)', q=_EIGHT, t='assessed WHERE price > 0 AND green > 0')} WHERE price > 0 AND green > 0)"
query("a23_binned_summary", _binned, f"SELECT bin, is_destroyed, n, round(exp(m), 6) AS g, round(exp(m - 1.96 * sd / sqrt(n)), 6) AS lo, round(exp(m + 1.96 * sd / sqrt(n)), 6) AS hi FROM (SELECT bin, is_destroyed, count(*) AS n, avg(ly) AS m, stddev_samp(ly) AS sd FROM {_BINNED} GROUP BY 1, 2 HAVING count(*) >= 5)")


def _gap(c):
    rows = B.quantile_bins(c.assessed.where("price > 0 and green > 0").withColumn("lx", F.log("price")).withColumn("l10", F.log10("green")), "lx", 8)
    one = lambda v: F.when(F.col("is_destroyed") == v, F.col("l10"))
    bins = rows.groupBy("bin").agg(F.median(one(1)).alias("a"), F.median(one(0)).alias("b"), F.count(one(1)).alias("na"), F.count(one(0)).alias("nb")).where("na >= 5 and nb >= 5")
    return bins.agg(_r(F.pow(F.lit(10.0), F.avg(F.col("a") - F.col("b")))).alias("ratio"), F.count("*").alias("bins"))


query("a24_matched_gap", _gap, f"SELECT round(10 ** avg(a - b), 6) AS ratio, count(*) AS bins FROM (SELECT bin, median(log10(green)) FILTER (WHERE is_destroyed = 1) AS a, median(log10(green)) FILTER (WHERE is_destroyed = 0) AS b FROM {_BINNED} GROUP BY bin HAVING count(*) FILTER (WHERE is_destroyed = 1) >= 5 AND count(*) FILTER (WHERE is_destroyed = 0) >= 5)")
query(
    "a25_paired_gap",
    lambda c: c.assessed.groupBy("kind").pivot("grp", ["A", "B"]).avg("is_destroyed").where("A is not null and B is not null").select("kind", _r(F.col("A") - F.col("B")).alias("gap")),
    "SELECT kind, round(a - b, 6) AS gap FROM (SELECT kind, avg(is_destroyed) FILTER (WHERE grp = 'A') AS a, avg(is_destroyed) FILTER (WHERE grp = 'B') AS b FROM assessed GROUP BY kind) WHERE a IS NOT NULL AND b IS NOT NULL",
)
query("a26_grid_max", lambda c: c.nodes.groupBy(F.floor(F.col("x") / 500).alias("cx"), F.floor(F.col("y") / 500).alias("cy")).agg(F.max("size").alias("m"), F.count("*").alias("n")), "SELECT CAST(floor(x / 500) AS BIGINT) AS cx, CAST(floor(y / 500) AS BIGINT) AS cy, max(size) AS m, count(*) AS n FROM nodes GROUP BY 1, 2")


def _hex(c):
    cx, cy = S.hex_cell(F.col("x"), F.col("y"), 800.0)
    return c.nodes.select(_r(cx, 4).alias("cx"), _r(cy, 4).alias("cy"), "size").groupBy("cx", "cy").agg(F.max("size").alias("m"))


_H = 800 * 3**0.5
query(
    "a26_hex_max",
    _hex,
    f"SELECT round(CASE WHEN near THEN ax ELSE bx END, 4) AS cx, round(CASE WHEN near THEN ay ELSE by_ END, 4) AS cy, max(size) AS m FROM (SELECT *, (x - ax) ** 2 + (y - ay) ** 2 < (x - bx) ** 2 + (y - by_) ** 2 AS near FROM (SELECT x, y, size, round_even(x / 800, 0) * 800 AS ax, round_even(y / {_H!r}, 0) * {_H!r} AS ay, (floor(x / 800) + 0.5) * 800 AS bx, (floor(y / {_H!r}) + 0.5) * {_H!r} AS by_ FROM nodes)) GROUP BY 1, 2",
)
query(
    "a27_class_bounds",
    lambda c: c.nodes.groupBy(F.floor(F.col("x") / 500).alias("cx")).agg(F.max("price").alias("m")).agg(F.array_sort(F.array_distinct(F.transform(F.percentile("m", [0.25, 0.5, 0.75]), lambda v: F.rint(v)))).alias("b")).select(F.explode("b").alias("bound")),
    "SELECT DISTINCT round_even(unnest(quantile_cont(m, [0.25, 0.5, 0.75])), 0) AS bound FROM (SELECT max(price) AS m FROM nodes GROUP BY floor(x / 500))",
)
query(
    "a28_rank_correlation",
    lambda c: S.spearman(c.nodes.where("green is not null"), "size", "green").select(_r(F.col("spearman")).alias("spearman")),
    "SELECT round(corr(a, b), 6) AS spearman FROM (SELECT rank() OVER (ORDER BY size) + (count(*) OVER (PARTITION BY size) - 1) / 2.0 AS a, rank() OVER (ORDER BY green) + (count(*) OVER (PARTITION BY green) - 1) / 2.0 AS b FROM nodes WHERE green IS NOT NULL)",
)
query(
    "a29_log_calibration",
    lambda c: c.nodes.where("price > 0 and green > 0").select(F.log("price").alias("lx"), F.log("green").alias("ly")).agg(
        _r(F.regr_slope("ly", "lx")).alias("slope"), _r(F.regr_intercept("ly", "lx")).alias("intercept"), _r(F.regr_r2("ly", "lx")).alias("r2"), _r(F.sqrt((F.regr_syy("ly", "lx") - F.pow(F.regr_sxy("ly", "lx"), F.lit(2)) / F.regr_sxx("ly", "lx")) / (F.count("*") - 2))).alias("sd"), F.count("*").alias("n")
    ),
    "SELECT round(regr_slope(ly, lx), 6) AS slope, round(regr_intercept(ly, lx), 6) AS intercept, round(regr_r2(ly, lx), 6) AS r2, round(sqrt((regr_syy(ly, lx) - regr_sxy(ly, lx) ** 2 / regr_sxx(ly, lx)) / (count(*) - 2)), 6) AS sd, count(*) AS n FROM (SELECT ln(price) AS lx, ln(green) AS ly FROM nodes WHERE price > 0 AND green > 0)",
)
query(
    "a31_cumulative_share",
    lambda c: c.nodes.select("size").join(F.broadcast(c.spark.range(0, 51, 10).withColumnRenamed("id", "cutoff"))).groupBy("cutoff").agg(_r(F.avg((F.col("size") >= F.col("cutoff")).cast("int"))).alias("share")),
    "SELECT cutoff, round(avg(CAST(size >= cutoff AS INTEGER)), 6) AS share FROM nodes, range(0, 51, 10) t(cutoff) GROUP BY cutoff",
)
query(
    "a32_fixed_order_counts",
    lambda c: c.spark.createDataFrame([(0, "open"), (1, "boxed"), (2, "none such")], "position int, eaves string").join(c.nodes.groupBy("eaves").agg(F.count("*").alias("n")), "eaves", "left").select("position", "eaves", F.coalesce("n", F.lit(0)).alias("n")),
    "SELECT position, d.eaves, count(n.node) AS n FROM (VALUES (0, 'open'), (1, 'boxed'), (2, 'none such')) d(position, eaves) LEFT JOIN nodes n ON n.eaves = d.eaves GROUP BY 1, 2",
)
query(
    "a35_missing_by_outcome",
    lambda c: S.unpivot(c.assessed.select("is_destroyed", "eaves", F.col("source_id")), ["is_destroyed"], ["eaves", "source_id"]).withColumn("u", S.unknown_value(F.col("value")).cast("int")).groupBy("variable").agg(
        F.sum(F.when(F.col("is_destroyed") == 1, F.col("u"))).alias("destroyed_unknown"), F.sum(F.when(F.col("is_destroyed") == 0, F.col("u"))).alias("survived_unknown"),
        _r(100 * (F.avg(F.when(F.col("is_destroyed") == 1, F.col("u"))) - F.avg(F.when(F.col("is_destroyed") == 0, F.col("u"))))).alias("difference_pp"),
    ),
    "SELECT variable, CAST(sum(u) FILTER (WHERE is_destroyed = 1) AS BIGINT) AS destroyed_unknown, CAST(sum(u) FILTER (WHERE is_destroyed = 0) AS BIGINT) AS survived_unknown, round(100 * (avg(u) FILTER (WHERE is_destroyed = 1) - avg(u) FILTER (WHERE is_destroyed = 0)), 6) AS difference_pp FROM (SELECT is_destroyed, variable, CAST(value IS NULL OR lower(trim(value)) IN ('', 'unknown', 'nan', 'none') AS INTEGER) AS u FROM (SELECT is_destroyed, 'eaves' AS variable, eaves AS value FROM assessed UNION ALL SELECT is_destroyed, 'source_id', source_id FROM assessed)) GROUP BY variable",
)
query("a36_group_minimum", lambda c: c.nodes.groupBy("kind").agg(F.min("x").alias("m")), "SELECT kind, min(x) AS m FROM nodes GROUP BY kind")
query(
    "a37_expansion_counts",
    lambda c: c.nodes.agg(*[F.count_if(F.hypot(F.col("x") - 5000, F.col("y") - 5000) <= r).alias(f"within_{r}") for r in (1000, 2000, 4000)], F.count_if(F.hypot(F.col("x") - 5000, F.col("y") - 5000) > 4000).alias("beyond")),
    "SELECT count(*) FILTER (WHERE d <= 1000) AS within_1000, count(*) FILTER (WHERE d <= 2000) AS within_2000, count(*) FILTER (WHERE d <= 4000) AS within_4000, count(*) FILTER (WHERE d > 4000) AS beyond FROM (SELECT sqrt((x - 5000) ** 2 + (y - 5000) ** 2) AS d FROM nodes)",
)
query(
    "a38_balance",
    lambda c: _rounded(S.smd(c.assessed.where("defended is not null"), ["green", "price", "size"], "defended"), "smd"),
    "SELECT variable, round((avg(v) FILTER (WHERE defended = 1) - avg(v) FILTER (WHERE defended = 0)) / sqrt((var_samp(v) FILTER (WHERE defended = 1) + var_samp(v) FILTER (WHERE defended = 0)) / 2), 6) AS smd FROM (SELECT defended, 'green' AS variable, green AS v FROM assessed UNION ALL SELECT defended, 'price', price FROM assessed UNION ALL SELECT defended, 'size', CAST(size AS DOUBLE) FROM assessed) WHERE defended IS NOT NULL GROUP BY variable",
)
query(
    "a39_overlap",
    lambda c: c.assessed.where("defended is not null and green is not null").join(F.broadcast(c.assessed.where("defended = 1").agg(F.min("green").alias("lo"), F.max("green").alias("hi")))).groupBy("defended").agg(_r(F.percentile("green", 0.05)).alias("p5"), _r(F.percentile("green", 0.95)).alias("p95"), _r(F.avg(F.col("green").between(F.col("lo"), F.col("hi")).cast("int"))).alias("inside")),
    "SELECT defended, round(quantile_cont(green, 0.05), 6) AS p5, round(quantile_cont(green, 0.95), 6) AS p95, round(avg(CAST(green BETWEEN (SELECT min(green) FROM assessed WHERE defended = 1) AND (SELECT max(green) FROM assessed WHERE defended = 1) AS INTEGER)), 6) AS inside FROM assessed WHERE defended IS NOT NULL AND green IS NOT NULL GROUP BY defended",
)
query(
    "a40_era_table",
    lambda c: c.assessed.where("year_built is not null").withColumn("era", B.cut(F.col("year_built"), [1992, 2009], ["old", "middle", "new"])).groupBy("era", "kind").agg(F.count("*").alias("n"), _r(F.avg("is_destroyed")).alias("share")).where("n >= 30"),
    "SELECT CASE WHEN year_built < 1992 THEN 'old' WHEN year_built < 2009 THEN 'middle' ELSE 'new' END AS era, kind, count(*) AS n, round(avg(is_destroyed), 6) AS share FROM assessed WHERE year_built IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 30",
)
query(
    "a42_large_by_region",
    lambda c: c.table("supplier").join(c.table("nation"), F.col("s_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_regionkey").alias("region")).agg(F.count("*").alias("n"), F.count_if(F.col("s_acctbal") > 5000).alias("large")).withColumn("share", _r(F.col("large") / F.col("n"))),
    "SELECT n_regionkey AS region, count(*) AS n, count(*) FILTER (WHERE s_acctbal > 5000) AS large, round(count(*) FILTER (WHERE s_acctbal > 5000) / count(*), 6) AS share FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1",
)
query("a43_count", lambda c: c.table("lineitem").agg(F.count("*").alias("n")), "SELECT count(*) AS n FROM lineitem", raw=True)
query("a44_rollup", lambda c: c.assessed.rollup("grp", "kind").agg(F.count("*").alias("n")).select("grp", "kind", "n"), "SELECT grp, kind, count(*) AS n FROM assessed GROUP BY ROLLUP (grp, kind)")
query(
    "a47_cumulative_levels",
    lambda c: c.nodes.agg(*[F.count_if(F.col("green") >= p).alias(f"at_{int(100 * p)}") for p in (0.25, 0.5, 0.75)]),
    "SELECT count(*) FILTER (WHERE green >= 0.25) AS at_25, count(*) FILTER (WHERE green >= 0.5) AS at_50, count(*) FILTER (WHERE green >= 0.75) AS at_75 FROM nodes",
)


def _received(c):
    hit = E.symmetrised(c.edges).join(c.assessed.where("is_destroyed = 1").select(F.col("node").alias("emitter")), "emitter", "left_semi")
    own = hit.groupBy(F.col("receiver").alias("node")).agg(F.sum("vf").alias("s"))
    met = c.nodes.join(own, "node", "left").withColumn("limit", F.col("size") / 50)
    return met.select("node", _r(F.least(F.coalesce("s", F.lit(0.0)), "limit")).alias("exposed"), _r(F.least(F.coalesce("s", F.lit(0.0)), "limit") / F.col("limit")).alias("share"))


query(
    "a48_capped_exposure",
    _received,
    "SELECT node, round(least(coalesce(s, 0), size / 50.0), 6) AS exposed, round(least(coalesce(s, 0), size / 50.0) / (size / 50.0), 6) AS share FROM nodes LEFT JOIN (SELECT receiver AS node, sum(vf) AS s FROM directed WHERE emitter IN (SELECT node FROM assessed WHERE is_destroyed = 1) GROUP BY 1) USING (node)",
)
query(
    "a49_zero_filled_sums",
    lambda c: c.nodes.select("node").join(c.bonds.where("f >= 0.06").groupBy(F.col("j").alias("node")).agg(F.sum("f").alias("s")), "node", "left").select("node", _r(F.coalesce("s", F.lit(0.0))).alias("s")),
    "SELECT node, round(coalesce(s, 0), 6) AS s FROM nodes LEFT JOIN (SELECT j AS node, sum(f) AS s FROM bonds WHERE f >= 0.06 GROUP BY 1) USING (node)",
)

# Windows, bins.
_RANK = "(SELECT node, neighbor, f, row_number() OVER (PARTITION BY node ORDER BY f DESC, neighbor) AS rank FROM inc)"
query("w01_top_n", lambda c: E.ranked_incidence(c.bonds, 2).select("node", "neighbor", "rank"), f"SELECT node, neighbor, rank FROM {_RANK} WHERE rank <= 2")
query(
    "w02_top_n_by_position",
    lambda c: E.ranked_incidence(c.bonds.withColumn("edge_id", -F.col("i") * 1000003 - F.col("j")), 2, "edge_id").select("node", "neighbor", "rank"),
    "SELECT node, neighbor, rank FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY f DESC, -least(node, neighbor) * 1000003 - greatest(node, neighbor)) AS rank FROM inc) WHERE rank <= 2",
)
query("w03_top_n_by_neighbor", lambda c: E.ranked_incidence(c.bonds, 1).select("node", "neighbor"), f"SELECT node, neighbor FROM {_RANK} WHERE rank = 1")
query(
    "w05_running_histogram",
    lambda c: c.nodes.groupBy("size").agg(F.count("*").alias("n")).withColumn("run", F.sum("n").over(Window.orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, 0))),
    "SELECT size, n, CAST(sum(n) OVER (ORDER BY size DESC ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM (SELECT size, count(*) AS n FROM nodes GROUP BY size)",
)


def _falls(c):
    sizes = c.nodes.groupBy("size").agg(F.avg("green").alias("m"))
    top = sizes.agg(F.max_by("size", F.struct("m", -F.col("size"))).alias("top"))
    after = sizes.join(F.broadcast(top)).where("size >= top")
    order = Window.orderBy("size")
    low = after.withColumn("low", F.min("m").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("prior", F.lag("low").over(order))
    return low.where("prior is null or low < prior").select("size", _r(F.col("m")).alias("m"))


query(
    "w06_cumulative_minimum",
    _falls,
    "SELECT size, round(m, 6) AS m FROM (SELECT *, lag(low) OVER (ORDER BY size) AS prior FROM (SELECT size, m, min(m) OVER (ORDER BY size ROWS UNBOUNDED PRECEDING) AS low FROM (SELECT size, avg(green) AS m FROM nodes GROUP BY size) WHERE size >= (SELECT size FROM (SELECT size, avg(green) AS m FROM nodes GROUP BY size) ORDER BY m DESC, size LIMIT 1))) WHERE prior IS NULL OR low < prior",
)
query("w07_group_share", lambda c: c.assessed.groupBy("grp", "outcome").agg(F.count("*").alias("n")).withColumn("share", _r(F.col("n") / F.sum("n").over(Window.partitionBy("grp")))), "SELECT grp, outcome, n, round(n / sum(n) OVER (PARTITION BY grp), 6) AS share FROM (SELECT grp, outcome, count(*) AS n FROM assessed GROUP BY 1, 2)")
query("w08_duplicates", lambda c: c.nodes.where("source_id is not null").withColumn("n", F.count("*").over(Window.partitionBy("source_id"))).where("n > 1").select("node"), "SELECT node FROM (SELECT node, count(*) OVER (PARTITION BY source_id) AS n FROM nodes WHERE source_id IS NOT NULL) WHERE n > 1")
query("w09_keep_first", lambda c: c.nodes.where("source_id is not null").withColumn("r", F.row_number().over(Window.partitionBy("source_id").orderBy(F.desc("price"), "node"))).where("r = 1").select("source_id", "node"), "SELECT source_id, node FROM (SELECT source_id, node, row_number() OVER (PARTITION BY source_id ORDER BY price DESC, node) AS r FROM nodes WHERE source_id IS NOT NULL) WHERE r = 1")
_TEN = ", ".join(str(i / 10) for i in range(11))
_E10 = _EDGES.format(x="size", q=_TEN, t="nodes")
query("w10_quantile_bins", lambda c: B.quantile_bins(c.nodes, "size", 10).groupBy("bin").agg(F.count("*").alias("n")), f"SELECT greatest(len(list_filter(e, lambda v: v < size)) - 1, 0) AS bin, count(*) AS n FROM nodes, {_E10} GROUP BY 1")
query("w11_quantile_bins_left", lambda c: B.quantile_bins(c.nodes, "size", 10, right=False).groupBy("bin").agg(F.count("*").alias("n")), f"SELECT least(greatest(len(list_filter(e, lambda v: v <= size)) - 1, 0), len(e) - 2) AS bin, count(*) AS n FROM nodes, {_E10} GROUP BY 1")
query(
    "w12_fixed_bins",
    lambda c: c.nodes.select("node", B.cut(F.col("size"), [10, 25], ["low", "mid", "high"]).alias("l"), B.cut(F.col("size"), [10, 25], ["low", "mid", "high"], right=True).alias("r")),
    "SELECT node, CASE WHEN size < 10 THEN 'low' WHEN size < 25 THEN 'mid' ELSE 'high' END AS l, CASE WHEN size <= 10 THEN 'low' WHEN size <= 25 THEN 'mid' ELSE 'high' END AS r FROM nodes",
)
query("w13_search_sorted", lambda c: c.nodes.select("node", B.below(F.array(*[F.lit(v) for v in (5, 10, 20, 40)]), F.col("size")).alias("k")), "SELECT node, len(list_filter([5, 10, 20, 40], lambda v: v < size)) AS k FROM nodes")
query("w14_doubling_bins", lambda c: c.nodes.select("size", B.doubling_bin(F.col("size")).alias("bin")).groupBy("bin").agg(F.count("*").alias("n"), F.max("size").alias("m")), "SELECT CAST(CASE WHEN size > 1 THEN ceil(log2(size)) ELSE 0 END AS INTEGER) AS bin, count(*) AS n, max(size) AS m FROM nodes GROUP BY 1")
query("w16_group_cutoff", lambda c: c.assessed.join(c.assessed.groupBy("grp").agg(F.percentile("price", 0.75).alias("q")), "grp").where("price >= q").select("node"), "SELECT node FROM assessed JOIN (SELECT grp, quantile_cont(price, 0.75) AS q FROM assessed GROUP BY grp) USING (grp) WHERE price >= q")
query("w17_argmax", lambda c: c.nodes.groupBy("kind").agg(F.max_by("node", F.struct("price", -F.col("node"))).alias("node")), "SELECT kind, node FROM (SELECT kind, node, row_number() OVER (PARTITION BY kind ORDER BY price DESC, node) AS r FROM nodes) WHERE r = 1")

# Sorts, limits, set operations.
query("o01_order_limit", lambda c: c.bonds.orderBy(F.desc("f"), "i", "j").limit(20).select("i", "j"), "SELECT i, j FROM bonds ORDER BY f DESC, i, j LIMIT 20")
query("o02_n_largest", lambda c: c.nodes.orderBy(F.desc("price"), "node").limit(3).select("node"), "SELECT node FROM nodes ORDER BY price DESC, node LIMIT 3")
query("o03_sorted_output", lambda c: c.nodes.orderBy("grp", F.desc("size"), "node").select("grp", "size", "node"), "SELECT grp, size, node FROM nodes ORDER BY grp, size DESC, node")
query("o04_input_order", lambda c: E.pair_lookup(_asked(c), c.edges).orderBy("position").select("position", "f"), f"SELECT position, f FROM ({_LOOKUP}) ORDER BY position")
query("o05_median_position", lambda c: c.nodes.withColumn("r", F.row_number().over(Window.partitionBy("kind").orderBy("price", "node"))).withColumn("n", F.count("*").over(Window.partitionBy("kind"))).where("r = floor(n / 2) + 1").select("kind", "node"), "SELECT kind, node FROM (SELECT kind, node, row_number() OVER (PARTITION BY kind ORDER BY price, node) AS r, count(*) OVER (PARTITION BY kind) AS n FROM nodes) WHERE r = floor(n / 2) + 1")
query("o06_head_per_group", lambda c: c.nodes.withColumn("r", F.row_number().over(Window.partitionBy("grp").orderBy("size", "node"))).where("r <= 1").select("grp", "node"), "SELECT grp, node FROM (SELECT grp, node, row_number() OVER (PARTITION BY grp ORDER BY size, node) AS r FROM nodes) WHERE r <= 1")
query("u01_symmetrise", lambda c: _rounded(E.symmetrised(c.edges).groupBy("receiver").agg(F.count("*").alias("n"), F.sum("vf").alias("s")), "s"), "SELECT receiver, count(*) AS n, round(sum(vf), 6) AS s FROM directed GROUP BY receiver")
query("u02_one_plan_for_groups", lambda c: c.assessed.groupBy("grp").agg(F.sum("is_destroyed").alias("k")), "SELECT grp, CAST(sum(is_destroyed) AS BIGINT) AS k FROM (SELECT * FROM assessed WHERE grp = 'A' UNION ALL SELECT * FROM assessed WHERE grp = 'B') GROUP BY grp")
query("u03_outer_concat", lambda c: c.assessed.groupBy("kind").agg(F.count(F.when(F.col("is_destroyed") == 1, 1)).alias("d"), F.count(F.when(F.col("defended") == 1, 1)).alias("t")), "SELECT kind, coalesce(d, 0) AS d, coalesce(t, 0) AS t FROM (SELECT kind, count(*) AS d FROM assessed WHERE is_destroyed = 1 GROUP BY kind) FULL JOIN (SELECT kind, count(*) AS t FROM assessed WHERE defended = 1 GROUP BY kind) USING (kind)")
query("u04_newly_linked", lambda c: c.bonds.where("f >= 0.06").select("i").distinct().join(c.bonds.where("f >= 0.08").select("i").distinct(), "i", "left_anti"), "SELECT i FROM bonds WHERE f >= 0.06 EXCEPT SELECT i FROM bonds WHERE f >= 0.08")
query("u05_unordered_pairs", lambda c: E.ranked_incidence(c.bonds, 2).select(F.least("node", "neighbor").alias("a"), F.greatest("node", "neighbor").alias("b")).distinct(), f"SELECT DISTINCT least(node, neighbor) AS a, greatest(node, neighbor) AS b FROM {_RANK} WHERE rank <= 2")
query("u06_intersect", lambda c: c.nodes.where("defended = 1").select("node").intersect(c.assessed.where("is_destroyed = 1").select("node")), "SELECT node FROM nodes WHERE defended = 1 INTERSECT SELECT node FROM assessed WHERE is_destroyed = 1")

# Direction in time.
_DIR = f"SELECT node, count(*) FILTER (WHERE dt < 0) AS n_up, count(*) FILTER (WHERE dt > 0) AS n_down, round(avg(is_destroyed) FILTER (WHERE dt < 0), 6) AS up_share, round(sum(vf) FILTER (WHERE dt < 0), 6) AS f_up, round(avg(is_destroyed) FILTER (WHERE dt > 0 AND defended = 0), 6) AS down, round(avg(is_destroyed) FILTER (WHERE dt < 0 AND defended = 0), 6) AS up, count(*) FILTER (WHERE dt > 0 AND defended = 0) AS n_down_plain, count(*) FILTER (WHERE dt < 0 AND defended = 0) AS n_up_plain, round(avg(is_destroyed) FILTER (WHERE dt > 0 AND defended = 0 AND any_damage = 1), 6) AS down_escalation, round(avg(is_destroyed) FILTER (WHERE dt < 0 AND defended = 0 AND any_damage = 1), 6) AS up_escalation FROM {_TIMED} GROUP BY node HAVING count(*) FILTER (WHERE dt < 0) > 0 AND count(*) FILTER (WHERE dt > 0) > 0"
query("d04_directional", lambda c: _rounded(X.directional(_timed(c)), "up_share", "f_up", "down", "up", "down_escalation", "up_escalation"), _DIR)
query(
    "d05_view_shares",
    lambda c: _rounded(X.view_shares(_timed(c)), "f_up_potential", "f_down_potential", "f_up_defended", "f_down_defended", "f_up_destroyed"),
    f"SELECT node, round(sum(CASE WHEN dt < 0 THEN vf ELSE 0 END), 6) AS f_up_potential, round(sum(CASE WHEN dt > 0 THEN vf ELSE 0 END), 6) AS f_down_potential, round(sum(CASE WHEN dt < 0 AND defended = 1 THEN vf ELSE 0 END), 6) AS f_up_defended, round(sum(CASE WHEN dt > 0 AND defended = 1 THEN vf ELSE 0 END), 6) AS f_down_defended, round(sum(CASE WHEN dt < 0 AND is_destroyed = 1 THEN vf ELSE 0 END), 6) AS f_up_destroyed FROM {_TIMED} GROUP BY node",
)


def _iv(c):
    frame = X.directional(_timed(c)).join(c.assessed.select("node", "grp", "defended", (1 - F.col("is_destroyed")).alias("survived")), "node").where("defended is not null")
    return _rounded(X.effect_ratio(frame), "first_stage", "down_contrast", "up_placebo", "directional_contrast", "local_ratio", n=4)


query(
    "m26_effect_ratio",
    _iv,
    f"""SELECT round(first_stage, 4) AS first_stage, round(b, 4) AS down_contrast, round(c, 4) AS up_placebo, round(b - c, 4) AS directional_contrast, round((b - c) / first_stage, 4) AS local_ratio FROM (
  SELECT sum(a * n) / sum(n) AS first_stage, sum(b * n) / sum(n) AS b, sum(c * n) / sum(n) AS c FROM (
    SELECT grp, count(*) AS n, avg(1 - is_destroyed) FILTER (WHERE defended = 1) - avg(1 - is_destroyed) FILTER (WHERE defended = 0) AS a, avg(down) FILTER (WHERE defended = 1) - avg(down) FILTER (WHERE defended = 0) AS b, avg(up) FILTER (WHERE defended = 1) - avg(up) FILTER (WHERE defended = 0) AS c
    FROM (SELECT node, avg(is_destroyed) FILTER (WHERE dt > 0 AND defended = 0) AS down, avg(is_destroyed) FILTER (WHERE dt < 0 AND defended = 0) AS up FROM {_TIMED} GROUP BY node HAVING count(*) FILTER (WHERE dt < 0) > 0 AND count(*) FILTER (WHERE dt > 0) > 0) JOIN assessed USING (node) WHERE defended IS NOT NULL
    GROUP BY grp HAVING count(*) FILTER (WHERE defended = 1) >= 2 AND count(*) FILTER (WHERE defended = 0) >= 2))""",
)
