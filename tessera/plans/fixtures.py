"""The analogue of the node, edge and attribute tables over the test tables, in Spark and in SQL.

Parts are nodes; two parts are linked if an order holds both, and each sees the other with the
share of its own orders that they share. All attributes are plain arithmetic on keys; the
outcome of a node rises with what it shares with susceptible neighbours of its group.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.session import dealt_by_size, durable

#: Share of a node's orders that it has in common with susceptible neighbours at which half of the nodes are destroyed or damaged.
DESTROYED_AT, DAMAGED_AT = 0.85, 0.7
#: Nodes up to this size are susceptible; a size is at most 50 and stands for a uniform draw.
SUSCEPTIBLE, LARGEST = 25, 50
#: What is added to a part's state in a basket.
DESTROYED, DAMAGED, PLAIN = 2, 4, 8

SQL = f"""
purchases AS MATERIALIZED (SELECT DISTINCT l_orderkey AS o, l_partkey AS p FROM lineitem),
buys AS MATERIALIZED (SELECT p, count(*) AS n FROM purchases GROUP BY p),
shared AS MATERIALIZED (SELECT a.p AS i, b.p AS j, count(*) AS n FROM purchases a JOIN purchases b ON a.o = b.o AND a.p < b.p GROUP BY 1, 2),
edges AS MATERIALIZED (SELECT i, j, CAST(s.n AS DOUBLE) / a.n AS f_ij, CAST(s.n AS DOUBLE) / b.n AS f_ji, s.n >= 2 AS contact
  FROM shared s JOIN buys a ON a.p = s.i JOIN buys b ON b.p = s.j),
bonds AS MATERIALIZED (SELECT i, j, least(1.0, greatest(f_ij, f_ji)) AS f FROM edges),
inc AS (SELECT i AS node, j AS neighbor, f FROM bonds UNION ALL SELECT j, i, f FROM bonds),
directed AS (SELECT i AS receiver, j AS emitter, f_ij AS vf FROM edges UNION ALL SELECT j, i, f_ji FROM edges),
nodes AS (SELECT p_partkey AS node,
    CASE WHEN p_partkey % 17 = 0 THEN 'None' WHEN p_partkey % 13 = 0 THEN concat('dup', CAST(p_partkey // 39 AS VARCHAR)) WHEN p_partkey % 19 = 0 THEN NULL
      ELSE concat('S', CAST(p_partkey AS VARCHAR)) END AS source_id,
    CAST((p_partkey * 7919) % 10007 AS DOUBLE) AS x, CAST((p_partkey * 104729) % 10009 AS DOUBLE) AS y,
    CASE WHEN CAST(replace(p_brand, 'Brand#', '') AS INTEGER) % 2 = 0 THEN 'A' ELSE 'B' END AS grp,
    p_size AS size, p_type AS kind, p_retailprice AS price,
    CASE WHEN p_partkey % 11 <> 0 THEN CAST((p_partkey * 37) % 1201 AS DOUBLE) / 100 END AS arrival,
    CASE WHEN p_partkey % 13 = 0 THEN NULL WHEN p_partkey % 5 = 0 THEN 1 ELSE 0 END AS defended,
    CASE WHEN p_partkey % 23 <> 0 THEN 1950 + p_partkey % 75 END AS year_built,
    CASE WHEN p_partkey % 29 <> 0 THEN CAST((p_partkey * 31) % 97 AS DOUBLE) / 97 END AS green,
    CASE p_partkey % 9 WHEN 0 THEN '' WHEN 1 THEN ' Unknown ' WHEN 2 THEN NULL WHEN 3 THEN 'open' ELSE 'boxed' END AS eaves,
    (p_partkey % 10) < 3 AS is_interface
  FROM part),
pressure AS MATERIALIZED (SELECT r.node, CAST(sum(e.n) AS BIGINT) AS shared, max(e.own) AS own
  FROM (SELECT s.i, s.j, s.n, a.n AS own FROM shared s JOIN buys a ON a.p = s.i UNION ALL SELECT s.j, s.i, s.n, b.n FROM shared s JOIN buys b ON b.p = s.j) e
  JOIN nodes r ON r.node = e.i JOIN nodes t ON t.node = e.j AND t.grp = r.grp AND t.size <= {SUSCEPTIBLE} AND t.node % 7 <> 0 GROUP BY 1),
assessed AS MATERIALIZED (SELECT *, CASE WHEN is_destroyed = 1 THEN 'destroyed' WHEN any_damage = 1 THEN 'partial' ELSE 'no_damage' END AS outcome
  FROM (SELECT n.*, CASE WHEN shared > 0 AND size * (1 + power({DESTROYED_AT} * own / shared, 8)) < {LARGEST} THEN 1 ELSE 0 END AS is_destroyed,
      CASE WHEN shared > 0 AND size * (1 + power({DAMAGED_AT} * own / shared, 8)) < {LARGEST} THEN 1 ELSE 0 END AS any_damage
    FROM nodes n LEFT JOIN pressure p ON p.node = n.node WHERE n.node % 7 <> 0))
"""

#: Components of the bonds of at least a threshold, for {tau}; needs WITH RECURSIVE.
COMPONENTS = """
reach(node, label) AS (SELECT node, node FROM nodes UNION SELECT l.neighbor, r.label FROM reach r JOIN links l ON l.node = r.node),
labels AS (SELECT node, min(label) AS component_id FROM reach GROUP BY node),
state AS (SELECT node, component_id, count(*) OVER (PARTITION BY component_id) AS component_size FROM labels)
"""


def sql(body: str, links: str | None = None) -> str:
    """A query over the fixture; ``links`` (columns i, j) adds components as ``state``."""
    if links is None:
        return f"WITH {SQL}\n{body}"
    both = f"active AS ({links}), links AS (SELECT i AS node, j AS neighbor FROM active UNION ALL SELECT j, i FROM active)"
    return f"WITH RECURSIVE {SQL}, {both}, {COMPONENTS}\n{body}"


def _edge_columns(links: DataFrame) -> DataFrame:
    return links.select("i", "j", (F.col("n") / F.col("ni")).alias("f_ij"), (F.col("n") / F.col("nj")).alias("f_ji"), (F.col("n") >= 2).alias("contact"))


class Context:
    """The fixture's DataFrames for one session and folder."""

    _kept: dict[tuple[str, str, str], DataFrame] = {}
    _lines: dict[str, int] = {}

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def kept(self, name: str, build) -> DataFrame:
        """A table that is built once for a session and folder and kept in the shared folder."""
        if self.dir not in self._lines:
            self._lines[self.dir] = self.table("lineitem").count()
        dealt_by_size(self.spark, self._lines[self.dir])
        key = (self.spark.sparkContext.applicationId, self.dir, name)
        if key not in self._kept:
            for old in [k for k in self._kept if k[:2] != key[:2]]:
                del self._kept[old]
            self._kept[key] = durable(build())
        return self._kept[key]

    def build_baskets(self) -> DataFrame:
        """Orders of several parts, ``(o, ps)``: each part (p) once, with the orders that have it (n) and its role.

        A role is 0 or 1 by the part's group, 2 more if it is susceptible, null if the part is
        unknown. Both are set while the purchases lie dealt by part, so pairs need no joins.
        """
        lines = self.table("lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_partkey").alias("p")).where("p is not null")
        counted = lines.repartition("p").distinct().withColumn("n", F.count("*").over(Window.partitionBy("p"))).where("o is not null")
        source = F.coalesce((F.col("size") <= SUSCEPTIBLE) & (F.col("node") % 7 != 0), F.lit(False))
        role = F.when(F.col("grp") == "A", 0).otherwise(1) + F.when(source, 2).otherwise(0)
        roles = self.nodes.groupBy(F.col("node").alias("p")).agg(F.max(role.cast("byte")).alias("role"))
        met = counted.join(roles, "p", "left").repartition("o")
        return met.groupBy("o").agg(F.array_sort(F.collect_list(F.struct("p", "n", "role"))).alias("ps")).where("size(ps) > 1")

    @cached_property
    def baskets(self) -> DataFrame:
        return self.kept("baskets", self.build_baskets)

    def build_links(self, baskets: DataFrame | None = None) -> DataFrame:
        """Linked pairs with the orders that they share (n) and have (ni, nj)."""
        baskets = self.baskets if baskets is None else baskets
        # All parts of an order meet in one row. Most pairs share one order, so nothing is summed before they are dealt.
        pairs = baskets.select("ps", F.posexplode("ps").alias("k", "a")).select("a", F.explode(F.expr("slice(ps, k + 2, size(ps))")).alias("b"))
        dealt = pairs.select(F.col("a.p").alias("i"), F.col("b.p").alias("j"), F.col("a.n").alias("ni"), F.col("b.n").alias("nj")).repartition("i", "j")
        return dealt.groupBy("i", "j").agg(F.count("*").alias("n"), F.max("ni").alias("ni"), F.max("nj").alias("nj")).select("i", "j", "n", "ni", "nj")

    def build_edges(self) -> DataFrame:
        return _edge_columns(self.build_links(self.build_baskets()))

    @cached_property
    def edges(self) -> DataFrame:
        return _edge_columns(self.kept("links", self.build_links))

    @cached_property
    def bonds(self) -> DataFrame:
        from tessera.operators.edges import with_bond

        return with_bond(self.edges).select("i", "j", "f")

    @cached_property
    def nodes(self) -> DataFrame:
        p = F.col("p_partkey")
        text = p.cast("string")
        return self.table("part").select(
            p.alias("node"),
            F.when(p % 17 == 0, "None").when(p % 13 == 0, F.concat(F.lit("dup"), F.floor(p / 39).cast("string"))).when(p % 19 == 0, None).otherwise(F.concat(F.lit("S"), text)).alias("source_id"),
            ((p * 7919) % 10007).cast("double").alias("x"),
            ((p * 104729) % 10009).cast("double").alias("y"),
            F.when(F.replace(F.col("p_brand"), F.lit("Brand#"), F.lit("")).cast("int") % 2 == 0, "A").otherwise("B").alias("grp"),
            F.col("p_size").alias("size"),
            F.col("p_type").alias("kind"),
            F.col("p_retailprice").alias("price"),
            F.when(p % 11 != 0, ((p * 37) % 1201).cast("double") / 100).alias("arrival"),
            F.when(p % 13 == 0, None).when(p % 5 == 0, 1).otherwise(0).alias("defended"),
            F.when(p % 23 != 0, 1950 + p % 75).alias("year_built"),
            F.when(p % 29 != 0, ((p * 31) % 97).cast("double") / 97).alias("green"),
            F.when(p % 9 == 0, "").when(p % 9 == 1, " Unknown ").when(p % 9 == 2, None).when(p % 9 == 3, "open").otherwise("boxed").alias("eaves"),
            ((p % 10) < 3).alias("is_interface"),
        )

    def build_assessed(self) -> DataFrame:
        nodes, role = self.nodes, F.col("e.role")
        # What a part shares with the susceptible of its group, order by order: those in the order less itself.
        of_a, of_b = F.size(F.filter("ps", lambda e: e["role"] == 2)), F.size(F.filter("ps", lambda e: e["role"] == 3))
        each = self.baskets.select(of_a.alias("of_a"), of_b.alias("of_b"), F.explode("ps").alias("e")).where("e.role is not null")
        others = F.when(role % 2 == 1, F.col("of_b")).otherwise(F.col("of_a")) - F.when(role >= 2, 1).otherwise(0)
        shared = each.select(F.col("e.p").alias("node"), F.col("e.n").alias("own"), others.alias("shared")).where("shared > 0")
        pressure = shared.groupBy("node").agg(F.sum("shared").alias("shared"), F.max("own").alias("own"))
        met = nodes.where("node % 7 <> 0").join(pressure, "node", "left")
        hit = lambda at: F.when((F.col("shared") > 0) & (F.col("size") * (1 + F.pow(at * F.col("own") / F.col("shared"), F.lit(8.0))) < LARGEST), 1).otherwise(0)
        met = met.withColumns({"is_destroyed": hit(DESTROYED_AT), "any_damage": hit(DAMAGED_AT)}).drop("shared", "own")
        outcome = F.when(F.col("is_destroyed") == 1, "destroyed").when(F.col("any_damage") == 1, "partial").otherwise("no_damage")
        return met.withColumn("outcome", outcome).select(*nodes.columns, "outcome", "is_destroyed", "any_damage")

    @cached_property
    def assessed(self) -> DataFrame:
        return self.kept("assessed", self.build_assessed)

    def build_fates(self) -> DataFrame:
        """Baskets with what came of each part: ``state`` (null if it isn't assessed) and arrival.

        A state is 0 or 1 by the part's group, and more by ``DESTROYED`` if it is destroyed, by
        ``DAMAGED`` if it has any damage and by ``PLAIN`` if it is known not to be defended.
        """
        state = F.when(F.col("grp") == "A", 0).otherwise(1)
        for value, when in ((DESTROYED, F.col("is_destroyed") == 1), (DAMAGED, F.col("any_damage") == 1), (PLAIN, F.col("defended") == 0)):
            state = state + F.when(when, value).otherwise(0)
        known = self.assessed.select(F.col("node").alias("p"), state.cast("byte").alias("state"), "arrival")
        each = self.baskets.select("o", F.explode("ps").alias("e")).select("o", "e.p", "e.n")
        met = each.join(known.hint("shuffle_hash"), "p", "left").repartition("o")
        return met.groupBy("o").agg(F.collect_list(F.struct("p", "n", "state", "arrival")).alias("ps"))

    @cached_property
    def fates(self) -> DataFrame:
        return self.kept("fates", self.build_fates)

    @cached_property
    def zones(self) -> DataFrame:
        """Three overlapping classes as closed rings with their boxes."""
        rows = [("Influence", 1, 500.0, 6000.0, 500.0, 6000.0), ("Intermix", 2, 3000.0, 9000.0, 2000.0, 5000.0), ("Interface", 3, 4000.0, 7000.0, 4000.0, 8000.0)]
        boxes = self.spark.createDataFrame(rows, "zone string, priority int, x0 double, x1 double, y0 double, y1 double")
        corner = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
        return boxes.withColumn("ring", F.array(corner("x0", "y0"), corner("x1", "y0"), corner("x1", "y1"), corner("x0", "y1"), corner("x0", "y0")))
