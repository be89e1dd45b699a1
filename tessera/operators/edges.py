"""Edge algebra: bonds, orientations, pruning and pair look-ups on a weighted edge list.

An edge list has one row per unordered pair: ``i``, ``j``, the weight seen by ``i`` (``f_ij``) and
the weight seen by ``j`` (``f_ji``). Adjacency is derived and never stored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bond(a: Column, b: Column, clamp: bool = True) -> Column:
    """Direction-free strength of a pair; nulls are skipped, two nulls give null."""
    strongest = F.greatest(a, b)
    return F.when(strongest.isNotNull(), F.least(F.lit(1.0), strongest)) if clamp else strongest


def floor_zero(x: Column) -> Column:
    """Null and negative weights as zero."""
    return F.greatest(F.coalesce(x, F.lit(0.0)), F.lit(0.0))


def unit_range(x: Column) -> Column:
    return F.least(F.lit(1.0), floor_zero(x))


def first_of(a: Column, b: Column) -> Column:
    """Lower end of an unordered pair, in the order of the id's type."""
    return F.least(a, b)


def last_of(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def with_bond(edges: DataFrame, clamp: bool = True) -> DataFrame:
    return edges.withColumn("f", bond(F.col("f_ij"), F.col("f_ji"), clamp))


def at_least(edges: DataFrame, threshold: float) -> DataFrame:
    """Pairs whose unclamped bond reaches the threshold.

    Said as a disjunction over the stored columns, which reaches the Parquet scan; a
    comparison with ``greatest`` would not.
    """
    return edges.where((F.col("f_ij") >= threshold) | (F.col("f_ji") >= threshold))


def symmetrised(edges: DataFrame, *carry: str) -> DataFrame:
    """Both orientations in one scan: ``receiver``, ``emitter``, ``vf`` is the receiver's weight."""
    one = F.struct(F.col("i").alias("receiver"), F.col("j").alias("emitter"), F.col("f_ij").alias("vf"), *carry)
    two = F.struct(F.col("j").alias("receiver"), F.col("i").alias("emitter"), F.col("f_ji").alias("vf"), *carry)
    return edges.select(F.explode(F.array(one, two)).alias("e")).select("e.*")


def symmetrised_reverse(edges: DataFrame) -> DataFrame:
    """The other convention: the weight from ``i`` to ``j`` is what ``j`` receives."""
    one = F.struct(F.col("j").alias("receiver"), F.col("i").alias("emitter"), F.col("f_ij").alias("vf"))
    two = F.struct(F.col("i").alias("receiver"), F.col("j").alias("emitter"), F.col("f_ji").alias("vf"))
    return edges.select(F.explode(F.array(one, two)).alias("e")).select("e.*")


def incidence(edges: DataFrame, *carry: str) -> DataFrame:
    """``(node, neighbor, f)``: each pair once from each end."""
    one = F.struct(F.col("i").alias("node"), F.col("j").alias("neighbor"), F.col("f"), *carry)
    two = F.struct(F.col("j").alias("node"), F.col("i").alias("neighbor"), F.col("f"), *carry)
    return edges.select(F.explode(F.array(one, two)).alias("e")).select("e.*")


def induced(edges: DataFrame, ids: DataFrame, node: str = "node") -> DataFrame:
    """Edges with both ends in ``ids``."""
    own = ids.select(F.col(node).alias("__n")).distinct()
    return edges.join(own, edges["i"] == own["__n"], "left_semi").join(own, edges["j"] == own["__n"], "left_semi")


def touching(edges: DataFrame, ids: DataFrame, node: str = "node") -> DataFrame:
    """Edges with an end in ``ids``, each once."""
    own = ids.select(F.col(node).alias("__n")).distinct().withColumn("__in", F.lit(True))
    left = edges.join(own.withColumnsRenamed({"__n": "i", "__in": "__a"}), "i", "left")
    both = left.join(own.withColumnsRenamed({"__n": "j", "__in": "__b"}), "j", "left")
    return both.where("__a or __b").select(*edges.columns)


def pair_lookup(pairs: DataFrame, edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Bond of arbitrary ordered pairs, zero where there is no edge; the rows' order column stays."""
    keyed = edges.select(first_of(F.col("i"), F.col("j")).alias("__lo"), last_of(F.col("i"), F.col("j")).alias("__hi"), "f_ij", "f_ji")
    asked = pairs.withColumns({"__lo": first_of(F.col(a), F.col(b)), "__hi": last_of(F.col(a), F.col(b))})
    met = asked.join(keyed.withColumn("__hit", F.lit(True)), ["__lo", "__hi"], "left")
    # least and greatest skip nulls, so a missing edge needs its own branch.
    return met.select(*pairs.columns, F.when(F.col("__hit").isNull(), F.lit(0.0)).otherwise(bond(F.col("f_ij"), F.col("f_ji"))).alias("f"))


def collapse_pairs(directed: DataFrame, a: str, b: str, weight: str, distance: str) -> DataFrame:
    """Strongest weight and shortest distance of each unordered pair of a directed list; no self loops."""
    pairs = directed.where(F.col(a) != F.col(b)).select(first_of(F.col(a), F.col(b)).alias("i"), last_of(F.col(a), F.col(b)).alias("j"), F.col(weight).alias("w"), F.col(distance).alias("d"))
    return pairs.groupBy("i", "j").agg(F.max("w").alias("weight"), F.min("d").alias("distance"))


def strongest_incident(edges: DataFrame) -> DataFrame:
    """``(node, m)``: the largest bond at each node."""
    return incidence(edges).groupBy("node").agg(F.max("f").alias("m"))


def ranked_incidence(edges: DataFrame, n: int | None = None, tie_break: str = "neighbor") -> DataFrame:
    """Incident bonds ranked from strongest, ties by ``neighbor`` or by an edge position column.

    The rank filter stands right above the window, so Spark prunes before and after the shuffle.
    """
    carry = [] if tie_break == "neighbor" else [tie_break]
    ranked = incidence(edges, *carry).withColumn("rank", F.row_number().over(Window.partitionBy("node").orderBy(F.desc("f"), tie_break)))
    return ranked if n is None else ranked.where(F.col("rank") <= n)
