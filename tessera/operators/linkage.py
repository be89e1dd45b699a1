"""Link rules and their components at one or many thresholds.

For every rule an edge is active at threshold t iff its activation weight is at least t, so the
active sets are nested. The weight is computed once; a threshold is then a filter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.components import CHUNK, SMALL, connected_components, reduce_to_forest, star_components
from tessera.operators.edges import incidence, ranked_incidence, strongest_incident
from tessera.session import durable


def top_n_profile(edges: DataFrame, n: int, tie_break: str = "neighbor") -> DataFrame:
    """``(node, k, s)``: how many of the n strongest bonds a node has, and their sum."""
    return ranked_incidence(edges, n, tie_break).groupBy("node").agg(F.count("*").alias("k"), F.sum("f").alias("s"))


def top_n_edges(edges: DataFrame, n: int, tie_break: str = "neighbor") -> DataFrame:
    """Edges among the n strongest of either end, each once."""
    picked = ranked_incidence(edges, n, tie_break)
    return picked.groupBy(F.least("node", "neighbor").alias("i"), F.greatest("node", "neighbor").alias("j")).agg(F.max("f").alias("f"))


def eeat_weights(edges: DataFrame) -> DataFrame:
    """Plain thresholding: an edge's weight is its bond."""
    return edges.select("i", "j", "f", F.col("f").alias("w"))


def top_n_pruned_weights(edges: DataFrame, n: int, tie_break: str = "neighbor") -> DataFrame:
    return top_n_edges(edges, n, tie_break).select("i", "j", "f", F.col("f").alias("w"))


def _over(f: Column, alpha: float) -> Column:
    return f / alpha if alpha > 0 else F.lit(float("inf"))


def cumulative_top_n_weights(edges: DataFrame, n: int = 2, alpha: float = 0.25, tie_break: str = "neighbor") -> DataFrame:
    """A node qualifies with n bonds whose sum reaches t; an edge needs both ends and a bond of alpha t.

    ``exact`` holds what a comparison at one threshold needs without a division.
    """
    profile = top_n_profile(edges, n, tie_break).where(F.col("k") == n).select("node", "s")
    picked = top_n_edges(edges, n, tie_break)
    ends = picked.join(profile.withColumnsRenamed({"node": "i", "s": "s_i"}), "i").join(profile.withColumnsRenamed({"node": "j", "s": "s_j"}), "j")
    return ends.select("i", "j", "f", F.least("s_i", "s_j").alias("ends"), F.least("s_i", "s_j", _over(F.col("f"), alpha)).alias("w"))


def anchored_weights(edges: DataFrame, alpha: float = 0.75, both: bool = False) -> DataFrame:
    """Strong edges, and weaker ones of at least alpha t next to a node (or two) with a strong edge."""
    top = strongest_incident(edges)
    ends = edges.select("i", "j", "f").join(top.withColumnsRenamed({"node": "i", "m": "m_i"}), "i").join(top.withColumnsRenamed({"node": "j", "m": "m_j"}), "j")
    anchor = F.least("m_i", "m_j") if both else F.greatest("m_i", "m_j")
    return ends.select("i", "j", "f", anchor.alias("ends"), F.least(anchor, _over(F.col("f"), alpha)).alias("w"))


def active(weights: DataFrame, threshold: float, alpha: float | None = None) -> DataFrame:
    """Active edges at a threshold. With ``alpha`` the floor is compared by multiplication."""
    if alpha is None or "ends" not in weights.columns:
        return weights.where(F.col("w") >= threshold)
    return weights.where((F.col("ends") >= threshold) & (F.col("f") >= alpha * threshold))


def states(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Nodes with the component that the links give; nodes without a link are singletons."""
    return connected_components(nodes, links, "node", "i", "j")


def maximum_spanning_forest(weights: DataFrame, small: int = CHUNK, max_rounds: int = 40) -> DataFrame:
    """``(i, j, w)``: a spanning forest of the heaviest edges.

    Tasks reduce their own edges first, and what they leave is dealt to fewer tasks while that
    still drops a third. A small rest is finished in one bounded task; a larger one by Boruvka rounds: every component picks its heaviest outgoing edge (ties by the pair), the
    picks join the forest and components are merged.
    """
    reduced = durable(reduce_to_forest(weights.select("i", "j", F.col("w").cast("double").alias("w")).where("i <> j and w is not null")))
    n = reduced.count()
    while n > small > 0:
        merged = durable(reduce_to_forest(reduced.repartition(-(-n // small))))
        before, n, reduced = n, merged.count(), merged
        if 3 * n > 2 * before:
            break
    if n <= small:
        return durable(reduce_to_forest(reduced.coalesce(1)))
    live = reduced.select("i", "j", "w", F.col("i").alias("ci"), F.col("j").alias("cj"))
    forest = reduced.limit(0)
    for _ in range(max_rounds):
        if live.isEmpty():
            break
        order = F.struct("w", (-F.col("i")).alias("a"), (-F.col("j")).alias("b"))
        sides = live.select(F.explode(F.array("ci", "cj")).alias("c"), order.alias("o"))
        picks = sides.groupBy("c").agg(F.max("o").alias("o")).select(F.col("o.w").alias("w"), (-F.col("o.a")).alias("i"), (-F.col("o.b")).alias("j")).distinct()
        picks = durable(picks.join(live.select("i", "j", "ci", "cj").distinct(), ["i", "j"]))
        forest = durable(forest.unionByName(picks.select("i", "j", "w")))
        merged = star_components(picks, "ci", "cj", min(small, SMALL))
        for c in ("ci", "cj"):
            live = live.join(merged.withColumnsRenamed({"node": c, "component": f"{c}_new"}), c, "left").withColumn(c, F.coalesce(f"{c}_new", c)).drop(f"{c}_new")
        live = durable(live.where("ci <> cj"))
    return forest


def _labels_at(thresholds: list[float]):
    steps = sorted(thresholds, reverse=True)

    def per_task(batches):
        rows = [b for b in batches if len(b)]
        if not rows:
            return
        i, j, w = (np.concatenate([b.column(k).to_numpy(zero_copy_only=False) for b in rows]) for k in range(3))
        ids, at = np.unique(np.concatenate([i, j]), return_inverse=True)
        ends, up, seen, above = (at[: len(i)], at[len(i) :]), np.arange(len(ids)), np.zeros(len(ids), bool), None
        for t in steps:
            band = w >= t if above is None else (w >= t) & (w < above)
            a, b = (e[band] for e in ends)
            seen[a] = seen[b] = True
            while len(a):
                a, b = up[a], up[b]
                apart = a != b
                a, b = a[apart], b[apart]
                up[np.maximum(a, b)] = np.minimum(a, b)  # down only, so the least id ends as the root
                while not np.array_equal(further := up[up], up):
                    up = further
            own, above = np.flatnonzero(seen), t
            for first in range(0, len(own), 1 << 16):
                part = own[first : first + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), t)), pa.array(ids[part].astype(np.int64)), pa.array(ids[up[part]].astype(np.int64))], ["threshold", "node", "component"])

    return per_task


def sweep(nodes: DataFrame, weights: DataFrame, thresholds: list[float], small: int = CHUNK) -> DataFrame:
    """``(node, component_id, component_size, threshold)`` at each threshold, from one spanning forest.

    A small forest is passed once, from heavy to light, in one bounded task. With a larger one
    thresholds are gone through from high to low: the edges between two of them join components
    of the higher one, so each edge is looked at once, however many thresholds there are.
    """
    weights = weights.where(F.col("w") >= min(float(t) for t in thresholds)) if thresholds else weights  # lighter edges join nothing
    forest = durable(maximum_spanning_forest(weights, small))
    if forest.count() <= small:
        labels = durable(forest.coalesce(1).mapInArrow(_labels_at([float(t) for t in thresholds]), "threshold double, node bigint, component bigint"))
        steps = F.broadcast(nodes.sparkSession.createDataFrame([(float(t),) for t in thresholds], "threshold double"))
        met = nodes.select("node").join(steps).join(labels, ["threshold", "node"], "left").withColumn("component_id", F.coalesce("component", "node"))
        sizes = met.groupBy("threshold", "component_id").agg(F.count("*").alias("component_size"))
        return met.join(sizes, ["threshold", "component_id"]).select("node", "component_id", "component_size", "threshold")
    ids = nodes.select("node").distinct()
    inside = durable(forest.join(ids.select(F.col("node").alias("i")), "i", "left_semi").join(ids.select(F.col("node").alias("j")), "j", "left_semi").select("i", "j", "w"))
    now, above, found = ids.withColumn("component_id", F.col("node")), None, {}
    for t in sorted({float(t) for t in thresholds}, reverse=True):
        band = inside.where(F.col("w") >= t) if above is None else inside.where((F.col("w") >= t) & (F.col("w") < above))
        end = lambda k, name: now.select(F.col("node").alias(k), F.col("component_id").alias(name))  # noqa: E731, B023
        merged = star_components(band.join(end("i", "a"), "i").join(end("j", "b"), "j").select("a", "b"), "a", "b", min(small, SMALL)).withColumnRenamed("node", "component_id")
        now = durable(now.join(merged, "component_id", "left").select("node", F.coalesce("component", "component_id").alias("component_id")))
        sizes = now.groupBy("component_id").agg(F.count("*").alias("component_size"))
        found[t], above = nodes.select("node").join(now, "node").join(sizes, "component_id").select("node", "component_id", "component_size", F.lit(t).alias("threshold")), t
    parts = None
    for t in thresholds:
        parts = found[float(t)] if parts is None else parts.unionByName(found[float(t)])
    return parts


def minimum_neighbors(nodes: DataFrame, edges: DataFrame, threshold: float) -> DataFrame:
    """For each node the number of its strongest bonds whose sum first reaches the threshold."""
    from pyspark.sql import Window

    w = Window.partitionBy("node").orderBy(F.desc("f"), "neighbor")
    run = incidence(edges).select("node", "f", F.row_number().over(w).alias("rank"), F.sum("f").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("total"))
    reached = F.when(F.col("total") >= threshold, F.col("rank"))
    own = run.groupBy("node").agg(F.count("*").alias("available"), F.sum("f").alias("total_f"), F.min(reached).alias("needed"), F.min_by(F.when(F.col("total") >= threshold, F.col("total")), reached).alias("f_at"))
    met = nodes.join(own, "node", "left")
    return met.select("node", F.coalesce("available", F.lit(0)).alias("available"), F.coalesce("total_f", F.lit(0.0)).alias("total_f"), F.col("needed").cast("int").alias("needed"), "f_at", F.col("needed").isNotNull().alias("reachable"))


def interconnected(state: DataFrame, is_interface: str, outside: str) -> DataFrame:
    """Flag members outside the mapped zone of a component of two or more that touches the interface."""
    touch = state.groupBy("component_id").agg(F.max(F.col(is_interface).cast("int")).alias("__touch"))
    flag = F.col(outside) & (F.col("component_size") >= 2) & (F.col("__touch") == 1)
    return state.join(touch, "component_id").withColumn("interconnected", flag).drop("__touch")
