"""Connected components and spanning forests of an edge list.

Each task first reduces its own edges to a spanning forest, a bounded chunk at a time, which
drops no connection. What is left of a small graph is finished in one task of bounded size; a
larger one goes through alternating star contraction:

Every round replaces the edge list by one that hangs each node below a smaller neighbour;
it ends when every node hangs directly below the smallest id that it can reach. A round is
made of grouped minima and equi-joins only, so no neighbour list meets in one task, and the
number of rounds grows with the logarithm of the largest component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import durable

#: Edges that one task may finish, some 20 MB; beyond it the rounds run.
SMALL = 250_000
#: Edges that a task reduces on arrays at once, some 350 MB of memory; a forest of so many is finished in one task.
CHUNK = 2_000_000


class Union:
    """Disjoint sets of any ids; the root of a set is its least id."""

    def __init__(self) -> None:
        self.up: dict = {}

    def find(self, x):
        up = self.up
        root = x
        while (above := up.get(root, root)) != root:
            root = above
        while x != root:
            up[x], x = root, up.get(x, x)
        return root

    def join(self, a, b) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        self.up.setdefault(min(a, b), min(a, b))
        return True


def forest_of(i: np.ndarray, j: np.ndarray, w: np.ndarray | None = None) -> np.ndarray:
    """Positions of the edges of a spanning forest, the heaviest one if there are weights; ties by the pair, then by position.

    Boruvka rounds on arrays: every component picks the first of its edges, which is the forest
    that taking edges one by one in their order gives.
    """
    order = np.arange(len(i)) if w is None else np.lexsort((j, i, -w))
    ids, at = np.unique(np.concatenate([i[order], j[order]]), return_inverse=True)
    a, b, live, kept = at[: len(i)], at[len(i) :], np.arange(len(i)), []
    while True:
        apart = a != b
        a, b, live = a[apart], b[apart], live[apart]
        if not len(live):
            break
        back, best = np.arange(len(live))[::-1], []
        for end in (a, b):  # of a repeated index the last value stays, so the first edge
            first = np.full(len(ids), len(live))
            first[end[::-1]] = back
            best.append(first)
        best = np.minimum(*best)
        picking = np.flatnonzero(best < len(live))
        edge = best[picking]
        up = np.arange(len(ids))
        up[picking] = np.where(a[edge] == picking, b[edge], a[edge])
        root = picking[(up[up[picking]] == picking) & (picking < up[picking])]  # two that picked one edge
        up[root] = root
        kept.append(live[np.unique(edge)])
        while not np.array_equal(above := up[up], up):
            up = above
        a, b = up[a], up[b]
    return order[np.sort(np.concatenate(kept))] if kept else order[:0]


def _forests(batches: Iterator[pa.RecordBatch], chunk: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """A spanning forest of each chunk of edges, of the heaviest ones if there is a third column."""

    def reduced(rows: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
        table = pa.Table.from_batches(rows).combine_chunks()
        kept = forest_of(*[c.to_numpy() for c in table.columns[:3]])
        return table.take(pa.array(kept)).combine_chunks().to_batches()

    rows: list[pa.RecordBatch] = []
    for batch in batches:
        rows.append(batch)
        if sum(len(r) for r in rows) >= chunk:
            yield from reduced(rows)
            rows = []
    if rows:
        yield from reduced(rows)


def reduce_to_forest(edges: DataFrame) -> DataFrame:
    """Edges that connect the same nodes, with at most one spanning forest for each chunk of a task.

    A third column holds weights; then every edge of the maximum spanning forest is kept.
    """
    return edges.mapInArrow(_forests, edges.schema)


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sets, kind = Union(), None
    for batch in batches:
        kind = batch.schema.types[0]
        for a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            sets.join(a, b)
    if kind is not None:
        nodes = list(sets.up)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, kind), pa.array([sets.find(n) for n in nodes], kind)], ["node", "component"])


def _downward(edges: DataFrame) -> DataFrame:
    """Distinct edges (hi, lo) with hi > lo; self loops and nulls go."""
    return edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    """Hang each larger neighbour of a node below the smallest node of its neighbourhood."""
    both = edges.select(F.explode(F.array(F.struct(F.col("hi").alias("u"), F.col("lo").alias("v")), F.struct(F.col("lo").alias("u"), F.col("hi").alias("v")))).alias("e")).select("e.u", "e.v")
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return _downward(both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")))


def _small_star(edges: DataFrame) -> DataFrame:
    """Hang a node and its smaller neighbours below the smallest of them."""
    least = edges.groupBy("hi").agg(F.min("lo").alias("m"))
    moved = edges.join(least, "hi").select(F.explode(F.array(F.struct(F.col("lo").alias("a"), F.col("m").alias("b")), F.struct(F.col("hi").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
    return _downward(moved)


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("hi", "lo")).alias("x")).first()
    return row["n"], row["x"]


def star_components(edges: DataFrame, a: str = "a", b: str = "b", small: int = SMALL, max_rounds: int = 60) -> DataFrame:
    """Nodes of non-trivial components with the least node id of each.

    Takes an edge list with the orderable id columns ``a`` and ``b`` and returns
    ``(node, component)``: one row for every node that has an edge to another node, with the
    smallest id reachable from it. Repeated edges, self loops, both orientations and edges
    with a null end are allowed; they change nothing. An empty list gives an empty result.
    """
    pairs = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    reduced = durable(reduce_to_forest(pairs))
    if reduced.count() <= small:
        kind = reduced.schema["a"].dataType.simpleString()
        return durable(reduced.coalesce(1).mapInArrow(_finish, f"node {kind}, component {kind}"))
    now = durable(_downward(reduced))
    state = _state(now)
    for _ in range(max_rounds):
        if not state[0]:
            break
        now = durable(_small_star(_large_star(now)))
        before, state = state, _state(now)
        if state == before:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("lo").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(roots)


def connected_components(nodes: DataFrame, edges: DataFrame, node: str = "node", a: str = "a", b: str = "b") -> DataFrame:
    """``nodes`` with ``component_id`` (least reachable id) and ``component_size``; single nodes stay.

    Edges that name an id outside ``nodes`` are dropped first (an induced subgraph).
    """
    ids = nodes.select(F.col(node).alias("__id")).distinct()
    inside = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).join(ids.withColumnRenamed("__id", "a"), "a", "left_semi").join(ids.withColumnRenamed("__id", "b"), "b", "left_semi")
    labels = star_components(inside).withColumnRenamed("node", "__id")
    labelled = nodes.join(labels, nodes[node] == labels["__id"], "left").drop("__id").withColumn("component_id", F.coalesce("component", node)).drop("component")
    sizes = labelled.groupBy("component_id").agg(F.count("*").alias("component_size"))
    return labelled.join(sizes, "component_id", "left").select(*[c for c in nodes.columns], "component_id", "component_size")
