"""Exact near-duplicate vectors by dual traversal of cover trees.

Equal vectors of a label become one class first, so copies cost nothing further. The upper
levels of the tree span the cluster: while a label's cell holds more classes than a task takes,
a bounded number of its classes become centres, every class goes to its nearest centre, and a
grouped maximum gives the covering radii. Pairs of cells descend with them: a pair goes on to
those children whose centres are within the threshold plus both radii. Cells that one level more
halves the radii of take it. What no round splits is cut by hash, each part with the radius of the whole.

A surviving pair of cells is one group. In it each cell is indexed by a cover tree, whose
nested levels have halving radii: centres of a level lie further apart than its radius, and each
node knows the true radius that covers its members. The traversal starts from the pair of roots
and drops a pair of nodes when the distance of their centres exceeds the threshold by more than
both covering radii; what is left at the leaves is compared exactly. A group reports the number
of links of each class and spanning links, not all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.components import star_components
from tessera.session import durable, small_batches

COSINE = 0.93
#: Numbers in the vectors of a cell that one task takes (8,192 of 64 dimensions): a group holds two cells.
NUMBERS = 1 << 19
#: Centres that a cell is split by, and rounds of splitting.
FANOUT = 16
ROUNDS = 4
#: Classes from which a cell is tried at one level more, and how many the new cells must hold on average.
REFINED = 64
LEAST_CHILD = 24
#: Rows of centres and of pairs of cells that may be broadcast: some 100 MB of 64 dimensions.
BROADCAST_ROWS = 200_000
#: Nodes of so few members, or so small a radius, are leaves.
LEAF = 48
LEAST_RADIUS = 0.03
#: Distances of children that are held at once.
AT_ONCE = 1 << 20
#: Members that a level of a tree looks at together for its next centres.
ASKED = 256


class Node(NamedTuple):
    """A node of a cover tree over unit vectors."""

    centre: int
    radius: float
    members: np.ndarray
    children: list[Node]
    centres: np.ndarray  # of the children
    radii: np.ndarray
    sizes: np.ndarray  # members of those children that are leaves, 0 of the others


def _node(centre: int, radius: float, members: np.ndarray, children: list[Node]) -> Node:
    return Node(centre, radius, members, children, np.array([c.centre for c in children], int), np.array([c.radius for c in children]), np.array([0 if c.children else len(c.members) for c in children], int))


def cover_tree(x: np.ndarray, members: np.ndarray | None = None, separation: float = 2.0) -> Node:
    """Cover tree over the rows ``members`` of ``x``; the first member is the root's centre."""
    members = np.arange(len(x)) if members is None else members
    centre = members[0]
    if len(members) == 1:
        return _node(centre, 0.0, members, [])
    apart = np.sqrt(np.maximum(0, ((x[members] - x[centre]) ** 2).sum(axis=1)))
    radius = float(apart.max(initial=0.0))
    if len(members) <= LEAF or radius <= LEAST_RADIUS:
        return _node(centre, radius, members, [])
    separation = min(separation, 2.0)
    while separation >= radius:  # levels at which the root would be the only node
        separation /= 2
    children, left = [], members
    while len(left):
        own = x[left]
        near = 2 - 2 * (own[:ASKED] @ own.T) <= separation**2
        free = np.ones(len(left), bool)
        for i in range(len(near)):
            if free[i]:
                taken = near[i] & free
                taken[i] = True
                free &= ~taken
                children.append(cover_tree(x, left[taken][np.argsort(left[taken] != left[i], kind="stable")], separation / 2))
        left = left[free]
    return _node(centre, radius, members, children)


def near_pairs(a: np.ndarray, b: np.ndarray | None, cosine: float = COSINE) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of unit rows of ``a`` and ``b`` (or within ``a``, each once) at ``cosine`` or more."""
    same = b is None
    b = a if same else b
    if not len(a) or not len(b):
        return np.zeros(0, int), np.zeros(0, int)
    reach = np.sqrt(2 - 2 * cosine) + 1e-7
    root_a = cover_tree(a)
    root_b = root_a if same else cover_tree(b)
    left, right, todo = [], [], [(root_a, root_b)]

    def compare(i: np.ndarray, j: np.ndarray, within: bool = False) -> None:
        """The pairs of members ``i`` and ``j`` that are near enough; ``within``: both are one list."""
        for at in range(0, len(i), few := max(1, AT_ONCE // max(1, len(j)))):
            k, m = np.nonzero(a[i[at : at + few]] @ b[j].T >= cosine - 1e-9)
            k += at
            keep = k < m if within else slice(None)
            left.append(i[k[keep]])
            right.append(j[m[keep]])

    while todo:
        p, q = todo.pop()
        if not p.children and not q.children:
            compare(p.members, q.members, p is q)
            continue
        ps, pc, pr, pn = (p.children, p.centres, p.radii, p.sizes) if p.children else ([p], np.array([p.centre]), np.array([p.radius]), np.array([len(p.members)]))
        qs, qc, qr, qn = (q.children, q.centres, q.radii, q.sizes) if q.children else ([q], np.array([q.centre]), np.array([q.radius]), np.array([len(q.members)]))
        few = max(1, AT_ONCE // len(qs))
        for at in range(0, len(ps), few):
            own = np.arange(at, min(at + few, len(ps)))
            apart = np.sqrt(np.maximum(0, 2 - 2 * (a[pc[own]] @ b[qc].T)))
            near = apart <= reach + pr[own, None] + qr[None, :]
            if p is q:
                near &= own[:, None] <= np.arange(len(qs))[None, :]
            # Leaves of one member have been compared by this; leaves of several are, many at once.
            one_p, one_q = pn[own] == 1, qn == 1
            i, j = np.nonzero(near & one_p[:, None] & one_q[None, :] & (apart <= reach))
            i, j = pc[own[i]], qc[j]
            close = (a[i] * b[j]).sum(axis=1) >= cosine - 1e-9
            close &= (i != j) if p is q else True
            left.append(i[close])
            right.append(j[close])
            for k in np.flatnonzero(pn[own] > 1):
                met = np.flatnonzero(near[k] & (qn > 0))
                met = met[met != own[k]] if p is q else met
                if len(met):
                    compare(ps[own[k]].members, np.concatenate([qs[m].members for m in met]))
            for m in np.flatnonzero(qn > 1):
                met = own[np.flatnonzero(near[:, m] & one_p)]
                if len(met):
                    compare(pc[met], qs[m].members)
            for k, m in zip(*(x.tolist() for x in np.nonzero(near & ((pn[own] == 0)[:, None] | (qn == 0)[None, :]))), strict=True):
                todo.append((ps[own[k]], qs[m]))
            if p is q:
                todo.extend((ps[k], ps[k]) for k in own[pn[own] > 1])
    return np.concatenate(left or [np.zeros(0, int)]), np.concatenate(right or [np.zeros(0, int)])


def _spanning(i: np.ndarray, j: np.ndarray, n: int) -> list[tuple[int, int]]:
    up = list(range(n))
    out = []
    for a, b in zip(i.tolist(), j.tolist(), strict=True):
        while up[a] != a:
            up[a] = up[up[a]]
            a = up[a]
        while up[b] != b:
            up[b] = up[up[b]]
            b = up[b]
        if a != b:
            up[max(a, b)] = min(a, b)
            out.append((a, b))
    return out


def _group(cosine: float):
    def per_group(table: pa.Table) -> pa.Table:
        ids, weight, second = (table.column(c).to_numpy() for c in ("cid", "n", "second"))
        order = np.lexsort((ids, second))
        ids, weight, second = ids[order], weight[order], second[order]
        flat = table.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        raw = flat.astype(np.float64, copy=False).reshape(len(ids), -1)[order]
        raw = raw / np.abs(raw).max(axis=1, keepdims=True)  # no overflow in the squares
        unit = raw / np.sqrt((raw**2).sum(axis=1, keepdims=True))
        cut = int(np.searchsorted(second, True)) if second.any() else len(ids)
        whole = table.column("a")[0] == table.column("b")[0]  # a cell against itself
        i, j = near_pairs(unit[:cut], None if whole else unit[cut:], cosine)  # parts by hash may be empty
        j = j if whole else j + cut
        dots = (raw[i] * raw[j]).sum(axis=1) / (np.sqrt((raw[i] ** 2).sum(axis=1)) * np.sqrt((raw[j] ** 2).sum(axis=1)))
        i, j = i[dots >= cosine], j[dots >= cosine]
        linked = np.bincount(i, weight[j], len(ids)) + np.bincount(j, weight[i], len(ids))
        has = np.flatnonzero(linked)
        links = _spanning(i, j, len(ids))
        a = [*ids[has].tolist(), *(int(ids[x]) for x, _ in links)]
        b = [*[None] * len(has), *(int(ids[y]) for _, y in links)]
        n = [*linked[has].astype(np.int64).tolist(), *[0] * len(links)]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "n": pa.array(n, pa.int64())})

    return per_group


def _units(df: DataFrame) -> DataFrame:
    """``df`` with ``unit``: the vector scaled to length one in double precision, its largest component scaled out first."""
    most = F.array_max(F.transform("embedding", lambda x: F.abs(x))).cast("double")
    scaled = df.withColumn("most", most).withColumn("scaled", F.expr("transform(embedding, v -> double(v) / most)"))
    length = scaled.withColumn("length", F.sqrt(F.aggregate("scaled", F.lit(0.0), lambda s, x: s + x * x)))
    return length.withColumn("unit", F.expr("transform(scaled, v -> v / length)")).drop("most", "scaled", "length")


def _nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nearest of a cell's centres to each class, and its distance."""
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        cid, cell, emb, centres = batch.columns
        out_k, out_d = [], []
        for c, e, own in zip(cell, emb, centres, strict=True):
            key = c.as_py()
            if key not in held:
                if len(held) > 64:
                    held.clear()
                held[key] = np.stack([x.values.to_numpy() for x in own.values])
            x = e.values.to_numpy(zero_copy_only=False).astype(np.float64)
            x = x / np.abs(x).max()
            dots = held[key] @ (x / np.sqrt(x @ x))
            k = int(dots.argmax())
            out_k.append(k)
            out_d.append(float(np.sqrt(max(0.0, 2 - 2 * dots[k]))))
        yield pa.RecordBatch.from_arrays([cid, cell, emb, pa.array(out_k, pa.int32()), pa.array(out_d, pa.float64())], ["cid", "cell", "embedding", "k", "d"])


def cells(classes: DataFrame, cosine: float = COSINE, block: int | None = None, fanout: int = FANOUT, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """``(cid, cell)`` of all classes, and the pairs ``(a, b)`` of cells, a <= b, that may hold links.

    ``classes`` is ``(cid, label, embedding)``. A cell holds about ``block`` classes at most (by default
    as many as hold ``NUMBERS`` numbers), whose vectors have one label and one length. Every link lies in a pair. Driver state: counts.
    """
    reach = float(np.sqrt(2 - 2 * cosine)) + 1e-6
    vector = classes.schema["embedding"].dataType.simpleString()
    todo = classes.select("cid", F.xxhash64("label", F.size("embedding")).alias("cell"), "embedding")
    most = F.lit(block) if block else F.ceil(F.lit(NUMBERS) / F.col("dim"))
    sizes = durable(todo.groupBy("cell").agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("dim")).withColumn("most", most))
    pairs = durable(sizes.select(F.col("cell").alias("a"), F.col("cell").alias("b"), F.col("n").alias("na"), F.col("n").alias("nb"), *[F.lit(None).cast("array<double>").alias(c) for c in ("ca", "cb")], *[F.lit(0.0).alias(c) for c in ("ra", "rb")]))
    done = []

    def settled(pairs: DataFrame, children: DataFrame) -> DataFrame:
        """Pairs of the children of paired cells that are within reach; cells without children stay as they are."""
        for end in "ab":
            kids = children.select(F.col("parent").alias(end), F.col("cell").alias(f"k{end}"), F.col("n").alias(f"m{end}"), F.col("centre").alias(f"v{end}"), F.col("radius").alias(f"w{end}"))
            pairs = pairs.join(F.broadcast(kids) if small else kids, end, "left")
        kept = [F.coalesce(f"{x}{end}", f"{y}{end}").alias(f"{y}{end}") for y, x in (("c", "v"), ("r", "w"), ("n", "m")) for end in "ab"]
        moved = pairs.select(F.coalesce("ka", "a").alias("p"), F.coalesce("kb", "b").alias("q"), (F.col("a") == F.col("b")).alias("own"), *kept).where("not own or p <= q")
        dot = F.aggregate(F.zip_with("ca", "cb", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
        far = F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * dot)) > reach + F.col("ra") + F.col("rb")
        return moved.where((F.col("p") == F.col("q")) | ~F.coalesce(far, F.lit(False))).select(F.col("p").alias("a"), F.col("q").alias("b"), "na", "nb", "ca", "cb", "ra", "rb")

    def split(open_: DataFrame, cells_: int, most_centres, seed: int, apart: F.Column | None = None) -> tuple[DataFrame, DataFrame]:
        """The classes of open cells with their nearest centre's cell, and those new cells with their radii.

        Centres are the first of some 4 * fanout classes by a hash of their id; with ``apart``
        only those of them that far from all earlier ones.
        """
        some = open_.where(F.pmod(F.xxhash64("cid", F.lit(seed)), F.col("n")) < 4 * fanout)
        first = some.withColumn("k", F.row_number().over(Window.partitionBy("cell").orderBy(F.xxhash64("cid"), "cid"))).where(F.col("k") <= most_centres)
        listed = _units(first.withColumn("apart", F.lit(0.0) if apart is None else apart)).groupBy("cell").agg(F.max("apart").alias("apart"), F.array_sort(F.collect_list(F.struct("k", "unit"))).alias("s"))
        far = lambda u, v: 2 - 2 * F.aggregate(F.zip_with(u, v, lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x) > F.col("apart") * F.col("apart")
        empty = F.expr("cast(array() as array<array<double>>)")
        net = F.aggregate("s", empty, lambda a, x: F.when(F.forall(a, lambda u: far(u, x["unit"])), F.concat(a, F.array(x["unit"]))).otherwise(a))
        centres = durable(listed.select("cell", (F.transform("s", lambda x: x["unit"]) if apart is None else net).alias("centres")))
        met = open_.select("cid", "cell", "embedding").join(F.broadcast(centres) if cells_ * fanout <= BROADCAST_ROWS else centres, "cell", "left")
        met = met.select("cid", "cell", "embedding", F.coalesce("centres", F.array(F.col("embedding").cast("array<double>"))).alias("centres"))
        placed = durable(met.mapInArrow(_nearest, f"cid bigint, cell bigint, embedding {vector}, k int, d double"))
        covered = placed.groupBy("cell", "k").agg(F.count("*").alias("n"), F.max("d").alias("radius"), F.max(F.size("embedding")).alias("dim"))
        children = covered.join(centres, "cell", "left").select(F.col("cell").alias("parent"), F.xxhash64("cell", "k").alias("cell"), "n", "dim", F.expr("try_element_at(centres, k + 1)").alias("centre"), F.when(F.col("centres").isNotNull(), F.col("radius") + 1e-6).alias("radius"))
        return placed, durable(children)

    def sized(cells_: DataFrame, rows: int) -> DataFrame:
        return F.broadcast(cells_) if rows <= BROADCAST_ROWS else cells_

    made, n_made = [], 0
    for n in range(rounds + 1):
        counted = todo.join(sized(sizes, sizes.count()), "cell")
        done.append(counted.where("n <= most").select("cid", "cell", "embedding"))
        n_big = sizes.where("n > most").count()
        if not n_big or n == rounds:
            break
        placed, children = split(counted.where("n > most"), n_big, F.least(F.lit(fanout), F.ceil(F.col("n") / F.col("most")) + 1), n)
        small = n_big * fanout <= BROADCAST_ROWS
        pairs = durable(settled(pairs, children))
        todo = placed.select("cid", F.xxhash64("cell", "k").alias("cell"), "embedding")
        sizes = children.select("cell", "n", "dim", "radius").withColumn("most", most)
        made.append(sizes.where("n <= most").select("cell", "n", "radius"))
        n_made += n_big * fanout
    out = reduce(DataFrame.unionByName, done)
    if made:
        # One level more where it halves the radii: clusters then get cells of their own, and far ones never meet.
        known = durable(reduce(DataFrame.unionByName, made).where(F.col("n") >= REFINED))
        placed, children = split(out.join(sized(known, n_made), "cell"), n_made, F.lit(8 * fanout), rounds, F.col("radius") / 2)
        tight = children.groupBy(F.col("parent").alias("cell")).agg((F.sum(F.col("n") * F.col("radius")) / F.sum("n")).alias("mean"), F.count("*").alias("into"))
        tight = tight.join(known, "cell").where((2 * F.col("mean") <= F.col("radius")) & (F.col("n") >= LEAST_CHILD * F.col("into"))).select("cell")
        tight = durable(tight)
        small = n_made * fanout <= BROADCAST_ROWS
        pairs = durable(settled(pairs, children.join(tight.withColumnRenamed("cell", "parent"), "parent", "left_semi")))
        finer = placed.join(sized(tight, n_made), "cell", "left_semi").select("cid", F.xxhash64("cell", "k").alias("cell"))
        out = out.join(sized(tight, n_made), "cell", "left_anti").select("cid", "cell").unionByName(finer)
    out = out.select("cid", "cell")
    # What is still too big: parts by hash, with the centre and the radius of the whole.
    parts = F.ceil(F.col("n") / F.col("most")).cast("int")
    whole = durable(sizes.where("n > most"))
    if not whole.isEmpty():
        small = whole.count() <= BROADCAST_ROWS
        last = todo.join(sized(whole, whole.count()), "cell")
        out = out.unionByName(last.select("cid", F.xxhash64("cell", F.lit("part"), F.pmod(F.xxhash64("cid"), parts).cast("bigint")).alias("cell")))
        split_ = whole.select(F.col("cell").alias("parent"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("i")).select("parent", F.xxhash64("parent", F.lit("part"), F.col("i").cast("bigint")).alias("cell"), F.lit(None).cast("bigint").alias("n"), F.lit(None).cast("array<double>").alias("centre"), F.lit(None).cast("double").alias("radius"))
        pairs = durable(settled(pairs, split_))
    return durable(out), pairs.select("a", "b")


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, block: int | None = None, fanout: int = FANOUT, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``(id, n_links, component_id, kept)`` for every row of ``vectors``.

    Only vectors of equal, non-null labels and equal length are compared. A vector that is null,
    empty or zero, or that holds a null or non-finite number, links with nothing, and its row is
    its own component. Rows with equal vectors are linked with each other, repeated rows too. A
    null id counts as a link of others; a component of null ids has a null id. Numbers other
    than float are compared as doubles.
    """
    small_batches(vectors.sparkSession)
    stored = vectors.schema[vector_col].dataType.simpleString()
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast(stored if stored == "array<float>" else "array<double>").alias("embedding"))
    usable = F.expr("label is not null and size(embedding) > 0 and forall(embedding, v -> v is not null and not isnan(v) and abs(v) < double('Infinity')) and exists(embedding, v -> v <> 0)")
    classes = rows.where(usable).groupBy("label", "embedding").agg(F.min("id").alias("least"), F.count("*").alias("n"))
    classes = durable(classes.withColumn("cid", F.monotonically_increasing_id()))
    placed, pairs = cells(classes, cosine, block, fanout)
    ends = pairs.select("a", "b", F.explode(F.when(F.col("a") == F.col("b"), F.array("a")).otherwise(F.array("a", "b"))).alias("cell")).withColumn("second", F.col("cell") != F.col("a"))
    ends = durable(ends)
    placed = placed.join(classes.select("cid", "n", "embedding"), "cid")
    dealt = placed.join(F.broadcast(ends) if ends.count() <= BROADCAST_ROWS else ends, "cell").select("a", "b", "cid", "n", "embedding", "second")
    found = durable(dealt.groupBy("a", "b").applyInArrow(_group(cosine), "a bigint, b bigint, n bigint"))
    labels = star_components(found.where("b is not null")).withColumnsRenamed({"node": "cid"})
    links = found.where("b is null").groupBy(F.col("a").alias("cid")).agg(F.sum("n").alias("others"))
    joined = classes.join(links, "cid", "left").join(labels, "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    roots = joined.groupBy("component").agg(F.min("least").alias("component_id"))
    done = joined.join(roots, "component").select("label", "embedding", (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id", F.lit(True).alias("in"))
    out = rows.join(done, ["label", "embedding"], "left")
    component = F.when(F.col("in"), F.col("component_id")).otherwise(F.col("id"))
    return out.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("id") == component).alias("kept"))


#: All pairs of a label, and the rows that a chain of links reaches.
ORACLE_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
n AS (SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS s FROM v),
link AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM n a JOIN n b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
  WHERE list_dot_product(a.e, b.e) / (a.s * b.s) >= 0.93),
reach AS (SELECT vec_id AS x, vec_id AS y FROM embeddings UNION SELECT reach.x, link.y FROM reach JOIN link ON link.x = reach.y),
least AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x),
counts AS (SELECT x, count(*) AS n FROM link GROUP BY x)
SELECT vec_id, CAST(coalesce(counts.n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN least ON least.x = vec_id LEFT JOIN counts ON counts.x = vec_id
"""


def query(spark, sf_dir: str) -> DataFrame:
    """Links and components of all vectors."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).withColumnRenamed("id", "vec_id")
