"""Overlay of polygon layers: union, intersection, difference, buffers, erosion and opening.

A layer is worked on as directed boundary segments with the inside on their left; rings are only
put together at the end. Coordinates are rounded to a grid, segments are cut at the borders of
tiles, and each tile arranges its own ones exactly on integers (``functions.arrangement``). What
winds around a tile without touching it is known from the crossings of its row: the winding
numbers at the lower left corner of a tile are a running sum along the row. So no task holds
more than one tile, whatever the size of a polygon or of the layer.

Grid points have even numbers of half units and tile borders odd ones, so no point lies on a
border, and both tiles at a border compute the same cut from the same segment.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.arrangement import LARGEST, chains, divided, straightened
from tessera.operators.components import connected_components
from tessera.session import durable

#: What the winding numbers of the first and of the second layer must be inside the result.
RULES = {
    "union": lambda w: (w > 0).any(axis=1),
    "intersection": lambda w: (w > 0).all(axis=1),
    "difference": lambda w: (w[:, 0] > 0) & (w[:, 1] <= 0),
    "symmetric": lambda w: (w[:, 0] > 0) != (w[:, 1] > 0),
}
_RULE_SQL = {"union": "wa > 0 or wb > 0", "intersection": "wa > 0 and wb > 0", "difference": "wa > 0 and wb <= 0", "symmetric": "(wa > 0) <> (wb > 0)"}
_PATH = "tx long, ty long, path array<struct<x:long,y:long>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _pairs(ring: Column) -> Column:
    """The steps of a ring as structs of their ends a and b."""
    steps = lambda r: F.zip_with(F.slice(r, F.lit(1), F.greatest(F.size(r) - 1, F.lit(0))), F.slice(r, F.lit(2), F.greatest(F.size(r) - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    return let(ring, steps)


def ring_area(ring: Column) -> Column:
    """Signed area of a closed ring of struct(x, y), positive if it runs counterclockwise; from its first point, for precision."""

    def around(first: Column, pairs: Column) -> Column:
        step = lambda s, p: s + (p["a"]["x"] - first["x"]) * (p["b"]["y"] - first["y"]) - (p["b"]["x"] - first["x"]) * (p["a"]["y"] - first["y"])
        return F.aggregate(pairs, F.lit(0.0), step) / 2

    return let(ring, lambda r: let(F.get(r, F.lit(0)), lambda first: around(first, _pairs(r))))


def closed_ring(ring: Column) -> Column:
    """The ring without null points, its first point repeated at its end; null with fewer than three points."""
    known = F.filter(ring, lambda p: p["x"].isNotNull() & p["y"].isNotNull() & ~F.isnan(p["x"]) & ~F.isnan(p["y"]))
    shut = lambda r: F.when(F.size(r) < 3, None).when(F.get(r, F.lit(0)) == F.element_at(r, -1), r).otherwise(F.concat(r, F.slice(r, 1, 1)))
    return let(known, shut)


def ring_segments(rings: DataFrame, ring: str = "ring", hole: str | None = None) -> DataFrame:
    """``(x1, y1, x2, y2)`` of all rings, counterclockwise, or clockwise where ``hole`` is true.

    Rings may be open or closed and run either way; null rings, null points and rings without
    area give no segments.
    """
    cut_out = F.coalesce(F.col(hole), F.lit(False)) if hole else F.lit(False)
    turned = lambda r: let(ring_area(r), lambda a: F.when(a == 0, None).when((a > 0) == cut_out, F.reverse(r)).otherwise(r))
    steps = rings.select(F.explode(_pairs(let(closed_ring(F.col(ring)), turned))).alias("s"))
    return steps.select("s.a.x", "s.a.y", "s.b.x", "s.b.y").toDF("x1", "y1", "x2", "y2")


def _even(value: Column) -> Column:
    return (F.floor(value / 2 + 0.5) * 2).cast("long")


def _weighted(first: DataFrame, second: DataFrame | None, unit: float) -> DataFrame:
    """Segments on the grid, each once, from the lesser end to the greater, with its weight in each layer."""
    sides = [first.select("x1", "y1", "x2", "y2", F.lit(1).alias("wa"), F.lit(0).alias("wb"))]
    if second is not None:
        sides.append(second.select("x1", "y1", "x2", "y2", F.lit(0).alias("wa"), F.lit(1).alias("wb")))
    both = sides[0] if second is None else sides[0].unionByName(sides[1])
    grid = both.select(*[(F.floor(F.col(c) / unit + 0.5) * 2).cast("long").alias(c) for c in ("x1", "y1", "x2", "y2")], "wa", "wb")
    forth = (F.col("x1") < F.col("x2")) | ((F.col("x1") == F.col("x2")) & (F.col("y1") < F.col("y2")))
    pick = lambda a, b: F.when(forth, F.col(a)).otherwise(F.col(b))
    ordered = grid.select(pick("x1", "x2").alias("x1"), pick("y1", "y2").alias("y1"), pick("x2", "x1").alias("x2"), pick("y2", "y1").alias("y2"), *[F.when(forth, F.col(w)).otherwise(-F.col(w)).alias(w) for w in ("wa", "wb")])
    summed = ordered.groupBy("x1", "y1", "x2", "y2").agg(F.sum("wa").alias("wa"), F.sum("wb").alias("wb"))
    return summed.where("(x1 <> x2 or y1 <> y2) and (wa <> 0 or wb <> 0)")


def _pieces(segments: DataFrame, size: int) -> DataFrame:
    """Segments cut at tile borders: ``(tx, ty, x1, y1, x2, y2, wa, wb)``, first by columns, then by rows.

    The rows that a piece of a column meets follow from its rounded ends, so what rounding does
    near a corner is the same on all sides of it.
    """
    tile = lambda v: F.floor((v + 1) / F.lit(float(size)))
    col = F.col
    columns = segments.select("*", tile(col("x1")).alias("c1"), tile(col("x2")).alias("c2")).select("*", F.explode(F.sequence("c1", "c2")).alias("tx"))
    y_at = lambda line: _even(col("y1") + (col("y2") - col("y1")) * ((line - col("x1")) / (col("x2") - col("x1"))))
    left, right = col("tx") * size - 1, (col("tx") + 1) * size - 1
    columns = columns.select(
        "tx", "wa", "wb",
        F.when(col("tx") == col("c1"), col("x1")).otherwise(left).alias("xa"), F.when(col("tx") == col("c1"), col("y1")).otherwise(y_at(left)).alias("ya"),
        F.when(col("tx") == col("c2"), col("x2")).otherwise(right).alias("xb"), F.when(col("tx") == col("c2"), col("y2")).otherwise(y_at(right)).alias("yb"),
    )
    rising = col("yb") >= col("ya")
    low_high = columns.select(
        "tx", "wa", "wb", rising.alias("rising"),
        F.when(rising, col("xa")).otherwise(col("xb")).alias("lx"), F.least("ya", "yb").alias("ly"),
        F.when(rising, col("xb")).otherwise(col("xa")).alias("hx"), F.greatest("ya", "yb").alias("hy"),
    )
    rows = low_high.select("*", tile(col("ly")).alias("r1"), tile(col("hy")).alias("r2")).select("*", F.explode(F.sequence("r1", "r2")).alias("ty"))
    inner = lambda x: F.greatest(col("tx") * size, F.least((col("tx") + 1) * size - 2, x))
    x_at = lambda line: inner(_even(col("lx") + (col("hx") - col("lx")) * ((line - col("ly")) / (col("hy") - col("ly")))))
    bottom, top = col("ty") * size - 1, (col("ty") + 1) * size - 1
    px, py = F.when(col("ty") == col("r1"), col("lx")).otherwise(x_at(bottom)), F.when(col("ty") == col("r1"), col("ly")).otherwise(bottom)
    qx, qy = F.when(col("ty") == col("r2"), col("hx")).otherwise(x_at(top)), F.when(col("ty") == col("r2"), col("hy")).otherwise(top)
    ends = rows.select("tx", "ty", "wa", "wb", "rising", px.alias("px"), py.alias("py"), qx.alias("qx"), qy.alias("qy"))
    turn = lambda a, b: F.when(col("rising"), col(a)).otherwise(col(b))
    directed = ends.select("tx", "ty", turn("px", "qx").alias("x1"), turn("py", "qy").alias("y1"), turn("qx", "px").alias("x2"), turn("qy", "py").alias("y2"), "wa", "wb")
    return directed.where("x1 <> x2 or y1 <> y2")


def _overlay_tile(size: int, rule: str):
    keep = RULES[rule]

    def overlay(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        tx, ty = (k.as_py() for k in key)
        values = lambda names: np.stack([rows[c].to_numpy() for c in names], axis=1)
        origin = np.array([tx * size - 1, ty * size - 1] * 2, np.int64)
        found = divided(values(["x1", "y1", "x2", "y2"]) - origin, values(["wa", "wb"]), values(["ca", "cb"])[0], size, keep)
        paths = [straightened(path) + origin[:2] for path in chains(found, size)]
        return pa.table({"tx": pa.array([tx] * len(paths), pa.int64()), "ty": pa.array([ty] * len(paths), pa.int64()), "path": _path_array(paths)})

    return overlay


def _path_array(paths: list[np.ndarray]) -> pa.Array:
    points = np.concatenate(paths) if paths else np.zeros((0, 2), np.int64)
    flat = pa.StructArray.from_arrays([pa.array(points[:, 0], pa.int64()), pa.array(points[:, 1], pa.int64())], ["x", "y"])
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, paths)]), pa.int32()), flat)


@dataclass(frozen=True)
class Layer:
    """A layer as paths between tile borders (in half units), and the tiles whose lower left corner lies inside."""

    paths: DataFrame
    corners: DataFrame
    unit: float
    size: int

    def edges(self) -> DataFrame:
        """``(x1, y1, x2, y2)``: directed boundary segments, the inside on their left."""
        steps = self.paths.select("path", F.explode(F.sequence(F.lit(0), F.size("path") - 2)).alias("k"))
        a, b = F.get("path", F.col("k")), F.get("path", F.col("k") + 1)
        half = self.unit / 2
        return steps.select((a["x"] * half).alias("x1"), (a["y"] * half).alias("y1"), (b["x"] * half).alias("x2"), (b["y"] * half).alias("y2"))

    def measure(self) -> DataFrame:
        """One row ``(area, length)``; zeros for an empty layer. Areas are exact for the rounded coordinates."""
        edges = self.paths.select("path", F.explode(F.sequence(F.lit(0), F.size("path") - 2)).alias("k"))
        a, b = F.get("path", F.col("k")), F.get("path", F.col("k") + 1)
        strip = (b["y"] - a["y"]).cast("decimal(38,0)") * (a["x"] + b["x"]).cast("decimal(19,0)")
        length = F.hypot((b["x"] - a["x"]).cast("double"), (b["y"] - a["y"]).cast("double"))
        found = edges.agg(F.sum(strip).alias("area"), F.sum(length).alias("length"))
        half = self.unit / 2
        return found.select(F.coalesce(F.col("area").cast("double") / 2 * half * half, F.lit(0.0)).alias("area"), F.coalesce(F.col("length") * half, F.lit(0.0)).alias("length"))

    def holds(self, points: DataFrame, point: str = "id") -> DataFrame:
        """``(point, inside)`` for points ``(point, x, y)``; null coordinates lie outside, points on the boundary on either side."""
        half, size = self.unit / 2, self.size
        tile = lambda c: F.floor((F.floor(F.col(c) / self.unit + 0.5) * 2 + 1) / F.lit(float(size)))
        placed = points.select(point, (F.col("x") / half).alias("x"), (F.col("y") / half).alias("y"), tile("x").alias("tx"), tile("y").alias("ty"))
        step = F.struct("x1", "y1", "x2", "y2")
        cut = self.paths.select("tx", "ty", "path", F.explode(F.sequence(F.lit(0), F.size("path") - 2)).alias("k"))
        a, b = F.get("path", F.col("k")), F.get("path", F.col("k") + 1)
        held = cut.select("tx", "ty", a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2")).groupBy("tx", "ty").agg(F.collect_list(step).alias("steps"))
        met = placed.join(self.corners, ["tx", "ty"], "left").join(held, ["tx", "ty"], "left")
        # From the tile's corner along its lower border, then straight up.
        bottom = F.col("ty") * size - 1

        def crossed(s: Column) -> Column:
            along = F.when((F.least(s["y1"], s["y2"]) == bottom) & (F.when(s["y1"] == bottom, s["x1"]).otherwise(s["x2"]) <= F.col("x")), F.when(s["y2"] > s["y1"], -1).otherwise(1)).otherwise(0)
            rightward = s["x2"] > s["x1"]
            ax, ay, bx, by = (F.when(rightward, s[p]).otherwise(s[q]) for p, q in (("x1", "x2"), ("y1", "y2"), ("x2", "x1"), ("y2", "y1")))
            under = (ax <= F.col("x")) & (F.col("x") < bx) & ((bx - ax) * (F.col("y") - ay) - (by - ay) * (F.col("x") - ax) > 0)
            return along + F.when(under, F.when(rightward, 1).otherwise(-1)).otherwise(0)

        wound = F.coalesce(F.col("inside").cast("int"), F.lit(0)) + F.aggregate(F.coalesce("steps", F.array().cast("array<struct<x1:long,y1:long,x2:long,y2:long>>")), F.lit(0), lambda n, s: n + crossed(s))
        return met.select(point, F.coalesce(wound > 0, F.lit(False)).alias("inside"))

    def rings(self) -> DataFrame:
        """``(ring, area)``: closed rings of struct(x, y), counterclockwise around the inside; holes have negative areas.

        Paths that end at tile borders are joined there: at a point where several meet each goes
        on along the one that leaves the least inside between them. A ring is one value, so it
        is put together in one task; points that only a tile border made are left out again.
        """
        paths = durable(self.paths.withColumn("pid", F.monotonically_increasing_id()))
        first, last = F.get("path", F.lit(0)), F.element_at("path", -1)
        closed, open_ = paths.where(first == last), paths.where(first != last)
        second, before = F.get("path", F.lit(1)), F.element_at("path", -2)
        angle = lambda a, b: F.atan2((b["y"] - a["y"]).cast("double"), (b["x"] - a["x"]).cast("double"))
        outs = open_.select(first.alias("v"), F.col("pid").alias("next"), angle(first, second).alias("out"))
        ins = open_.select(last.alias("v"), "pid", angle(last, before).alias("back"))
        turn = F.pmod(F.col("back") - F.col("out"), F.lit(2 * np.pi))
        links = ins.join(outs, "v").groupBy("pid").agg(F.min_by("next", F.struct(turn, "next")).alias("next"))
        ids = connected_components(open_.select(F.col("pid").alias("node")), links.select(F.col("pid").alias("a"), F.col("next").alias("b")))
        parts = open_.select("pid", "path").join(links, "pid").join(ids.select(F.col("node").alias("pid"), F.col("component_id").alias("ring")), "pid")
        joined = parts.groupBy("ring").applyInArrow(_join_paths, "path array<struct<x:long,y:long>>")
        whole = closed.select("path").unionByName(joined)
        real = F.filter("path", lambda p: (p["x"] % 2 == 0) & (p["y"] % 2 == 0))
        corners = whole.select(real.alias("p")).select(F.when(F.get("p", F.lit(0)) == F.element_at("p", -1), F.slice("p", F.lit(1), F.size("p") - 1)).otherwise(F.col("p")).alias("p")).where("size(p) > 2")
        half = self.unit / 2
        ring = F.transform(F.concat("p", F.slice("p", 1, 1)), lambda q: F.struct((q["x"] * half).alias("x"), (q["y"] * half).alias("y")))
        return corners.select(ring.alias("ring")).withColumn("area", ring_area(F.col("ring"))).where("area <> 0")


def _join_paths(rows: pa.Table) -> pa.Table:
    """Paths of one ring in order; a component of links that is several cycles gives several rings."""
    paths = rows["path"].combine_chunks()
    flat, ends = paths.flatten(), np.concatenate([[0], np.cumsum(paths.value_lengths().to_numpy())])
    points = np.stack([flat.field("x").to_numpy(), flat.field("y").to_numpy()], axis=1)
    after = {pid: (to, n) for n, (pid, to) in enumerate(zip(rows["pid"].to_pylist(), rows["next"].to_pylist(), strict=True))}
    rings = []
    while after:
        at, ring = next(iter(after)), []
        while at in after:
            at, n = after.pop(at)
            ring.append(points[ends[n] + bool(ring) : ends[n + 1]])
        rings.append(np.concatenate(ring))
    return pa.table({"path": _path_array(rings)})


def overlay(first: DataFrame, second: DataFrame | None = None, rule: str = "union", cell: float = 1000.0, unit: float = 0.001) -> Layer:
    """Boolean combination of two sets of directed segments ``(x1, y1, x2, y2)``, as ``ring_segments`` or ``Layer.edges`` give them.

    Each set stands for what its rings wind around at least once: overlapping, touching, nested
    and repeated polygons are dissolved. Coordinates are rounded to ``unit``, and crossings too,
    which is the tolerance of the result. ``cell`` is the side of a tile: a tile's segments are
    arranged in one task, so it should be small enough for the densest place. Repeated polygons
    are summed before tiles are dealt. An empty set gives an empty layer.
    """
    size = 2 * round(cell / unit)
    if not 4 <= size <= LARGEST:
        raise ValueError(f"a tile may have up to {LARGEST // 2} units a side, not {size // 2}")
    tasks = int(first.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # said outright: bytes don't tell how long a tile takes
    pieces = durable(_pieces(_weighted(first, second, unit), size).repartition(tasks, "tx", "ty"))
    bottom = F.col("ty") * size - 1
    low = F.least("y1", "y2") == bottom
    walk = lambda w: F.sum(F.when(low, F.when(F.col("y2") > F.col("y1"), -F.col(w)).otherwise(F.col(w))).otherwise(0))
    tiles = pieces.groupBy("tx", "ty").agg(walk("wa").alias("da"), walk("wb").alias("db"))
    row = Window.partitionBy("ty").orderBy("tx")
    before = row.rowsBetween(Window.unboundedPreceding, -1)
    upto = row.rowsBetween(Window.unboundedPreceding, 0)
    tiles = durable(
        tiles.select(
            "tx", "ty", *[F.coalesce(F.sum(f"d{s}").over(before), F.lit(0)).alias(f"c{s}") for s in "ab"],
            *[F.sum(f"d{s}").over(upto).alias(f"w{s}") for s in "ab"], F.lead("tx").over(row).alias("next"),
        )
    )
    paths = durable(pieces.join(tiles.select("tx", "ty", "ca", "cb"), ["tx", "ty"]).repartition(tasks, "tx", "ty").groupBy("tx", "ty").applyInArrow(_overlay_tile(size, rule), _PATH))
    own = tiles.where(F.expr(_RULE_SQL[rule].replace("wa", "ca").replace("wb", "cb"))).select("tx", "ty")
    between = tiles.where(F.expr(_RULE_SQL[rule]) & (F.col("next") > F.col("tx") + 1)).select(F.explode(F.sequence(F.col("tx") + 1, F.col("next") - 1)).alias("tx"), "ty")
    return Layer(paths, own.unionByName(between).withColumn("inside", F.lit(True)), unit, size)


def capsules(edges: DataFrame, reach: float, quad: int = 16) -> DataFrame:
    """Segments of the rings around each edge at distance ``reach``, with ``quad`` steps a quarter of their round ends.

    The round ends are polygons inscribed in circles, so they fall short of the true distance by
    at most ``reach * (1 - cos(pi / (4 * quad)))``.
    """
    corners, step = 2 * (2 * quad + 1), np.pi / 2 / quad
    right = F.atan2(F.col("y2") - F.col("y1"), F.col("x2") - F.col("x1")) - np.pi / 2
    steps = edges.where("x1 <> x2 or y1 <> y2").select("x1", "y1", "x2", "y2", right.alias("t"), F.explode(F.sequence(F.lit(0), F.lit(corners - 1))).alias("k"))

    def corner(k: Column) -> list[Column]:
        front = k <= 2 * quad
        angle = F.col("t") + F.when(front, k * step).otherwise((k - 1) * step)
        return [F.when(front, F.col("x2")).otherwise(F.col("x1")) + reach * F.cos(angle), F.when(front, F.col("y2")).otherwise(F.col("y1")) + reach * F.sin(angle)]

    return steps.select(*corner(F.col("k")), *corner((F.col("k") + 1) % corners)).toDF("x1", "y1", "x2", "y2")


def shortfall(reach: float, quad: int = 16) -> float:
    """How far a buffer's border may lie inside the true one."""
    return reach * (1 - float(np.cos(np.pi / (4 * quad))))


def dilate(layer: Layer, reach: float, quad: int = 16, cell: float | None = None) -> Layer:
    """All points at most ``reach`` from the layer (see ``shortfall``), on tiles of ``cell`` (the layer's own if None)."""
    edges = layer.edges()
    return overlay(edges.unionByName(capsules(edges, reach, quad)), None, "union", cell or layer.size * layer.unit / 2, layer.unit) if reach > 0 else layer


def erode(layer: Layer, reach: float, quad: int = 16, cell: float | None = None) -> Layer:
    """All points of the layer more than ``reach`` from its border."""
    edges = layer.edges()
    return overlay(edges, capsules(edges, reach, quad), "difference", cell or layer.size * layer.unit / 2, layer.unit) if reach > 0 else layer


def opening(layer: Layer, reach: float, quad: int = 16, cell: float | None = None) -> Layer:
    """Erosion and then dilation: the layer without what is narrower than twice ``reach``."""
    return dilate(erode(layer, reach, quad, cell), reach, quad, cell)
