"""Measures of single shapes: convex hulls of point groups, simplified rings, inner points, lengths."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.layers import let, ring_area

_RING = "array<struct<x:double,y:double>>"
#: Parts that the points of a key are dealt to before their hulls meet.
SALTS = 16


def hull(points: np.ndarray) -> np.ndarray:
    """Corners of the convex hull, counterclockwise from the lowest x; fewer than three for points on a line."""
    points = np.unique(points, axis=0)
    if len(points) < 3:
        return points

    def chain(ordered: np.ndarray) -> list[tuple[float, float]]:
        out: list[tuple[float, float]] = []
        for x, y in ordered.tolist():
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (y - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (x - out[-2][0]):
                out.pop()
            out.append((x, y))
        return out[:-1]

    return np.array(chain(points) + chain(points[::-1]))


def convex_hulls(points: DataFrame, key: str, x: str = "x", y: str = "y") -> DataFrame:
    """``(key, ring)``: the closed hull of each key's points, as partial hulls that are merged.

    Each task first reduces its points to hulls, so what is shuffled is corners. Points with null
    or not-a-number coordinates don't count; a key without any has no row, one whose points lie
    on a line has their ends. A null key is a key.
    """
    kind = points.schema[key].dataType.simpleString()
    real = points.select(F.col(key).alias("key"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), F.pmod(F.hash(F.monotonically_increasing_id()), F.lit(SALTS)).alias("salt"))
    real = real.where("x is not null and y is not null and not isnan(x) and not isnan(y)")

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch]).append_column("row", pa.array(np.arange(batch.num_rows)))
            places = np.stack([batch.column("x").to_numpy(zero_copy_only=False), batch.column("y").to_numpy(zero_copy_only=False)], axis=1)
            for rows in table.group_by("key").aggregate([("row", "list")])["row_list"].to_pylist():
                corners = hull(places[rows])
                one = pa.array([rows[0]] * len(corners), pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("key").take(one), pa.array(corners[:, 0]), pa.array(corners[:, 1]), batch.column("salt").take(one)], ["key", "x", "y", "salt"])

    def merged(rows: pa.Table) -> pa.Table:
        corners = hull(np.stack([rows["x"].to_numpy(), rows["y"].to_numpy()], axis=1))
        return pa.table({"key": rows["key"].take(pa.array([0] * len(corners), pa.int64())), "x": corners[:, 0], "y": corners[:, 1]})

    def closed(rows: pa.Table) -> pa.Table:
        corners = hull(np.stack([rows["x"].to_numpy(), rows["y"].to_numpy()], axis=1))
        ring = [{"x": float(a), "y": float(b)} for a, b in np.concatenate([corners, corners[:1]])]
        return pa.table({"key": rows["key"].take(pa.array([0], pa.int64())), "ring": pa.array([ring], pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))})

    corners = real.mapInArrow(partial, f"key {kind}, x double, y double, salt int")
    corners = corners.groupBy("key", "salt").applyInArrow(merged, f"key {kind}, x double, y double")
    return corners.groupBy("key").applyInArrow(closed, f"key {kind}, ring {_RING}").withColumnRenamed("key", key)


def _kept(points: np.ndarray, tolerance: float) -> np.ndarray:
    """Which points of a line stay: the farthest from each chord, as long as it is farther than the tolerance."""
    keep = np.zeros(len(points), bool)
    keep[[0, -1]] = True
    todo = [(0, len(points) - 1)]
    while todo:
        first, last = todo.pop()
        if last - first < 2:
            continue
        (ax, ay), (bx, by) = points[first], points[last]
        dx, dy = bx - ax, by - ay
        px, py = points[first + 1 : last, 0] - ax, points[first + 1 : last, 1] - ay
        square = dx * dx + dy * dy
        t = np.clip((px * dx + py * dy) / square, 0, 1) if square else 0.0
        far = np.hypot(px - t * dx, py - t * dy)
        k = int(np.argmax(far))
        if far[k] > tolerance:
            k += first + 1
            keep[k] = True
            todo += [(first, k), (k, last)]
    return keep


def _from_rings(rings: list[np.ndarray | None]) -> pa.Array:
    flat = np.concatenate([r for r in rings if r is not None] or [np.zeros((0, 2))])
    ends = pa.array(np.cumsum([0, *(0 if r is None else len(r) for r in rings)]), pa.int32())
    return pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], ["x", "y"]), mask=pa.array([r is None for r in rings]))


def _arrays(rings: pa.Array) -> Iterator[np.ndarray | None]:
    for ring in rings:
        yield None if not ring.is_valid else np.stack([ring.values.field(c).to_numpy(zero_copy_only=False) for c in "xy"], axis=1).reshape(-1, 2)


def simplify(ring: Column, tolerance: float) -> Column:
    """The ring or line without points nearer than ``tolerance`` to what is left (Douglas and Peucker).

    A closed ring keeps the point it starts at and the one farthest from it, and stays closed; it
    may lose its area. Null stays null.
    """

    def thin(rings: pa.Array) -> pa.Array:
        out: list[np.ndarray | None] = []
        for points in _arrays(rings):
            if points is not None and len(points) > 2:
                if (points[0] == points[-1]).all():
                    turn = int(np.argmax(np.hypot(*(points - points[0]).T)))
                    keep = np.concatenate([_kept(points[: turn + 1], tolerance), _kept(points[turn:], tolerance)[1:]]) if turn else np.r_[True, np.zeros(len(points) - 2, bool), True]
                else:
                    keep = _kept(points, tolerance)
                points = points[keep]
            out.append(points)
        return _from_rings(out)

    return F.arrow_udf(thin, _RING)(ring)


def inner_point(rings: Column) -> Column:
    """A point inside a polygon (closed rings, holes among them): the middle of its widest stretch at half its height.

    The height is moved to the middle between the corners around it, so that no corner lies on it.
    Null for polygons without area.
    """

    def find(polygons: pa.Array) -> pa.Array:
        out = []
        for polygon in polygons:
            point = None
            if polygon.is_valid:
                parts = [r for r in _arrays(polygon.values) if r is not None and len(r) > 3]
                edges = np.concatenate([np.concatenate([r[:-1], r[1:]], axis=1) for r in parts] or [np.zeros((0, 4))])
                levels = np.unique(edges[:, 1])
                if len(levels) > 1:
                    k = min(max(int(np.searchsorted(levels, (levels[0] + levels[-1]) / 2)), 1), len(levels) - 1)
                    y = (levels[k - 1] + levels[k]) / 2
                    up = edges[(edges[:, 1] <= y) != (edges[:, 3] <= y)]
                    xs = np.sort(up[:, 0] + (y - up[:, 1]) / (up[:, 3] - up[:, 1]) * (up[:, 2] - up[:, 0]))
                    if len(xs) > 1:
                        w = int(np.argmax(xs[1::2] - xs[: len(xs) // 2 * 2 : 2]))
                        point = {"x": float(xs[2 * w] + xs[2 * w + 1]) / 2, "y": float(y)}
            out.append(point)
        return pa.array(out, pa.struct([("x", pa.float64()), ("y", pa.float64())]))

    return F.arrow_udf(find, "struct<x:double,y:double>")(rings)


def length(ring: Column) -> Column:
    """Length of a line or closed ring; 0 with fewer than two points, null for null."""
    steps = lambda r: F.aggregate(F.sequence(F.lit(1), F.size(r) - 1), F.lit(0.0), lambda s, k: s + F.hypot(F.get(r, k)["x"] - F.get(r, k - 1)["x"], F.get(r, k)["y"] - F.get(r, k - 1)["y"]))
    return let(ring, lambda r: F.when(r.isNull(), None).when(F.size(r) < 2, 0.0).otherwise(steps(r)))


def centroid(ring: Column) -> Column:
    """Centre of mass of a closed ring, as struct(x, y); null without area."""

    def around(r: Column, o: Column, area: Column) -> Column:
        def add(s: Column, k: Column) -> Column:
            a, b = F.get(r, k - 1), F.get(r, k)
            ax, ay, bx, by = a["x"] - o["x"], a["y"] - o["y"], b["x"] - o["x"], b["y"] - o["y"]
            w = ax * by - bx * ay
            return F.struct((s["x"] + (ax + bx) * w).alias("x"), (s["y"] + (ay + by) * w).alias("y"))

        total = F.aggregate(F.sequence(F.lit(1), F.size(r) - 1), F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y")), add)
        return let(total, lambda t: F.struct((o["x"] + t["x"] / (6 * area)).alias("x"), (o["y"] + t["y"] / (6 * area)).alias("y")))

    return let(ring, lambda r: let(ring_area(r), lambda a: F.when(F.coalesce(a, F.lit(0.0)) != 0, let(F.get(r, F.lit(0)), lambda o: around(r, o, a)))))
