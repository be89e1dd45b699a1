"""Visibility between points in space: which segments meet none of a set of triangles, or of upright boxes.

Triangles are dealt to the cells of a grid that their boxes meet, segments to the cells that they
run through, one after the other; only what shares a cell is tested, exactly, in column functions.
Boxes are tested whole, in cells of the plane, and first in the cells of a segment's two ends.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.session import durable

_AXES = "xyz"
#: Cells of a walk after which segments that are blocked by then go no further.
STOPS = (2, 16)


def point(x, y, z) -> Column:
    return F.struct(*[(v if isinstance(v, Column) else F.lit(float(v))).cast("double").alias(a) for v, a in zip((x, y, z), _AXES, strict=True)])


def _minus(a: Column, b: Column) -> dict[str, Column]:
    return {k: a[k] - b[k] for k in _AXES}


def _cross(a: dict[str, Column], b: dict[str, Column]) -> dict[str, Column]:
    return {"x": a["y"] * b["z"] - a["z"] * b["y"], "y": a["z"] * b["x"] - a["x"] * b["z"], "z": a["x"] * b["y"] - a["y"] * b["x"]}


def _dot(a: dict[str, Column], b: dict[str, Column]) -> Column:
    return a["x"] * b["x"] + a["y"] * b["y"] + a["z"] * b["z"]


def meets(start: Column, end: Column, a: Column, b: Column, c: Column) -> Column:
    """Whether a segment, without its ends, meets a triangle, with its border; one in the triangle's plane does not."""
    d, e1, e2, o = _minus(end, start), _minus(b, a), _minus(c, a), _minus(start, a)
    p, q = _cross(d, e2), _cross(o, e1)
    det = _dot(e1, p)
    # All is multiplied by the determinant's sign instead of being divided by it.
    sign = F.signum(det)
    u, v, t, size = sign * _dot(o, p), sign * _dot(d, q), sign * _dot(e2, q), F.abs(det)
    return (size > 0) & (u >= 0) & (v >= 0) & (u + v <= size) & (t > 0) & (t < size)


def _walk(segments: DataFrame, cell: float, first: int = 0, last: int | None = None, axes: str = _AXES) -> DataFrame:
    """``segments`` with a row for each cell that they run through, from the ``first`` of the walk up to the ``last``."""
    start, end = F.col("start"), F.col("end")

    def planes(k: str) -> Column:
        low, high = F.floor(F.least(start[k], end[k]) / cell), F.floor(F.greatest(start[k], end[k]) / cell)
        crossed = F.transform(F.sequence(low + 1, high), lambda i: (i * F.lit(cell) - start[k]) / (end[k] - start[k]))
        return F.when(high > low, crossed).otherwise(F.array().cast("array<double>"))

    turns = F.array_sort(F.concat(F.array(F.lit(0.0), F.lit(1.0)), *[planes(k) for k in axes]))
    stretches = segments.select("id", "start", "end", turns.alias("turns"))
    middle = F.transform(F.zip_with(F.slice("turns", F.lit(1), F.size("turns") - 1), F.slice("turns", F.lit(2), F.size("turns") - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda s: (s["a"] + s["b"]) / 2)
    middles = stretches.select("id", "start", "end", F.explode(F.slice(middle, first + 1, 1 << 30 if last is None else last - first)).alias("m"))
    return middles.select("id", "start", "end", *[F.floor((start[k] + (end[k] - start[k]) * F.col("m")) / cell).alias(f"c{k}") for k in axes]).distinct()


def _known(df: DataFrame, *points: str) -> DataFrame:
    """Rows whose points have no null or not-a-number coordinate."""
    real = lambda p: F.coalesce(F.col(p)["x"] + F.col(p)["y"] + F.col(p)["z"], F.lit(float("nan")))
    return df.where(~F.isnan(sum((real(p) for p in points), F.lit(0.0))))


def _clear(segments: DataFrame, triangles: DataFrame, cell: float) -> DataFrame:
    """The segments with known ends that meet no triangle.

    They walk a part of their cells at a time, and those that are blocked there end; where
    triangles are dense, few get beyond the first part.
    """
    margin = cell * 1e-9  # what lies on a border between cells belongs to both
    span = lambda k: F.explode(F.sequence(F.floor((F.least(*[F.col(p)[k] for p in "abc"]) - margin) / cell), F.floor((F.greatest(*[F.col(p)[k] for p in "abc"]) + margin) / cell))).alias(f"c{k}")
    dealt = _known(triangles, *"abc").select("a", "b", "c", span("x"))
    dealt = dealt.select("*", span("y")).select("*", span("z"))
    left = durable(_known(segments, "start", "end"))
    for first, last in zip((0, *STOPS), (*STOPS, None), strict=True):
        met = _walk(left, cell, first, last).hint("merge").join(dealt, [f"c{k}" for k in _AXES])
        hit = met.where(meets(*[F.col(p) for p in ("start", "end", "a", "b", "c")])).select("id").distinct()
        left = durable(left.hint("merge").join(hit, "id", "left_anti"))
    return left


def blocked(segments: DataFrame, triangles: DataFrame, cell: float) -> DataFrame:
    """``(id)`` of the segments ``(id, start, end)`` that meet a triangle ``(a, b, c)``; points are structs of x, y, z.

    ``cell`` is the side of a grid cell: of the order of the triangles' size, and small enough for
    the densest place. Segments and triangles with null or not-a-number coordinates meet nothing.
    """
    ends = sum((F.col(p)[k] for p in ("start", "end") for k in _AXES), F.lit(0.0))
    known = segments.where(ends.isNotNull() & ~F.isnan(ends))
    return known.select("id").distinct().hint("merge").join(_clear(segments, triangles, cell), "id", "left_anti")


def visible(segments: DataFrame, triangles: DataFrame, cell: float) -> DataFrame:
    """The segments that meet no triangle; those with unknown ends are not visible."""
    return _clear(segments, triangles, cell)


def enters(start: Column, end: Column) -> Column:
    """Whether a segment runs through the inside of the box with the columns x0, x1, y0, y1, z0, z1."""
    first, last = [F.lit(0.0)], [F.lit(1.0)]
    for k in _AXES:
        low, high, at, step = F.col(f"{k}0"), F.col(f"{k}1"), start[k], end[k] - start[k]
        # Spark may compute the quotient before it knows that the step is not 0, so it must not fail.
        a, b = F.try_divide(low - at, step), F.try_divide(high - at, step)
        first.append(F.when(step != 0, F.least(a, b)).when((low < at) & (at < high), 0.0).otherwise(2.0))
        last.append(F.when(step != 0, F.greatest(a, b)).otherwise(1.0))
    return F.greatest(*first) < F.least(*last)


def past_boxes(segments: DataFrame, boxes: DataFrame, cell: float) -> DataFrame:
    """The segments ``(id, start, end)`` with known ends that run through the inside of no box ``(x0, x1, y0, y1, z0, z1)``.

    Segments are first tested in the cells of their ends and, if they get past, along their walk:
    where boxes are dense, few have to. ``cell`` is the side of a cell of the plane, of the order
    of the boxes' width. A segment wholly inside a box does not get past it.
    """
    margin = cell * 1e-9  # what lies on a border between cells belongs to both
    span = lambda k: F.explode(F.sequence(F.floor((F.col(f"{k}0") - margin) / cell), F.floor((F.col(f"{k}1") + margin) / cell))).alias(f"c{k}")
    sides = [f"{k}{e}" for k in _AXES for e in (0, 1)]
    real = sum((F.col(c) for c in sides), F.lit(0.0))
    dealt = boxes.where(real.isNotNull() & ~F.isnan(real)).select(*sides, span("x")).select("*", span("y"))
    left = durable(_known(segments, "start", "end"))
    cell_of = lambda p: lambda df: df.select("*", *[F.floor(F.col(p)[k] / cell).alias(f"c{k}") for k in "xy"])
    walk = lambda first, last: lambda df: _walk(df, cell, first, last, "xy")
    for part in (cell_of("start"), cell_of("end"), walk(0, STOPS[-1]), walk(STOPS[-1], None)):
        met = part(left).hint("merge").join(dealt, ["cx", "cy"])
        hit = met.where(enters(F.col("start"), F.col("end"))).select("id").distinct()
        left = durable(left.hint("merge").join(hit, "id", "left_anti"))
    return left


def box_triangles(x0: Column, y0: Column, z0: Column, x1: Column, y1: Column, z1: Column) -> Column:
    """The twelve triangles of an upright box's faces, as an array of ``(a, b, c)``."""
    corner = lambda i: point(x1 if i & 1 else x0, y1 if i & 2 else y0, z1 if i & 4 else z0)
    faces = [(0, 1, 3, 2), (4, 5, 7, 6), (0, 1, 5, 4), (2, 3, 7, 6), (0, 2, 6, 4), (1, 3, 7, 5)]
    return F.array(*[F.struct(corner(p).alias("a"), corner(q).alias("b"), corner(r).alias("c")) for f in faces for p, q, r in ((f[0], f[1], f[2]), (f[0], f[2], f[3]))])
