"""Well-known binary: a decoder of all straight kinds in both byte orders, and a writer of rings."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Codes of the format. A collection's members have headers of their own; curved kinds aren't read.
KINDS = {1: "Point", 2: "LineString", 3: "Polygon", 4: "MultiPoint", 5: "MultiLineString", 6: "MultiPolygon", 7: "GeometryCollection", 15: "PolyhedralSurface", 16: "TIN", 17: "Triangle"}
_MEMBERS = {4: {1}, 5: {2}, 6: {3}, 7: set(KINDS), 15: {3}, 16: {17}}
_Z, _M, _SRID = 0x80000000, 0x40000000, 0x20000000
#: How deep collections may hold collections.
DEPTH = 32

SHAPE = "struct<kind:string,srid:int,parts:array<struct<kind:string,rings:array<array<struct<x:double,y:double,z:double,m:double>>>>>>"


class Broken(ValueError):
    """Bytes that are no geometry of a known kind."""


class _Reader:
    """One value's bytes; points are kept as arrays over the buffer and put together for the whole batch."""

    def __init__(self, data: memoryview) -> None:
        self.data, self.at = data, 0
        self.parts: list[tuple[str, list[np.ndarray]]] = []
        self.srid: int | None = None

    def take(self, form: str) -> tuple:
        size = struct.calcsize(form)
        if self.at + size > len(self.data):
            raise Broken("ends early")
        values = struct.unpack_from(form, self.data, self.at)
        self.at += size
        return values

    def points(self, order: str, z: bool, m: bool, n: int | None = None) -> np.ndarray:
        """``n`` points (or as many as a count says) with four numbers each, not-a-number where they have none."""
        if n is None:
            (n,) = self.take(f"{order}I")
        width = 2 + z + m
        if n * width * 8 > len(self.data) - self.at:
            raise Broken("ends early")
        raw = np.frombuffer(self.data, f"{order}f8", n * width, self.at).reshape(n, width)
        self.at += n * width * 8
        out = np.full((n, 4), np.nan)
        out[:, [0, 1, *([2] if z else []), *([3] if m else [])]] = raw
        return out

    def geometry(self, allowed: set[int], depth: int = 0) -> str:
        (mark,) = self.take("B")
        if mark > 1 or depth > DEPTH:
            raise Broken("no byte order")
        order = "<" if mark else ">"
        (code,) = self.take(f"{order}I")
        z, m = bool(code & _Z), bool(code & _M)
        if code & _SRID:
            (srid,) = self.take(f"{order}i")
            self.srid = srid if depth == 0 else self.srid
        code &= 0x0FFFFFFF
        if code >= 1000:
            z, m, code = z or code // 1000 in (1, 3), m or code // 1000 in (2, 3), code % 1000 if code < 4000 else 0
        if code not in KINDS or code not in allowed:
            raise Broken(f"kind {code}")
        kind = KINDS[code]
        if code == 1:
            point = self.points(order, z, m, 1)
            self.parts.append((kind, [] if np.isnan(point[0, :2]).all() else [point]))
        elif code == 2:
            line = self.points(order, z, m)
            self.parts.append((kind, [line] if len(line) else []))
        elif code in (3, 17):
            (n,) = self.take(f"{order}I")
            if n * 4 > len(self.data) - self.at:
                raise Broken("ends early")
            self.parts.append((kind, [self.points(order, z, m) for _ in range(n)]))
        else:
            (n,) = self.take(f"{order}I")
            if n * 5 > len(self.data) - self.at:
                raise Broken("ends early")
            for _ in range(n):
                self.geometry(_MEMBERS[code], depth + 1)
        return kind


def _shapes(values: Iterator[memoryview | None]) -> pa.StructArray:
    kinds, srids, missing = [], [], []
    part_ends, part_kinds, ring_ends, point_ends, points = [0], [], [0], [0], []
    for value in values:
        reader = None
        if value is not None:
            try:
                reader = _Reader(value)
                kind = reader.geometry(set(KINDS))
                if reader.at != len(value):
                    raise Broken("goes on")
            except Broken:
                reader = None
        missing.append(reader is None)
        kinds.append(kind if reader else None)
        srids.append(reader.srid if reader else None)
        for part, rings in reader.parts if reader else []:
            part_kinds.append(part)
            for ring in rings:
                points.append(ring)
                point_ends.append(point_ends[-1] + len(ring))
            ring_ends.append(ring_ends[-1] + len(rings))
        part_ends.append(len(part_kinds))
    flat = np.concatenate(points) if points else np.zeros((0, 4))
    columns = [pa.array(flat[:, k], pa.float64(), from_pandas=k > 1) for k in range(4)]
    ring_list = pa.ListArray.from_arrays(pa.array(point_ends, pa.int32()), pa.StructArray.from_arrays(columns, ["x", "y", "z", "m"]))
    part = pa.StructArray.from_arrays([pa.array(part_kinds, pa.string()), pa.ListArray.from_arrays(pa.array(ring_ends, pa.int32()), ring_list)], ["kind", "rings"])
    parts = pa.ListArray.from_arrays(pa.array(part_ends, pa.int32()), part)
    return pa.StructArray.from_arrays([pa.array(kinds, pa.string()), pa.array(srids, pa.int32()), parts], ["kind", "srid", "parts"], mask=pa.array(missing))


def decode(wkb: Column) -> Column:
    """Geometries as ``(kind, srid, parts)``; a part is a point, line or polygon with its kind and rings.

    Both byte orders, Z and M in either way of writing them, reference numbers, multi kinds and
    collections in each other. Empty geometries have no parts or parts without rings. Null and
    broken values, trailing bytes and curved kinds give null. Missing Z and M are null.
    """

    def read(values: pa.Array) -> pa.Array:
        return _shapes(memoryview(v.as_buffer()) if v.is_valid else None for v in values)

    return F.arrow_udf(read, SHAPE)(wkb)


def ring_table(df: DataFrame, wkb: str, *keep: str) -> DataFrame:
    """One row for each ring of the polygons: ``keep``, part and ring numbers from 0, ``ring`` of struct(x, y), ``hole``."""
    shaped = df.select(*keep, decode(F.col(wkb)).alias("s")).select(*keep, F.posexplode("s.parts").alias("part", "p"))
    rings = shaped.where(F.col("p.kind").isin("Polygon", "Triangle")).select(*keep, "part", F.posexplode("p.rings").alias("n", "r"))
    return rings.select(*keep, "part", "n", F.transform("r", lambda q: F.struct(q["x"].alias("x"), q["y"].alias("y"))).alias("ring"), (F.col("n") > 0).alias("hole"))


def encode(polygons: Column) -> Column:
    """An array of rings of struct(x, y) as a little-endian polygon; null gives null."""

    def write(values: pa.Array) -> pa.Array:
        out = []
        for rings in values.to_pylist():
            body = [struct.pack("<BII", 1, 3, len(rings))] if rings is not None else None
            for ring in rings or []:
                body += [struct.pack("<I", len(ring)), np.array([(p["x"], p["y"]) for p in ring], "<f8").tobytes()]
            out.append(None if body is None else b"".join(body))
        return pa.array(out, pa.binary())

    return F.arrow_udf(write, "binary")(polygons)
