import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.sources import wkb as W

CODES = {k: c for c, k in W.KINDS.items()}


def write(shape, order="<", z=False, m=False, iso=True, srid=None):
    """A plain encoder: (kind, body), the body points, a list of rings or of shapes."""
    kind, body = shape
    code = CODES[kind]
    code += (1000 * z + 2000 * m) if iso else 0
    code |= 0 if iso else z * 0x80000000 | m * 0x40000000
    code |= 0x20000000 if srid is not None else 0
    out = struct.pack(f"{order}BI", order == "<", code) + (struct.pack(f"{order}i", srid) if srid is not None else b"")
    width = 2 + z + m
    point = lambda p: struct.pack(f"{order}{width}d", *p[:width])
    count = lambda n: struct.pack(f"{order}I", n)
    if kind == "Point":
        return out + point(body or [float("nan")] * 4)
    if kind == "LineString":
        return out + count(len(body)) + b"".join(map(point, body))
    if kind in ("Polygon", "Triangle"):
        return out + count(len(body)) + b"".join(count(len(r)) + b"".join(map(point, r)) for r in body)
    return out + count(len(body)) + b"".join(write(s, ">" if order == "<" else "<", z, m, iso) for s in body)


def parts(shape):
    kind, body = shape
    if kind == "Point":
        return [(kind, [[body]] if body else [])]
    if kind == "LineString":
        return [(kind, [body] if body else [])]
    return [(kind, body)] if kind in ("Polygon", "Triangle") else [p for s in body for p in parts(s)]


SQUARE = [(0.0, 0.0, 1.0, 5.0), (4.0, 0.0, 2.0, 6.0), (4.0, 4.0, 3.0, 7.0), (0.0, 0.0, 1.0, 5.0)]
INNER = [(1.0, 1.0, 0.0, 0.0), (2.0, 1.0, 0.0, 0.0), (2.0, 2.0, 0.0, 0.0), (1.0, 1.0, 0.0, 0.0)]
POINT, LINE, POLYGON = ("Point", (1.5, -2.5, 3.5, 4.5)), ("LineString", SQUARE[:3]), ("Polygon", [SQUARE, INNER])
SHAPES = [
    POINT, LINE, POLYGON, ("MultiPoint", [POINT, POINT]), ("MultiLineString", [LINE, LINE]), ("MultiPolygon", [POLYGON, ("Polygon", [INNER])]), ("GeometryCollection", [POINT, ("GeometryCollection", [LINE, ("MultiPolygon", [POLYGON])])]),
    ("PolyhedralSurface", [POLYGON]), ("TIN", [("Triangle", [INNER])]), ("Triangle", [INNER]), ("Point", None), ("LineString", []), ("Polygon", []), ("MultiPolygon", []), ("GeometryCollection", []),
]


def read(spark, values):
    df = spark.createDataFrame([(i, None if v is None else bytearray(v)) for i, v in enumerate(values)], "i int, w binary")
    return [r["s"] for r in df.select("i", W.decode(F.col("w")).alias("s")).orderBy("i").collect()]


def test_every_kind_order_and_dimension(spark):
    forms = [(o, z, m, iso, srid) for o in "<>" for z in (False, True) for m in (False, True) for iso in (False, True) for srid in (None, 26911)]
    asked = [(shape, form) for shape in SHAPES for form in forms]
    for (shape, (_, z, m, _, srid)), got in zip(asked, read(spark, [write(s, *f) for s, f in asked]), strict=True):
        assert (got["kind"], got["srid"]) == (shape[0], srid)
        cut = lambda p: (p[0], p[1], p[2] if z else None, p[2 + z] if m else None)  # noqa: E731, B023
        assert [(p["kind"], [[tuple(q) for q in r] for r in p["rings"]]) for p in got["parts"]] == [(k, [[cut(q) for q in r] for r in rings]) for k, rings in parts(shape)]


def test_broken_bytes_give_null(spark):
    whole = write(POLYGON)
    curved = struct.pack("<BII", 1, 8, 0)
    huge = struct.pack("<BII", 1, 2, 0xFFFFFFFF)
    deep = b"".join(struct.pack("<BII", 1, 7, 1) for _ in range(100)) + write(POINT)
    wrong_member = struct.pack("<BII", 1, 4, 1) + write(LINE)
    values = [None, b"", b"\x01", whole[:-1], whole + b"x", b"\x02" + whole[1:], curved, huge, deep, wrong_member, struct.pack("<BII", 1, 5001, 0), whole]
    assert [g is None for g in read(spark, values)] == [True] * 11 + [False]


@settings(max_examples=300, deadline=None)
@given(st.sampled_from(SHAPES), st.binary(max_size=3), st.integers(0, 200), st.integers(0, 255))
def test_damaged_bytes_never_crash(shape, tail, at, value):
    data = bytearray(write(shape) + tail)
    data[at % len(data)] = value
    found = W._shapes([memoryview(bytes(data))])
    assert len(found) == 1


def test_ring_table_and_round_trip(spark):
    df = spark.createDataFrame([(7, bytearray(write(SHAPES[6]))), (8, None), (9, bytearray(write(POINT)))], "id int, w binary")
    rows = W.ring_table(df, "w", "id").collect()
    assert [(r["id"], r["part"], r["n"], r["hole"], len(r["ring"])) for r in rows] == [(7, 2, 0, False, 4), (7, 2, 1, True, 4)]
    again = W.ring_table(df, "w", "id").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("n", "ring"))).alias("x")).select("id", W.encode(F.col("x.ring")).alias("w"))
    assert [tuple(r)[:2] for r in W.ring_table(again, "w", "id").select("ring", "hole").orderBy("hole").collect()] == [(r["ring"], r["hole"]) for r in rows]
    with pytest.raises(W.Broken):
        W._Reader(memoryview(b"")).geometry({1})
