import struct
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.sources import shapefile as S
from tessera.sources import wkb as W


def box(x, y, half):
    return [{"x": float(x + a * half), "y": float(y + b * half)} for a, b in ((-1, -1), (1, -1), (1, 1), (-1, 1), (-1, -1))]


ROWS = [(i, i / 7, f"näme {i}" if i % 5 else None, i % 2 == 0, None if i % 11 == 0 else [box(10 * i, i, 4), *([box(10 * i, i, 1)] if i % 3 == 0 else [])]) for i in range(60)]
SCHEMA = "id bigint, v double, name string, even boolean, rings array<array<struct<x:double,y:double>>>"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    spark.dataSource.register(S.Shapefile)
    at = tmp_path_factory.mktemp("shapes")
    found = S.write(spark.createDataFrame(ROWS, SCHEMA).repartition(3), f"file:{at}").collect()
    assert sum(r["n"] for r in found) == 60 and len(list(at.glob("*.shp"))) == len(found) == 3 and not list(at.glob(".trial*"))
    return at


def load(spark, path, **options):
    return spark.read.format("shapefile").options(**options).load(str(path))


@pytest.mark.parametrize("records", [1, 7, 50_000])
def test_what_is_written_is_read(spark, folder, records):
    df = load(spark, folder, records=records)
    assert [f.simpleString() for f in df.schema] == ["id:bigint", "v:double", "name:string", "even:boolean", "wkb:binary"]
    got = sorted(tuple(r) for r in df.select("id", "v", "name", "even").collect())
    assert got == [r[:4] for r in ROWS]
    rings = W.ring_table(df, "wkb", "id").groupBy("id").agg(F.count("*").alias("n"), F.sum(F.col("hole").cast("int")).alias("holes")).collect()
    assert {(r["id"], r["n"], r["holes"]) for r in rings} == {(i, len(p), len(p) - 1) for i, *_, p in ROWS if p}
    assert df.rdd.getNumPartitions() >= (60 if records == 1 else 3)


def test_box_columns_and_zip(spark, folder, tmp_path):
    got = {r["id"] for r in load(spark, folder, box="95,0,205,100").select("id").collect()}
    assert got == {i for i, *_, p in ROWS if p and 10 * i + 4 >= 95 and 10 * i - 4 <= 205}
    slim = spark.read.format("shapefile").schema("name string").load(str(folder))
    assert slim.columns == ["name"] and slim.count() == 60
    one = sorted(folder.glob("*.shp"))[0]
    with zipfile.ZipFile(tmp_path / "z.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for end in (".shp", ".shx", ".dbf"):
            z.write(one.with_suffix(end), f"inner/{one.stem}{end}")
    assert sorted(map(str, load(spark, tmp_path / "z.zip").collect())) == sorted(map(str, load(spark, one).collect()))
    for bad in ({"box": "1,2"},):
        with pytest.raises(Exception, match="four numbers"):
            load(spark, folder, **bad).collect()


def test_a_partition_reads_only_its_records(folder, monkeypatch):
    one = str(sorted(folder.glob("*.shp"))[0])
    asked, read = [], S._read
    monkeypatch.setattr(S, "_read", lambda f, start, length: asked.append(length) or read(f, start, length))
    reader = S.Reader(S.Shapefile({"path": one}).schema(), {"path": one, "records": 4})
    asked.clear()
    batches = list(reader.read(reader.partitions()[1]))
    assert sum(b.num_rows for b in batches) == 4 and sum(asked) < 3000


def test_other_shapes_and_broken_files(tmp_path):
    pack = lambda kind, parts, points: struct.pack("<i4d", kind, 0, 0, 1, 1) + struct.pack("<ii", len(parts), len(points)) + np.array(parts, "<i4").tobytes() + np.array(points, "<f8").tobytes()
    read = lambda shape: W._shapes([memoryview(S.to_wkb(shape))])[0].as_py()
    assert S.to_wkb(struct.pack("<i", 0)) is None
    assert read(struct.pack("<i2d", 11, 3, 4) + bytes(16))["kind"] == "Point"
    assert read(struct.pack("<i4di", 8, 0, 0, 1, 1, 2) + np.arange(4.0).tobytes())["kind"] == "MultiPoint"
    assert read(pack(3, [0], [(0, 0), (1, 1)]))["kind"] == "LineString"
    assert read(pack(23, [0, 2], [(0, 0), (1, 1), (2, 2), (3, 3)]))["kind"] == "MultiLineString"
    ring = lambda x, half, outer: [(x - half, -half), (x - half, half), (x + half, half), (x + half, -half), (x - half, -half)][:: 1 if outer else -1]
    two = read(pack(15, [0, 5, 10], ring(0, 5, True) + ring(20, 5, True) + ring(20, 1, False)))
    assert two["kind"] == "MultiPolygon" and [len(p["rings"]) for p in two["parts"]] == [1, 2]
    assert read(pack(5, [0], ring(0, 5, False)))["kind"] == "Polygon"
    with pytest.raises(ValueError):
        S.to_wkb(struct.pack("<i", 9) + bytes(100))
    (tmp_path / "a.zip").write_bytes(b"")
    with pytest.raises((zipfile.BadZipFile, ValueError)):
        S._parts(str(tmp_path / "a.zip"))
    with pytest.raises(ValueError):
        S.Shapefile({"path": str(tmp_path / "none")}).schema() if (tmp_path / "none").mkdir() is None else None
