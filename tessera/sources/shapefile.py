"""Shapefiles as a Spark data source, and a writer of them.

A shapefile keeps an index of fixed-size entries, so a partition is a range of records: it reads
its part of the index, of the shapes and of the attributes, and no more. Of a folder all files
are read. A zipped one can't be entered in its middle and is a partition of its own.

    spark.dataSource.register(Shapefile)
    spark.read.format("shapefile").schema("name string, wkb binary").option("box", "0,0,9,9").load(path)

The schema given says which columns are read; without one all are, and ``wkb``. Records whose box
misses ``box`` are left out before their shape is decoded. Shapes are plane; Z and M are left out.
"""

from __future__ import annotations

import io
import struct
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import BinaryType, BooleanType, DoubleType, LongType, StringType, StructField, StructType

#: Records of a partition.
RECORDS = 50_000
_HEADER = 100
_POINT, _LINE, _POLYGON, _POINTS = 1, 3, 5, 8


def _place(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:") and not path.startswith("file://"):
        path = "file://" + path.removeprefix("file:")
    return pafs.FileSystem.from_uri(path)


def _files(path: str) -> list[str]:
    """The shapefiles of a path: itself, or those of a folder in order of their names."""
    fs, at = _place(path)
    if fs.get_file_info(at).type != pafs.FileType.Directory:
        return [path]
    found = fs.get_file_info(pafs.FileSelector(at, recursive=True))
    return sorted(path.rstrip("/") + f.path[len(at.rstrip("/")) :] for f in found if f.path.lower().endswith((".shp", ".zip")))


def _parts(path: str) -> dict[str, io.IOBase]:
    """The open files of shapes, index and attributes; seekable."""
    fs, at = _place(path)
    if at.lower().endswith(".zip"):
        with fs.open_input_file(at) as raw, zipfile.ZipFile(raw) as z:
            names = {n.lower()[-4:]: n for n in z.namelist() if n.lower().endswith((".shp", ".shx", ".dbf"))}
            if len(names) < 3:
                raise ValueError(f"{path} holds no whole shapefile")
            return {k: io.BytesIO(z.read(n)) for k, n in names.items()}
    return {k: fs.open_input_file(at[:-4] + k) for k in (".shp", ".shx", ".dbf")}


def _size(f) -> int:
    return f.seek(0, 2)


def _read(f, start: int, length: int) -> bytes:
    f.seek(start)
    data = f.read(length)
    if len(data) < length:
        raise ValueError("the file ends within a record")
    return data


@dataclass(frozen=True)
class Field:
    """An attribute: its place in a record, and how it is written."""

    name: str
    kind: str
    start: int
    length: int
    decimals: int

    def type(self):
        if self.kind == "L":
            return BooleanType()
        if self.kind in "NF":
            return DoubleType() if self.kind == "F" or self.decimals or self.length > 18 else LongType()
        return StringType()

    def value(self, record: bytes):
        text = record[self.start : self.start + self.length].decode("utf-8", "replace").strip(" \0")
        if self.kind == "L":
            return {"T": True, "Y": True, "F": False, "N": False}.get(text.upper())
        if self.kind in "NF":
            try:
                return int(text) if isinstance(self.type(), LongType) else float(text)
            except ValueError:
                return None
        return text or None


def _attributes(dbf) -> tuple[list[Field], int, int]:
    """Fields, length of the header and of a record."""
    header, record = struct.unpack("<HH", _read(dbf, 8, 4))
    raw, fields, at = _read(dbf, 32, header - 32), [], 1
    for i in range(0, len(raw) - 31, 32):
        if raw[i] == 0x0D:
            break
        name = raw[i : i + 11].split(b"\0")[0].decode("utf-8", "replace")
        fields.append(Field(name, chr(raw[i + 11]), at, raw[i + 16], raw[i + 17]))
        at += raw[i + 16]
    return fields, header, record


def _area(ring: np.ndarray) -> float:
    d = ring - ring[0]
    return float((d[:-1, 0] * d[1:, 1] - d[1:, 0] * d[:-1, 1]).sum() / 2)


def _inside(point: np.ndarray, ring: np.ndarray) -> bool:
    a, b = ring[:-1], ring[1:]
    spans = (a[:, 1] > point[1]) != (b[:, 1] > point[1])
    a, b = a[spans], b[spans]
    return bool((point[0] < a[:, 0] + (point[1] - a[:, 1]) / (b[:, 1] - a[:, 1]) * (b[:, 0] - a[:, 0])).sum() % 2)


def _wkb_rings(rings: list[np.ndarray]) -> bytes:
    return struct.pack("<BII", 1, 3, len(rings)) + b"".join(struct.pack("<I", len(r)) + r.astype("<f8").tobytes() for r in rings)


def to_wkb(shape: bytes) -> bytes | None:
    """A record's shape as well-known binary; outer rings run clockwise in a shapefile, and each hole joins the one around it."""
    (kind,) = struct.unpack_from("<i", shape)
    kind %= 10
    if kind == 0:
        return None
    if kind == _POINT:
        return struct.pack("<BI", 1, 1) + shape[4:20]
    if kind == _POINTS:
        (n,) = struct.unpack_from("<i", shape, 36)
        return struct.pack("<BII", 1, 4, n) + b"".join(struct.pack("<BI", 1, 1) + shape[40 + 16 * i : 56 + 16 * i] for i in range(n))
    if kind not in (_LINE, _POLYGON):
        raise ValueError(f"no such shape: {kind}")
    parts, n = struct.unpack_from("<ii", shape, 36)
    starts = [*struct.unpack_from(f"<{parts}i", shape, 44), n]
    points = np.frombuffer(shape, "<f8", 2 * n, 44 + 4 * parts).reshape(n, 2)
    pieces = [points[a:b] for a, b in zip(starts, starts[1:], strict=False) if b > a]
    if kind == _LINE:
        lines = [struct.pack("<BII", 1, 2, len(p)) + p.tobytes() for p in pieces]
        return lines[0] if len(lines) == 1 else struct.pack("<BII", 1, 5, len(lines)) + b"".join(lines)
    outer = [[r] for r in pieces if _area(r) <= 0] or [[r] for r in pieces]
    if len(outer) < len(pieces):
        for hole in (r for r in pieces if _area(r) > 0):
            next((o for o in outer if _inside(hole[0], o[0])), outer[-1]).append(hole)
    return _wkb_rings(outer[0]) if len(outer) == 1 else struct.pack("<BII", 1, 6, len(outer)) + b"".join(map(_wkb_rings, outer))


@dataclass
class Records(InputPartition):
    path: str
    first: int
    last: int


class Reader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict) -> None:
        self.schema, self.path, self.records = schema, options["path"], int(options.get("records", RECORDS))
        self.box = [float(v) for v in options["box"].split(",")] if options.get("box") else None
        if self.box is not None and len(self.box) != 4:
            raise ValueError("a box has four numbers: x0,y0,x1,y1")

    def partitions(self) -> list[Records]:
        out = []
        for path in _files(self.path):
            n = (_size(_parts(path)[".shx"]) - _HEADER) // 8
            step = max(1, n) if path.lower().endswith(".zip") else self.records
            out += [Records(path, i, min(n, i + step)) for i in range(0, n, step)]
        return out

    def read(self, partition: Records | None) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        files = _parts(partition.path)
        fields, header, length = _attributes(files[".dbf"])
        by_name = {f.name: f for f in fields}
        n = partition.last - partition.first
        index = np.frombuffer(_read(files[".shx"], _HEADER + 8 * partition.first, 8 * n), ">i4").reshape(n, 2).astype(np.int64) * 2
        named = [f for f in self.schema.names if f in by_name]
        wants_shape = "wkb" in self.schema.names or self.box is not None
        for first in range(0, n, 2048):
            part = index[first : first + 2048]
            attributes = _read(files[".dbf"], header + length * (partition.first + first), length * len(part))
            start, end = int(part[:, 0].min()), int((part[:, 0] + part[:, 1]).max()) + 8
            shapes = _read(files[".shp"], start, end - start) if wants_shape else b""
            rows: dict[str, list] = {c: [] for c in self.schema.names}
            for i, (at, size) in enumerate(part.tolist()):
                record = attributes[length * i : length * (i + 1)]
                if record[:1] == b"*":
                    continue
                shape = shapes[at - start + 8 : at - start + 8 + size]
                if self.box is not None and not self._meets(shape):
                    continue
                for c in named:
                    rows[c].append(by_name[c].value(record))
                if "wkb" in rows:
                    rows["wkb"].append(to_wkb(shape))
            count = max(map(len, rows.values()), default=0)
            yield pa.RecordBatch.from_arrays([pa.array(rows[f.name] or [None] * count, _ARROW[type(f.dataType)]) for f in self.schema], self.schema.names)

    def _meets(self, shape: bytes) -> bool:
        kind = struct.unpack_from("<i", shape)[0] % 10
        if kind == 0:
            return False
        x0, y0, x1, y1 = struct.unpack_from("<4d", shape, 4) if kind != _POINT else struct.unpack_from("<2d", shape, 4) * 2
        return x0 <= self.box[2] and x1 >= self.box[0] and y0 <= self.box[3] and y1 >= self.box[1]


_ARROW = {StringType: pa.string(), LongType: pa.int64(), DoubleType: pa.float64(), BooleanType: pa.bool_(), BinaryType: pa.binary()}


class Shapefile(DataSource):
    """``spark.read.format("shapefile")`` with the options ``path``, ``box`` and ``records`` (of a partition)."""

    @classmethod
    def name(cls) -> str:
        return "shapefile"

    def schema(self) -> StructType:
        found = _files(self.options["path"])
        if not found:
            raise ValueError(f"no shapefile in {self.options['path']}")
        fields = _attributes(_parts(found[0])[".dbf"])[0]
        return StructType([*(StructField(f.name, f.type()) for f in fields), StructField("wkb", BinaryType())])

    def reader(self, schema: StructType) -> Reader:
        odd = [f.name for f in schema if type(f.dataType) not in _ARROW]
        if odd:
            raise ValueError(f"no column of a shapefile has the type of {', '.join(odd)}")
        return Reader(schema, dict(self.options))


def write(df: DataFrame, folder: str, rings: str = "rings") -> DataFrame:
    """Polygons (arrays of closed rings of struct(x, y)) and their other columns, one shapefile a task; ``(path, n)``, written when run.

    Longs, doubles, strings and booleans are kept; strings up to 254 bytes. A file gets its name
    once it is whole, so a task that is tried again leaves no half of one.
    """
    names = [f.name for f in df.schema if f.name != rings]
    kinds = {"bigint": ("N", 18, 0), "int": ("N", 18, 0), "double": ("F", 24, 15), "string": ("C", 254, 0), "boolean": ("L", 1, 0)}
    layout = [(n, *kinds[df.schema[n].dataType.simpleString()]) for n in names]

    def text(value, kind: str, length: int) -> bytes:
        if value is None:
            return b" " * length if kind != "L" else b"?"
        if kind == "L":
            return b"T" if value else b"F"
        raw = str(value).encode() if kind == "C" else (str(value) if kind == "N" else repr(value)).encode()
        if len(raw) > length:
            raise ValueError(f"{value!r} takes more than {length} bytes")
        return raw.ljust(length) if kind == "C" else raw.rjust(length)

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        fs, at = _place(folder)
        fs.create_dir(at, recursive=True)
        stem, trial = f"{at}/part-{task.partitionId():05d}", f"{at}/.trial-{task.taskAttemptId()}"
        n, place, box = 0, _HEADER, np.array([np.inf, np.inf, -np.inf, -np.inf])
        bodies = {k: io.BytesIO() for k in (".shp", ".shx", ".dbf")}
        for batch in batches:
            for row in batch.to_pylist():
                polygon = [np.array([(p["x"], p["y"]) for p in r], "<f8") for r in row[rings] or []]
                polygon = [r[::-1] if (_area(r) > 0) == (k == 0) else r for k, r in enumerate(polygon)]
                if polygon:
                    points = np.concatenate(polygon)
                    own = np.r_[points.min(axis=0), points.max(axis=0)]
                    box = np.r_[np.minimum(box[:2], own[:2]), np.maximum(box[2:], own[2:])]
                    starts = np.cumsum([0, *map(len, polygon)])[:-1]
                    shape = struct.pack("<i", _POLYGON) + own.astype("<f8").tobytes() + struct.pack("<ii", len(polygon), len(points)) + starts.astype("<i4").tobytes() + points.tobytes()
                else:
                    shape = struct.pack("<i", 0)
                n += 1
                bodies[".shp"].write(struct.pack(">ii", n, len(shape) // 2) + shape)
                bodies[".shx"].write(struct.pack(">ii", place // 2, len(shape) // 2))
                bodies[".dbf"].write(b" " + b"".join(text(row[name], kind, length) for name, kind, length, _ in layout))
                place += 8 + len(shape)
        if not n:
            return
        bounds = (box if np.isfinite(box).all() else np.zeros(4)).astype("<f8").tobytes() + bytes(32)
        head = lambda size: struct.pack(">i20xi", 9994, size // 2) + struct.pack("<ii", 1000, _POLYGON) + bounds
        fields = b"".join(name.encode()[:10].ljust(11, b"\0") + kind.encode() + bytes(4) + bytes([length, decimals]) + bytes(14) for name, kind, length, decimals in layout)
        heads = {".shp": head(place), ".shx": head(_HEADER + 8 * n), ".dbf": struct.pack("<B3xIHH20x", 3, n, 33 + len(fields), 1 + sum(x[2] for x in layout)) + fields + b"\r"}
        for end in (".dbf", ".shx", ".shp"):  # a reader looks for the shapes, which come last
            with fs.open_output_stream(trial + end) as out:
                out.write(heads[end])
                out.write(bodies[end].getbuffer())
            fs.move(trial + end, stem + end)
        yield pa.RecordBatch.from_arrays([pa.array([stem + ".shp"]), pa.array([n], pa.int64())], ["path", "n"])

    return df.select(rings, *names).mapInArrow(save, "path string, n long")
