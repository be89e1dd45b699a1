"""Readers with stated columns, and descriptions of files."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.joins import require_columns


def parquet(spark: SparkSession, *paths: str, columns: list[str] | None = None, merge: bool = False) -> DataFrame:
    """One or several Parquet paths or globs; ``merge`` unites files whose columns differ."""
    df = spark.read.option("mergeSchema", str(merge).lower()).parquet(*paths)
    return require_columns(df, columns, ", ".join(paths)).select(*columns) if columns else df


def in_box(x: str, y: str, x0: float, y0: float, x1: float, y1: float) -> Column:
    """A closed box on stored columns, which reaches the scan as range filters."""
    return F.col(x).between(x0, x1) & F.col(y).between(y0, y1)


def tiles_for(x0: float, y0: float, x1: float, y1: float, size: float) -> list[tuple[int, int]]:
    """Grid tiles that a box meets, for reading only their files."""
    span = lambda a, b: range(int(a // size), int(b // size) + 1)
    return [(i, j) for i in span(x0, x1) for j in span(y0, y1)]


def csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """A JSON manifest as one row; nested settings stay nested."""
    return spark.read.option("multiLine", True).json(path)


def point_from_wkb(wkb: str) -> tuple[Column, Column]:
    """Coordinates of a column of little-endian WKB points, in column functions."""

    def double(at: int) -> Column:
        # Big-endian bits of the number: its sign, exponent and fraction, put together again.
        backwards = ", ".join(f"substring({wkb}, {at + k}, 1)" for k in range(7, -1, -1))
        bits = F.expr(f"conv(hex(concat({backwards})), 16, -10)").cast("long")
        power, fraction = F.shiftrightunsigned(bits, 52).bitwiseAND(2047), bits.bitwiseAND((1 << 52) - 1)
        size = F.when(power == 0, fraction * 2.0**-1074).otherwise((1 + fraction * 2.0**-52) * F.pow(F.lit(2.0), power - 1023))
        return F.when(bits < 0, -size).otherwise(size)

    return double(6), double(14)


def geo_metadata(path: str) -> dict:
    """Primary geometry column and reference system from a Parquet footer, read on the driver."""
    import pyarrow.parquet as pq

    raw = (pq.read_schema(path).metadata or {}).get(b"geo")
    if raw is None:
        raise ValueError(f"{path} has no geo metadata")
    meta = json.loads(raw)
    own = meta["columns"][meta["primary_column"]]
    return {"primary_column": meta["primary_column"], "crs": own.get("crs"), "encoding": own.get("encoding")}


def lookup(df: DataFrame, value, *keys: str):
    """First row whose first key, else the next key and so on, has the value; None without one."""
    for key in keys:
        if row := df.where(F.col(key) == F.lit(value)).limit(1).take(1):
            return row[0]
    return None


def inventory(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """``(path, bytes, sha256)`` of all files with content below a folder, hashed on the executors."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    return found.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def check_inventory(found: DataFrame, expected: DataFrame) -> DataFrame:
    """Problems by path: missing, unexpected, of another size or another checksum."""
    a, b = expected.alias("a"), found.alias("b")
    met = a.join(b, "path", "full")
    problem = (
        F.when(F.col("b.sha256").isNull(), "missing").when(F.col("a.sha256").isNull(), "unexpected").when(F.col("a.bytes") != F.col("b.bytes"), "size").when(F.col("a.sha256") != F.col("b.sha256"), "checksum")
    )
    return met.select("path", problem.alias("problem")).where("problem is not null")


def check_columns(spark: SparkSession, required: dict[str, list[str]]) -> list[str]:
    """Messages for the paths that can't be read or that lack a column; only footers are read."""
    out = []
    for path, columns in required.items():
        try:
            require_columns(spark.read.parquet(path), columns, path)
        except Exception as error:  # noqa: BLE001
            out.append(str(error).splitlines()[0])
    return out


def import_closure(root: Path, package: str, start: str) -> set[str]:
    """Modules of a package that a module imports, directly or not, from the source text."""
    import ast

    todo, seen = [start], set()
    while todo:
        name = todo.pop()
        base = root / name.replace(".", "/")
        path = base.with_suffix(".py") if base.with_suffix(".py").exists() else base / "__init__.py"
        if name in seen or not path.exists():
            continue
        seen.add(name)
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module, *[f"{node.module}.{a.name}" for a in node.names]] if isinstance(node, ast.ImportFrom) and node.module else []
            todo += [n for n in names if n.split(".")[0] == package]
    return seen
