"""Writers with commit semantics, and caches that are keyed by their parameters."""

from __future__ import annotations

import json
import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target, jvm.org.apache.hadoop.fs.Path


def exists(spark: SparkSession, path: str) -> bool:
    fs, target, _ = _fs(spark, path)
    return fs.exists(target)


def write_atomic(df: DataFrame, path: str, compression: str = "zstd") -> None:
    """Write Parquet beside the target, then put it in the target's place by two renames.

    A reader finds the old files or all of the new ones, never a part; between the renames, for
    a moment, it finds none. If the second rename fails the old files are put back.
    """
    fs, target, make = _fs(df.sparkSession, path)
    part, old = make(f"{path}.partial"), make(f"{path}.old")
    fs.delete(part, True)
    df.write.option("compression", compression).parquet(f"{path}.partial")
    fs.delete(old, True)
    had = fs.exists(target)
    if had and not fs.rename(target, old):
        raise OSError(f"could not move {path} aside")
    if not fs.rename(part, target):
        if had:
            fs.rename(old, target)
        raise OSError(f"could not rename to {path}")
    fs.delete(old, True)


def _text(spark: SparkSession, path: str) -> str | None:
    return spark.read.text(path, wholetext=True).first()[0] if exists(spark, path) else None


def write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, target, _ = _fs(spark, path)
    out = fs.create(target, True)
    out.write(bytearray(text.encode()))
    out.close()


def same_parameters(a: dict | None, b: dict) -> bool:
    """Equal keys and values, numbers up to rounding."""
    if a is None or a.keys() != b.keys():
        return False
    close = lambda x, y: math.isclose(x, y, rel_tol=1e-12) if isinstance(x, float) or isinstance(y, float) else x == y
    return all(close(a[k], b[k]) for k in b)


def source_signature(spark: SparkSession, path: str) -> list:
    """Length and modification time of the files of a source."""
    fs, target, _ = _fs(spark, path)
    status = fs.globStatus(target)
    return [[s.getPath().getName(), s.getLen(), s.getModificationTime()] for s in status]


def cached(spark: SparkSession, path: str, parameters: dict, build: Callable[[], dict[str, DataFrame]], force: bool = False) -> dict[str, DataFrame]:
    """Named tables below ``path``, built anew unless the stored parameters are the asked ones."""
    stored = _text(spark, f"{path}/parameters.json")
    names = json.loads(stored)["tables"] if stored else []
    if force or not stored or not same_parameters(json.loads(stored)["parameters"], parameters):
        tables = build()
        for name, df in tables.items():
            write_atomic(df, f"{path}/{name}")
        names = list(tables)
        write_text(spark, f"{path}/parameters.json", json.dumps({"parameters": parameters, "tables": names}))
    return {name: spark.read.parquet(f"{path}/{name}") for name in names}
