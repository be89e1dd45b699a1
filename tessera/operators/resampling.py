"""Fits and block bootstraps from tables of bins, so that no sample meets in one task.

A response curve's least squares see a row only through its exposure and outcome. Rows whose
exposure falls into the same narrow bin of its logarithm are summed: how many, how many hits and
their mean exposure. A fit over bins minimises the same sum up to terms of the second order in
the bins' width. A bootstrap draws whole blocks, so a draw is a count for each block, and its
bins are the blocks' bins times these counts, added up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.curves import Curve, fit_curve

#: Bins of a fit, and of each draw of a bootstrap.
BINS, DRAW_BINS = 16_384, 512


def exposure_bins(rows: DataFrame, keys: list[str], x: str, sums: dict[str, Column], bins: int = BINS) -> DataFrame:
    """``(keys, bin, n, lx)`` and ``sums`` for each occupied bin of the logarithm of ``x``; only positive ``x`` count.

    Bins are of equal width between the least and the greatest value of all rows, so rows of
    different keys share them; ``lx`` is the sum of logarithms.
    """
    real = rows.where((F.col(x) > 0) & (F.col(x) < float("inf"))).withColumn("lx", F.log(x))
    ends = real.agg(F.min("lx").alias("low"), F.max("lx").alias("high")).first()
    low, width = ends["low"] or 0.0, ((ends["high"] or 0.0) - (ends["low"] or 0.0)) / bins or 1.0
    at = F.least(F.floor((F.col("lx") - low) / width), F.lit(bins - 1)).cast("int")
    return real.groupBy(*keys, at.alias("bin")).agg(F.count("*").alias("n"), F.sum("lx").alias("lx"), *[F.sum(c).alias(k) for k, c in sums.items()])


def fit_bins(part: pd.DataFrame, hits: str = "hits") -> Curve:
    """The curve through bins, each weighing what its rows weigh."""
    part = part.sort_values("bin")
    n = part["n"].to_numpy(float)
    return fit_curve(np.exp(part["lx"].to_numpy(float) / n), part[hits].to_numpy(float) / n, n)


def bin_scores(curve: Curve, part: pd.DataFrame, hits: str = "hits") -> tuple[float, float]:
    """Brier score and mean log loss over the rows of the bins."""
    n, k = part["n"].to_numpy(float), part[hits].to_numpy(float)
    p = np.clip(curve.at(np.exp(part["lx"].to_numpy(float) / n)), 1e-12, 1 - 1e-12)
    return float((n * p * p - 2 * p * k + k).sum() / n.sum()), float(-(k * np.log(p) + (n - k) * np.log(1 - p)).sum() / n.sum())


def block_counts(blocks: DataFrame, draws: int, seed: int = 0) -> DataFrame:
    """``(draw, grp, block, times)``: how often each draw takes each block of a group, never 0.

    ``blocks`` has ``(grp, block)``, each once. A draw takes as many blocks of a group as the
    group has, with replacement; it hangs on the seed, the draw and the order of the blocks.
    """
    sizes = {r["grp"]: r["n"] for r in blocks.groupBy("grp").agg(F.count("*").alias("n")).collect()}  # one for each group
    order = sorted(sizes, key=str)
    numbered = blocks.select("grp", "block", (F.row_number().over(Window.partitionBy("grp").orderBy("block")) - 1).alias("at"))

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column("id").to_pylist():
                rng = np.random.default_rng([seed, k])
                for g in order:
                    times = np.bincount(rng.integers(0, sizes[g], sizes[g]), minlength=sizes[g])
                    at = np.flatnonzero(times)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k), pa.int32()), pa.array([g] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(times[at], pa.int64())], ["draw", "grp", "at", "times"])

    spark = blocks.sparkSession
    taken = spark.range(0, draws, 1, min(draws, 64)).mapInArrow(take, "draw int, grp string, at int, times long")
    return taken.join(numbered, ["grp", "at"]).select("draw", "grp", "block", "times")


def drawn(table: DataFrame, counts: DataFrame, keys: list[str], sums: list[str]) -> DataFrame:
    """Sums of a table by block ``(grp, block, keys, sums)`` for each draw: ``(draw, grp, keys, sums)``."""
    met = table.join(counts, ["grp", "block"])
    return met.groupBy("draw", "grp", *keys).agg(*[F.sum(F.col(s) * F.col("times")).alias(s) for s in sums])
