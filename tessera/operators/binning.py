"""Bins and size classes: exact quantile edges, fixed cuts, doubling bins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def quantile_edges(df: DataFrame, column: str, probabilities: list[float], by: list[str] | None = None) -> DataFrame:
    """Exact interpolated quantiles as a sorted array of distinct values: one row, or one per group."""
    edges = F.array_sort(F.array_distinct(F.percentile(column, probabilities))).alias("edges")
    return df.groupBy(*(by or [])).agg(edges) if by else df.agg(edges)


def below(edges: Column, x: Column) -> Column:
    """How many edges are smaller than x (a left search)."""
    return F.size(F.filter(edges, lambda e: e < x))


def upto(edges: Column, x: Column) -> Column:
    """How many edges are at most x (a right search)."""
    return F.size(F.filter(edges, lambda e: e <= x))


def quantile_bins(df: DataFrame, column: str, n: int, right: bool = True, name: str = "bin") -> DataFrame:
    """Bin number from 0 by quantile edges; repeated edges are merged.

    Bins are closed on the right with the least value in the first, or closed on the left with
    the largest in the last. Null values have a null bin.
    """
    edges = quantile_edges(df, column, [i / n for i in range(n + 1)])
    met = df.join(F.broadcast(edges))
    x, last = F.col(column), F.size("edges") - 2
    at = F.greatest(below(F.col("edges"), x) - 1, F.lit(0)) if right else F.least(F.greatest(upto(F.col("edges"), x) - 1, F.lit(0)), last)
    return met.withColumn(name, F.when(x.isNotNull(), at)).drop("edges")


def cut(x: Column, bounds: list[float], labels: list[str], right: bool = False) -> Column:
    """Label of a fixed bin; ``bounds`` are the inner bounds, the outer ones are open."""
    out = F.lit(labels[-1])
    for bound, label in reversed(list(zip(bounds, labels, strict=False))):
        out = F.when((x <= bound) if right else (x < bound), F.lit(label)).otherwise(out)
    return F.when(x.isNotNull(), out)


def doubling_bin(size: Column) -> Column:
    """0 for 1, 1 for 2, 2 for 3-4, 3 for 5-8 ...: exact for all sizes, without a logarithm."""
    return F.when(size > 1, F.length(F.bin(size.cast("long") - 1))).otherwise(F.lit(0)).cast("int")


def size_classes(members: DataFrame, n: int = 6, by: str = "grp") -> DataFrame:
    """Member-weighted size classes within each group: 0 for singletons, else 1 to ``n``.

    ``members`` has ``component_size`` and ``assessed``. The upper bounds are the rounded-up
    quantiles over assessed members of larger components; if two coincide in a group this raises.
    """
    probabilities = [i / n for i in range(1, n + 1)]
    linked = members.where("assessed and component_size > 1")
    bounds = linked.groupBy(by).agg(F.array_sort(F.array_distinct(F.transform(F.percentile("component_size", probabilities), lambda v: F.ceil(v)))).alias("upper"))
    short = bounds.where(F.size("upper") != n).select(by, F.size("upper").alias("n")).take(1)
    if short:
        raise ValueError(f"{short[0][by]}: size quantiles collapsed to {short[0]['n']} classes")
    met = members.join(F.broadcast(bounds), by)
    return met.withColumn("size_class", F.when(F.col("component_size") == 1, 0).otherwise(1 + below(F.col("upper"), F.col("component_size")))).drop("upper")


def quartile_classes(members: DataFrame) -> DataFrame:
    """Member-weighted quartiles of component size as half-open classes 1 to 4; an empty class raises."""
    edges = quantile_edges(members, "component_size", [0.25, 0.5, 0.75])
    met = members.join(F.broadcast(edges)).withColumn("quartile", 1 + upto(F.col("edges"), F.col("component_size"))).drop("edges")
    found = {r["quartile"] for r in met.select("quartile").distinct().collect()}
    if found != {1, 2, 3, 4}:
        raise ValueError(f"empty size classes: {sorted({1, 2, 3, 4} - found)}")
    return met
