"""Shares, intervals and roll-ups of nodes and components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.session import durable

Z95 = 1.959963984540054


def wilson(k: Column, n: Column, clamp: bool = True) -> tuple[Column, Column]:
    """Wilson 95 % interval of k in n, clamped to contain the share."""
    z2, p = Z95 * Z95, k / n
    centre, half = (p + z2 / (2 * n)) / (1 + z2 / n), Z95 * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n)) / (1 + z2 / n)
    return (F.least(centre - half, p), F.greatest(centre + half, p)) if clamp else (centre - half, centre + half)


def with_pooled(df: DataFrame, by: str, keys: list[str], aggregates: list[Column], pooled: str = "POOLED") -> DataFrame:
    """Aggregates for each group and for all groups together, in one pass."""
    out = df.groupingSets([[*keys, by], list(keys)], *keys, by).agg(F.grouping(by).alias("__all"), *aggregates)
    return out.withColumn(by, F.when(F.col("__all") == 1, F.lit(pooled)).otherwise(F.col(by))).drop("__all")


def entropy(p: Column) -> Column:
    """Binary Shannon entropy, 0 at the ends."""
    inner = (p > 0) & (p < 1)
    q = F.when(inner, p)
    return F.when(inner, -(q * F.log2(q) + (1 - q) * F.log2(1 - q))).when(p.isNotNull(), 0.0)


def mean_entropy(members: DataFrame, label: str = "component_id", outcome: str = "is_destroyed") -> DataFrame:
    """Entropy of the outcome within components of two or more, weighted by their size."""
    parts = members.groupBy(label).agg(F.count("*").alias("n"), F.avg(outcome).alias("p")).where("n >= 2")
    return parts.agg(F.sum("n").alias("members"), F.try_divide(F.sum(F.col("n") * entropy(F.col("p"))), F.sum("n")).alias("entropy"))


def clustered_se(df: DataFrame, value: str, cluster: str) -> DataFrame:
    """Mean and cluster-robust standard error of a mean."""
    mean = df.agg(F.avg(value).alias("m"), F.count(value).alias("n"))
    scores = df.join(F.broadcast(mean)).groupBy(cluster).agg(F.sum(F.col(value) - F.col("m")).alias("u"), F.first("m").alias("m"), F.first("n").alias("n"))
    g = F.count("*")
    return scores.agg(F.first("m").alias("mean"), g.alias("clusters"), F.sqrt(g / (g - 1) * F.sum(F.col("u") * F.col("u")) / F.pow(F.first("n"), F.lit(2))).alias("se"))


def unpivot(df: DataFrame, ids: list[str], columns: list[str]) -> DataFrame:
    return df.unpivot(ids, columns, "variable", "value")


def smd(df: DataFrame, columns: list[str], arm: str) -> DataFrame:
    """Standardised mean difference of each column between the arms 1 and 0."""
    long = unpivot(df.select(F.col(arm).alias("arm"), *[F.col(c).cast("double").alias(c) for c in columns]), ["arm"], columns)
    one, none = (lambda f: f(F.when(F.col("arm") == 1, F.col("value")))), (lambda f: f(F.when(F.col("arm") == 0, F.col("value"))))
    return long.groupBy("variable").agg(((one(F.avg) - none(F.avg)) / F.sqrt((one(F.var_samp) + none(F.var_samp)) / 2)).alias("smd"))


def running_total(df: DataFrame, column: str, count: str) -> DataFrame:
    """``df`` with ``upto``: the sum of ``count`` over all rows up to the row's ``column``, in its order.

    Rows are dealt by ranges, summed within each, and the ranges' totals are added up, so no task holds all.
    """
    from pyspark.sql import Window

    dealt = durable(df.repartitionByRange(F.col(column)).withColumn("__range", F.spark_partition_id()))
    totals = dealt.groupBy("__range").agg(F.sum(count).alias("__all"))  # one row for each range
    before = F.sum("__all").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    ahead = F.broadcast(totals.select("__range", F.coalesce(before, F.lit(0)).alias("__ahead")))
    within = F.sum(count).over(Window.partitionBy("__range").orderBy(column).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return dealt.join(ahead, "__range").withColumn("upto", F.col("__ahead") + within).drop("__range", "__ahead")


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """Rank correlation of the rows that have both values, with average ranks for ties.

    Ranks come from counts per value, so ties are summed before the ordered pass.
    """
    rows = df.select(a, b).where(F.col(a).isNotNull() & F.col(b).isNotNull())

    def ranked(column: str, name: str) -> DataFrame:
        counts = rows.groupBy(column).agg(F.count("*").alias("n"))
        return running_total(counts, column, "n").select(column, (F.col("upto") - (F.col("n") - 1) / 2).alias(name))

    return rows.join(ranked(a, "__ra"), a).join(ranked(b, "__rb"), b).agg(F.corr("__ra", "__rb").alias("spearman"))


def component_summary(state: DataFrame, x: str = "x", y: str = "y", interface: str = "is_interface") -> DataFrame:
    """One row for each component: size, interface members, centre, extent and class."""
    out = state.groupBy("component_id").agg(
        F.count("*").alias("size"), F.sum(F.col(interface).cast("int")).alias("interface_members"), F.avg(x).alias("cx"), F.avg(y).alias("cy"), F.hypot(F.max(x) - F.min(x), F.max(y) - F.min(y)).alias("diagonal")
    )
    inside, size = F.col("interface_members"), F.col("size")
    category = F.when(size == 1, "isolated").when((inside > 0) & (inside < size), "spanning").when(inside > 0, "interface").otherwise("outside")
    return out.withColumns({"category": category, "outside_share": 1 - inside / size})


def size_frequency(state: DataFrame) -> DataFrame:
    """Components and members for each component size, with the members' share in that size or more."""
    from pyspark.sql import Window

    sizes = state.groupBy(F.col("component_size").alias("size")).agg(F.count("*").alias("members"), F.count_distinct("component_id").alias("components"))
    larger = Window.orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, Window.currentRow)  # one row for each size
    return sizes.withColumn("share_from_here", F.sum("members").over(larger) / F.sum("members").over(Window.partitionBy()))


def unknown_value(x: Column) -> Column:
    """Null, blank or one of the words that stand for unknown."""
    return x.isNull() | F.lower(F.trim(x)).isin("", "unknown", "nan", "none")


def category_counts(df: DataFrame, a: DataFrame, b: DataFrame, on_a: str, on_b: str) -> DataFrame:
    """Counts over the full product of two category tables, zero where there is none, with shares in ``a``."""
    from pyspark.sql import Window

    counts = df.groupBy(on_a, on_b).agg(F.count("*").alias("n"))
    grid = a.select(on_a).crossJoin(b.select(on_b)).join(counts, [on_a, on_b], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return grid.withColumn("share", F.coalesce(F.try_divide("n", F.sum("n").over(Window.partitionBy(on_a))), F.lit(0.0)))


def hex_cell(x: Column, y: Column, size: float) -> tuple[Column, Column]:
    """Centre of the hexagon that holds a point: the nearer of two shifted rectangular lattices."""
    wide, high = size, size * 3**0.5
    ax, ay = F.rint(x / wide) * wide, F.rint(y / high) * high
    bx, by = (F.floor(x / wide) + 0.5) * wide, (F.floor(y / high) + 0.5) * high
    nearer = (x - ax) * (x - ax) + (y - ay) * (y - ay) < (x - bx) * (x - bx) + (y - by) * (y - by)
    return F.when(nearer, ax).otherwise(bx), F.when(nearer, ay).otherwise(by)
