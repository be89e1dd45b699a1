"""Sharding with the smallest possible largest shard: a minimax contiguous partition.

Equal texts are one atomic group. Groups are ordered by the 64-bit hash of their text, so an
order needs no sort: any range of hashes is a range of groups. A capacity is feasible if a
greedy pass, filling each shard with as many next groups as fit, ends within the shard count;
the smallest feasible capacity is found by binary search, and the cuts are those of its pass.

The pass runs on the sizes of hash ranges, of which a bounded number comes to the driver. A
range that holds several groups leaves its inner cut points unknown; treating it as uncuttable
and as freely cuttable bounds the true capacity from both sides, and only ranges that a cut can
still fall into are split further, until none of them holds more than one group. The answer is
that of the pass over all single groups, whatever their number.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import durable

SHARDS = 24
#: The hash ranges that the first look takes, and into how many each open range is split later.
FIRST_BITS = 14
NEXT_BITS = 8


def greedy_cuts(ends: list[int], capacity: int, shards: int, start: int = 0) -> list[int]:
    """Boundary indices that a greedy pass cuts at.

    ``ends`` are the cumulative sizes at each boundary (``ends[0]`` is 0). The pass stops at the
    last boundary, after ``shards`` cuts, or where nothing more fits.
    """
    cuts, at = [], start
    while len(cuts) < shards and at < len(ends) - 1:
        at = max(at, bisect_right(ends, ends[at] + capacity) - 1)
        cuts.append(at)
    return cuts


def _reached(ends: list[int], capacity: int, shards: int, generous: bool, single: list[bool]) -> list[int]:
    """Boundaries that no true cut falls short of or, if generous, that none goes beyond."""
    cuts, at, last = [], 0, len(ends) - 1
    while len(cuts) < shards and at < last:
        to = max(at, bisect_right(ends, ends[at] + capacity) - 1)
        if generous and to < last and not single[to]:
            to += 1
        cuts.append(to)
        at = to
    return cuts + [at] * (shards - len(cuts))


def minimax_cuts(sizes: list[int], shards: int) -> tuple[int, list[int]]:
    """Smallest capacity and the cut positions, for group sizes that are all known."""
    ends = [0, *accumulate(sizes)]
    low, high = max([0, *sizes, -(-ends[-1] // shards)]), ends[-1]
    while low < high:
        mid = (low + high) // 2
        cuts = greedy_cuts(ends, mid, shards)
        if not cuts or cuts[-1] == len(sizes):
            high = mid
        else:
            low = mid + 1
    return low, greedy_cuts(ends, low, shards)


class _Ranges:
    """Sizes of consecutive hash ranges ``(first, last, size, groups, largest)``, all but empty ones."""

    def __init__(self, rows: list[tuple[int, int, int, int, int]]) -> None:
        self.rows = sorted(rows)
        self.ends = [0, *accumulate(r[2] for r in self.rows)]
        self.single = [r[3] <= 1 for r in self.rows]

    def bounds(self, shards: int) -> tuple[int, int]:
        """The largest capacity known too small plus one, and the smallest known large enough."""
        found = []
        for generous in (True, False):
            low, high = max([0, *(r[4] for r in self.rows), -(-self.ends[-1] // shards)]), max(self.ends[-1], 0)
            while low < high:
                mid = (low + high) // 2
                if _reached(self.ends, mid, shards, generous, self.single)[-1:] in ([len(self.rows)], []):
                    high = mid
                else:
                    low = mid + 1
            found.append(low)
        return found[0], found[1]

    def open_ranges(self, shards: int) -> list[int]:
        """Indices of the ranges of several groups that a cut of the true capacity may fall into."""
        low, high = self.bounds(shards)
        short, far = _reached(self.ends, low, shards, False, self.single), _reached(self.ends, high, shards, True, self.single)
        return sorted({i for a, b in zip(short, far, strict=True) for i in range(a, min(b + 1, len(self.rows))) if not self.single[i]})


def _look(groups: DataFrame, bits: int, inside: DataFrame | None) -> list[tuple[int, int, int, int, int]]:
    """Sizes of the ranges of hashes that agree in their first ``bits`` bits; finer ones ``inside``."""
    rows = groups
    if inside is not None:
        rows = groups.withColumn("outer", F.shiftright("key", 64 - bits)).join(F.broadcast(inside), "outer", "left_semi")
        bits = min(64, bits + NEXT_BITS)
    found = rows.groupBy(F.shiftright("key", 64 - bits).alias("part")).agg(F.sum("size").alias("size"), F.count("*").alias("n"), F.max("size").alias("most")).collect()
    step = 1 << (64 - bits)
    return [(r["part"] * step, r["part"] * step + step - 1, r["size"], r["n"], r["most"]) for r in found]


def contiguous_cuts(groups: DataFrame, shards: int = SHARDS, first_bits: int = FIRST_BITS) -> list[int]:
    """The last hash of each shard but the final one, from ``groups (key, size)`` with distinct keys."""
    spark = groups.sparkSession
    ranges = _Ranges(_look(groups, first_bits, None))
    while todo := ranges.open_ranges(shards):
        width = max(ranges.rows[i][1] - ranges.rows[i][0] + 1 for i in todo)  # the coarsest first
        split = {i for i in todo if ranges.rows[i][1] - ranges.rows[i][0] + 1 == width}
        inside = spark.createDataFrame([(ranges.rows[i][0] // width,) for i in split], "outer bigint")
        parts = _look(groups, 64 - (width.bit_length() - 1), inside)
        ranges = _Ranges([r for i, r in enumerate(ranges.rows) if i not in split] + parts)
    capacity = ranges.bounds(shards)[1]
    cuts = greedy_cuts(ranges.ends, capacity, shards)
    return [ranges.rows[c - 1][1] for c in cuts[:-1] if c]


def shard(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, size, text_crc32, shard, slot)`` for every row; equal texts share a shard.

    The size is the text's UTF-8 bytes plus 8; a null text has size 8 and the checksum of an
    empty one, and goes where empty texts go. Slots are gapless from 0 in each shard. Repeated
    rows get slots of their own. With fewer groups than shards the last shards stay empty. An
    empty table gives an empty result.
    """
    raw = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).alias("id"), (F.octet_length(raw).cast("long") + 8).alias("size"), F.crc32(raw).alias("text_crc32"), F.xxhash64(raw).alias("key"))
    rows = durable(rows.withColumn("rid", F.monotonically_increasing_id()))
    groups = durable(rows.groupBy("key").agg(F.sum("size").alias("size")))
    cuts = contiguous_cuts(groups, shards)
    place = sum(((F.col("key") > F.lit(c)).cast("int") for c in cuts), F.lit(0))
    # Slots: rows are numbered within their input partition, and partitions follow each other.
    parts = rows.select("*", place.alias("shard"), F.shiftright("rid", 33).alias("part"))
    counts = parts.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    local = F.row_number().over(Window.partitionBy("shard", "part").orderBy("rid")) - 1
    return parts.withColumn("local", local).join(offsets, ["shard", "part"]).select("id", "size", "text_crc32", "shard", (F.col("earlier") + F.col("local")).alias("slot"))


def query(spark, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of near equal bytes."""
    found = shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
