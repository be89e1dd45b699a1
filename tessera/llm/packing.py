"""Packing of tokenised documents into sequences of fixed capacity: best fit, decreasing.

Best fit asks only for lengths, and there are at most ``capacity`` of them, so the whole packing
is decided on a histogram of piece lengths. A segment tree over the remaining capacities finds
the tightest open sequence that still takes a piece in logarithmic time; sequences with equal
room are interchangeable and are held as runs, so equal pieces are placed a run at a time, as
the piece-by-piece algorithm would place them one after another. Pieces get a gapless rank
within their length (counted per input partition, so no length meets in one task), and the
rank names the seat. The plan has a few rows per length, whatever the number of documents.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import durable, small_batches

CAPACITY = 1024
END = 2
VOCABULARY = "byte_bpe_50k"
SPECIAL = "<|endoftext|>"
#: Cuts of a text whose ids a worker keeps, twice over, and the longest of them: some 200 MB.
CACHED_WORDS = 1 << 19
LONGEST_WORD = 32

# The white space of the Unicode standard, and ASCII punctuation but the apostrophe of contractions.
_WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_MARKS = r"!-&(-/:-@\[-`{-~"
#: Letters and digits up to a mark or white space; else all up to white space; a run of white
#: space but its last character, which goes with the next word if it is a space.
_CUTS = re.compile(rf" ?[^\W_]++(?=[{_WHITE}{_MARKS}]|\Z)| ?[^{_WHITE}]+|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]")
_END = np.array([END], "<u4").tobytes()


class Placement(NamedTuple):
    """Pieces of ``length`` with ranks from ``first``: ``per_bin`` to each of ``bins`` sequences."""

    length: int
    first: int
    bins: int
    per_bin: int
    sequence: int
    offset: int


class RoomTree:
    """Segment tree over remaining capacities: how many open sequences have each."""

    def __init__(self, capacity: int) -> None:
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, room: int, n: int) -> None:
        i = self.leaves + room
        while i:
            self.count[i] += n
            i //= 2

    def tightest(self, least: int) -> int | None:
        """The smallest room of at least ``least`` that an open sequence has."""
        i = self.leaves + least
        if self.count[i]:
            return least
        while i > 1:
            if i % 2 == 0 and self.count[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i if self.count[2 * i] else 2 * i + 1
                return i - self.leaves
            i //= 2
        return None


def best_fit_decreasing(histogram: dict[int, int], capacity: int = CAPACITY) -> list[Placement]:
    """Seats for all pieces, given the number of pieces of each length from 1 to ``capacity``."""
    tree, runs, plan, opened = RoomTree(capacity), {}, [], 0
    for length in sorted(histogram, reverse=True):
        left, first = histogram[length], 0
        while left:
            room = tree.tightest(length)
            if room is None:
                per_bin = min(capacity // length, left)
                start, n, room = opened, left // per_bin, capacity
                opened += n
                bins = n
            else:
                start, n = runs[room].pop()
                tree.add(room, -n)
                per_bin = min(room // length, left)
                bins = min(n, left // per_bin)
                if bins < n:
                    runs[room].append((start + bins, n - bins))
                    tree.add(room, n - bins)
            plan.append(Placement(length, first, bins, per_bin, start, capacity - room))
            if rest := room - per_bin * length:
                runs.setdefault(rest, []).append((start, bins))
                tree.add(rest, bins)
            first += bins * per_bin
            left -= bins * per_bin
    return plan


class _Encoder(dict):
    """Token ids of the public byte-level vocabulary, as little-endian unsigned 32-bit words.

    All ids come from ``tokenizers``. It cuts a text into parts before it merges anything, and
    parts never share a token, so a text is cut at places where the library surely cuts, and the
    ids of a cut are kept: the dict maps cuts to their ids' bytes, in two generations of bounded
    size. A text with the special token's own string is encoded whole.
    """

    def __init__(self, name: str, most: int = CACHED_WORDS) -> None:
        import public_tokenizers
        from tokenizers import Tokenizer

        super().__init__()
        self.full, self.most, self.older = Tokenizer.from_file(public_tokenizers.path(f"{name}.json")), most, {}

    def _whole(self, text: str) -> bytes:
        return np.array(self.full.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __missing__(self, word: str) -> bytes:
        raw = self.older.get(word)
        if raw is None:
            raw = self._whole(word)
        if len(word) <= LONGEST_WORD:
            if len(self) >= self.most:
                self.older = dict(self)
                self.clear()
            self[word] = raw
        return raw

    def __call__(self, text: str) -> np.ndarray:
        raw = self._whole(text) if SPECIAL in text else b"".join(map(self.__getitem__, _CUTS.findall(text)))
        return np.frombuffer(raw + _END, "<u4")


@functools.cache
def _encoder(vocabulary: str, most: int) -> _Encoder:
    """One encoder for a worker process, whose words serve the tasks that follow."""
    return _Encoder(vocabulary, most)


def pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, cached_words: int = CACHED_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, piece, start, length, ids_crc32)``: the pieces of every row's token ids.

    A document's ids end with id 2; null and empty texts have that one id. Only documents of
    more ids than ``capacity`` are cut: all pieces but the first are then full. ``cached_words``
    and ``keep_encoder`` (between the tasks of a worker) trade memory for time and change no result.
    """

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(vocabulary, cached_words)
        for batch in batches:
            rows, piece, start, length, crc = [], [], [], [], []
            for n, text in enumerate(x.as_py() for x in batch.column(1)):
                ids = encode(text or "")
                at, upto, k = 0, len(ids) % capacity or capacity, 0
                while at < len(ids):
                    part = ids[at:upto]
                    rows.append(n)
                    piece.append(k)
                    start.append(at)
                    length.append(len(part))
                    crc.append(zlib.crc32(part.tobytes()))
                    at, upto, k = upto, upto + capacity, k + 1
            columns = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            yield pa.RecordBatch.from_arrays(columns, ["id", "piece", "start", "length", "ids_crc32"])

    small_batches(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(per_batch, f"id {id_type}, piece int, start bigint, length bigint, ids_crc32 bigint")


def pack(docs: DataFrame, capacity: int = CAPACITY, **params) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``; offsets in a sequence are gapless from 0.

    Repeated and null ids are packed row by row. An empty table gives an empty result.
    """
    cut = durable(pieces(docs, capacity, **params).withColumn("rid", F.monotonically_increasing_id()).withColumn("part", F.shiftright("rid", 33)))
    counts = cut.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    plan = best_fit_decreasing(histogram, capacity)
    seats: dict[int, list[Placement]] = {}
    for x in plan:
        seats.setdefault(x.length, []).append(x)
    spark = docs.sparkSession
    schema = "length bigint, seats array<struct<first:bigint,per_bin:bigint,sequence:bigint,offset:bigint>>"
    table = spark.createDataFrame([(n, [(x.first, x.per_bin, x.sequence, x.offset) for x in own]) for n, own in seats.items()], schema)
    local = F.row_number().over(Window.partitionBy("length", "part").orderBy("rid")) - 1
    ranked = cut.withColumn("local", local).join(offsets, ["length", "part"]).withColumn("rank", F.col("earlier") + F.col("local"))
    seat = F.expr("element_at(filter(seats, s -> s.first <= rank), -1)")
    placed = ranked.join(F.broadcast(table), "length").withColumn("seat", seat).withColumn("nth", F.col("rank") - F.col("seat.first"))
    return placed.select(
        "id",
        "piece",
        "start",
        "length",
        "ids_crc32",
        (F.col("seat.sequence") + F.floor(F.col("nth") / F.col("seat.per_bin"))).alias("sequence_id"),
        (F.col("seat.offset") + F.col("nth") % F.col("seat.per_bin") * F.col("length")).alias("offset"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 1024 tokens."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumnRenamed("id", "doc_id")
