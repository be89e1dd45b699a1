"""Fill-in-the-middle by a parallel automaton scan.

One automaton reads bytes: it tracks whether a line unit has begun, and how much of a sentinel
has just been read (once all of one, for good). A chunk of a text says, for every state it may
be entered in, which state it leaves in and how many units begin inside. Such functions compose
associatively, so a chunk is summed up without knowing what stands before it; composing the
functions of a text's chunks gives the state each is entered in, the number of units, and the
chunk that holds each cut.

A text of up to one chunk is a single function and is cut in the task that reads it. Longer
texts are dealt out as chunks: the functions are computed where the chunks are, only they meet
by text, and the cuts are found in the chunks that hold them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.session import durable, small_batches

CHUNK_BYTES = 1 << 15
SEED, RATE, SPM = 7, 100, 50
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

_CUT = "n long, marked boolean, first long, second long"
_FUNCTION = "to array<int>, units array<long>, chars long"


@dataclass(frozen=True)
class Automaton:
    """``step[class, state]`` and ``begins[class, state]`` (units begun); even states stand before a unit."""

    classes: np.ndarray
    step: np.ndarray
    begins: np.ndarray
    found: int

    @classmethod
    def of(cls, sentinels: list[str]) -> Automaton:
        """Reads lines and looks for the sentinels: states are 2 * node + (1 inside a line)."""
        words = [s.encode() for s in sentinels]
        letters = sorted({b for w in words for b in w} | {10})
        nodes = sorted({w[:k] for w in words for k in range(len(w))})  # what may have been read of a sentinel
        found = len(nodes)
        classes = np.zeros(256, np.uint8)
        classes[letters] = np.arange(1, len(letters) + 1)
        step = np.zeros((len(letters) + 1, 2 * found + 2), np.int64)
        begins = np.zeros_like(step)
        for c, letter in enumerate([None, *letters]):
            for node in range(found + 1):
                to = found
                if node < found:
                    read = nodes[node] + bytes([letter]) if letter is not None else b""
                    to = found if any(read.endswith(w) for w in words) else max((n for n in range(found) if read.endswith(nodes[n])), key=lambda n: len(nodes[n])) if read else nodes.index(b"")
                for inside in (0, 1):
                    step[c, 2 * node + inside] = 2 * to + (letter != 10)
                    begins[c, 2 * node + inside] = not inside
        return cls(classes, step, begins, found)

    def scan(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The exit state and the units begun, for each entry state."""
        if not len(data):
            return np.arange(self.step.shape[1]), np.zeros(self.step.shape[1], np.int64)
        kinds = self.classes[data]
        keep = kinds > 0
        keep[0] = True
        keep[1:] |= kinds[:-1] > 0  # of bytes that mean nothing one is as good as a run of them
        kinds = kinds[keep]
        to, units = self.step[kinds], self.begins[kinds]
        while len(to) > 1:
            odd = (to[-1:], units[-1:]) if len(to) % 2 else (to[:0], units[:0])
            half = len(to) // 2 * 2
            to, units = compose((to[0:half:2], units[0:half:2]), (to[1:half:2], units[1:half:2]))
            to, units = np.concatenate([to, odd[0]]), np.concatenate([units, odd[1]])
        return to[0], units[0]


Function = tuple[np.ndarray, np.ndarray]


def compose(one: Function, two: Function) -> Function:
    """First ``one``, then ``two``; stacks of functions compose row by row."""
    return np.take_along_axis(two[0], one[0], -1), one[1] + np.take_along_axis(two[1], one[0], -1)


def running(to: np.ndarray, units: np.ndarray) -> Function:
    """Composition of each chunk's function with all before it, in a logarithmic number of steps."""
    d = 1
    while d < len(to):
        a, b = compose((to[:-d], units[:-d]), (to[d:], units[d:]))
        to, units = np.concatenate([to[:d], a]), np.concatenate([units[:d], b])
        d *= 2
    return to, units


def _chars(data: np.ndarray) -> int:
    return int(np.count_nonzero((data & 0xC0) != 0x80))


def unit_start(data: np.ndarray, begun: bool, k: int) -> int:
    """Code points before the ``k``-th unit (from 1) that begins here, or all of them for 0."""
    if k == 0:
        return _chars(data)
    starts = np.flatnonzero(data[:-1] == 10) + 1
    at = starts[k - 1] if begun else 0 if k == 1 else starts[k - 2]
    return _chars(data[:at])


def _bytes(value: pa.Scalar) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), np.uint8)


def _cut_whole(machine: Automaton) -> Column:
    """Cuts of whole texts, by text and two draws."""

    def cut(text: pa.Array, h1: pa.Array, h2: pa.Array) -> pa.Array:
        out = []
        for value, a, b in zip(text, h1.to_pylist(), h2.to_pylist(), strict=True):
            data = _bytes(value)
            to, units = machine.scan(data)
            n = int(units[0])
            cuts = sorted((a % (n + 1), b % (n + 1)))
            places = [unit_start(data, False, u + 1 if u < n else 0) for u in cuts]
            out.append((n, bool(to[0] // 2 == machine.found), *places))
        columns = list(zip(*out, strict=True)) if out else [(), (), (), ()]
        return pa.StructArray.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.bool_()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.int64())], ["n", "marked", "first", "second"])

    return F.arrow_udf(cut, _CUT)


def _split(size: int):
    """Texts into chunks of at most ``size`` bytes that end between code points; at most 64 chunks a batch."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rid, key, text in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                data = text.as_buffer().to_pybytes()
                ends = [0]
                while ends[-1] < len(data):
                    end = min(ends[-1] + size, len(data))
                    while end < len(data) and data[end] & 0xC0 == 0x80:
                        end -= 1
                    ends.append(end)
                for first in range(0, len(ends) - 1, 64):
                    part = ends[first : first + 65]
                    k = len(part) - 1
                    columns = [pa.array([rid.as_py()] * k, pa.int64()), pa.array([key.as_py()] * k, pa.string()), pa.array(range(first, first + k), pa.int32()), pa.array([data[i:j] for i, j in zip(part, part[1:], strict=False)], pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, ["rid", "key", "no", "chunk"])

    return split


def _scan_chunk(machine: Automaton) -> Column:
    def scan(chunk: pa.Array) -> pa.Array:
        found = [(*machine.scan(_bytes(v)), _chars(_bytes(v))) for v in chunk]
        to, units = (pa.array([f[i].tolist() for f in found], pa.list_(t)) for i, t in ((0, pa.int32()), (1, pa.int64())))
        return pa.StructArray.from_arrays([to, units, pa.array([f[2] for f in found], pa.int64())], ["to", "units", "chars"])

    return F.arrow_udf(scan, _FUNCTION)


def _resolve(machine: Automaton):
    """The chunk of each cut of one text: its entry state, the unit to look for there, the code points before."""

    def resolve(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("no")
        to, units = running(np.stack(rows["to"].to_list()).astype(np.int64), np.stack(rows["units"].to_list()))
        before = np.concatenate([[0], units[:, 0]])  # units begun before each chunk, and in all
        state = np.concatenate([[0], to[:, 0]])
        chars = np.concatenate([[0], np.cumsum(rows["chars"].to_numpy())])
        n, marked = int(before[-1]), bool(state[-1] // 2 == machine.found)
        out = []
        for which, u in enumerate(sorted((int(rows["h1"].iloc[0]) % (n + 1), int(rows["h2"].iloc[0]) % (n + 1)))):
            k = int(np.searchsorted(before, u + 1)) - 1 if u < n else len(rows) - 1
            out.append((rows["rid"].iloc[0], which, rows["no"].iloc[k], n, marked, bool(state[k] % 2), u + 1 - int(before[k]) if u < n else 0, int(chars[k])))
        return pd.DataFrame(out, columns=["rid", "which", "no", "n", "marked", "begun", "k", "earlier"])

    return resolve


def _place(chunk: pa.Array, begun: pa.Array, k: pa.Array) -> pa.Array:
    return pa.array([unit_start(_bytes(c), b, n) for c, b, n in zip(chunk, begun.to_pylist(), k.to_pylist(), strict=True)], pa.int64())


def _draws(key: Column, seed: int) -> list[Column]:
    """Four unsigned numbers of 32 bits, from the hash of the seed and the id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), key), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]


def _far(rows: DataFrame, machine: Automaton, chunk_bytes: int, seed: int) -> DataFrame:
    """``(rid, key, text, cut)`` of texts of several chunks."""
    chunks = rows.select("rid", "key", F.col("text").cast("binary").alias("text")).mapInArrow(_split(chunk_bytes), "rid long, key string, no int, chunk binary")
    chunks = durable(chunks.repartition("rid", "no"))
    functions = chunks.select("rid", "no", *_draws(F.coalesce("key", F.lit("")), seed)[:2], _scan_chunk(machine)("chunk").alias("f")).select("rid", "no", "h1", "h2", "f.*")
    wanted = functions.groupBy("rid").applyInPandas(_resolve(machine), "rid long, which int, no int, n long, marked boolean, begun boolean, k long, earlier long")
    placed = wanted.join(chunks.select("rid", "no", "chunk"), ["rid", "no"]).withColumn("place", F.col("earlier") + F.arrow_udf(_place, "long")("chunk", "begun", "k"))
    cut = F.struct(F.max("n").alias("n"), F.max("marked").alias("marked"), F.max(F.when(F.col("which") == 0, F.col("place"))).alias("first"), F.max(F.when(F.col("which") == 1, F.col("place"))).alias("second"))
    cuts = placed.groupBy("rid").agg(cut.alias("cut"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("no", F.col("chunk").cast("string").alias("chunk")))), lambda x: x["chunk"]), "")
    texts = chunks.groupBy("rid").agg(F.max("key").alias("key"), whole.alias("text"))
    return texts.join(cuts, "rid").select("rid", "key", "text", "cut")


def transform(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm: int = SPM, chunk_bytes: int = CHUNK_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n, form, prefix_chars, middle_chars, output)`` for every row.

    Cuts fall between lines, drawn by the hash of the seed and the id. ``rate`` of 100 texts are
    transformed and ``spm`` of 100 of those in suffix-prefix-middle order; empty texts and those
    that hold a sentinel stay plain, with null numbers. A null text is empty, a null id draws
    like an empty one. Repeated rows are transformed one by one. An empty table gives an empty
    result; other columns don't matter. A text may be as long as a value can be.
    """
    if chunk_bytes < 4:
        raise ValueError("a chunk must be able to hold any code point, 4 bytes")
    small_batches(docs.sparkSession)
    machine = Automaton.of([PREFIX, SUFFIX, MIDDLE])
    typed = docs.schema[id_col].dataType
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    key = F.coalesce(F.col("id").cast("string"), F.lit(""))
    near = rows.where(F.octet_length("text") <= chunk_bytes).select("id", key.alias("key"), "text")
    cut = _cut_whole(machine)(F.col("text").cast("binary"), *_draws(F.col("key"), seed)[:2])
    near = near.select("id", "key", "text", cut.alias("cut"))
    far = rows.where(F.octet_length("text") > chunk_bytes).select(F.monotonically_increasing_id().alias("rid"), F.col("id").cast("string").alias("key"), "text")
    far = _far(far, machine, chunk_bytes, seed).select(F.col("key").cast(typed).alias("id"), F.coalesce("key", F.lit("")).alias("key"), "text", "cut")
    both = near.unionByName(far).select("id", "text", "cut", *_draws(F.col("key"), seed)[2:])
    plain = (F.col("text") == "") | F.col("cut.marked") | (F.col("h3") % 100 >= rate)
    form = F.when(plain, "plain").when(F.col("h4") % 100 < spm, "spm").otherwise("psm")
    text, first, second = F.col("text"), F.col("cut.first"), F.col("cut.second")
    prefix, middle, suffix = F.substr(text, F.lit(1), first), F.substr(text, first + 1, second - first), F.substr(text, second + 1)
    output = (
        F.when(F.col("form") == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
        .when(F.col("form") == "spm", F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
        .otherwise(text)
    )
    cut_there = F.col("form") != "plain"
    return both.withColumn("form", form).select("id", F.col("cut.n").alias("n"), "form", F.when(cut_there, first).alias("prefix_chars"), F.when(cut_there, second - first).alias("middle_chars"), output.alias("output"))


def restore(output: Column, form: Column) -> Column:
    """The text that ``transform`` was given."""
    part = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    order = F.when(form == "psm", F.array(F.lit(1), F.lit(3), F.lit(2))).otherwise(F.array(F.lit(2), F.lit(3), F.lit(1)))
    return F.when(form == "plain", output).otherwise(F.array_join(F.transform(order, lambda i: F.get(part, i)), ""))


def query(spark, sf_dir: str) -> DataFrame:
    """Digests of all documents transformed, and restored from that."""
    made = transform(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return made.select(
        F.col("id").alias("doc_id"),
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


ORACLE_SQL = r"""
WITH docs AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256(concat('7:', CAST(doc_id AS VARCHAR))) AS h FROM documents),
drawn AS (
  SELECT *, len(u) AS n, CAST(concat('0x', substr(h, 1, 8)) AS BIGINT) AS h1, CAST(concat('0x', substr(h, 9, 8)) AS BIGINT) AS h2,
    CAST(concat('0x', substr(h, 17, 8)) AS BIGINT) AS h3, CAST(concat('0x', substr(h, 25, 8)) AS BIGINT) AS h4 FROM docs),
cut AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn),
parts AS (SELECT *, coalesce(array_to_string(u[1:a], ''), '') AS x, coalesce(array_to_string(u[a + 1:b], ''), '') AS y, coalesce(array_to_string(u[b + 1:], ''), '') AS z FROM cut)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(x) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(y) END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN concat('<P>', x, '<S>', z, '<M>', y) WHEN 'spm' THEN concat('<S>', z, '<P>', x, '<M>', y) ELSE text END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM parts
"""
