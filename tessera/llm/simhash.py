"""Near-duplicate texts by 64-bit similarity fingerprints, searched with Burkhard-Keller trees.

Fingerprints of whole texts are made in one pass over the data. Equal fingerprints become one
class, and all further work is on classes. Two classes that differ in at most ``radius`` bits
agree fully on ``blocks - radius`` of ``blocks`` bit blocks, so every class is dealt to one
shard for each choice of those blocks, and linked classes always meet in a shard. A shard is
indexed by BK-trees: a child hangs below its parent under their Hamming distance, and a search
follows only edges whose key lies within the radius of the distance just measured. A shard of
more than ``tree_nodes`` classes is held in several trees; each class is then sent to the
trees after its own, so that a tree's size bounds the memory of a task whatever the skew.
A shard reports spanning links, not all pairs, and the components are labelled in Spark.

``keep_one`` asks for more than close fingerprints: shingle sets of a given Jaccard similarity. Two
sets of similarity 0.8 differ in some ten bits of 64 and in up to twice as many, which bit blocks
can't shard without sending each class everywhere. Its shards are therefore bands of min-hashes
(25 of 5 meet a pair of similarity 0.8 with probability 0.99995, a closer one more surely), its
trees are searched within ``WIDE_RADIUS`` bits, and what a tree finds is compared on whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.components import star_components
from tessera.session import durable, small_batches

SHINGLE = 4
SEED = 42
RADIUS = 4
BLOCKS = 6
TREE_NODES = 2048

#: ``keep_one``: words of a shingle, similarity of linked sets, bands and min-hashes in each.
WIDE_SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 25, 5
#: Bits that sets of that similarity may differ in: five standard deviations above their mean.
WIDE_RADIUS = 24
#: Classes, and bytes of their sets, that one tree of a band holds.
PART_CLASSES = 1024
PART_BYTES = 16 << 20
#: Rows whose keys may be broadcast to the pass over the texts: some 50 MB.
BROADCAST_ROWS = 500_000

_DRAWN = np.random.default_rng(SEED).integers(0, 1 << 63, (3, BANDS * ROWS), dtype=np.uint64)
_XOR, _TIMES, _MIX = _DRAWN[0] * np.uint64(2), _DRAWN[1] * np.uint64(2) + np.uint64(1), (_DRAWN[2] * np.uint64(2) + np.uint64(1)).reshape(BANDS, ROWS)
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
_LANES = (np.arange(8, dtype=np.int64) * 256)[None, :]


def shingle_hashes(text: str | None, width: int = SHINGLE) -> np.ndarray:
    """Hashes of the word shingles in page order; a shorter text is one shingle, a blank one has none."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return np.empty(0, "<u8")
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([digest(joined, SEED)], "<u8")
    spaces = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts = [0, *(spaces + 1).tolist()]
    ends = [*spaces.tolist(), len(joined)]
    return np.fromiter((digest(joined[i:j], SEED) for i, j in zip(starts, ends[width - 1 :], strict=False)), "<u8", len(words) - width + 1)


def majority(hashes: np.ndarray) -> int:
    """The unsigned 64-bit word of the bits that are set in over half of the hashes; zero for none."""
    if len(hashes) < 2:
        return int(hashes[0]) if len(hashes) else 0
    lanes = hashes.view(np.uint8).reshape(-1, 8)
    set_bits = np.zeros(64, np.int64)
    for at in range(0, len(lanes), 16384):  # bounds memory on very long texts
        counts = np.bincount((lanes[at : at + 16384] + _LANES).ravel(), minlength=2048).reshape(8, 256)
        set_bits += (counts @ _BITS).ravel()
    return int.from_bytes(np.packbits(2 * set_bits > len(hashes), bitorder="little").tobytes(), "little")


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """The unsigned 64-bit fingerprint of one text; null, empty and blank texts give zero."""
    return majority(shingle_hashes(text, width))


_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, fp)`` for every row, fp as a signed long; repeated and null ids stay as they are."""

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [_signed(fingerprint(t.as_py())) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["id", "fp"])

    small_batches(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(per_batch, f"id {id_type}, fp bigint")


def _block_masks(blocks: int) -> list[int]:
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    return [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:], strict=False)]


def shard_keys(fp, radius: int = RADIUS, blocks: int = BLOCKS):
    """Array of one shard key for each choice of ``blocks - radius`` agreeing blocks."""
    masks = _block_masks(blocks)
    keys = []
    for n, chosen in enumerate(combinations(range(blocks), blocks - radius)):
        mask = 0
        for i in chosen:
            mask |= masks[i]
        keys.append(F.struct(F.lit(n).cast("smallint").alias("part"), fp.bitwiseAND(F.lit(_signed(mask))).alias("bits")))
    return F.array(*keys)


class BKTree:
    """Distinct 64-bit words; a child's key is its integer Hamming distance to its parent."""

    def __init__(self) -> None:
        self.words: list[int] = []
        self.children: list[dict[int, int]] = []

    def insert(self, word: int) -> int:
        """The index of the word's node, which is new if the word is."""
        if not self.words:
            self.words.append(word)
            self.children.append({})
            return 0
        at = 0
        while True:
            d = (self.words[at] ^ word).bit_count()
            if d == 0:
                return at
            below = self.children[at].get(d)
            if below is None:
                self.children[at][d] = len(self.words)
                self.words.append(word)
                self.children.append({})
                return len(self.words) - 1
            at = below

    def within(self, word: int, radius: int) -> Iterator[int]:
        """Indices of the nodes at most ``radius`` away from ``word``, as the search meets them."""
        todo = [0] if self.words else []
        words, children = self.words, self.children
        while todo:
            at = todo.pop()
            d = (words[at] ^ word).bit_count()
            if d <= radius:
                yield at
            below = children[at]
            if below:
                lo, hi = d - radius, d + radius
                todo.extend(i for k, i in below.items() if lo <= k <= hi)


class _Shard:
    """One tree with the classes that hang together in it."""

    def __init__(self, radius: int) -> None:
        self.radius, self.tree, self.up = radius, BKTree(), []

    def _root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def add(self, word: int) -> list[tuple[int, int]]:
        """Insert a node; links that join it to what it was not yet joined to."""
        roots = {self._root(i) for i in self.tree.within(word, self.radius)}
        self.tree.insert(word)
        new = len(self.up)
        self.up.append(new)
        for r in roots:
            self.up[r] = new
        return [(word, self.tree.words[r]) for r in roots]

    def ask(self, word: int) -> list[tuple[int, int]]:
        """Links of a word of another tree to the groups of this one."""
        return [(word, self.tree.words[r]) for r in {self._root(i) for i in self.tree.within(word, self.radius)}]


def _search(radius: int):
    def per_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, shard = None, _Shard(radius)
        for batch in batches:
            out: list[tuple[int, int]] = []
            for part, bits, tree, asks, fp in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (part, bits, tree) != now:
                    now, shard = (part, bits, tree), _Shard(radius)
                word = fp & 0xFFFFFFFFFFFFFFFF
                out += shard.ask(word) if asks else shard.add(word)
            yield pa.RecordBatch.from_arrays([pa.array([_signed(x[i]) for x in out], pa.int64()) for i in (0, 1)], ["a", "b"])

    return per_partition


def links(classes: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, tree_nodes: int = TREE_NODES) -> DataFrame:
    """Spanning links ``(a, b)`` between distinct fingerprints (column ``fp``) within ``radius`` bits.

    Not all pairs: any two fingerprints within the radius end in one component of the result.
    """
    keyed = classes.select("fp", F.explode(shard_keys(F.col("fp"), radius, blocks)).alias("k")).select("fp", "k.part", "k.bits")
    sizes = keyed.groupBy("part", "bits").agg(F.count("*").alias("n")).where("n > 1")
    trees = F.ceil(F.col("n") / tree_nodes)
    own = F.pmod(F.xxhash64("fp"), trees).cast("int")
    placed = keyed.join(sizes, ["part", "bits"]).select("part", "bits", "fp", trees.cast("int").alias("trees"), own.alias("own"))
    stops = placed.select("part", "bits", "fp", "own", F.explode(F.expr("sequence(own, trees - 1)")).alias("tree"))
    dealt = stops.select("part", "bits", "tree", (F.col("tree") != F.col("own")).alias("asks"), "fp")
    ordered = dealt.repartition("part", "bits", "tree").sortWithinPartitions("part", "bits", "tree", "asks", "fp")
    return ordered.mapInArrow(_search(radius), "a bigint, b bigint")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, blocks: int = BLOCKS, tree_nodes: int = TREE_NODES) -> DataFrame:
    """One row per row of ``docs``: ``(id, fp, component_id)``.

    ``component_id`` is the smallest id that links reach, the row's own included. Null, empty
    and blank texts all have fingerprint zero and are linked with each other like any equal
    fingerprints. Rows with a null id take part; a component of null ids only has a null
    ``component_id``. Repeated rows stay. An empty table gives an empty result.
    """
    rows = durable(fingerprints(docs, id_col, text_col))
    classes = rows.groupBy("fp").agg(F.min("id").alias("least"))
    labels = star_components(links(classes.select("fp"), radius, blocks, tree_nodes)).withColumnsRenamed({"node": "fp"})
    joined = classes.join(labels, "fp", "left").select("fp", "least", "component")
    grouped = joined.where("component is not null").groupBy("component").agg(F.min("least").alias("component_id"))
    of_class = joined.join(grouped, "component", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    return rows.join(of_class, "fp").select("id", "fp", "component_id")


def query(spark, sf_dir: str) -> DataFrame:
    """Fingerprints and components of all documents."""
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def bands(own: np.ndarray) -> list[int]:
    """One signed key for each band of min-hashes of a shingle set; none for an empty set."""
    if not len(own):
        return []
    least = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for at in range(0, len(own), 1024):  # bounds memory on very long texts
        np.minimum(least, ((own[at : at + 1024, None] ^ _XOR) * _TIMES).min(axis=0), out=least)
    rows = least.reshape(BANDS, ROWS)
    return (((rows ^ (rows >> np.uint64(29))) * _MIX).sum(axis=1, dtype=np.uint64)).view(np.int64).tolist()


def similar(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY) -> bool:
    """Whether two sorted sets have so much Jaccard similarity."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) < similarity * len(b) - 1e-9:
        return False
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    both = int(np.count_nonzero(b[at] == a))
    return both >= similarity * (len(a) + len(b) - both) - 1e-9


class _SetShard:
    """One tree over the fingerprints of shingle sets, with the groups that similar sets form in it."""

    def __init__(self, radius: int, similarity: float) -> None:
        self.radius, self.similarity, self.tree = radius, similarity, BKTree()
        self.at: list[list[int]] = []  # classes of each node
        self.sets: list[tuple[int, np.ndarray]] = []
        self.up: list[int] = []
        self.groups = 0

    _root = _Shard._root

    def _met(self, word: int, own: np.ndarray) -> dict[int, int]:
        """For each group that holds a similar set, one class of it."""
        found: dict[int, int] = {}
        for node in self.tree.within(word, self.radius):
            for i in self.at[node]:
                r = self._root(i)
                if r not in found and similar(own, self.sets[i][1], self.similarity):
                    found[r] = i
            if len(found) == self.groups:
                break
        return found

    def ask(self, word: int, key: int, own: np.ndarray) -> list[tuple[int, int]]:
        """Links of a class of another tree to the groups of this one."""
        return [(key, self.sets[i][0]) for i in self._met(word, own).values()]

    def add(self, word: int, key: int, own: np.ndarray) -> list[tuple[int, int]]:
        """Insert a class; links that join it to what it was not yet joined to."""
        met = self._met(word, own)
        node = self.tree.insert(word)
        if node == len(self.at):
            self.at.append([])
        new = len(self.up)
        self.at[node].append(new)
        self.sets.append((key, own))
        self.up.append(new)
        for r in met:
            self.up[r] = new
        self.groups += 1 - len(met)
        return [(key, self.sets[i][0]) for i in met.values()]


def _search_sets(radius: int, similarity: float):
    def per_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, shard = None, _SetShard(radius, similarity)
        for batch in batches:
            out: list[tuple[int, int]] = []
            for band, bits, part, asks, fp, key, raw in zip(*batch.columns, strict=True):
                place = (band.as_py(), bits.as_py(), part.as_py())
                if place != now:
                    now, shard = place, _SetShard(radius, similarity)
                word, own = fp.as_py() & 0xFFFFFFFFFFFFFFFF, np.frombuffer(raw.as_py(), "<u8")
                out += (shard.ask if asks.as_py() else shard.add)(word, key.as_py(), own)
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], ["a", "b"])

    return per_partition


def _signatures(width: int):
    def per_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, fps, n, keys = [], [], [], []
            for text in batch.column(3):
                found = np.unique(shingle_hashes(text.as_py(), width))
                own.append(_signed(xxhash.xxh64_intdigest(found.tobytes(), SEED)))
                fps.append(_signed(majority(found)))
                n.append(len(found))
                keys.append(bands(found))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(own, pa.int64()), pa.array(fps, pa.int64()), pa.array(n, pa.int32()), pa.array(keys, pa.list_(pa.int64()))], ["id", "row", "digest", "own", "fp", "n", "bands"])

    return per_partition


def _sets(width: int):
    def per_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [np.unique(shingle_hashes(t.as_py(), width)).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], ["own", "raw"])

    return per_partition


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` with a key of each row: hashes of its id (null ids, too) and of its text."""
    return docs.withColumns({"__row": F.xxhash64(id_col), "__digest": F.xxhash64(F.col(text_col).cast("string"))})


def set_links(classes: DataFrame, texts: DataFrame, width: int = WIDE_SHINGLE, similarity: float = SIMILARITY, radius: int = WIDE_RADIUS, part_classes: int = PART_CLASSES, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Spanning links ``(a, b)`` between classes of shingle sets of ``similarity`` or more.

    ``classes`` is ``(own, fp, n, bands, row, digest)`` and ``texts`` is ``(row, digest, text)``,
    which holds a row for each class. Only classes that share a band with another one send
    their sets, and classes that share several bands with the same others are compared once.
    """
    banded = classes.select("own", "fp", "n", F.posexplode("bands").alias("band", "bits"))
    met = banded.groupBy("band", "bits").agg(F.count("*").alias("k"), F.bit_xor(F.xxhash64("own")).alias("all"), F.min("own").alias("lo"), F.max("own").alias("hi"), F.sum("n").alias("hashes")).where("k > 1")
    parts = F.greatest(F.ceil(F.col("k") / part_classes), F.ceil(F.col("hashes") * 8 / PART_BYTES)).cast("int")
    shards = met.groupBy("k", "all", "lo", "hi").agg(F.min(F.struct("band", "bits", parts.alias("parts"))).alias("s")).select("s.band", "s.bits", "s.parts")
    placed = durable(banded.join(shards, ["band", "bits"]).select("band", "bits", "own", "fp", "parts"))
    wanted = durable(placed.select("own").distinct().join(classes.select("own", "row", "digest"), "own"))
    side = F.broadcast(wanted) if wanted.count() <= broadcast_rows else wanted
    sets = texts.join(side, ["row", "digest"]).select("own", "text").mapInArrow(_sets(width), "own bigint, raw binary").dropDuplicates(["own"])
    home = F.pmod(F.xxhash64("own"), F.col("parts")).cast("int")
    stops = placed.withColumn("home", home).select("band", "bits", "own", "fp", "home", F.explode(F.expr("sequence(home, parts - 1)")).alias("part"))
    dealt = stops.join(sets, "own").select("band", "bits", "part", (F.col("part") != F.col("home")).alias("asks"), "fp", "own", "raw")
    ordered = dealt.repartition("band", "bits", "part").sortWithinPartitions("band", "bits", "part", "asks", "own")
    return ordered.mapInArrow(_search_sets(radius, similarity), "a bigint, b bigint")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDE_SHINGLE, broadcast_rows: int = BROADCAST_ROWS, **params) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates: the one of the least id, null ids last.

    Groups are texts linked by word shingles of the given Jaccard similarity. Rows are told apart
    by id and text together, so a repeated id loses no other text and null ids take part; of
    rows with equal id and text one stays. Null, empty and blank texts are copies of each other.
    Other columns stay as they are. An empty table stays empty. Texts are not shuffled unless
    more than ``broadcast_rows`` rows go.
    """
    small_batches(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()
    texts = _keyed(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")), "id", "text").select("id", F.col("__row").alias("row"), F.col("__digest").alias("digest"), "text")
    rows = durable(texts.mapInArrow(_signatures(width), f"id {id_type}, row bigint, digest bigint, own bigint, fp bigint, n int, bands array<bigint>"))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row", "digest")).alias("first")
    classes = durable(rows.groupBy("own").agg(first, F.first("fp").alias("fp"), F.first("n").alias("n"), F.first("bands").alias("bands")))
    links = set_links(classes.select("own", "fp", "n", "bands", "first.row", "first.digest"), texts.drop("id"), width, broadcast_rows=broadcast_rows, **params)
    labels = star_components(links).withColumnsRenamed({"node": "own"})
    kept = classes.select("own", "first").join(labels, "own", "left").groupBy(F.coalesce("component", "own").alias("component")).agg(F.min("first").alias("first"))
    kept = kept.select("first.row", "first.digest", F.lit(True).alias("stays"))
    # Rows that go, and those that stay but are there more than once; all others need no look-up.
    odd = rows.groupBy("row", "digest").agg(F.count("*").alias("k")).join(kept, ["row", "digest"], "left").where("stays is null or k > 1")
    odd = durable(odd.select(F.col("row").alias("__row"), F.col("digest").alias("__digest"), F.col("stays").isNotNull().alias("__stays")))
    counts = odd.agg(F.count("*").alias("all"), F.sum(F.col("__stays").cast("int")).alias("twice")).first()
    sized = F.broadcast if counts["all"] <= broadcast_rows else lambda df: df
    keyed = _keyed(docs, id_col, text_col)
    out = keyed.join(sized(odd), ["__row", "__digest"], "left_anti").select(*docs.columns)
    if counts["twice"]:
        again = keyed.join(sized(odd.where("__stays").drop("__stays")), ["__row", "__digest"], "left_semi")
        out = out.unionByName(again.dropDuplicates(["__row", "__digest"]).select(*docs.columns))
    return out
