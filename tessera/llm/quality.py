"""Quality of texts by a sparse ensemble of rules, compiled into Spark column expressions.

Statistics of whole texts are taken in one pass. Shallow boosted trees are grown on a bounded,
hash-ordered sample of labelled rows; every path from a root to a node becomes a conjunction of
comparisons, and an L1-penalised logistic regression keeps the few that carry weight. The
result is a score column over the statistics that runs as generated JVM code.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.session import durable, small_batches

#: The classifier learns from so many labelled rows at most, those first by the hash of their id.
SAMPLE_ROWS = 20_000
TREES = 40
DEPTH = 3
BINS = 48
SHRINKAGE = 0.2
LASSO = 0.002
THRESHOLD = 0.7

STATISTICS = (
    "log_chars", "log_words", "word_chars", "upper_share", "digit_share", "space_share", "stop_share", "symbol_share", "pipe_share", "shout_share",
    "high_share", "symbol_words", "plain_words", "distinct_words", "top_word", "repeated_trigrams", "repeated_lines", "line_words", "short_lines", "line_ends",
)

_CLASS = np.zeros((256, 8), np.float64)
for _b in range(256):
    _c = chr(_b)
    _CLASS[_b] = [65 <= _b <= 90, 97 <= _b <= 122, 48 <= _b <= 57, _b in (32, 9, 10, 11, 12, 13), _c in ".,;:?'\"()-", _c in "#$%&*+/<=>@[\\]^_`{}~", _c == "|", _c == "!"]


def statistics(text: str | None) -> list[float]:
    """The statistics of one whole text; those of null and blank texts are all zero."""
    text = text or ""
    words = text.split()
    if not words:
        return [0.0] * len(STATISTICS)
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    upper, lower, digit, space, stop, symbol, pipe, shout = np.bincount(raw, minlength=256) @ _CLASS
    n, chars = len(words), len(raw)
    high = chars - (upper + lower + digit + space + stop + symbol + pipe + shout)
    distinct: dict[str, int] = {}
    for w in words:
        distinct[w] = distinct.get(w, 0) + 1
    plain = sum(k for w, k in distinct.items() if w.strip(".,;:?'\"()-").isalpha())
    marked = sum(k for w, k in distinct.items() if not w[-1].isalnum() and w[-1] not in ".,;:?'\")-")
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    per_line = [x.count(" ") + 1 for x in lines]
    trigrams = max(1, n - 2)
    return [
        np.log1p(chars), np.log1p(n), (chars - space) / n, upper / max(1.0, upper + lower), digit / chars, space / chars, stop / chars, symbol / chars, pipe / chars, shout / chars,
        high / chars, marked / n, plain / n, len(distinct) / n, max(distinct.values()) / n, 1 - len(set(zip(words, words[1:], words[2:], strict=False))) / trigrams if n > 2 else 0.0,
        1 - len(set(lines)) / len(lines), np.log1p(n / len(lines)), sum(k < 6 for k in per_line) / len(lines), sum(x.rstrip()[-1] in ".!?" for x in lines) / len(lines),
    ]


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, digest`` and one double column for each statistic, one row per row of ``docs``."""

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([statistics(t.as_py()) for t in batch.column(2)], np.float64).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(np.ascontiguousarray(values[:, i])) for i in range(len(STATISTICS)))], ["id", "digest", *STATISTICS])

    small_batches(docs.sparkSession)
    text = F.col(text_col).cast("string")
    schema = f"id {docs.schema[id_col].dataType.simpleString()}, digest bigint, " + ", ".join(f"{s} double" for s in STATISTICS)
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("digest"), text.alias("text")).mapInArrow(per_batch, schema)


class Condition(NamedTuple):
    """``statistic <= cut`` if ``below``, else ``statistic > cut``."""

    statistic: int
    below: bool
    cut: float


Rule = frozenset  # of Condition


class Model(NamedTuple):
    """Weighted rules; the score is the logistic of the bias and the weights of all rules that hold."""

    bias: float
    rules: list[tuple[Rule, float]]

    def score(self) -> Column:
        total = F.lit(float(self.bias))
        for rule, weight in self.rules:
            holds = F.lit(True)
            for c in sorted(rule):
                holds &= F.col(STATISTICS[c.statistic]) <= F.lit(c.cut) if c.below else F.col(STATISTICS[c.statistic]) > F.lit(c.cut)
            total += F.when(holds, F.lit(float(weight))).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def _holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for c in rule:
        out &= (x[:, c.statistic] <= c.cut) == c.below
    return out


def _grow(x: np.ndarray, cuts: list[np.ndarray], grad: np.ndarray, hess: np.ndarray, depth: int, least: int, paths: list[Rule], path: Rule = frozenset()) -> list[tuple[Rule, float]]:
    """Leaves of one tree fitted to the gradients; the paths of all its nodes go to ``paths``."""
    value = grad.sum() / (hess.sum() + 1.0)
    best = (1e-6, 0, 0.0)
    if depth and len(x) >= 2 * least:
        whole = grad.sum() ** 2 / (hess.sum() + 1.0)
        for j, edges in enumerate(cuts):
            if not len(edges):
                continue
            at = np.searchsorted(edges, x[:, j], "left")
            g, h, n = (np.cumsum(np.bincount(at, weights=w, minlength=len(edges) + 1))[:-1] for w in (grad, hess, np.ones(len(x))))
            gain = g**2 / (h + 1) + (grad.sum() - g) ** 2 / (hess.sum() - h + 1) - whole
            gain[(n < least) | (len(x) - n < least)] = 0
            if gain.max() > best[0]:
                best = (gain.max(), j, edges[gain.argmax()])
    if best[0] <= 1e-6 or not depth or len(x) < 2 * least:
        return [(path, value)]
    _, j, cut = best
    left = x[:, j] <= cut
    leaves = []
    for side, mask in ((True, left), (False, ~left)):
        below = path | {Condition(j, side, float(cut))}
        paths.append(below)
        leaves += _grow(x[mask], cuts, grad[mask], hess[mask], depth - 1, least, paths, below)
    return leaves


def _lasso_logistic(z: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[np.ndarray, float]:
    """Weights and bias of an L1-penalised logistic regression, by accelerated proximal gradients."""
    n, k = z.shape
    scale = np.linalg.norm(np.c_[z, np.ones(n)], 2) ** 2 / (4 * n) + 1e-9
    w, b = np.zeros(k), float(np.log((y.mean() + 1e-9) / (1 - y.mean() + 1e-9)))
    v, c, t = w.copy(), b, 1.0
    for _ in range(steps):
        r = 1 / (1 + np.exp(-(z @ v + c))) - y
        step_w, step_b = v - z.T @ r / n / scale, c - r.mean() / scale
        new_w = np.sign(step_w) * np.maximum(np.abs(step_w) - penalty / scale, 0)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = new_w + (t - 1) / t2 * (new_w - w), step_b + (t - 1) / t2 * (step_b - b)
        w, b, t = new_w, step_b, t2
    return w, b


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, penalty: float = LASSO, seed: int = 7) -> Model:
    """Rules and weights for statistics ``x`` and labels ``y``.

    With labels of one class only, or none, the score is the smoothed share of label 1.
    """
    prior = (y.sum() + 1) / (len(y) + 2)
    if len(set(y.tolist())) < 2:
        return Model(float(np.log(prior / (1 - prior))), [])
    order = np.lexsort((*x.T, y))  # the result must not hang on the order of the rows
    x, y = x[order], y[order].astype(float)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for j in range(x.shape[1])]
    cuts = [c[c < x[:, j].max()] for j, c in enumerate(cuts)]
    rng, paths = np.random.default_rng(seed), []
    raw, least = np.full(len(y), np.log(prior / (1 - prior))), max(5, len(y) // 500)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        some = rng.random(len(y)) < 0.7
        for rule, value in _grow(x[some], cuts, (y - p)[some], (p * (1 - p))[some], depth, least, paths):
            raw[_holds(rule, x)] += SHRINKAGE * value
    rules, seen = [], set()
    for rule in dict.fromkeys(paths):
        column = _holds(rule, x)
        if least <= column.sum() <= len(y) - least and (mark := column.tobytes()) not in seen:
            seen.add(mark)
            rules.append((rule, column))
    if not rules:
        return Model(float(np.log(prior / (1 - prior))), [])
    z = np.stack([c for _, c in rules], axis=1).astype(float)
    spread = z.std(axis=0) + 1e-9
    w, b = _lasso_logistic((z - z.mean(axis=0)) / spread, y, penalty)
    kept = np.flatnonzero(np.abs(w) > 1e-6)
    return Model(float(b - (w * z.mean(axis=0) / spread).sum()), [(rules[k][0], float(w[k] / spread[k])) for k in kept])


def held_out(id_col: str) -> Column:
    """Rows that no classifier may learn from; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sampled(labels: DataFrame, target: str = "quality", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``(doc_id, y)``: the ids to learn from, at most ``sample_rows`` in the order of their hash.

    Held-out ids, null ids, labels other than 0 and 1 and ids with both labels are not learnt from.
    """
    usable = labels.where(F.col(target).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
    agreed = usable.groupBy("doc_id").agg(F.min(F.col(target).cast("int")).alias("y"), F.max(F.col(target).cast("int")).alias("other")).where("y = other")
    return agreed.select("doc_id", "y").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)


def learn(features: DataFrame, sample: DataFrame, **params) -> Model:
    """A model from the rows of ``features`` (as ``measured`` gives them) whose id is in ``sample``.

    Of rows with one id, that of the least text hash is learnt from.
    """
    rows = features.join(F.broadcast(sample), features["id"] == sample["doc_id"])
    each = rows.groupBy("doc_id").agg(F.min_by(F.struct("y", *STATISTICS), F.struct("digest", *STATISTICS)).alias("x")).select("x.*")
    table = each.toPandas()  # at most as many rows as the sample
    return fit(table[list(STATISTICS)].to_numpy(float), table["y"].to_numpy(int), **params)


def scored(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample_rows: int = SAMPLE_ROWS, **params) -> DataFrame:
    """``(id, digest, held_out, score, predicted)`` for every row of ``docs``.

    Null and empty texts are scored by their all-zero statistics. Null ids are not held out and
    never learnt from. Repeated rows get equal scores. An empty table gives an empty result.
    """
    features = durable(measured(docs))
    model = learn(features, sampled(labels, sample_rows=sample_rows), **params)
    return features.select("id", "digest", held_out("id").alias("held_out"), model.score().alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def query(spark, sf_dir: str) -> DataFrame:
    """Quality scores of all documents."""
    found = scored(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return found.select(F.col("id").alias("doc_id"), "held_out", "score", "predicted")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample_rows: int = SAMPLE_ROWS, **params) -> DataFrame:
    """``docs`` without the rows that the classifier rejects.

    The model is learnt from the same sample as in ``scored``, and the rows are then measured and
    judged in one pass that carries them along, so no text is shuffled.
    """
    sample = durable(sampled(labels, sample_rows=sample_rows))
    model = learn(measured(docs.join(F.broadcast(sample), "doc_id", "left_semi")), sample, **params)
    columns = docs.columns
    at = columns.index("text")
    plain = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)])
    names = [*plain.columns, *STATISTICS]

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([statistics(t.as_py()) for t in batch.column(at)], np.float64).reshape(-1, len(STATISTICS))
            added = [pa.array(np.ascontiguousarray(values[:, i])) for i in range(len(STATISTICS))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names)

    schema = ", ".join([*(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(docs.schema)), *(f"{s} double" for s in STATISTICS)])
    judged = plain.mapInArrow(per_batch, schema).where(model.score() >= threshold)
    return judged.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(columns)])
