"""Language of web pages by Bayesian fusion of text, markup, address and host.

The text gives a log likelihood for each language, from character trigrams learnt on a bounded
sample of labelled documents; it is tempered, since neighbouring trigrams are not independent.
What markup declares and the suffix of the address give likelihoods estimated over all pages by
grouped aggregation of the text posteriors. The prior of a host is the smoothed mix of its own
pages with those of its registered domain, which is smoothed to the whole corpus. Each piece of
evidence counts once: the suffix is no level of the prior, and a page's own posterior is left
out of every sum that judges it. Sums have a row for each key and language while they are made,
so the number of languages is not bounded.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.html import main_text
from tessera.llm.urls import host_and_path
from tessera.session import durable, small_batches

#: Labelled documents that the text model learns from: those first by the hash of their id.
SAMPLE_ROWS = 6_000
BUCKETS = 1 << 15
#: Nats of text evidence per trigram that count, and at most in all.
TEMPER = 0.2
MOST_NATS = 12.0
#: Pages of its parent that a host and a domain are smoothed with.
SMOOTHING = 5.0
#: Sums (keys times languages) that may be broadcast: some 100 MB.
BROADCAST_SUMS = 4_000_000

_HTML_LANG = re.compile(r"<html\b[^>]*?\slang\s*=\s*[\"']?([A-Za-z]{2,3})", re.I)


def _grams(text: str) -> np.ndarray:
    codes = np.frombuffer(f" {text} ".lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    return ((codes[:-2] * 961 + codes[1:-1] * 31 + codes[2:]) * np.uint64(2654435761) >> np.uint64(7)) % BUCKETS


class TextModel:
    """Trigram log probabilities of each language, from ``(language, bucket, count)`` rows."""

    def __init__(self, counts: list[tuple[str, int, int]]) -> None:
        self.langs = sorted({lang for lang, _, _ in counts})
        table = np.full((len(self.langs), BUCKETS), 0.5)
        row = {lang: i for i, lang in enumerate(self.langs)}
        for lang, bucket, n in counts:
            table[row[lang], bucket] += n
        self.logs = np.log(table / table.sum(axis=1, keepdims=True)).astype(np.float32)

    def likelihoods(self, text: str) -> list[float]:
        """Tempered log likelihoods, at most 0 and at least -MOST_NATS; all 0 for no text."""
        if not text or not self.langs:
            return [0.0] * len(self.langs)
        counts = np.bincount(_grams(text).astype(np.int64), minlength=BUCKETS)
        at = np.flatnonzero(counts)
        total = (self.logs[:, at].astype(float) * counts[at]).sum(axis=1) * TEMPER
        return np.maximum(total - total.max(), -MOST_NATS).tolist()


def text_model(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> TextModel:
    """A text model from the documents with a language, ``sample_rows`` of them by the hash of their id.

    Whole texts are counted on the executors; the driver gets one count for each language and bucket.
    """
    known = docs.where("lang is not null and text is not null and text <> ''").select("lang", "text", F.xxhash64("doc_id", "lang").alias("h"))
    upto = known.select("h").orderBy("h").limit(sample_rows).agg(F.max("h")).first()[0]
    if upto is None:
        return TextModel([])
    some = known.where(F.col("h") <= upto)

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in ((a.as_py(), b.as_py()) for a, b in zip(*batch.columns, strict=True)):
                counts = np.bincount(_grams(text).astype(np.int64), minlength=BUCKETS)
                table[lang] = table[lang] + counts if lang in table else counts
        for lang, counts in table.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(counts[at].astype(np.int64))], ["lang", "bucket", "n"])

    small_batches(docs.sparkSession)
    counted = some.select("lang", "text").mapInArrow(per_batch, "lang string, bucket int, n bigint")
    return TextModel([tuple(r) for r in counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).collect()])


def evidence(pages: DataFrame, model: TextModel, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Host, domain, suffix, declared language and text log likelihoods for each page."""
    context = pages.sparkSession.sparkContext
    small_batches(pages.sparkSession)
    shared = context.broadcast(model)  # 128 KB for each language of the bounded sample

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            declared, text = [], []
            for page in (x.as_py() for x in batch.column(3)):
                m = _HTML_LANG.search(page) if page else None
                declared.append(m[1].lower() if m else None)
                text.append(shared.value.likelihoods(main_text(page)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(declared, pa.string()), pa.array(text, pa.list_(pa.float64()))], ["id", "url", "host", "declared", "text_log"])

    host, _ = host_and_path(F.col(url_col).cast("string"))
    id_type = pages.schema["__id"].dataType.simpleString()
    rows = pages.select(F.col("__id").alias("id"), F.col(url_col).cast("string").alias("url"), host.alias("host"), F.col(html_col).cast("string").alias("html"))
    seen = rows.mapInArrow(per_batch, f"id {id_type}, url string, host string, declared string, text_log array<double>")
    parts = F.split(F.regexp_replace("host", r":[0-9]*$", ""), r"\.")
    return seen.select("*", F.element_at(parts, -1).alias("suffix"), F.array_join(F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), 2), ".").alias("domain"))


def _normal(logs: Column) -> Column:
    """Probabilities in proportion to the exponentials of an array of logarithms."""
    weights = F.transform(logs, lambda x: F.exp(x - F.array_max(logs)))
    return F.transform(weights, lambda w: w / F.aggregate(weights, F.lit(0.0), lambda a, x: a + x))


def _sums(soft: DataFrame, name: str, *keys: str) -> DataFrame:
    """For each key an array ``name`` with the sum of the text posteriors of each language, and their total."""
    long = soft.select(*keys, F.posexplode("soft").alias("at", "p")).groupBy(*keys, "at").agg(F.sum("p").alias("p"))
    listed = long.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("at", "p"))).alias("s"))  # as many as languages
    return listed.select(*keys, F.transform("s", lambda x: x["p"]).alias(name), F.aggregate("s", F.lit(0.0), lambda a, x: a + x["p"]).alias(f"{name}_all"))


def identify(pages: DataFrame, docs: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", smoothing: float = SMOOTHING, **params) -> DataFrame:
    """``(id, url, host, declared, lang, confidence, text_lang)`` for every row of ``pages``.

    ``lang`` is the language of the largest posterior, of equal ones the first by name. A page
    without text is judged by the other evidence; null urls share the empty host. Without any
    labelled document ``lang`` and ``confidence`` are null. Repeated rows count as pages of their own.
    """
    model = text_model(docs, **params)
    rows = durable(evidence(pages.withColumn("__id", F.col(id_col)), model, url_col, html_col))
    if not model.langs:
        none = F.lit(None).cast("string")
        return rows.select("id", "url", "host", "declared", none.alias("lang"), F.lit(None).cast("double").alias("confidence"), none.alias("text_lang"))
    soft = rows.withColumn("soft", _normal(F.col("text_log")))

    def sized(df: DataFrame) -> DataFrame:
        df = durable(df)
        return F.broadcast(df) if df.count() * len(model.langs) <= BROADCAST_SUMS else df

    def every(of: DataFrame, name: str) -> list[Column]:
        """The sums over all rows as constants: one number for each language on the driver."""
        row = _sums(of.withColumn("one", F.lit(1)), "sums", "one").first()
        found = row["sums"] if row else [0.0] * len(model.langs)
        return [F.array(*map(F.lit, found)).alias(name), F.lit(sum(found)).alias(f"{name}_all")]

    def values(name: str, key: str) -> DataFrame:
        """Sums for each value, with those of all values and the number of values."""
        known = soft.where(F.col(key).isNotNull())
        own = durable(_sums(known, name, key))
        return sized(own.select("*", every(known, f"{name}_sum")[0], F.lit(float(max(own.count(), 2))).alias(f"{name}_n")))

    met = soft.select("*", *every(soft, "whole")).join(sized(_sums(soft, "in_domain", "domain")), "domain", "left").join(sized(_sums(soft, "in_host", "host")), "host", "left")
    met = met.join(values("as_declared", "declared"), "declared", "left").join(values("in_suffix", "suffix"), "suffix", "left")

    # Every sum without the page itself; the page is a row of mass one in each of its groups.
    k = F.lit(float(len(model.langs)))
    at = lambda column, i: F.get(F.col(column), i)
    less = lambda column, i: F.greatest(at(column, i) - at("soft", i), F.lit(0.0))

    def fused(i: Column) -> Column:
        prior = (less("whole", i) + 1) / (F.col("whole_all") - 1 + k)
        for level in ("in_domain", "in_host"):
            prior = (less(level, i) + smoothing * prior) / (F.greatest(F.col(f"{level}_all") - 1, F.lit(0.0)) + smoothing)
        logs = at("text_log", i) + F.log(prior)
        for name in ("as_declared", "in_suffix"):
            given = F.log((less(name, i) + 0.5) / (less(f"{name}_sum", i) + 0.5 * F.col(f"{name}_n")))
            logs = logs + F.coalesce(given, F.lit(0.0))
        return logs

    ranked = met.withColumn("logs", F.transform(F.sequence(F.lit(0), F.lit(len(model.langs) - 1)), fused)).withColumn("posterior", _normal(F.col("logs")))
    names = F.array(*[F.lit(x) for x in model.langs])
    pick = lambda column: F.element_at(names, F.array_position(column, F.array_max(column)).cast("int"))
    return ranked.select("id", "url", "host", "declared", pick(F.col("posterior")).alias("lang"), F.array_max("posterior").alias("confidence"), F.when(F.array_min("text_log") < 0, pick(F.col("text_log"))).alias("text_lang"))


def query(spark, sf_dir: str) -> DataFrame:
    """Languages of all pages."""
    found = identify(spark.read.parquet(f"{sf_dir}/pages.parquet"), spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.withColumnRenamed("id", "page_id")
