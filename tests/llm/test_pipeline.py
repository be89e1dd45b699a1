import re
import shutil
import zlib

import corpus_pipeline
import pytest
from conftest import SF
from pyspark.sql import functions as F
from test_neardup import plain_groups

from tessera.llm import packing, pii, quality


def test_stages_have_effect_and_shape(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_run_equals_the_plain_version(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    good = {r["doc_id"] for r in quality.query(spark, SF).collect() if r["predicted"] == 1}
    docs = {k: v for k, v in docs.items() if k in good}
    rows = sorted(docs.items())
    docs = {rows[i][0]: rows[i][1] for i in set(plain_groups(rows))}
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = {tuple(w[i : i + 10]) for w in map(split, items) if w for i in range(max(1, len(w) - 9))}
    sizes = {len(w) for w in windows}
    leaks = lambda w: any(tuple(w[i : i + n]) in windows for n in sizes for i in range(len(w) - n + 1))
    docs = {k: v for k, v in docs.items() if not leaks(split(v))}
    docs = {k: pii.redacted(v, pii.base_spans(v)) for k, v in docs.items()}
    encode = packing._Encoder(packing.VOCABULARY)
    want = []
    for k, v in docs.items():
        ids = encode(v)
        cuts = [0, *range(len(ids) % 1024 or 1024, len(ids) + 1, 1024)]
        want += [(k, n, a, b - a, zlib.crc32(ids[a:b].tobytes())) for n, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    rows = corpus_pipeline.run(spark, SF).collect()
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == sorted(want)
    histogram = {}
    for w in want:
        histogram[w[3]] = histogram.get(w[3], 0) + 1
    assert len({r["sequence_id"] for r in rows}) == max(x.sequence + x.bins for x in packing.best_fit_decreasing(histogram))


@pytest.fixture
def folder(tmp_path):
    for t in ("labels", "benchmark"):
        shutil.copy(f"{SF}/{t}.parquet", tmp_path)
    return tmp_path


def test_odd_rows_go_through_all_stages(spark, folder):
    text = " ".join(f"Plain words of text {i}, as one reads them in any book." for i in range(40))
    odd = [(None, None), (None, ""), (1, None), (7, text), (7, text), (7, f"{text} and far more beyond it " + "so that it is another one " * 50), (None, text), (900_001, "word " * 300_000)]
    rows = spark.createDataFrame(odd, "doc_id bigint, text string").withColumns({"lang": F.lit(None).cast("string"), "source": F.lit("s"), "n_chars": F.length("text").cast("bigint")})
    own = spark.read.parquet(f"{SF}/documents.parquet")
    clash = {c: F.lit(c) for c in ("id", "row", "digest", "own", "score", "fp", "spans", "rid", "length", "key")}
    docs = own.unionByName(rows.select(*[F.col(c).cast(own.schema[c].dataType) for c in own.columns])).withColumns(clash)
    docs.write.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(folder))
        assert docs.columns == [*own.columns, *clash]
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    whole = corpus_pipeline.run(spark, str(folder))
    assert whole.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert whole.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


def test_empty_documents(spark, folder):
    spark.read.parquet(f"{SF}/documents.parquet").limit(0).write.parquet(f"{folder}/documents.parquet")
    assert corpus_pipeline.run(spark, str(folder)).collect() == []
