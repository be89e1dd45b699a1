import duckdb
import pytest
from conftest import SF
from pyspark.sql import functions as F

from tessera.llm import decontaminate as D


def test_equals_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    columns = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    got = sorted(tuple(r) for r in D.query(spark, SF).select(*columns).collect())
    want = sorted(con.sql(f"SELECT {', '.join(columns)} FROM ({D.ORACLE_SQL})").fetchall())
    assert got == want and any(r[-1] for r in got)


ITEMS = [(1, "one two three four five six seven eight nine ten eleven"), (2, "Short item"), (3, None), (4, "..."), (5, "ONE two three four five six seven eight nine ten"), (None, "lone")]


@pytest.mark.parametrize("rows", [D.BROADCAST_ROWS, 0])
def test_windows_short_items_and_spans(spark, rows):
    items = spark.createDataFrame(ITEMS, "item_id int, text string")
    ten = "One, two-three four FIVE six seven eight nine ten"
    docs = [(1, f"x {ten} eleven y"), (2, "a short\nITEM b Short item"), (3, None), (4, ""), (5, f"{ten} zzz {ten}"), (6, "one two three four five six seven eight nine"), (7, "lone é lone"), (8, "Éshort item"), (8, "Éshort item")]
    found = D.contamination(spark.createDataFrame(docs, "doc_id int, text string"), items, broadcast_rows=rows, keep=["doc_id"]).collect()
    got = sorted((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) for r in found)
    assert got == [(1, 13, 11, 2, True), (2, 6, 4, 1, True), (3, 0, 0, 0, False), (4, 0, 0, 0, False), (5, 21, 20, 2, True), (6, 9, 0, 0, False), (7, 3, 2, 0, True), (8, 2, 0, 0, False), (8, 2, 0, 0, False)]


def test_every_window_offset_is_found(spark):
    body = " ".join(f"w{i}" for i in range(30))
    items = spark.createDataFrame([(1, body)], "item_id int, text string")
    docs = [(at * 100 + start, " ".join(["pad"] * at + [f"w{i}" for i in range(start, start + 10)] + ["end"])) for at in range(6) for start in (0, 3, 20)]
    found = D.contamination(spark.createDataFrame(docs, "doc_id int, text string"), items).collect()
    assert all(r["n_hit"] == 10 for r in found) and len(found) == len(docs)


def test_long_text_empty_tables_and_foreign_columns(spark):
    items = spark.createDataFrame(ITEMS, "item_id int, text string")
    long = "pad " * 150_000 + "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([(1, long)], "doc_id int, text string").withColumns({"rid": F.lit("r"), "n_hit": F.lit("h"), "w": F.lit(0)})
    (row,) = D.contamination(docs, items).collect()
    assert (row["n_words"], row["n_hit"], row["rid"], row["w"]) == (150_010, 10, "r", 0)
    assert D.contamination(docs.limit(0), items).collect() == []
    (row,) = D.contamination(docs, items.limit(0)).collect()
    assert (row["n_hit"], row["contaminated"]) == (0, False)


def test_removal_keeps_clean_rows(spark):
    items = spark.createDataFrame(ITEMS, "item_id int, text string")
    docs = spark.createDataFrame([(1, "a short item"), (1, "clean"), (None, "short item!"), (None, None), (2, "fine")], "doc_id int, text string")
    for rows in (D.BROADCAST_ROWS, 0):
        got = D.remove_contaminated(docs, items, broadcast_rows=rows).collect()
        assert sorted([tuple(r) for r in got], key=str) == sorted([(1, "clean"), (None, None), (2, "fine")], key=str)


def test_main_path_is_native(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plan = D.contamination(docs, spark.read.parquet(f"{SF}/benchmark.parquet"), keep=["doc_id"])._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
