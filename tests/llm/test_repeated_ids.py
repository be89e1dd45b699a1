from tessera.llm import simhash


def test_repeated_and_null_ids(spark):
    one, two, three = (" ".join(f"{w}{i}" for i in range(30)) for w in "abc")
    rows = [(7, one, 1), (7, two, 2), (3, one, 3), (None, three, 4), (None, three, 5), (None, two, 6), (7, two, 7)]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string, n int")).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in kept), key=str) == sorted([(3, one), (7, two), (None, three)], key=str)
