"""Benchmark decontamination with the word windows of the test items, in DataFrame functions only.

The window set of the items is broadcast when its counted size allows it, and joined by
shuffle beyond that. Documents are scanned once. Looking up a window at every word would make
a key for every word of the corpus; instead a shorter gram is looked up at every ``stride``-th
word. A window of W words that starts anywhere holds a whole gram of W - stride + 1 words that
starts at a multiple of the stride, so no occurrence is missed. Only where such a gram hits
are the windows around it built in full and compared word by word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.session import durable

WINDOW = 10
#: Grams of windows and ids of their items that may be broadcast: at 100 bytes each some 200 MB at most.
BROADCAST_ROWS = 2_000_000

#: Runs of ASCII digits, ASCII letters and all characters beyond ASCII, before lower-casing.
WORD = r"([^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]++)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text.cast("string"), F.lit("")), F.lit(WORD), 1)


def _stride(length: int) -> int:
    """Distance of look-ups for windows of ``length`` words; grams then have length - stride + 1."""
    return max(1, length // 2)


def _gram_key(length: Column, words: Column) -> Column:
    """Key of a gram; full lower-casing only makes more texts equal, and hits are verified."""
    return F.xxhash64(length, F.lower(F.array_join(words, " ")))


def item_windows(items: DataFrame, window: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``(len, body, items)``: every distinct window with the ids of the items it stands in.

    An item of fewer words, but not none, is one window. The ids are strings; a null id adds none.
    """
    lowered = F.translate(F.col(text_col).cast("string"), _UPPER, _LOWER)
    words = items.select(F.col(id_col).cast("string").alias("item"), _words(lowered).alias("w")).where("size(w) > 0")
    size = F.least(F.size("w"), F.lit(window))
    starts = words.select("item", "w", size.alias("len"), F.explode(F.sequence(F.lit(1), F.size("w") - size + 1)).alias("p"))
    bodies = starts.select("item", "len", F.array_join(F.slice("w", F.col("p"), F.col("len")), " ").alias("body"))
    return bodies.groupBy("len", "body").agg(F.collect_set("item").alias("items"))


def _item_grams(windows: DataFrame, lengths: list[int]) -> DataFrame:
    """Distinct keys of all grams inside the windows."""
    stride = F.element_at(F.create_map(*[F.lit(x) for n in lengths for x in (n, _stride(n))]), F.col("len"))
    parts = windows.select("len", F.split("body", " ").alias("w"), stride.alias("s")).select("len", "w", "s", F.explode(F.sequence(F.lit(1), F.col("s"))).alias("at"))
    return parts.select(_gram_key(F.col("len"), F.slice("w", F.col("at"), F.col("len") - F.col("s") + 1)).alias("key")).distinct()


def _place(length: int):
    return lambda at: F.struct(F.lit(length).alias("len"), at.alias("at"))


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", keep: list[str] | None = None, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Columns ``keep`` of ``docs`` (all if None) with ``n_words, n_hit, n_items, items_sha256, contaminated``.

    Every row stays. A word is hit if it lies in any occurrence of a window. Null and word-less texts have no
    words and no hits; an empty benchmark hits nothing. Repeated rows are judged one by one.
    The columns added replace input columns of the same names.
    """
    windows = durable(item_windows(items, window, item_id, item_text))
    counts = windows.groupBy("len").agg(F.count("*").alias("n"), F.sum(F.size("items")).alias("ids")).collect()  # at most ``window`` rows
    lengths = sorted(r["len"] for r in counts)
    small = sum(r["n"] * window + r["ids"] for r in counts) <= broadcast_rows
    sized = F.broadcast if small else lambda df: df

    added = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    kept = [c for c in keep or docs.columns if c not in added]
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.struct(*kept).alias("row"), _words(F.col(text_col)).alias("w"))

    # A marker at 0 keeps each document; the rest are the look-ups for each window length.
    pair = "struct<len:int,at:int>"
    places = [F.array(F.struct(F.lit(0).alias("len"), F.lit(0).alias("at"))).cast(f"array<{pair}>")]
    for n in lengths:
        last = F.size("w") - (n - _stride(n))
        steps = F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1)), F.lit(_stride(n))), _place(n))
        places.append(F.when(last >= 1, steps).otherwise(F.array().cast(f"array<{pair}>")))
    looked = rows.select("rid", "row", "w", F.explode(F.concat(*places)).alias("x")).select("rid", "row", "w", "x.len", "x.at")

    if lengths:
        stride = F.element_at(F.create_map(*[F.lit(x) for n in lengths for x in (n, _stride(n))]), F.col("len"))
        first = F.greatest(F.col("at") - stride + 1, F.lit(1))
        gram = F.slice("w", F.col("at"), F.col("len") - stride + 1)
        marker = F.col("at") == 0
        around = [
            "rid",
            F.when(marker, F.col("row")).alias("row"),
            F.when(marker, F.size("w")).alias("n_words"),
            "len",
            F.when(marker, F.lit(0)).otherwise(first).alias("first"),
            F.when(~marker, F.slice("w", first, F.col("at") - first + F.col("len"))).alias("near"),
        ]
        key = F.when(~marker, _gram_key(F.col("len"), gram)).alias("key")
        grams = _item_grams(windows, lengths).withColumn("known", F.lit(True))
        before = looked.select("*", key) if small else looked.select(*around, key)
        met = before.join(sized(grams), "key", "left").where("len = 0 or known")
        near = met.select(*around) if small else met.drop("key", "known")
        shifts = F.expr("if(len = 0, array(0), if(size(near) >= len, sequence(1, size(near) - len + 1), array()))")
        tried = near.select("rid", "row", "n_words", "len", "first", "near", F.explode(shifts).alias("q"))
        body = F.when(F.col("q") > 0, F.translate(F.array_join(F.slice("near", F.col("q"), F.col("len")), " "), _UPPER, _LOWER))
        tried = tried.select("rid", "row", "n_words", "len", (F.col("first") + F.col("q") - 1).alias("p"), body.alias("body"))
        found = tried.join(sized(windows), ["len", "body"], "left").where("len = 0 or items is not null")
    else:
        found = looked.select("rid", "row", F.size("w").alias("n_words"), "len", F.lit(0).alias("p"), F.lit(None).cast("array<string>").alias("items"))

    per_doc = found.groupBy("rid").agg(
        F.any_value("row", ignoreNulls=True).alias("row"),
        F.max("n_words").alias("n_words"),
        F.collect_set(F.when(F.col("len") > 0, F.struct("p", "len"))).alias("spans"),
        F.flatten(F.collect_set("items")).alias("ids"),
    )
    covered = F.expr(
        "aggregate(array_sort(spans), named_struct('upto', 0, 'n', 0L), "
        "(a, s) -> named_struct('upto', greatest(a.upto, s.p + s.len - 1), 'n', a.n + greatest(0, s.p + s.len - 1 - greatest(s.p - 1, a.upto))), a -> a.n)"
    )
    ids = F.array_sort(F.array_distinct("ids"))
    return per_doc.select(
        *[F.col("row").getField(c).alias(c) for c in kept],
        F.col("n_words").cast("long").alias("n_words"),
        covered.alias("n_hit"),
        F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    """Contamination of all documents by all benchmark items."""
    return contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=["doc_id"])


def remove_contaminated(docs: DataFrame, items: DataFrame, broadcast_rows: int = BROADCAST_ROWS, **params) -> DataFrame:
    """``docs`` without the documents that hold an occurrence of a window.

    A document is known by its id and its text's hash together, so a clean row that shares the
    id of a contaminated one stays; a null id or text compares as equal to null.
    """
    slim = docs.select(F.col("doc_id").alias("id"), "text", F.xxhash64("text").alias("digest"))
    found = contamination(slim, items, keep=["id", "digest"], broadcast_rows=broadcast_rows, **params)
    bad = durable(found.where("contaminated").select("id", "digest").distinct())
    if bad.count() * 10 <= broadcast_rows:
        bad = F.broadcast(bad)
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["id"]) & (F.xxhash64(docs["text"]) == bad["digest"]), "left_anti")


ORACLE_SQL = r"""
WITH item_words AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL),
item_starts AS (
  SELECT item_id, w, least(len(w), 10) AS k, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS p FROM item_words WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, k, array_to_string(w[p:p + k - 1], ' ') AS body FROM item_starts),
doc_words AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
doc_starts AS (
  SELECT rid, k, w, unnest(range(1, len(w) - k + 2)) AS p FROM doc_words, (SELECT DISTINCT k FROM windows) WHERE len(w) >= k),
doc_windows AS (SELECT rid, k, p, array_to_string(w[p:p + k - 1], ' ') AS body FROM doc_starts),
found AS (SELECT rid, p, k, item_id FROM doc_windows JOIN windows USING (k, body)),
places AS (SELECT DISTINCT rid, unnest(range(p, p + k)) AS q FROM found),
hit AS (SELECT rid, count(*) AS n FROM places GROUP BY rid),
met AS (
  SELECT rid, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(hit.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(met.n, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM doc_words LEFT JOIN hit USING (rid) LEFT JOIN met USING (rid)
"""
