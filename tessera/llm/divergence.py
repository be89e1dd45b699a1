"""How the sources of a language differ in their words: exact divergences by DuckDB in shards.

Each task counts terms with DuckDB SQL over the batches of texts it reads and hands on sums, so
what is shuffled is small. The summed counts are hashed by language and term into shards of
bounded size; in each shard DuckDB turns counts into integer shares, adds up its part of the
divergence of every pair of sources that a term can tell apart, and keeps the best terms of
each source. Spark adds the parts and ranks them.

Of a pair of sources a shard only meets terms that one of them has. All other terms give a pair
the same value, that of two counts of zero; the parts hold the difference to it, and it is added
once for all terms at the end. So work follows the counts that exist, not terms times pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import durable, small_batches

MIN_DOCS = 10
TOP_TERMS = 10
SCALE = 1_000_000_000
#: Counts (a term in a source) that a shard holds on average, and distinct sums that a counting task keeps before it hands them on.
SHARD_ROWS = 60_000
TASK_ROWS = 400_000
#: Parts that the sources of a language are dealt to where they meet all others.
SALTS = 16
#: Languages whose totals may be broadcast: some 60 bytes each.
BROADCAST_LANGS = 100_000

_COUNTED = "lang string, source string, term string, n long, docs long"
_PARTS = "part string, source string, item string, value long"


def _connection():
    """A private DuckDB of one thread that never writes to disk."""
    import duckdb

    return duckdb.connect(config={"threads": 1, "memory_limit": "600MB", "temp_directory": ""})


COUNT = r"""
INSERT INTO sums SELECT lang, source, term, sum(n), count(*) FROM (
  SELECT rid, lang, source, term, count(*) AS n FROM (
    SELECT rid, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM (SELECT row_number() OVER () AS rid, lang, source, text FROM batch)) GROUP BY ALL) GROUP BY lang, source, term
"""
MERGE = "CREATE OR REPLACE TABLE sums AS SELECT lang, source, term, CAST(sum(n) AS BIGINT) AS n, CAST(sum(docs) AS BIGINT) AS docs FROM sums GROUP BY lang, source, term"
EMPTY = "CREATE OR REPLACE TABLE sums (lang VARCHAR, source VARCHAR, term VARCHAR, n BIGINT, docs BIGINT)"


def _batches(con, sql: str, schema: pa.Schema) -> list[pa.RecordBatch]:
    found = con.sql(sql).arrow()
    table = found.read_all() if hasattr(found, "read_all") else found
    return table.cast(schema).to_batches(max_chunksize=50_000)


def count_terms(batches: Iterator[pa.RecordBatch], most: int = TASK_ROWS) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each term in each source, summed over the batches.

    Sums are merged whenever the table has grown by ``most`` rows, and handed on where merging
    leaves more than half of that.
    """
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])
    con = _connection()
    con.execute(EMPTY)
    for batch in batches:
        con.register("batch", pa.Table.from_batches([batch]))
        con.execute(COUNT)
        con.unregister("batch")
        if con.sql("SELECT count(*) FROM sums").fetchall()[0][0] > most:
            con.execute(MERGE)
            if con.sql("SELECT count(*) FROM sums").fetchall()[0][0] > most // 2:
                yield from _batches(con, "SELECT * FROM sums", schema)
                con.execute(EMPTY)
    con.execute(MERGE)
    yield from _batches(con, "SELECT * FROM sums", schema)
    con.close()


#: The parts of one shard, whose rows are all of one language. Shares are exact integers.
SHARD = """
WITH sized AS (SELECT source, total, terms, 1 + {scale}::HUGEINT * 2 // (total + 2 * terms) AS p0 FROM groups),
met AS (SELECT term, source, n, 1 + {scale}::HUGEINT * (n + 2) // (total + 2 * terms) AS p FROM counts JOIN sized USING (source)),
told AS (SELECT term, 1 + {scale}::HUGEINT * (sum(n) + 2) // (any_value(total) + 2 * any_value(terms)) AS q FROM counts CROSS JOIN (SELECT max(lang_total) AS total, max(terms) AS terms FROM groups) GROUP BY term),
best AS (
  SELECT source, term AS item, CAST((p - q) * (p - q) // (p + q) AS BIGINT) AS value FROM met JOIN told USING (term) WHERE p > q
  QUALIFY row_number() OVER (PARTITION BY source ORDER BY value DESC, term) <= {top}),
together AS (
  SELECT a.term, a.source, b.source AS item, a.p, b.p AS q FROM met a JOIN met b ON a.term = b.term AND a.source < b.source),
alone AS (
  SELECT a.source, z.source AS item, a.p, z.p0 AS q FROM met a CROSS JOIN sized z ANTI JOIN met b ON b.term = a.term AND b.source = z.source),
moved AS (
  SELECT least(m.source, m.item) AS source, greatest(m.source, m.item) AS item, sum((p - q) * (p - q) // (p + q) - (a.p0 - b.p0) * (a.p0 - b.p0) // (a.p0 + b.p0)) AS value
  FROM (SELECT source, item, p, q FROM together UNION ALL SELECT * FROM alone) m JOIN sized a ON a.source = m.source JOIN sized b ON b.source = m.item GROUP BY 1, 2)
SELECT 'term' AS part, source, item, value FROM best UNION ALL SELECT 'pair', source, item, CAST(value AS BIGINT) FROM moved
"""


def _shard_parts(top: int):
    def parts(key, counts: pa.Table, groups: pa.Table) -> pa.Table:
        schema = pa.schema([("part", pa.string()), ("source", pa.string()), ("item", pa.string()), ("value", pa.int64())])
        con = _connection()
        con.register("counts", counts.select(["term", "source", "n"]))
        con.register("groups", groups.select(["source", "total", "terms", "lang_total"]))
        out = pa.Table.from_batches(_batches(con, SHARD.format(scale=SCALE, top=top), schema), schema)
        con.close()
        return out.append_column("lang", pa.array([key[0].as_py()] * out.num_rows, pa.string()))

    return parts


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP_TERMS, shard_rows: int = SHARD_ROWS, task_rows: int = TASK_ROWS, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """``(lang, source, part, item, value, rank)``: how each source of a language differs from the others.

    Null languages, sources and texts are empty strings. Part ``pair`` has every other source
    of the language, part ``term`` the ``top`` terms that the source has more often than its
    language. A language keeps the terms of at least ``min_docs`` documents; where it keeps none
    its pairs have value 0. Ties are broken by the item's UTF-8 bytes. Repeated rows count as
    documents of their own. A language of one source has no pairs; an empty table gives an empty
    result. Other columns don't matter.
    """
    small_batches(docs.sparkSession)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(text(lang_col).alias("lang"), text(source_col).alias("source"), text(text_col).alias("text"))
    counted = rows.mapInArrow(lambda batches: count_terms(batches, task_rows), _COUNTED).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))

    # Terms that a language keeps: its counts are dealt by term, so no language is one task.
    of_term = Window.partitionBy("lang", "term")
    kept = durable(counted.withColumn("all_docs", F.sum("docs").over(of_term)).where(F.col("all_docs") >= min_docs).select("lang", "source", "term", "n"))
    terms = kept.select("lang", "term").distinct().groupBy("lang").agg(F.count("*").alias("terms"))
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("rows"))
    langs = sums.groupBy("lang").agg(F.sum("total").alias("lang_total"), F.sum("rows").alias("lang_rows")).join(terms, "lang")
    langs = durable(langs.withColumn("shards", F.ceil(F.col("lang_rows") / shard_rows).cast("int")))
    few = F.broadcast if langs.count() <= BROADCAST_LANGS else lambda df: df

    groups = docs.select(text(lang_col).alias("lang"), text(source_col).alias("source")).distinct()
    groups = groups.join(sums.drop("rows"), ["lang", "source"], "left").join(few(langs), "lang", "left").fillna(0, ["total", "terms", "lang_total", "shards"])
    groups = durable(groups.select("lang", "source", "total", "terms", "lang_total", "shards"))

    dealt = kept.join(few(langs.select("lang", "shards")), "lang").withColumn("shard", F.pmod(F.hash("term"), "shards"))
    copies = groups.where("shards > 0").withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
    parts = dealt.groupBy("lang", "shard").cogroup(copies.groupBy("lang", "shard")).applyInArrow(_shard_parts(top), f"{_PARTS}, lang string")
    parts = durable(parts.groupBy("lang", "part", "source", "item").agg(F.sum("value").alias("value")))

    # Every pair of a language's sources: what all terms give them without counts, and what the shards add.
    p0 = F.when(F.col("terms") > 0, F.expr(f"1 + 2L * {SCALE} div (total + 2 * terms)"))
    a = groups.select("lang", "source", p0.alias("p"), "terms", F.pmod(F.hash("source"), F.lit(SALTS)).alias("salt"))
    b = groups.select("lang", F.col("source").alias("item"), p0.alias("q"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    moved = parts.where("part = 'pair'").select("lang", F.explode(F.array(F.struct("source", "item", "value"), F.struct(F.col("item").alias("source"), F.col("source").alias("item"), "value"))).alias("x")).select("lang", "x.*")
    pairs = a.join(b, ["lang", "salt"]).where("source <> item").join(moved, ["lang", "source", "item"], "left")
    flat = F.coalesce(F.expr("terms * ((p - q) * (p - q) div (p + q))"), F.lit(0))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", (flat + F.coalesce("value", F.lit(0))).alias("value"))
    by_rank = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    best = parts.where("part = 'term'").select("lang", "source", "part", "item", "value").withColumn("rank", F.row_number().over(by_rank)).where(F.col("rank") <= top)
    return pairs.withColumn("rank", F.row_number().over(by_rank)).unionByName(best)


def query(spark, sf_dir: str) -> DataFrame:
    """Divergences of all sources of all documents."""
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
tokens AS (
  SELECT rid, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS n FROM tokens GROUP BY 1, 2 HAVING count(DISTINCT rid) >= 10),
size AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY 1),
grp AS (SELECT DISTINCT lang, source FROM docs),
counted AS (SELECT lang, source, term, count(*) AS n FROM tokens JOIN kept USING (lang, term) GROUP BY 1, 2, 3),
total AS (SELECT lang, source, sum(n) AS total FROM counted GROUP BY 1, 2),
given AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, CAST(1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 2) // (coalesce(t.total, 0) + 2 * s.v) AS BIGINT) AS p,
    CAST(1 + 1000000000::HUGEINT * (k.n + 2) // (s.total + 2 * s.v) AS BIGINT) AS q
  FROM grp g JOIN kept k ON k.lang = g.lang JOIN size s ON s.lang = g.lang LEFT JOIN total t ON t.lang = g.lang AND t.source = g.source
    LEFT JOIN counted c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
sums AS (
  SELECT a.lang, a.source, b.source AS item, CAST(sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS BIGINT) AS value
  FROM given a JOIN given b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
  FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // (p + q) AS value FROM given WHERE n > 0 AND p > q),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""
