"""Scans, sinks and caches over the test tables."""

from __future__ import annotations

import struct
import uuid

import pandas as pd
from pyspark.sql import functions as F

from tessera.operators import linkage as L
from tessera.plans.base import query
from tessera.plans.graph import TAU, _EEAT
from tessera.session import checkpoint_folder
from tessera.sources import readers as R
from tessera.sources import sinks as K


def _path(c, *names: str) -> list[str]:
    return [f"{c.dir}/{n}.parquet" for n in names]


def _folder(c) -> str:
    return f"{checkpoint_folder(c.spark)}/{uuid.uuid4().hex}"


query("s01_scan", lambda c: R.parquet(c.spark, *_path(c, "lineitem")).groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("q")), "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS q FROM lineitem GROUP BY 1, 2", raw=True)
query("s02_file_list", lambda c: R.parquet(c.spark, *_path(c, "nation", "nation")).groupBy("n_regionkey").agg(F.count("*").alias("n")), "SELECT n_regionkey, count(*) AS n FROM (SELECT * FROM nation UNION ALL SELECT * FROM nation) GROUP BY 1", raw=True)
query("s03_union_by_name", lambda c: R.parquet(c.spark, *_path(c, "nation", "region"), merge=True).select("n_nationkey", "n_name", "r_regionkey", "r_name"), "SELECT n_nationkey, n_name, NULL::INTEGER AS r_regionkey, NULL AS r_name FROM nation UNION ALL SELECT NULL, NULL, r_regionkey, r_name FROM region", raw=True)
query("s04_columns", lambda c: R.parquet(c.spark, *_path(c, "orders"), columns=["o_orderkey", "o_totalprice"]), "SELECT o_orderkey, o_totalprice FROM orders", raw=True)
query("s05_row_filter", lambda c: R.parquet(c.spark, *_path(c, "part")).where(F.col("p_partkey").isin(3, 5, 8, 999999)).select("p_partkey", "p_name"), "SELECT p_partkey, p_name FROM part WHERE p_partkey IN (3, 5, 8, 999999)", raw=True)
query("s06_box", lambda c: R.parquet(c.spark, *_path(c, "lineitem")).where(R.in_box("l_quantity", "l_discount", 5, 0.02, 10, 0.04)).agg(F.count("*").alias("n")), "SELECT count(*) AS n FROM lineitem WHERE l_quantity BETWEEN 5 AND 10 AND l_discount BETWEEN 0.02 AND 0.04", raw=True)
query("s12_frame_as_table", lambda c: c.spark.sql("SELECT grp, count(*) AS n FROM {nodes} GROUP BY grp", nodes=c.nodes), "SELECT grp, count(*) AS n FROM nodes GROUP BY grp")
query("s13_parameters", lambda c: c.spark.sql("SELECT node FROM {nodes} WHERE x BETWEEN :lo AND :hi", args={"lo": 100.0, "hi": 900.0}, nodes=c.nodes), "SELECT node FROM nodes WHERE x BETWEEN 100 AND 900")
query("s16_schema", lambda c: c.spark.createDataFrame([(f.name, f.dataType.simpleString()) for f in c.table("part").schema], "name string, type string"), "SELECT unnest(['p_partkey', 'p_name', 'p_brand', 'p_type', 'p_size', 'p_retailprice']) AS name, unnest(['bigint', 'string', 'string', 'string', 'int', 'double']) AS type", raw=True)


def _point(c):
    row = R.lookup(c.nodes.select("source_id", F.col("node").cast("string").alias("text"), "node"), "42", "source_id", "text")
    return c.spark.createDataFrame([(row["node"],)], "node bigint")


query("s17_point_lookup", _point, "SELECT node FROM nodes WHERE node = 42")


def _round_trip(c):
    path = _folder(c)
    K.write_atomic(c.bonds.where("f >= 0.06"), path)
    return c.spark.read.parquet(path).select("i", "j")


query("k01_parquet_round_trip", _round_trip, "SELECT i, j FROM bonds WHERE f >= 0.06")


def _csv(c):
    path = _folder(c)
    c.nodes.select("node", "grp", "size").write.option("header", True).csv(path)
    return R.csv(c.spark, path, "node bigint, grp string, size int")


query("k03_csv_round_trip", _csv, "SELECT node, grp, size FROM nodes")
query("s10_csv_scan", lambda c: _csv(c).groupBy("grp").agg(F.sum("size").alias("s")), "SELECT grp, CAST(sum(size) AS BIGINT) AS s FROM nodes GROUP BY grp")


def _manifest(c):
    """A run's manifest, with the number of tiles that its nodes lie in."""
    import json

    path = f"{_folder(c)}/manifest.json"
    tiles = c.nodes.select(F.floor(F.col("x") / 500), F.floor(F.col("y") / 500)).distinct().count()
    K.write_text(c.spark, path, json.dumps({"model": "m", "tile_count": tiles, "config": {"max_distance_m": 100.0, "tile_size_m": 500}}, indent=1))
    return R.manifest(c.spark, path).select("model", "tile_count", F.col("config.max_distance_m").alias("reach"))


query("s11_manifest", _manifest, "SELECT 'm' AS model, count(*) AS tile_count, CAST(100.0 AS DOUBLE) AS reach FROM (SELECT DISTINCT floor(x / 500), floor(y / 500) FROM nodes)")


def _bundle(c):
    """Nodes, components and summary, cached by their parameters; the second call reads them back."""

    def build():
        state = L.states(c.nodes, L.active(L.eeat_weights(c.bonds), TAU)).select("node", "component_id", "component_size")
        parts = state.groupBy("component_id").agg(F.count("*").alias("size"))
        return {"nodes": state, "components": parts, "summary": parts.agg(F.count("*").alias("components"), F.max("size").alias("largest"))}

    path, asked = _folder(c), {"method": "eeat", "threshold": TAU, "source": K.source_signature(c.spark, f"{c.dir}/lineitem.parquet")}
    K.cached(c.spark, path, asked, build)

    def never():
        raise AssertionError("the cache was not used")

    return K.cached(c.spark, path, asked | {"threshold": TAU + 1e-17}, never)["summary"]


query("k05_parameter_cache", _bundle, "SELECT count(DISTINCT component_id) AS components, max(component_size) AS largest FROM state", _EEAT)
query("k06_bundle", lambda c: _bundle(c).select("components"), "SELECT count(DISTINCT component_id) AS components FROM state", _EEAT)


def _view(c):
    c.nodes.where("grp = 'A'").createOrReplaceTempView("tessera_session_nodes")
    return c.spark.sql("SELECT count(*) AS n FROM tessera_session_nodes")


query("k07_session_table", _view, "SELECT count(*) AS n FROM nodes WHERE grp = 'A'")


def _inventory(c):
    """Sizes and checksums of the summaries written for each group."""
    path = _folder(c)
    for r in c.nodes.groupBy("grp").agg(F.count("*").alias("n"), F.sum("size").alias("s")).collect():  # one row for each group
        K.write_text(c.spark, f"{path}/{r['grp']}/summary.txt", f"{r['grp']},{r['n']},{r['s']}")
    return R.inventory(c.spark, path).select(F.regexp_extract("path", "([^/]+)/[^/]+$", 1).alias("grp"), "bytes", "sha256")


query("k09_inventory", _inventory, "SELECT grp, CAST(length(t) AS BIGINT) AS bytes, sha256(t) AS sha256 FROM (SELECT grp, concat(grp, ',', count(*), ',', sum(size)) AS t FROM nodes GROUP BY grp)")


def _validators(c):
    found = R.check_columns(c.spark, {f"{c.dir}/part.parquet": ["p_partkey"], f"{c.dir}/nation.parquet": ["n_name", "missing_column"]})
    return c.spark.createDataFrame([(m.split("lacks")[-1].strip(),) for m in found], "problem string")


query("d13_validators", _validators, "SELECT 'columns: missing_column' AS problem", raw=True)
query("d14_filtered_copy", lambda c: _copy(c), "SELECT node, kind FROM nodes WHERE node IN (1, 2, 3)")


def _copy(c):
    path = _folder(c)
    K.write_atomic(c.nodes.where(F.col("node").isin(1, 2, 3)).select("node", "kind"), path)
    return c.spark.read.parquet(path)


def _replaced(c):
    """A folder written twice: the second writing is what is read, and nothing else is left beside it."""
    path = _folder(c)
    for grp in ("A", "B"):
        K.write_atomic(c.nodes.where(F.col("grp") == grp).select("node", "grp"), path)
    assert not any(K.exists(c.spark, path + end) for end in (".partial", ".old"))
    return c.spark.read.parquet(path).groupBy("grp").agg(F.count("*").alias("n"))


query("k02_replace", _replaced, "SELECT grp, count(*) AS n FROM nodes WHERE grp = 'B' GROUP BY grp")


def _source_cache(c):
    """A cache keyed by its source's files: used while they are the same, built anew when they change."""
    path, source, built = _folder(c), _folder(c), []

    def tables():
        built.append(1)
        return {"t": c.spark.read.parquet(source).groupBy("grp").agg(F.count("*").alias("n"))}

    for grp in ("A", "A", "B"):  # the second round finds the first one's files
        if len(built) < 1 or grp == "B":
            K.write_atomic(c.nodes.where(F.col("grp") == grp).select("node", "grp"), source)
        found = K.cached(c.spark, path, {"source": K.source_signature(c.spark, f"{source}/*.parquet")}, tables)["t"]
    return found.withColumn("built", F.lit(len(built)))


query("k04_source_cache", _source_cache, "SELECT grp, count(*) AS n, 2 AS built FROM nodes WHERE grp = 'B' GROUP BY grp")


def _markdown(c):
    from tessera.functions.models import markdown

    rows = [r.asDict() for r in c.nodes.groupBy("grp").agg(F.count("*").alias("n")).orderBy("grp").collect()]  # one row for each group
    return c.spark.createDataFrame([(markdown(rows),)], "text string")


query("k11_markdown", _markdown, "SELECT concat('| grp | n |', chr(10), '|---|---|', chr(10), string_agg(concat('| ', grp, ' | ', n, ' |'), chr(10) ORDER BY grp)) AS text FROM (SELECT grp, count(*) AS n FROM nodes GROUP BY grp)")


def _footer(c):
    """Geometry column, encoding and reference system from a file's footer; the driver writes and reads the one file."""
    import json
    import os

    import pyarrow as pa
    import pyarrow.parquet as pq

    folder = _folder(c).removeprefix("file:")
    os.makedirs(folder)
    meta = {"primary_column": "footprint", "columns": {"footprint": {"encoding": "WKB", "crs": {"name": "plane"}}}}
    pq.write_table(pa.table({"footprint": pa.array([b""])}).replace_schema_metadata({"geo": json.dumps(meta)}), f"{folder}/g.parquet")
    found = R.geo_metadata(f"{folder}/g.parquet")
    return c.spark.createDataFrame([(found["primary_column"], found["encoding"], found["crs"]["name"])], "primary_column string, encoding string, crs string")


query("s07_geo_footer", _footer, "SELECT 'footprint' AS primary_column, 'WKB' AS encoding, 'plane' AS crs", raw=True)


def _wkb(c):
    """Points stored as WKB, kept by id through a semi-join and decoded in column functions."""

    def packed(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([struct.pack("<BIdd", 1, 1, a, b) for a, b in zip(x, y, strict=True)])

    table = c.nodes.select("node", F.pandas_udf(packed, "binary")("x", "y").alias("wkb")).join(c.assessed.where("is_destroyed = 1"), "node", "left_semi")
    x, y = R.point_from_wkb("wkb")
    return table.select("node", x.alias("x"), y.alias("y"))


query("s08_wkb_points", _wkb, "SELECT node, x, y FROM nodes WHERE node IN (SELECT node FROM assessed WHERE is_destroyed = 1)")
