"""Operators of this subpackage against their SQL on the smallest test data."""

import duckdb
import pytest
from conftest import SF
from test_oracle import normal

from tessera.llm import queries as Q

TABLES = "documents pages embeddings benchmark labels conversations".split()


@pytest.mark.parametrize("name", sorted(set(Q.ORACLE_SQL) & {"op11_chat", "op12_divergence", "op13_fim"}))
def test_same_rows(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    assert normal(Q.QUERIES[name](spark, SF).toPandas()) == normal(con.sql(Q.ORACLE_SQL[name]).df())
