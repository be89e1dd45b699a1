"""Registration of queries and of their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.plans.fixtures import Context, sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, build: Callable[[Context], DataFrame], body: str | None = None, links: str | None = None, raw: bool = False) -> None:
    """Add a query; ``body`` is its SQL over the fixture (``raw``: over the test tables alone)."""
    if name in QUERIES:
        raise ValueError(name)
    QUERIES[name] = lambda spark, sf_dir: build(Context(spark, sf_dir))
    if body is not None:
        ORACLE_SQL[name] = body if raw else sql(body, links)
