"""Registered queries and the SQL each must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.catalog import corpus, prepared, reading, scoring, splits, tokens, vectors
from millrace.session import ship_package

Query = Callable[[SparkSession, str], DataFrame]

_MODULES = (corpus, splits, tokens, reading, prepared, scoring, vectors)


def _shipping(query: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return query(spark, sf_dir)

    run.__name__ = query.__name__
    return run


def queries() -> dict[str, Query]:
    return {name: _shipping(q) for m in _MODULES for name, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
