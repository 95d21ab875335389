"""The engine's queries by name, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weftline.workers import reachable

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str, *tables: str) -> Callable[[Callable[..., DataFrame]], Query]:
    """Registers a function of tables as a query of its own name."""

    def register(function: Callable[..., DataFrame]) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            reachable(spark)
            return function(*[spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables])

        QUERIES[function.__name__] = run
        ORACLE_SQL[function.__name__] = sql
        return run

    return register
