"""Every query by name, and its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kilnbase.sources.catalog import register

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function under its name, with the SQL that must give the same rows."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def sql_query(name: str, tables: str, spark_sql: str, oracle: str | None = None) -> None:
    """Registers a query written in Spark SQL over `tables`; `oracle` where DuckDB words it differently."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        register(spark, sf_dir, *tables.split())
        return spark.sql(spark_sql)

    run.__name__ = name
    QUERIES[name] = run
    ORACLES[name] = oracle or spark_sql


def _import_all() -> None:
    import importlib

    for module in MODULES:
        importlib.import_module(module)


MODULES: tuple[str, ...] = ("kilnbase.plans.relational", "kilnbase.plans.scalar", "kilnbase.plans.composed", "kilnbase.plans.knowledge",
                            "kilnbase.plans.streams", "kilnbase.plans.connectors")
_import_all()
