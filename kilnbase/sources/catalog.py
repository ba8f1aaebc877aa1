"""Readers for the star-schema and corpus tables, one Parquet file or directory each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """The table as Spark reads it; nothing is opened outside Spark's own readers."""
    if table not in TABLES:
        raise ValueError(f"unknown table {table!r}")
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def register(spark: SparkSession, sf_dir: str, *tables: str) -> None:
    """Temporary views, for queries written in SQL."""
    for table in tables or TABLES:
        load(spark, sf_dir, table).createOrReplaceTempView(table)
