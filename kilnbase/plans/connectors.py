"""Queries over formats, the custom source and the function kinds a user may register."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kilnbase.sources import formats, parts
from kilnbase.sources.catalog import load
from kilnbase.sources.scratch import shared_path
from kilnbase.streaming.events import run_append

from .registry import query


def _round_trip(kind: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        nation = load(spark, sf_dir, "nation")
        path = shared_path(spark, f"nation-{kind}")
        formats.write_files(nation, path, kind)
        return formats.read_files(spark, path, kind, nation.schema)

    run.__name__ = f"scan_{kind}"
    return query("SELECT n_nationkey, n_name, n_regionkey FROM nation")(run)


for _kind in formats.FORMATS:
    _round_trip(_kind)


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F'")
def sink_partitioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A partitioned write; reading one partition touches its folder alone."""
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    path = shared_path(spark, "orders-by-status")
    formats.write_files(orders, path, "parquet", ["o_orderstatus"])
    return spark.read.schema(orders.schema).parquet(path).where("o_orderstatus = 'F'")


@query("SELECT n_name AS value FROM nation")
def scan_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "nation-lines")
    load(spark, sf_dir, "nation").select("n_name").write.text(path)
    return formats.read_lines(spark, path)


@query("SELECT string_agg(r_name || chr(10), '' ORDER BY r_name) AS content, sum(strlen(r_name) + 1)::BIGINT AS length FROM region")
def scan_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text file of five lines, read back as bytes."""
    path = shared_path(spark, "region-file")
    load(spark, sf_dir, "region").select("r_name").coalesce(1).sortWithinPartitions("r_name").write.text(path)
    return formats.read_binary(spark, path).where("length > 0").select(F.decode("content", "UTF-8").alias("content"), "length")


_EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double"


def _event_files(spark: SparkSession, sf_dir: str) -> str:
    """The events in the shared folder, where Python workers can open them whatever store the tables are in."""
    path = shared_path(spark, "events-parts")
    load(spark, sf_dir, "events").selectExpr(*[f"CAST({c.rsplit(' ', 1)[0]} AS {c.rsplit(' ', 1)[1]}) AS {c.rsplit(' ', 1)[0]}" for c in _EVENTS.split(", ")]).write.parquet(path)
    parts.enable(spark)
    return path


@query("SELECT event_id, ts, user_id, value FROM events WHERE event_type = 'purchase' AND user_id >= 10")
def scan_python_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases read through the Python source; both filters are evaluated in it."""
    rows = spark.read.format(parts.NAME).schema(_EVENTS).option("path", _event_files(spark, sf_dir)).load()
    return rows.where("event_type = 'purchase' AND user_id >= 10").select("event_id", "ts", "user_id", "value")


@query("SELECT event_id, ts, user_id, event_type, value FROM events")
def stream_python_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events through the Python source's stream reader."""
    rows = spark.readStream.format(parts.NAME).schema(_EVENTS).option("path", _event_files(spark, sf_dir)).load()
    return run_append(rows, "python-stream")


@query("SELECT n_nationkey, n_nationkey * 2 + 1 AS v FROM nation")
def udf_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION kilnbase_odd(x INT) RETURNS INT RETURN x * 2 + 1")
    load(spark, sf_dir, "nation").createOrReplaceTempView("nation")
    return spark.sql("SELECT n_nationkey, kilnbase_odd(n_nationkey) AS v FROM nation")


@query("SELECT p_partkey, p_retailprice * 2 AS v FROM part")
def udf_pandas(spark: SparkSession, sf_dir: str) -> DataFrame:
    @F.pandas_udf("double")
    def double(x: pd.Series) -> pd.Series:
        return x * 2

    return load(spark, sf_dir, "part").select("p_partkey", double("p_retailprice").alias("v"))


@query("SELECT p_brand, round(max(p_retailprice) - min(p_retailprice), 6) AS spread FROM part GROUP BY p_brand")
def udf_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    @F.pandas_udf("double")
    def spread(x: pd.Series) -> float:
        return float(x.max() - x.min())

    return load(spark, sf_dir, "part").groupBy("p_brand").agg(F.round(spread("p_retailprice"), 6).alias("spread"))


@query("SELECT s_suppkey, rank() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal, s_suppkey) AS pos FROM supplier")
def udf_grouped_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    def rank(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["s_acctbal", "s_suppkey"])
        return pd.DataFrame({"s_suppkey": part["s_suppkey"], "pos": range(1, len(part) + 1)})

    return load(spark, sf_dir, "supplier").groupBy("s_nationkey").applyInPandas(rank, "s_suppkey long, pos long")


@query("SELECT r.r_name AS r_name, count(n_nationkey) AS nations FROM region r LEFT JOIN nation ON r_regionkey = n_regionkey GROUP BY 1")
def udf_cogrouped_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    def count(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"r_name": left["r_name"], "nations": [len(right)] * len(left)})

    region, nation = load(spark, sf_dir, "region"), load(spark, sf_dir, "nation")
    return region.groupBy("r_regionkey").cogroup(nation.groupBy("n_regionkey")).applyInPandas(count, "r_name string, nations long")


@query("SELECT o_orderkey, o_totalprice > 200000 AS big FROM orders")
def udf_partition_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    def mark(batches):
        import pyarrow.compute as pc

        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pc.greater(batch.column(1), 200000.0)], names=["o_orderkey", "big"])

    return load(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").mapInArrow(mark, "o_orderkey long, big boolean")


@query("SELECT n_nationkey, unnest(range(0, n_regionkey + 1))::INT AS k FROM nation")
def udf_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    @F.udtf(returnType="k int")
    class UpTo:
        def eval(self, n: int):
            for k in range(n + 1):
                yield (k,)

    spark.udtf.register("kilnbase_up_to", UpTo)
    load(spark, sf_dir, "nation").createOrReplaceTempView("nation")
    return spark.sql("SELECT n_nationkey, k FROM nation, LATERAL kilnbase_up_to(n_regionkey)")
