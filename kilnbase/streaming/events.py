"""Structured Streaming over the events table: windows, sessions, deduplication, joins and keyed state.

`events.ts` has no time zone, which watermarks reject, so streams cast it to a timestamp (sessions run in UTC).
Every query is started with `availableNow`, so it reads all files in bounded batches and ends. Aggregates run in complete
mode into a table that each batch replaces; what is emitted by row is appended to Parquet files, whose sink writes
each batch once.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from kilnbase.sources.catalog import load
from kilnbase.sources.scratch import is_folder, shared_path
from kilnbase.streaming.keyed import KeyedTable, upsert

LATE = "40 days"  # a table's files come in no order of time, so nothing within its span may count as late


def event_stream(spark: SparkSession, sf_dir: str, late: str = LATE, files_per_batch: int | None = None) -> DataFrame:
    """The events table as a stream, be it one file or a folder of files as Spark writes it."""
    schema = load(spark, sf_dir, "events").schema
    path = f"{sf_dir.rstrip('/')}/events.parquet"
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    # a stream reads folders: of a single file, the folder that holds it and the name alone
    stream = reader.parquet(path) if is_folder(spark, path) else reader.option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def run_complete(df: DataFrame, name: str) -> DataFrame:
    """The final state of an aggregate over the whole stream."""
    spark = df.sparkSession
    out = shared_path(spark, name)

    def replace(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(out)

    query = df.writeStream.outputMode("complete").option("checkpointLocation", shared_path(spark, f"{name}-log")).trigger(availableNow=True).foreachBatch(replace).start()
    query.awaitTermination()
    return spark.read.parquet(out)


def run_append(df: DataFrame, name: str) -> DataFrame:
    """All rows that the stream emits."""
    spark = df.sparkSession
    out = shared_path(spark, name)
    query = df.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", shared_path(spark, f"{name}-log")).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


def tumbling(stream: DataFrame, width: str, slide: str | None = None) -> DataFrame:
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    return stream.groupBy(window, "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(
        F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


def sessions(stream: DataFrame, gap: str) -> DataFrame:
    return stream.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select(
        F.col("session_window.start").cast("timestamp_ntz").alias("started"), "user_id", "n")


def deduplicated(stream: DataFrame) -> DataFrame:
    return stream.dropDuplicatesWithinWatermark(["event_id"]).select("event_id", "user_id")


def click_then_view(clicks: DataFrame, views: DataFrame, within: str) -> DataFrame:
    """Stream-stream join with a time bound on both sides, so state is dropped in time."""
    c = clicks.where("event_type = 'click'").select(F.col("event_id").alias("click_id"), "user_id", F.col("ts").alias("clicked"))
    v = views.where("event_type = 'view'").select(F.col("event_id").alias("view_id"), F.col("user_id").alias("viewer"), F.col("ts").alias("viewed"))
    bound = F.expr(f"user_id = viewer AND viewed >= clicked AND viewed <= clicked + INTERVAL {within}")
    return c.join(v, bound).select("click_id", "view_id")


def with_customer(stream: DataFrame, customers: DataFrame) -> DataFrame:
    """Stream-static join."""
    return stream.join(customers, stream.user_id == customers.c_custkey).select("event_id", "c_mktsegment")


class CountPerUser(StatefulProcessor):
    """Keyed state: events and value so far of each user; every batch emits the users it touched."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("sums", "n long, total double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        n, total = self.state.get() if self.state.exists() else (0, 0.0)
        for part in rows:
            n, total = n + len(part), total + float(part["value"].sum())
        self.state.update((n, total))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "total": [round(total, 4)]})

    def close(self) -> None:
        pass


def latest_table(spark: SparkSession, path: str, buckets: int = 32) -> KeyedTable:
    """The last event of each user."""
    return KeyedTable(spark, path, "user_id long, event_id long, ts timestamp", ("user_id",), lambda: F.struct(-F.unix_micros("ts"), -F.col("event_id")), buckets)


def latest_by_user(stream: DataFrame, name: str) -> DataFrame:
    spark = stream.sparkSession
    table = latest_table(spark, shared_path(spark, name))
    return upsert(stream, table, shared_path(spark, f"{name}-log")).read()


def running_totals(stream: DataFrame) -> DataFrame:
    return stream.groupBy("user_id").transformWithStateInPandas(CountPerUser(), "user_id long, n long, total double", "Update", "None")


def run_updates(df: DataFrame, name: str) -> DataFrame:
    """Every update that the stream emits, appended batch by batch; a batch that is run again replaces itself."""
    spark = df.sparkSession
    out = shared_path(spark, name)

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = df.writeStream.outputMode("update").option("checkpointLocation", shared_path(spark, f"{name}-log")).trigger(availableNow=True).foreachBatch(keep).start()
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(out)
