"""Windows that close: append-mode aggregates over a folder that grows, with a watermark that moves, and rows that come too late.

An `Inbox` is a folder that batches of events are written to. `follow` runs a stream over what it holds until all of it is read and then ends; the next call goes on
from the same checkpoint, with the state and the watermark that the last one left. A window is emitted once, when the watermark passes its
end, and leaves the state. A row whose windows have all closed is dropped. `closing_event` is a row far ahead of all others, which moves the watermark
past them; it takes no part in any window.

Rows on time may come in any order within the delay (`LATE`). Rows of null time are in no window. An empty inbox gives no rows. State holds the open windows only, and what is
emitted is appended by the file sink, each batch once, so a run that is stopped and begun again gives the same rows.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kilnbase.sources.scratch import shared_path

LATE = "40 days"
#: The closing event lies so far behind the last event, more than any delay and window together.
BEYOND = "400 days"
SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double"
CLOSING = "(closing)"


@dataclass
class Inbox:
    spark: SparkSession
    path: str

    @classmethod
    def fresh(cls, spark: SparkSession, name: str) -> Inbox:
        box = cls(spark, shared_path(spark, f"{name}-inbox"))
        box.put(spark.createDataFrame([], SCHEMA))
        return box

    def put(self, events: DataFrame) -> None:
        events.select(*[F.col(c.name).cast(c.dataType) for c in self.spark.createDataFrame([], SCHEMA).schema]).write.mode("append").parquet(self.path)

    def close(self, events: DataFrame) -> None:
        """Puts one event that lies beyond all of `events`."""
        last = events.agg(F.max(F.col("ts").cast("timestamp")).alias("ts")).select(
            F.lit(-1).alias("event_id"), (F.coalesce("ts", F.timestamp_seconds(F.lit(0))) + F.expr(f"INTERVAL {BEYOND}")).alias("ts"),
            F.lit(None).alias("user_id"), F.lit(CLOSING).alias("event_type"), F.lit(None).alias("value"))
        self.put(last)

    def stream(self, late: str = LATE) -> DataFrame:
        """What is put in, with a watermark that the closing event moves although it is not among the rows."""
        marked = self.spark.readStream.schema(SCHEMA).parquet(self.path).withWatermark("ts", late)
        # a condition on `ts` stays above the watermark; one on `event_type` alone would go below it, and the closing event with it
        return marked.where(f"ts IS NOT NULL AND NOT (event_type <=> '{CLOSING}' AND ts >= TIMESTAMP '0001-01-01')")


@dataclass
class Closed:
    """An append-mode stream over an inbox, and where its rows, its checkpoint and its progress are."""

    box: Inbox
    shape: Callable[[DataFrame], DataFrame]
    out: str
    log: str
    progress: list[dict] = field(default_factory=list)

    @classmethod
    def begin(cls, box: Inbox, shape: Callable[[DataFrame], DataFrame], name: str) -> Closed:
        return cls(box, shape, shared_path(box.spark, name), shared_path(box.spark, f"{name}-log"))

    def follow(self) -> None:
        """Reads all that the inbox holds by now and ends."""
        rows = self.shape(self.box.stream())
        query = rows.writeStream.outputMode("append").format("parquet").option("path", self.out).option("checkpointLocation", self.log).trigger(availableNow=True).start()
        query.awaitTermination()
        self.progress += [json.loads(p.json) if hasattr(p, "json") and isinstance(p.json, str) else p for p in query.recentProgress]

    def rows(self) -> DataFrame:
        return self.box.spark.read.schema(self.shape(self.box.stream()).schema).parquet(self.out)

    def held(self) -> int:
        """Rows in state after the last batch, of all stateful operators together."""
        return sum(o["numRowsTotal"] for o in self.progress[-1]["stateOperators"])

    def dropped(self) -> int:
        return sum(o["numRowsDroppedByWatermark"] for p in self.progress for o in p["stateOperators"])


def by_window(stream: DataFrame, width: str) -> DataFrame:
    return stream.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(
        F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


def by_session(stream: DataFrame, gap: str) -> DataFrame:
    return stream.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select(
        F.col("session_window.start").cast("timestamp_ntz").alias("started"), "user_id", "n")


def busiest(stream: DataFrame, width: str, within: str) -> DataFrame:
    """Two stateful operators in a chain: counts by the shorter window, then the greatest of them in each longer one."""
    counts = stream.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"))
    return counts.groupBy(F.window(F.window_time("window"), within).alias("outer"), "event_type").agg(
        F.max("n").alias("most"), F.count("*").alias("windows")).select(F.col("outer.start").cast("timestamp_ntz").alias("start"), "event_type", "most", "windows")


def replayed(spark: SparkSession, events: DataFrame, shape: Callable[[DataFrame], DataFrame], name: str) -> Closed:
    """All events, then the closing event, then all events once more: the second time they are late, and dropped."""
    box = Inbox.fresh(spark, name)
    closed = Closed.begin(box, shape, name)
    box.put(events)
    closed.follow()
    box.close(events)
    closed.follow()
    box.put(events)
    closed.follow()
    return closed
