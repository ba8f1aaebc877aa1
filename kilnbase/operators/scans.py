"""Ordered scans that no single key can hold up: as-of joins and sessions over one key with any share of the rows.

Rows are dealt by ranges of (key, time) and written, so a key of many rows lies in several parts, one after the other. Each
part is scanned by itself, and what a part must know of those before it is carried: the last match, the time of the last row, the sessions
begun. Only keys that lie in more than one part need that, and of those a part holds at most two, its first and its last; so what
is carried has at most two rows for each part, and it is broadcast. The window over the carried rows is as small.

Against `joins.asof_join` and `windows.sessionize` this costs one written table and one more shuffle: take it where one key may hold a large share of all rows.
Rows of one key and one time stay together; a single instant with most of the rows is one part.

A null key is a key like others for sessions and matches nothing in as-of joins; rows of null time are left out of sessions and have no match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kilnbase.sources.scratch import shared_path


def dealt(df: DataFrame, by: str, ts: str) -> DataFrame:
    """The rows in parts by ranges of (by, ts), each with its part's number; written, so that a part stays what it is if a task is run again."""
    path = shared_path(df.sparkSession, "scan")
    df.repartitionByRange(F.col(by), F.col(ts)).withColumn("_part", F.spark_partition_id()).write.parquet(path)
    return df.sparkSession.read.parquet(path)


def carried(parts: DataFrame, by: str, value: Column) -> DataFrame:
    """by, _part, _carry: `value` over the parts before, for keys of several parts. `parts` has a row for each key and part."""
    several = parts.withColumn("_in", F.count("*").over(W.partitionBy(by))).where("_in > 1")
    before = W.partitionBy(by).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    return several.select(F.col(by).alias("_by"), F.col("_part").alias("_of"), value.over(before).alias("_carry"))


def with_carry(rows: DataFrame, carry: DataFrame, by: str, name: str) -> DataFrame:
    on = rows[by].eqNullSafe(carry["_by"]) & (rows["_part"] == carry["_of"])
    return rows.join(F.broadcast(carry), on, "left").drop("_by", "_of").withColumnRenamed("_carry", name)


def asof_join(left: DataFrame, right: DataFrame, by: str, left_ts: str, right_ts: str, right_id: str) -> DataFrame:
    """Each left row with `right_id` of the last right row of its key at or before its time; the greatest id of one time."""
    rows = left.withColumns({"_ts": F.col(left_ts), "_side": F.lit(1), "_rid": F.lit(None).cast(right.schema[right_id].dataType)})
    other = right.where(F.col(by).isNotNull() & F.col(right_ts).isNotNull()).select(
        F.col(by), F.col(right_ts).alias("_ts"), F.lit(0).alias("_side"), F.col(right_id).alias("_rid"))
    both = dealt(rows.unionByName(other, allowMissingColumns=True), by, "_ts")
    order = W.partitionBy(by, "_part").orderBy("_ts", "_side", "_rid").rowsBetween(W.unboundedPreceding, 0)
    parts = both.groupBy(by, "_part").agg(F.max(F.when(F.col("_side") == 0, F.struct("_ts", "_rid"))).alias("_last"))
    carry = carried(parts, by, F.last("_last", ignorenulls=True))
    scanned = with_carry(both.withColumn("_own", F.last("_rid", ignorenulls=True).over(order)).where(F.col("_side") == 1), carry, by, "_far")
    match = F.when(F.col("_ts").isNotNull(), F.coalesce("_own", F.col("_far")["_rid"]))
    return scanned.select(*left.columns, match.alias(f"match_{right_id}"))


def sessionize(events: DataFrame, by: str, ts: str, gap: str) -> DataFrame:
    """by, session from 1, started, ended, n: a new session starts where more than `gap` has passed since the row before."""
    rows = dealt(events.where(F.col(ts).isNotNull()).select(by, ts), by, ts)
    w = W.partitionBy(by, "_part").orderBy(ts)
    ends = rows.groupBy(by, "_part").agg(F.max(ts).alias("_end"))
    seen = with_carry(rows.withColumn("_before", F.lag(ts).over(w)), carried(ends, by, F.max("_end")), by, "_far")
    previous = F.coalesce("_before", "_far")
    starts = F.when(previous.isNull() | (F.col(ts) > previous + F.expr(f"INTERVAL {gap}")), 1).otherwise(0)
    marked = seen.select(by, ts, "_part", starts.alias("_starts"))
    own = F.sum("_starts").over(w.rangeBetween(W.unboundedPreceding, W.currentRow))  # rows of one time are of one session
    begun = marked.groupBy(by, "_part").agg(F.sum("_starts").alias("_begun"))
    numbered = with_carry(marked.withColumn("_own", own), carried(begun, by, F.sum("_begun")), by, "_earlier")
    session = F.col("_own") + F.coalesce("_earlier", F.lit(0))
    return numbered.withColumn("session", session).groupBy(by, "session").agg(F.min(ts).alias("started"), F.max(ts).alias("ended"), F.count("*").alias("n"))
