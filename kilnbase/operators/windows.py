"""Sessions, top-k by group and other window compositions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def sessionize(events: DataFrame, by: str, ts: str, order: str, gap: str) -> DataFrame:
    """Sessions of each key: a new one starts where more than `gap` has passed since the row before.

    Returns the key, session number from 1, first and last time and rows. Nulls in `ts` are left out. A key's rows
    are sorted in one task, which spills.
    """
    w = W.partitionBy(by).orderBy(ts, order)
    previous = F.lag(ts).over(w)
    starts = F.when(previous.isNull() | (F.col(ts) > previous + F.expr(f"INTERVAL {gap}")), 1).otherwise(0)
    numbered = events.where(F.col(ts).isNotNull()).withColumn("_starts", starts)
    numbered = numbered.withColumn("session", F.sum("_starts").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return numbered.groupBy(by, "session").agg(F.min(ts).alias("started"), F.max(ts).alias("ended"), F.count("*").alias("n"))


def top_k_by_group(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first `k` rows of each group; Spark prunes groups on both sides of the shuffle."""
    rank = F.row_number().over(W.partitionBy(*by).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= k).drop("_rank")


def first_by_key(df: DataFrame, by: list[str], order: Column) -> DataFrame:
    """One row of each key, the least under `order`, by aggregation: no sort of the group."""
    least = df.groupBy(*by).agg(F.min_by(F.struct(*[c for c in df.columns if c not in by]), order).alias("_row"))
    return least.select(*by, "_row.*")
