"""Exact percentiles of groups of any size: no group's values are held by one task.

Values are counted by group and value, then dealt by ranges of the two in parts (`scans.dealt`), so a group of many values lies in several parts, one after the other. A running count
in each part, and the counts of the parts before it, give the ranks that a value covers; the values that cover the wanted ranks are picked by an aggregate with partial sums. A value
that fills half a group is one row after the first count. The window over parts has at most a row for each part of a group.

Nulls take no part; NaN is the greatest value. A group of nulls only has no row; a null group is a group. Between two ranks the value is interpolated, as `percentile` does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kilnbase.operators.scans import dealt


def quantiles(df: DataFrame, by: str, value: str, fractions: dict[str, float]) -> DataFrame:
    """`by` and a column for each name of `fractions`, the exact percentile of `value`."""
    counts = df.select(F.col(by).alias("_key"), F.col(value).cast("double").alias("_value")).where("_value IS NOT NULL").groupBy("_key", "_value").agg(F.count("*").alias("_rows"))
    rows = dealt(counts, "_key", "_value")
    parts = rows.groupBy("_key", "_part").agg(F.sum("_rows").alias("_in"))
    group = W.partitionBy("_key")
    before = F.coalesce(F.sum("_in").over(group.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    places = parts.select(F.col("_key").alias("_of"), F.col("_part").alias("_at"), before.alias("_before"), F.sum("_in").over(group).alias("_n"))
    running = rows.withColumn("_upto", F.sum("_rows").over(W.partitionBy("_key", "_part").orderBy("_value").rowsBetween(W.unboundedPreceding, 0)))
    ranked = running.join(places, running["_key"].eqNullSafe(places["_of"]) & (running["_part"] == places["_at"])).withColumn("_upto", F.col("_upto") + F.col("_before"))
    picked, out = [], []
    for name, p in fractions.items():
        place = F.lit(p) * (F.col("_n") - 1)
        for side, rank in (("low", F.floor(place)), ("high", F.ceil(place))):
            holds = (rank < F.col("_upto")) & (rank >= F.col("_upto") - F.col("_rows"))
            picked.append(F.max(F.when(holds, F.col("_value"))).alias(f"{side} {name}"))
        low, high, rest = F.col(f"low {name}"), F.col(f"high {name}"), place - F.floor(place)
        out.append(F.when(low == high, low).otherwise(low * (1 - rest) + high * rest).alias(name))
    return ranked.groupBy("_key").agg(F.max("_n").alias("_n"), *picked).select(F.col("_key").alias(by), *out)
