"""Joins that Spark SQL has no operator for, composed from operators that it has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, by: str, left_ts: str, right_ts: str, right_id: str, strict: bool = False) -> DataFrame:
    """Each left row with `right_id` of the last right row of its key at or before its time (before it, if `strict`).

    One union and one window over (key, time): one shuffle, no pair is ever made. Of right rows at one time the
    greatest id counts. Left rows without a match are kept with a null. A key's rows are sorted in one task, which
    spills: where one key holds a large share of all rows, split it by time first.
    """
    side = F.lit(1 if not strict else -1)
    rows = left.withColumns({"_ts": F.col(left_ts), "_side": side, "_rid": F.lit(None).cast(right.schema[right_id].dataType)})
    other = right.select(F.col(by), F.col(right_ts).alias("_ts"), F.lit(0).alias("_side"), F.col(right_id).alias("_rid"))
    order = W.partitionBy(by).orderBy("_ts", "_side", "_rid").rowsBetween(W.unboundedPreceding, 0)
    both = rows.unionByName(other, allowMissingColumns=True).withColumn("_match", F.last("_rid", ignorenulls=True).over(order))
    return both.where(F.col("_side") != 0).select(*left.columns, F.col("_match").alias(f"match_{right_id}"))


#: Levels of `range_join`: cells of 2^-30 to 2^1023, whatever is shorter or longer counts as that.
LEVELS = (-30, 1023)


def span_level(low: Column, high: Column) -> Column:
    """The level of the least dyadic cells that are not shorter than the span."""
    length = F.greatest(high - low, F.lit(2.0 ** LEVELS[0]))
    return F.least(F.ceil(F.log2(length)), F.lit(LEVELS[1])).cast("int")


def _cell(x: Column, level: Column) -> Column:
    """Number of the cell that holds x; a double, as it may exceed any whole number type."""
    scaled = x / F.pow(F.lit(2.0), level.cast("double"))
    return F.when(F.abs(scaled) < 2.0**52, F.floor(scaled).cast("double")).otherwise(scaled)


def range_join(points: DataFrame, spans: DataFrame, at: Column, low: Column, high: Column) -> DataFrame:
    """Points with the spans [low, high] that hold them, as an equi-join on dyadic cells; no width is to be chosen.

    A span of length n lies in the cells of about 2^ceil(log2 n), two of them (four beyond 2^1023), so it is never repeated
    more than that, be it short or long. A point is looked up once at each level that some span has: these are collected, at most 1,054
    whatever the tables' sizes, 30 for spans of 1 to 10^9. Cells are of the span's own size, so a pair that is compared has a fair
    chance to hold; the bounds as given are checked after the join. A crowded cell is a skewed join key, which adaptive execution splits.

    Nulls, NaN and spans of low > high match nothing; infinite bounds hold; repeated rows pair each with each. Whole numbers and decimals are
    placed by their nearest doubles, which keeps their order, and compared as they are.
    """
    most = F.lit(1.7976931348623157e308)
    real = lambda c: F.greatest(F.least(c.cast("double"), most), -most)
    sized = spans.withColumns({"_low": low, "_high": high}).where("_low <= _high AND NOT isnan(double(_high))")
    sized = sized.withColumn("_level", span_level(real(F.col("_low")), real(F.col("_high"))))
    levels = sorted(r[0] for r in sized.select("_level").distinct().collect())
    first, last = (_cell(real(F.col(c)), F.col("_level")) for c in ("_low", "_high"))
    covers = F.array_distinct(F.filter(F.array(first, first + 1, last - 1, last), lambda c: (c >= first) & (c <= last)))
    right = sized.withColumn("_cell", F.explode(covers))
    found = points.withColumn("_at", at).where("_at IS NOT NULL AND NOT isnan(double(_at))")
    places = F.array(*[F.struct(F.lit(k).alias("_level"), _cell(real(F.col("_at")), F.lit(k)).alias("_cell")) for k in levels])
    if not levels:
        places = places.cast("array<struct<_level: int, _cell: double>>")
    left = found.select("*", F.inline(places))
    return left.join(right, ["_level", "_cell"]).where("_at BETWEEN _low AND _high").drop("_level", "_cell", "_at", "_low", "_high")


def interval_join(left: DataFrame, right: DataFrame, by: str, left_ts: str, right_ts: str, within: str) -> DataFrame:
    """Pairs of a key whose right time lies from the left time to `within` after it."""
    later = right.withColumnRenamed(by, "_by")
    bound = F.expr(f"INTERVAL {within}")
    return left.join(later, (F.col(by) == F.col("_by")) & (F.col(right_ts) >= F.col(left_ts)) & (F.col(right_ts) <= F.col(left_ts) + bound)).drop("_by")


def salted_join(left: DataFrame, right: DataFrame, on: list[str], spread: list[str], salts: int = 8) -> DataFrame:
    """Inner equi-join with the left side's keys dealt over `salts` tasks and the right side repeated for each.

    For a left key that holds a large share of all rows; adaptive execution splits milder skew by itself. The salt is a
    hash of the left columns `spread`, such as a row's id, so a task that is run again deals its rows as before.
    """
    dealt = left.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    copied = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return dealt.join(copied, [*on, "_salt"]).drop("_salt")
