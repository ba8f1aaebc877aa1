"""Window frames that leave out the current row, its peers or its ties, from frames that Spark has.

A frame GROUPS BETWEEN a PRECEDING AND b FOLLOWING is the groups before, the current row's own group and the groups after. Its own group, in turn, is the rows
before, the current row and the rows after. Any exclusion is a choice of these five; an aggregate that can be put together from parts
(sum, count, least, greatest) is computed on each part and combined. One shuffle serves all parts, as they share the partition columns, into tasks of
some `ROWS` rows, however many there are. Two sorts serve them: one by the order, for the groups' numbers, one by these. A partition is sorted in one task, which spills.

Nulls of the value are ignored as by the aggregates; a frame left without values gives null, and 0 for a count. Ties in all order columns are one group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: What stays of a frame under each exclusion, beside the groups before and after.
KEPT = {"NO OTHERS": ("before", "self", "after"), "CURRENT ROW": ("before", "after"), "TIES": ("self",), "GROUP": ()}
KINDS = ("sum", "count", "min", "max")
#: Rows for a task, whose sorts hold them.
ROWS = 500_000


def _combined(kind: str, parts: list[Column]) -> Column:
    if kind == "min":
        return F.least(*parts) if len(parts) > 1 else parts[0]
    if kind == "max":
        return F.greatest(*parts) if len(parts) > 1 else parts[0]
    total = F.coalesce(parts[0], F.lit(0))
    for p in parts[1:]:
        total = total + F.coalesce(p, F.lit(0))
    return total if kind == "count" else F.when(F.coalesce(*parts).isNotNull(), total)


def excluding(df: DataFrame, by: list[str], order: list[str], value: str, exclude: str, before: int, after: int, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """`df` with columns named by `kinds`: aggregates of `value` over GROUPS BETWEEN `before` PRECEDING AND `after` FOLLOWING EXCLUDE `exclude`."""
    if exclude not in KEPT or not set(kinds) <= set(KINDS) or before < 0 or after < 0:
        raise ValueError(f"cannot build this frame: {exclude!r}, {kinds!r}, {before}, {after}")
    tasks = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // ROWS))
    ranked = df.repartition(tasks, *by).withColumn("_group", F.dense_rank().over(W.partitionBy(*by).orderBy(*order)).cast("long"))
    groups = W.partitionBy(*by).orderBy("_group")
    peers = W.partitionBy(*by, "_group")  # in any order, the same for both frames: it then needs no sort of its own
    frames = ([groups.rangeBetween(-before, -1)] if before else []) + ([groups.rangeBetween(1, after)] if after else [])
    frames += [peers.rowsBetween(W.unboundedPreceding, -1)] if "before" in KEPT[exclude] else []
    frames += [peers.rowsBetween(1, W.unboundedFollowing)] if "after" in KEPT[exclude] else []
    own = "self" in KEPT[exclude]
    out = {}
    for kind in kinds:
        parts = [getattr(F, kind)(value).over(w) for w in frames]
        parts += [F.col(value).isNotNull().cast("long") if kind == "count" else F.col(value)] if own else []
        nothing = F.lit(0).cast("long") if kind == "count" else F.when(F.lit(False), F.col(value))
        out[kind] = _combined(kind, parts) if parts else nothing
    return ranked.select(*df.columns, *[c.alias(k) for k, c in out.items()])
