"""Sharding by balanced label propagation, under the law `rows`: shard sizes differ by one row at most.

Method. Documents of equal text are linked. Linked documents begin in shards drawn by hash; in each round every
document is pulled to the shard, of those with room, where most of its neighbours are, if no fewer are there than in
its own, and moves if that shard's quota has room. A group that needs several shards is pulled to as many at
once, those that hold most of it, to fill one after the other. Rooms are given out by strength of pull, whole hash classes at
a time; a group is of one class, but one of more than an eighth of a shard is spread over all classes, so
that part of it may move. Each move puts a group's documents closer together, so
rounds come to an end: when nothing moves, classes are made finer, and when still nothing moves
propagation is over. Documents without links, and any that a full shard could not keep, then fill the
shards up to their exact quotas.

Scale. Rounds work on ids of linked documents only, never on texts. The driver sees counts by shard, pull and
hash class, of bounded size. Ranks are counted in buckets, so neither a shard nor a group is ever one task.

Edge cases. Null text: size 8, checksum 0, equal to other null texts alone. Repeated rows are documents of equal
text. Null doc_ids are kept. Fewer rows than shards: some shards are empty. Empty table: no rows. Further columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Hash classes that room is given out by, coarse first.
CLASSES = (64, 512)


def shard(docs: DataFrame, shards: int = 24) -> DataFrame:
    """`docs` (doc_id, text): doc_id, size, text_crc32, law, shard, slot, grown_shard (null under this law)."""
    spark = docs.sparkSession
    text = F.col("text").cast("string")
    base = docs.select(
        F.col("doc_id").cast("long"), (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
        F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        F.concat(F.when(text.isNull(), "null").otherwise(""), F.md5(F.coalesce(text, F.lit("")).cast("binary"))).alias("gid"))
    base = common.written(base, "sharding-rows")
    total = base.count()
    quota = [total // shards + (s < total % shards) for s in range(shards)]

    groups = common.written(base.groupBy("gid").agg(F.count("*").alias("n")).where("n > 1").select("gid"), "sharding-groups")
    state = common.written(base.join(groups, "gid", "left_semi").withColumn("shard", _drawn(quota)), "sharding-state")
    state, loads = propagate(state, quota)

    order = ["gid", "doc_id"]
    loose = base.join(groups, "gid", "left_anti")
    if any(n > quota[s] for s, n in loads.items()):
        sat = common.written(common.ranked(state, ["shard"], order, "rank"), "sharding-ranks")
        fits = F.col("rank") < F.array(*(F.lit(q) for q in quota))[F.col("shard")]
        loose = loose.unionByName(sat.where(~fits).select(loose.columns))
        state = sat.where(fits).drop("rank")
    rest = [max(0, q - loads.get(s, 0)) for s, q in enumerate(quota)]
    loose = common.written(loose, "sharding-loose")
    filled = common.ranked(loose, [], order, "rank").withColumn("shard", _stretch(F.col("rank"), rest)).drop("rank")

    out = common.written(state.select(*base.columns, "shard").unionByName(filled), "sharding-placed")
    out = common.ranked(out, ["shard"], order, "slot", rows=total)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _stretch(position, sizes: list[int]):
    """The number of the stretch, of these sizes, that a position from 0 lies in."""
    out, end = F.lit(len(sizes) - 1), sum(sizes)
    for s in range(len(sizes) - 1, -1, -1):
        out = F.when(position < F.lit(end), F.lit(s)).otherwise(out) if sizes[s] else out
        end -= sizes[s]
    return out.cast("int")


def _drawn(quota: list[int]):
    """A shard drawn by hash, in proportion to its quota."""
    grain = 1 << 20
    whole = max(1, sum(quota))
    cuts = [grain * sum(quota[: s + 1]) // whole for s in range(len(quota))]
    sizes = [b - a for a, b in zip([0, *cuts], cuts, strict=False)]
    return _stretch(F.pmod(F.xxhash64("doc_id", "gid", F.lit(3)), F.lit(grain)), sizes)


def propagate(state: DataFrame, quota: list[int]) -> tuple[DataFrame, dict[int, int]]:
    """`state` (gid, doc_id, shard, ...) after the last round, and the rows in each shard."""
    spark, columns, written = state.sparkSession, state.columns, state
    limit = max(1, max(quota) // 8)
    loads = {r["shard"]: r["n"] for r in state.groupBy("shard").agg(F.count("*").alias("n")).collect()}
    finer = iter(CLASSES)
    classes, k = next(finer), 0
    while classes:
        free = [max(0, q - loads.get(s, 0)) for s, q in enumerate(quota)]
        pulled = common.written(_pulled(state, quota, free, limit, classes, k), "sharding-pulled")
        granted, moves = _grants(pulled.where("target is not null").groupBy("target", "strength", "class", "shard").agg(F.count("*").alias("n")).collect(), free)
        common.discard(spark, written)
        written, k = pulled, k + 1
        state = pulled.select(columns)
        if not granted:
            classes = next(finer, None)
            continue
        for (source, target), n in moves.items():
            loads[source] -= n
            loads[target] = loads.get(target, 0) + n
        table = F.broadcast(spark.createDataFrame(granted, "target int, strength int, class int").withColumn("granted", F.lit(True)))
        after = pulled.join(table, ["target", "strength", "class"], "left")
        state = after.withColumn("shard", F.when(F.col("granted"), F.col("target")).otherwise(F.col("shard"))).select(columns)
    return state, loads


def _pulled(state: DataFrame, quota: list[int], free: list[int], limit: int, classes: int, k: int) -> DataFrame:
    """`state` with the shard that pulls each document, null if none does, how strongly, and the document's class."""
    # a group's shards in a fixed order: by its rows there, then by hash
    place = F.struct("n", F.xxhash64("gid", "shard").alias("hash"), "shard")
    room = F.array(*(F.lit(f).cast("long") for f in free))
    cells = state.groupBy("gid", "shard").agg(F.count("*").alias("n"))
    pull = cells.groupBy("gid").agg(F.sort_array(F.collect_list(place), asc=False).alias("places"), F.sum("n").alias("rows"))
    needed = F.greatest(F.lit(1), F.ceil(F.col("rows") / F.lit(max([1, *quota])))).cast("int")
    roomy = lambda places: F.filter(places, lambda p: room[p["shard"]] > 0)
    pull = pull.withColumns({"top": F.slice("places", F.lit(1), needed), "some": F.slice(roomy(F.col("places")), 1, 1)})
    pull = pull.withColumns({"least": F.element_at("top", -1), "outside": F.col("rows") - F.aggregate("top", F.lit(0).cast("long"), lambda s, p: s + p["n"]), "goals": F.when(F.size(roomy(F.col("top"))) > 0, roomy(F.col("top"))).otherwise(F.col("some"))}).drop("top", "some")
    # written, so that the join is of two plain exchanges, which adaptive execution splits where a group is large
    pull = common.written(pull.withColumnRenamed("gid", "pull_gid"), "sharding-pulls")
    rows = state.join(pull, F.col("gid") == F.col("pull_gid"))
    own = F.filter("places", lambda p: p["shard"] == F.col("shard"))[0]
    # where a document stands among those that move, and so which goal's room it falls into
    stand = F.pmod(F.xxhash64("doc_id", "gid", F.lit(5)), F.greatest("outside", F.lit(1)))
    passed = F.aggregate("goals", F.struct(stand.alias("left"), F.lit(1).alias("nth")), lambda s, p: F.when(
        s["left"] >= room[p["shard"]], F.struct((s["left"] - room[p["shard"]]).alias("left"), (s["nth"] + 1).alias("nth"))).otherwise(
        F.struct(F.lit(-1).cast("long").alias("left"), s["nth"].alias("nth"))))["nth"]
    rows = rows.withColumns({"own": own, "best": F.get("goals", F.least(passed, F.size("goals")) - 1)})
    single = F.col("least.shard") == F.col("places")[0]["shard"]
    rows = rows.withColumn("moves", (F.col("shard") != F.col("best.shard")) & (F.col("own.n") <= F.col("best.n")) & (single | (F.col("own") < F.col("least"))))
    kind = F.when(F.col("rows") > limit, F.xxhash64("gid", "doc_id", F.lit(k))).otherwise(F.xxhash64("gid", F.lit(k)))
    return rows.select(
        *state.columns, F.when(F.col("moves"), F.col("best.shard")).alias("target"),
        F.least(F.floor(F.log2("best.n")), F.lit(40)).cast("int").alias("strength"), F.pmod(kind, F.lit(classes)).cast("int").alias("class"))


def _grants(wants: list, free: list[int]) -> tuple[list[tuple[int, int, int]], dict[tuple[int, int], int]]:
    """The (target, strength, class) that may move, the strongest first, and how many rows go from where to where."""
    cells: dict[tuple[int, int, int], list] = {}
    for r in wants:
        cells.setdefault((r["target"], r["strength"], r["class"]), []).append((r["shard"], r["n"]))
    left, granted, moves = list(free), [], {}
    for cell in sorted(cells, key=lambda c: (c[0], -c[1], c[2])):
        n = sum(n for _, n in cells[cell])
        if n <= left[cell[0]]:
            left[cell[0]] -= n
            granted.append(cell)
            for source, m in cells[cell]:
                moves[source, cell[0]] = moves.get((source, cell[0]), 0) + m
    return granted, moves


def cut(placed: DataFrame, docs: DataFrame) -> DataFrame:
    """What `shard` could not keep together: rows, groups, groups in more than one shard, rows outside their group's main shard."""
    texts = docs.select(F.col("doc_id").cast("long"), F.xxhash64(F.col("text").cast("string")).alias("group"), F.col("text").isNull().alias("absent"))
    cells = placed.join(texts, "doc_id").groupBy("group", "absent", "shard").agg(F.count("*").alias("n"))
    groups = cells.groupBy("group", "absent").agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.count("*").alias("shards")).where("n > 1")
    return groups.agg(F.sum("n").alias("rows"), F.count("*").alias("groups"), F.count(F.when(F.col("shards") > 1, 1)).alias("cut_groups"), F.sum(F.col("n") - F.col("most")).alias("cut_rows"))
