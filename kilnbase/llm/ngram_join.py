"""Jaccard self-join on word shingles: prefix filters under several global orders at once.

Method. If two sets have Jaccard similarity t or more, then under any order of all shingles their
prefixes of n - ceil(t n) + 1 shingles meet. One order drives the join: pairs that share a
prefix shingle, pass the length filter and the bound that the shingle's places set. Such a pair must
also share prefix shingles under every further order before its sets are compared. Every order has a
count table of its own, under a hash of its own: shingles of rare buckets come first, ties by another
hash. What is truly frequent comes last under each; what only shares a bucket with it does so under
one. Any order is a correct one, so the result is exact whatever the tables hold.

Groups. Only connections are asked for, so not all pairs of a large group are made. Equal sets are one
class. In up to `ROUNDS` rounds each document is compared with at most `HUBS` hubs of its prefix lists,
those it shares most lists with. In the last round every remaining candidate pair between
different components counts, unless the parities of the two sets part them: a set's parity has `64 * WORDS` bits, each odd or
even as the shingles that fall to it, and two sets differ in as many shingles at least as their parities in bits. So
a near-copy that no member of a large group is near enough to is not compared with each member. Of what remains
each document meets the member of least difference of each other component first, and the others if that has not
joined them. Pairs inside a component need no comparison, and all others get one or differ too much: no link is lost.

Scale. Shingles of all texts are never shuffled, only one order's prefixes are (15 % at 0.85). A list keeps the
rows that a neighbour by size could link with, so shingles that meet by chance go at once. Sets and
further prefixes are made again from the texts for the few documents that reach comparison: they are
found with a Bloom filter sized by their number, or by a join beyond `BLOOM_IDS`. With S shingles in all
a table of 2^b buckets tells shingles of more than some 3 sqrt(S / 2^b) documents from the rest.
The driver holds the count tables, of fixed size, and the Bloom filter, of bounded size. Component
links and pairs are tables.

Edge cases. Null, empty or blank texts: no shingles, linked with nothing. Fewer words than a shingle:
the whole sequence is the only one. Rows that share a doc_id are one node. Null doc_id: linked with
nothing, component null. Repeated rows and ties follow from the above. Empty table: no rows. Further
columns are ignored. Shingles are told apart by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common
from .graph import components
from .mph import mix
from .shingles import shingle_sets

ORDERS = 3
ROUNDS = 2
HUBS = 3
COUNT_BITS = 20
#: 64-bit words of a parity. It tells sets of up to some 600 shingles apart well, longer ones less and less.
WORDS = 8
PARITY = [f"b{k}" for k in range(WORDS)]
#: Most ids that go into a Bloom filter, of 16 bits each.
BLOOM_IDS = 1 << 23
_BLOCK = 1 << 16


def bucket(shingles: np.ndarray, order: int, bits: int) -> np.ndarray:
    return (mix(shingles, 200 + order) >> np.uint64(64 - bits)).astype(np.int64)


def frequency_ranks(docs: DataFrame, size: int, orders: int = ORDERS, bits: int = COUNT_BITS) -> np.ndarray:
    """For each order and bucket, the rank of the bucket by its count of documents, in 2^16 steps."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((orders, 1 << bits), np.uint32)
        for batch in batches:
            for shingles in shingle_sets(batch.column(0), size):
                for k in range(orders):
                    np.add.at(total[k], bucket(shingles, k, bits), np.uint32(1))
        kept = [(str(k), b, total[k, b * _BLOCK : (b + 1) * _BLOCK]) for k in range(orders) for b in range(-(-(1 << bits) // _BLOCK))]
        kept = [(k, b, common.narrowed(x)) for k, b, x in kept if x.any()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in kept], pa.string()), pa.array([k[1] for k in kept], pa.int32()),
             pa.array([TaskContext.get().partitionId() // 256] * len(kept), pa.int32()), pa.array([k[2] for k in kept], pa.binary())],
            names=["name", "block", "part", "counts"])

    parts = docs.select("text").mapInArrow(count, "name string, block int, part int, counts binary")
    out = np.zeros((orders, 1 << bits), np.uint32)
    for row in common.summed(parts).collect():
        counts = np.minimum(common.widened(row["counts"]), (1 << 32) - 1)
        out[int(row["name"]), row["block"] * _BLOCK : row["block"] * _BLOCK + len(counts)] = counts
    ranks = np.empty(out.shape, np.uint16)
    for k, counts in enumerate(out):  # equal counts share a rank; ranks are spread over 16 bits
        ranks[k] = np.searchsorted(np.sort(counts), counts) * 65535 // (1 << bits)
    return ranks


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1 if n else 0


def prefix(shingles: np.ndarray, ranks: np.ndarray, bits: int, order: int, percent: int) -> np.ndarray:
    """The first shingles under an order: by the rank of their bucket, then by a hash of the order's own."""
    key = (ranks[bucket(shingles, order, bits)].astype(np.uint64) << np.uint64(48)) | (mix(shingles, 100 + order) >> np.uint64(16))
    n = prefix_length(len(shingles), percent)
    at = np.argpartition(key, n - 1)[:n] if n < len(key) else np.arange(len(key))
    return shingles[at[np.lexsort((shingles[at], key[at]))]]


def parity(shingles: np.ndarray) -> np.ndarray:
    """`WORDS` words: a bit is set if an odd number of the shingles falls to it."""
    at = mix(shingles, 300) >> np.uint64(64 - (64 * WORDS - 1).bit_length())
    odd = np.bincount(at.astype(np.int64), minlength=64 * WORDS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def _sketches(docs: DataFrame, size: int, percent: int, bits: int, ranks) -> DataFrame:
    """doc_id, n, digest of the set, prefix under the first order, parity."""
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ranks.value[0]
        for batch in batches:
            n, digest, first, odd = [], [], [], []
            for s in shingle_sets(batch.column(1), size):
                n.append(len(s))
                digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                first.append(prefix(s, table, bits, 0, percent).view(np.int64))
                odd.append(parity(s))
            words = np.array(odd, np.int64).reshape(-1, WORDS)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(first, pa.list_(pa.int64())), *(pa.array(w) for w in words.T)],
                names=["doc_id", "n", "digest", "p0", *PARITY])

    schema = "doc_id long, n long, digest binary, p0 array<long>" + "".join(f", {b} long" for b in PARITY)
    return docs.select("doc_id", "text").mapInArrow(make, schema)


def linked_groups(docs: DataFrame, size: int = 4, percent: int = 85, orders: int = ORDERS, bits: int = COUNT_BITS) -> DataFrame:
    """`docs` (doc_id, text): doc_id, n_shingles, component_id for every row.

    Two documents link when 100 * intersection >= percent * union of their shingle sets.
    """
    spark = docs.sparkSession
    with common.small_batches(spark):
        docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
        ranks = spark.sparkContext.broadcast(frequency_ranks(docs, size, orders, bits))
        rows = common.written(_sketches(docs, size, percent, bits, ranks), "shingle-prefixes")

        member = rows.select("doc_id", "n", "digest")
        reps = rows.where("n > 0 and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
        reps = common.written(reps, "shingle-classes")
        # ids of a class hang on its smallest
        copies = member.join(reps.where("copies > 1").select("digest", "rep"), "digest").where("doc_id <> rep")
        joined = common.written(components(copies.select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))), "shingle-components")
        listed = common.written(_lists(rows, reps, percent), "prefix-lists")

        compare = lambda pairs: _verified(docs, pairs, size, percent, orders, bits, ranks)
        tried = None
        for k in range(ROUNDS):
            if k:
                listed = _mixed(listed, joined)
            pairs = common.written(_with_hubs(listed, tried, percent), "shingle-pairs")
            compared = pairs.count()
            if not compared:
                break
            links = compare(pairs)
            tried = pairs if tried is None else tried.unionAll(pairs)
            joined = _grown(joined, links)
            if links.count() * 50 < compared:
                break
        listed = _mixed(listed, joined)
        rest = common.written(_between_components(listed, _parities(rows), tried, percent), "shingle-pairs")
        common.discard(spark, listed)
        if not rest.isEmpty():
            closest = common.written(_closest(rest), "shingle-pairs")
            joined = _grown(joined, compare(closest))
            left = common.written(_apart(rest, joined).join(closest, ["a", "b"], "left_anti"), "shingle-pairs")
            if not left.isEmpty():
                joined = _grown(joined, compare(left))
        # the prefixes have served: what stays is a narrow table
        out = common.written(member.select("doc_id", "n").join(joined, member.doc_id == joined.node, "left").select(
            "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id")), "shingle-groups")
        for table in (rows, reps, joined):
            common.discard(spark, table)
        ranks.destroy()
    return out


def _lists(rows: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """token, doc_id, n, pos, component: the prefix lists of one document for each class, still a component by itself.

    In a list by size, a row stays if its next smaller or next larger neighbour passes the length filter: if
    neither does, no row of the list does. In a list of two the place bound must hold as well.
    """
    one = rows.where("n > 0").join(reps.select("digest", F.col("rep").alias("doc_id")), ["digest", "doc_id"])
    one = one.select("doc_id", F.col("n").cast("int").alias("n"), F.posexplode("p0").alias("pos", "token"))
    order = W.partitionBy("token").orderBy("n", "doc_id", "pos")
    here = F.struct("n", "pos")
    seen = one.withColumns({"x": F.lag(here).over(order), "y": F.lead(here).over(order)})
    seen = seen.withColumns({"xx": F.lag("n", 2).over(order), "yy": F.lead("n", 2).over(order)})
    two = "((x is null and yy is null) or (y is null and xx is null))"
    fits = lambda s: f"({s} is not null and 100 * least(n, {s}.n) >= {percent} * greatest(n, {s}.n) and (not {two} or least(n - pos, {s}.n - {s}.pos) >= {_need(percent, 'n', f'{s}.n')}))"
    return seen.where(f"{fits('x')} or {fits('y')}").select("token", "doc_id", "n", "pos", F.col("doc_id").alias("component"))


def _grown(joined: DataFrame, links: DataFrame) -> DataFrame:
    stars = joined.select(F.col("node").alias("a"), F.col("component").alias("b"))
    return common.written(components(stars.unionAll(links)), "shingle-components")


def _mixed(listed: DataFrame, joined: DataFrame) -> DataFrame:
    """The prefix lists that hold documents of several components, with the component of each row."""
    placed = listed.select("token", "doc_id", "n", "pos").join(joined.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    placed = placed.withColumn("component", F.coalesce("component", "doc_id"))
    mixed = placed.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high")
    # written, so that the join is of two plain exchanges, which adaptive execution splits where a token is frequent
    mixed = common.written(mixed.select("token"), "mixed-tokens")
    out = common.written(placed.join(mixed, "token", "left_semi"), "mixed-lists")
    for table in (listed, mixed):
        common.discard(listed.sparkSession, table)
    return out


def _need(percent: int, x: str, y: str) -> str:
    """Shingles that sets of these sizes must share."""
    return f"ceil({percent} * ({x} + {y}) / {100 + percent}.0D - 1e-9)"


def _near(percent: int) -> str:
    """Length filter and place bound for two rows x and y of a list, whichever is larger."""
    return f"100 * least(x_n, y_n) >= {percent} * greatest(x_n, y_n) and least(x_n - x_pos, y_n - y_pos) >= {_need(percent, 'x_n', 'y_n')}"


def _ordered(rows: DataFrame, *more: str) -> DataFrame:
    """Pairs of rows x and y as (a, b), the smaller set first."""
    first = F.struct("x_n", "x_doc_id") <= F.struct(F.col("y_n").alias("x_n"), F.col("y_doc_id").alias("x_doc_id"))
    pick = lambda c, d: F.when(first, F.col(c)).otherwise(F.col(d))
    return rows.select(pick("x_doc_id", "y_doc_id").alias("a"), pick("y_doc_id", "x_doc_id").alias("b"), *more)


def _with_hubs(listed: DataFrame, tried: DataFrame | None, percent: int, hubs: int = HUBS) -> DataFrame:
    """Pairs (a, b) of each document with hubs, of other components, of its lists.

    At most `hubs` for a document, those it meets in most lists; the last round takes all other pairs.
    """
    degrees = listed.groupBy("doc_id").agg(F.count("*").alias("degree"))
    known = listed.join(degrees, "doc_id")
    hub = known.groupBy("token").agg(F.max_by(F.struct("doc_id", "n", "pos", "component"), F.struct("degree", "doc_id")).alias("hub"))
    hub = common.written(hub, "list-hubs")  # as in `_mixed`
    rows = listed.join(hub, "token").where("component <> hub.component").selectExpr(
        "hub.doc_id x_doc_id", "hub.n x_n", "hub.pos x_pos", "doc_id y_doc_id", "n y_n", "pos y_pos").where(_near(percent))
    counts = rows.groupBy("x_doc_id", "x_n", "y_doc_id", "y_n").agg(F.count("*").alias("lists"))
    best = F.row_number().over(W.partitionBy("y_doc_id").orderBy(F.desc("lists"), "x_doc_id"))
    pairs = _ordered(counts.withColumn("rank", best).where(F.col("rank") <= hubs)).distinct()
    return pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti")


def _parities(rows: DataFrame) -> DataFrame:
    """doc_id and parity of each document that has one set; rows that share a doc_id may have several."""
    one = rows.where("n > 0 and doc_id is not null").groupBy("doc_id").agg(
        F.min("digest").alias("low"), F.max("digest").alias("high"), *(F.first(b).alias(b) for b in PARITY))
    return one.where("low = high").drop("low", "high")


_DIFFERENCE = " + ".join(f"bit_count(x_{b} ^ y_{b})" for b in PARITY)


def _between_components(placed: DataFrame, parities: DataFrame, tried: DataFrame | None, percent: int) -> DataFrame:
    """Candidate pairs (a no larger than b) of mixed lists whose documents are in different components, those components,
    and the number of bits in which their parities differ (0 where a parity is lacking)."""
    known = placed.join(parities, "doc_id", "left")
    # sets that link differ in (100 - percent) / (100 + percent) of their sizes at most
    fits = lambda x, y: f"coalesce((100 + {percent}) * ({_DIFFERENCE}) <= (100 - {percent}) * ({x} + {y}), true)"
    # components of a list are paired first, so that members of one component never meet; the smaller is x
    spans = known.groupBy("token", "component").agg(
        F.count("*").alias("docs"), F.min("n").alias("low"), F.max("n").alias("high"), F.max(F.col("n") - F.col("pos")).alias("reach"), *(F.first(b).alias(b) for b in PARITY))
    left, right = (spans.select("token", *(F.col(c).alias(f"{side}_{c}") for c in ("docs", "component", "low", "high", "reach", *PARITY))) for side in "xy")
    meet = left.join(right, "token").where(
        f"x_component <> y_component and (x_docs < y_docs or x_docs = y_docs and x_component < y_component) and 100 * x_high >= {percent} * y_low and 100 * y_high >= {percent} * x_low "
        f"and least(x_reach, y_reach) >= {_need(percent, 'x_low', 'y_low')} and (y_docs > 1 or {fits('x_low', 'y_low')})").select("token", "x_component", "y_component", "y_low", "y_high", "y_reach")
    side = lambda s: known.select("token", F.col("component").alias(f"{s}_component"), *(F.col(c).alias(f"{s}_{c}") for c in ("doc_id", "n", "pos", *PARITY)))
    # what a member of x must meet to fit any member of y
    may = (f"100 * x_n >= {percent} * y_low and 100 * y_high >= {percent} * x_n "
           f"and least(x_n - x_pos, y_reach) >= {_need(percent, 'x_n', 'y_low')}")
    one = meet.join(side("x"), ["token", "x_component"]).where(may).drop("y_low", "y_high", "y_reach")
    forth = one.join(side("y"), ["token", "y_component"]).where(f"{_near(percent)} and {fits('x_n', 'y_n')}")
    forth = forth.withColumn("bits", F.expr(f"coalesce({_DIFFERENCE}, 0)"))
    pairs = _ordered(forth, "bits", "x_component", "y_component", "x_doc_id")
    pairs = pairs.select("a", "b", "bits", *(F.expr(f"if(x_doc_id = {s}, x_component, y_component)").alias(f"{s}_component") for s in "ab")).distinct()
    return pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti")


def _closest(pairs: DataFrame) -> DataFrame:
    """Of the pairs, for each document and each other component the one of least difference."""
    forth = pairs.groupBy("a", "b_component").agg(F.min(F.struct("bits", "b")).alias("best")).select("a", "best.b")
    back = pairs.groupBy("b", "a_component").agg(F.min(F.struct("bits", "a")).alias("best")).select("best.a", "b")
    return forth.unionByName(back).distinct()


def _apart(pairs: DataFrame, joined: DataFrame) -> DataFrame:
    """The pairs (a, b) whose documents are still in different components."""
    for s in "ab":
        pairs = pairs.join(joined.select(F.col("node").alias(s), F.col("component").alias(f"{s}_now")), s, "left")
    return pairs.where("coalesce(a_now, a) <> coalesce(b_now, b)").select("a", "b").distinct()


def _bloom(ids: DataFrame, count: int) -> np.ndarray:
    """A Bloom filter over a column `id` of 16 bits for each: 64-bit words, one bit in each of two words."""
    size = 1 << max(10, (count // 4).bit_length())
    hashes = ids.select(F.explode(F.array(F.xxhash64("id"), F.xxhash64("id", F.lit(1)))).alias("h"))
    words = hashes.select(F.pmod(F.shiftright("h", 6), F.lit(size)).alias("w"), F.expr("shiftleft(1L, cast(h & 63L as int))").alias("bit"))
    table = words.groupBy("w").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(size, np.int64)
    out[table["w"].to_numpy()] = table["bits"].to_numpy()
    return out.view(np.uint64)


def _candidate_texts(docs: DataFrame, ids: DataFrame) -> tuple[DataFrame, np.ndarray | None]:
    """The documents to look at for these ids, and the Bloom filter that tells most others apart."""
    known = docs.where("doc_id is not null")
    count = ids.count()
    if count > BLOOM_IDS:
        return known.join(ids, known.doc_id == ids.id, "left_semi"), None
    return known, _bloom(ids, count)


def _sets(docs: DataFrame, ids: DataFrame, size: int, percent: int, orders: int, bits: int, ranks) -> DataFrame:
    """Shingle sets, and prefixes under the further orders as 32-bit hashes, of the documents with these ids
    and of a few that the Bloom filter lets pass."""
    docs, table = _candidate_texts(docs, ids)
    bloom = docs.sparkSession.sparkContext.broadcast(table)
    further = [f"p{k}" for k in range(1, orders)]

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = bloom.value
        for batch in batches:
            passed = np.ones(batch.num_rows, bool)
            for name in ("h0", "h1") if words is not None else ():
                h = batch.column(name).to_numpy()
                passed &= (words[(h >> 6) % len(words)] >> (h & 63).astype(np.uint64)) & np.uint64(1) > 0
            kept = batch.filter(pa.array(passed))
            for a in range(0, kept.num_rows, 64):  # sets of a few texts at a time
                part = kept.slice(a, 64)
                sets = list(shingle_sets(part.column("text"), size))
                others = [[(prefix(s, ranks.value[k], bits, k, percent) & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32) for s in sets] for k in range(1, orders)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())), *(pa.array(o, pa.list_(pa.int32())) for o in others)],
                    names=["doc_id", "shingles", *further])

    hashed = docs.select("doc_id", "text", F.xxhash64("doc_id").alias("h0"), F.xxhash64("doc_id", F.lit(1)).alias("h1"))
    return hashed.mapInArrow(make, "doc_id long, shingles array<long>" + "".join(f", {p} array<int>" for p in further))


def _verified(docs: DataFrame, pairs: DataFrame, size: int, percent: int, orders: int, bits: int, ranks) -> DataFrame:
    """Those of the pairs (a, b) that meet under every further order and then in fact."""
    spark = docs.sparkSession
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    sets = common.written(_sets(docs, ids, size, percent, orders, bits, ranks), "shingle-sets")
    side = lambda s, *names: sets.select(F.col("doc_id").alias(s), *(F.col(c).alias(f"{s}_{c}") for c in names))
    further = [f"p{k}" for k in range(1, orders)]
    meet = pairs.join(side("a", *further), "a").join(side("b", *further), "b")
    for p in further:
        meet = meet.where(F.arrays_overlap(f"a_{p}", f"b_{p}"))
    meet = common.written(meet.select("a", "b").distinct(), "shingle-candidates")
    whole = meet.join(side("a", "shingles"), "a").join(side("b", "shingles"), "b")
    same = F.size(F.array_intersect("a_shingles", "b_shingles"))
    out = whole.where(100 * same >= percent * (F.size("a_shingles") + F.size("b_shingles") - same)).select("a", "b").distinct()
    out = common.written(out, "shingle-links")
    for table in (sets, meet):
        common.discard(spark, table)
    return out


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One document of each linked group stays, that of the smallest doc_id; columns stay, whatever their names.

    Of rows that share a doc_id the one with the smallest text stays. Rows without a doc_id all stay.
    """
    groups = linked_groups(docs, size, percent).where("doc_id is not null")
    odd = groups.groupBy(F.col("doc_id").alias("odd_id")).agg(
        F.max((F.col("doc_id") != F.col("component_id")).cast("int")).alias("gone"), F.count("*").alias("n")).where("gone = 1 or n > 1")
    odd = common.written(odd.select("odd_id", "gone"), "shingle-odd-ids")
    place = [f"c{k}" for k in range(len(docs.columns))]
    at = dict(zip(docs.columns, place, strict=True))
    given = docs.toDF(*place).withColumn("id", F.col(at["doc_id"]).cast("long"))
    out = given.join(odd, F.col("id") == F.col("odd_id"), "left_anti")
    if not odd.where("gone = 0").isEmpty():
        several = given.join(odd.where("gone = 0").select("odd_id"), F.col("id") == F.col("odd_id"), "left_semi")
        first = F.row_number().over(W.partitionBy("id").orderBy(F.col(at["text"]).asc_nulls_last()))
        out = out.unionByName(several.withColumn("nth", first).where("nth = 1").drop("nth"))
    return out.select(*place).toDF(*docs.columns)
