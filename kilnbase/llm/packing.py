"""Best-two-fit packing of token runs into sequences of a fixed capacity.

Method. Only lengths matter to packing, and there are at most `capacity` of them. The driver packs
the histogram of lengths: it fills a bin greedily with the longest run that still fits; then it
takes out the bin's smallest run and looks for the two unpacked runs that fill the widened gap
most tightly; they take its place if they fill it better. The finished bin is a pattern, repeated
for as many bins as the counts allow, since its choices stay the same until one of its lengths
runs out. So the plan of any number of documents is a table whose size depends on the capacity
alone, and it is the plan that bin-by-bin packing would give. Each run then finds its bin by its
rank among the runs of its length.

Scale. Ranks are counted within (length, hash bucket) and offset by a running sum over buckets, so a
length that a third of all runs share is spread over many tasks. The plan is broadcast: at
most some ten thousand rows by the bound above.

Edge cases. Null or empty text: the end id alone. Documents beyond the capacity: pieces of the
capacity, the last may be shorter. Repeated rows are packed each. Null doc_ids are kept. Empty
table: no rows. Further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .word_encoder import ROOM, encoder

RUNS_PER_BUCKET = 50_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Patterns [(bins, [(length, runs of it in each bin), ...] longest first), ...]."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} does not fit a bin of {capacity}")
        left[length] = n
    patterns = []
    while left.any():
        used, most = _fill(left, capacity)
        bins = int(min(left[length] // n for length, n in most.items()))
        for length, n in used.items():
            left[length] -= n * bins
        patterns.append((bins, sorted(used.items(), reverse=True)))
    return patterns


def _fill(left: np.ndarray, capacity: int) -> tuple[dict[int, int], dict[int, int]]:
    """One bin: its runs by length, and the most of each length it held at any moment."""
    left, used, most, gap = left.copy(), {}, {}, capacity

    def put(length: int, n: int) -> None:
        nonlocal gap
        left[length] -= n
        gap -= n * length
        used[length] = used.get(length, 0) + n
        most[length] = max(most.get(length, 0), used[length])

    while gap > 0:
        fits = np.flatnonzero(left[: gap + 1])
        if not len(fits):
            break
        longest = int(fits[-1])
        put(longest, int(min(left[longest], gap // longest)))
    if gap > 0 and used:
        smallest = min(used)
        wide = gap + smallest
        present = np.flatnonzero(left[: wide + 1])
        if len(present):
            partner = np.searchsorted(present, wide - present, side="right") - 1
            a, b = present, present[np.maximum(partner, 0)]
            possible = (partner >= 0) & ((a != b) | (left[a] >= 2))
            # where a run would be its own partner and is alone, the next shorter one may serve
            alone = (partner > 0) & (a == b) & (left[a] < 2)
            b = np.where(alone, present[np.maximum(partner - 1, 0)], b)
            possible |= alone
            total = np.where(possible, a + b, 0)
            best = int(total.argmax())
            if total[best] > smallest:
                put(smallest, -1)
                put(int(a[best]), 1)
                put(int(b[best]), 1)
    return {k: n for k, n in used.items() if n}, most


def pack(runs: DataFrame, capacity: int, key: list[str], runs_per_bucket: int = RUNS_PER_BUCKET) -> DataFrame:
    """`runs` (a written table with `length` and the columns of `key`) with sequence_id and offset."""
    spark = runs.sparkSession
    histogram = {r["length"]: r["n"] for r in runs.groupBy("length").agg(F.count("*").alias("n")).collect()}
    placed = common.ranked(runs, ["length"], key, "rank", rows=sum(histogram.values()), per_bucket=runs_per_bucket)

    # Every length's runs lie one after the other on a line; each pattern owns stretches of it.
    base, at = {}, 0
    for length in sorted(histogram):
        base[length] = at
        at += histogram[length]
    cursor, stretches, first = dict(base), [], 0
    for bins, parts in plan(histogram, capacity):
        offset = 0
        for length, n in parts:
            stretches.append((cursor[length], first, n, offset))
            cursor[length] += n * bins
            offset += n * length
        first += bins
    shared = spark.sparkContext.broadcast((base, np.array(sorted(stretches), np.int64).reshape(-1, 4)))
    schema = placed.drop("rank").schema.add("sequence_id", "long").add("offset", "long")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, table = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            length = batch.column("length").to_numpy()
            line = np.array([base[x] for x in length.tolist()], np.int64) + batch.column("rank").to_numpy()
            row = table[np.searchsorted(table[:, 0], line, side="right") - 1]
            nth = line - row[:, 0]
            names = [n for n in batch.schema.names if n != "rank"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in names), pa.array(row[:, 1] + nth // row[:, 2]), pa.array(row[:, 3] + nth % row[:, 2] * length)],
                names=[*names, "sequence_id", "offset"])

    return placed.mapInArrow(place, schema)


def pieces(docs: DataFrame, vocabulary: str, capacity: int, end_id: int = 0, room: int = ROOM) -> DataFrame:
    """Documents (doc_id, text) encoded, ended and cut at the capacity; digests in place of ids."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, end = encoder(vocabulary, room), np.array([end_id], "<u4").tobytes()
        step = 4 * capacity
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = words.encode(text.as_py()) + end
                for k in range(0, len(ids), step):
                    part = ids[k : k + step]
                    rows.append((doc_id, k // step, k // 4, len(part) // 4, zlib.crc32(part)))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                                             names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, PIECES)


def pack_documents(spark: SparkSession, docs: DataFrame, vocabulary: str, capacity: int = 2048, end_id: int = 0, room: int = ROOM) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    `room`: bytes that a worker may take to remember encoded words.
    """
    with common.small_batches(spark):
        runs = common.written(pieces(docs, vocabulary, capacity, end_id, room), "packing-pieces")
    out = pack(runs, capacity, ["doc_id", "piece", "ids_crc32"])
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
