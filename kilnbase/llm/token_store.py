"""Token ids in binary files with keyed access through a minimal perfect hash index.

Format. A store is a folder. `*.ids` files are raw little-endian ids, nothing else: uint16 where
the vocabulary fits, uint32 otherwise; their documents follow in ascending (doc_id, text hash),
within a file and from file to file. `index` is a Parquet table of hash buckets; each holds one
minimal perfect hash over its keys and, addressed by it, arrays of fingerprint, file, offset and
length. A key is a doc_id and, for repeated doc_ids, the number of the repeat. Access by key is:
bucket, bit, rank, fingerprint, one range read.

A store is complete when its `manifest` is there, which is written last and names what `open_store` needs, so later
jobs read what an earlier one wrote. `get` reads one document on the driver: a bucket of the index and a range of a file.

Scale. One range shuffle of the texts; encoding and writing are one pass, a file for a task.
File offsets, not texts, go to the index, whose buckets are of bounded size. The driver holds one
row for each file. A file is renamed into place when complete, and only the files of the task
attempts whose rows were committed are listed, so lost executors leave no partial store. `path` is a folder
that all executors share: a plain path or a URI that pyarrow's file systems open (file, hdfs, s3, gs).

Edge cases. doc_id of any whole-number type: taken as long. Keys that the index lacks make `read` fail, or are
left out if it is told so. Null or empty text: the end id alone. Null doc_id: stored first, readable by key
None. Repeated rows: each is stored; keys (doc_id, 0), (doc_id, 1), ... Empty table: a store with
no files. Further columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .mph import MinimalPerfectHash, document_keys, fingerprints
from .word_encoder import encoder

KEYS_PER_BUCKET = 100_000
BUCKETS_PER_GROUP = 64
INDEX = "bucket int, body binary"
MANIFEST = "dtype string, buckets int, file struct<shard: int, name: string, n: long, before: long>"
ENTRY = "doc_id long, shard int, file string, offset long, n_tokens long, repeat long"


def _filesystem(path: str):
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and "://" not in path else path)
    return fs.LocalFileSystem(), path


@dataclass
class TokenStore:
    path: str
    dtype: str
    files: list[tuple[int, str, int, int]]  # shard, file, ids in it, ids before it
    index: DataFrame
    buckets: int


def write(spark: SparkSession, docs: DataFrame, vocabulary: str, path: str, end_id: int = 2,
          keys_per_bucket: int = KEYS_PER_BUCKET) -> TokenStore:
    """Encodes `docs` (doc_id, text), writes the id files and the index below `path`."""
    dtype = "<u2" if encoder(vocabulary).vocab_size <= 1 << 16 else "<u4"
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    # Equal doc_ids with different texts may be dealt out; sorting makes offsets ascend with doc_id.
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)

    def encode_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _write_file(batches, vocabulary, end_id, dtype, path)

    (_filesystem(path)[0]).create_dir(_filesystem(path)[1], recursive=True)
    entries = ordered.mapInArrow(encode_partition, ENTRY)
    with common.small_batches(spark):
        entries.write.parquet(f"{path}/entries")
    entries = spark.read.schema(entries.schema).parquet(f"{path}/entries")

    files, carried = _files(entries)
    entries = _with_global_repeats(spark, entries, carried)
    count = sum(f[4] for f in files)
    buckets = max(1, -(-count // keys_per_bucket))
    index = _bucketed(entries, buckets).groupBy("bucket").applyInArrow(_build_bucket, INDEX)
    # neighbouring buckets lie in one file, in order, so reading one bucket touches one row group
    index.repartition(F.expr(f"bucket div {BUCKETS_PER_GROUP}")).sortWithinPartitions("bucket").write.parquet(f"{path}/index")
    spark.createDataFrame([(dtype, buckets, f[:4]) for f in files] or [(dtype, buckets, None)], MANIFEST).coalesce(1).write.parquet(f"{path}/manifest")
    return open_store(spark, path)


def open_store(spark: SparkSession, path: str) -> TokenStore:
    """The store that `write` left at `path`."""
    rows = spark.read.schema(MANIFEST).parquet(f"{path}/manifest").collect()
    files = sorted(tuple(r["file"]) for r in rows if r["file"] is not None)
    return TokenStore(path, rows[0]["dtype"], files, spark.read.schema(INDEX).parquet(f"{path}/index"), rows[0]["buckets"])


def _bucketed(keys: DataFrame, buckets: int) -> DataFrame:
    """`_bucket_of` as an expression."""
    return keys.withColumn("bucket", F.pmod(F.xxhash64(F.col("doc_id").cast("long"), F.col("repeat").cast("long")), F.lit(buckets)).cast("int"))


def _bucket_of(doc_id: int | None, repeat: int, buckets: int) -> int:
    seed = 42
    for value in (doc_id, repeat):
        if value is not None:
            seed = xxhash.xxh64(struct.pack("<q", value), seed=seed).intdigest()
    return (seed - (1 << 64) if seed >> 63 else seed) % buckets


def get(store: TokenStore, doc_id: int | None, repeat: int = 0) -> np.ndarray | None:
    """Ids of one document, read on the driver; None if the index lacks the key."""
    rows = store.index.where(F.col("bucket") == _bucket_of(doc_id, repeat, store.buckets)).toArrow()
    keys = pa.table({"doc_id": pa.array([doc_id], pa.int64()), "repeat": pa.array([repeat], pa.int64())})
    place = _lookup_bucket(keys, rows).to_pylist()[0]
    if not place["found"]:
        return None
    system, root = _filesystem(store.path)
    width, name = np.dtype(store.dtype).itemsize, next(f for s, f, _, _ in store.files if s == place["shard"])
    with system.open_input_file(f"{root}/{name}") as source:
        return np.frombuffer(source.read_at(place["n_tokens"] * width, place["offset"] * width), store.dtype).astype("<u4")


def _write_file(batches, vocabulary: str, end_id: int, dtype: str, path: str):
    words, end = encoder(vocabulary), np.array([end_id], dtype).tobytes()
    system, root = _filesystem(path)
    shard, name = TaskContext.get().partitionId(), ""
    out, offset, last, repeat = None, 0, object(), 0
    for batch in batches:
        lengths, repeats = [], []
        ids = batch.column(0).to_pylist()
        for doc_id, text in zip(ids, batch.column(1), strict=True):
            if out is None:
                name = f"part-{shard:06d}-{uuid.uuid4().hex}.ids"
                out = system.open_output_stream(f"{root}/_{name}")
            tokens = np.frombuffer(words.encode(text.as_py()), "<u4")
            out.write(tokens.astype(dtype).tobytes() + end)
            repeat = repeat + 1 if doc_id == last else 0
            last = doc_id
            lengths.append(len(tokens) + 1)
            repeats.append(repeat)
        n = np.array(lengths, np.int64)
        starts = offset + np.cumsum(n) - n
        offset += int(n.sum())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(np.full(len(n), shard, np.int32)), pa.array([name] * len(n), pa.string()),
             pa.array(starts), pa.array(n), pa.array(repeats, pa.int64())],
            names=["doc_id", "shard", "file", "offset", "n_tokens", "repeat"])
    if out is not None:
        out.close()
        system.move(f"{root}/_{name}", f"{root}/{name}")


def _files(entries: DataFrame):
    """One row for each file, with the ids before it; and what repeats carry over a file's start."""
    key = F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id")
    rows = (
        entries.groupBy("shard", "file")
        .agg(F.sum("n_tokens").alias("n"), F.count("*").alias("docs"), F.min(key).alias("first"), F.max(key).alias("last"),
             F.max_by("repeat", F.col("offset")).alias("last_repeat"))
        .collect()
    )
    files, carried, before = [], [], 0
    previous, repeats = None, 0
    for r in sorted(rows, key=lambda r: r["shard"]):
        carry = repeats if previous is not None and previous == r["first"] else 0
        if carry:
            carried.append((r["shard"], r["first"]["doc_id"], carry))
        files.append((r["shard"], r["file"], r["n"], before, r["docs"]))
        before += r["n"]
        repeats = r["last_repeat"] + 1 + (carry if r["first"] == r["last"] else 0)
        previous = r["last"]
    return files, carried


def _with_global_repeats(spark: SparkSession, entries: DataFrame, carried: list) -> DataFrame:
    if not carried:
        return entries
    more = spark.createDataFrame(carried, "shard int, carried_id long, carry long")
    joined = entries.join(more, "shard", "left")
    same = F.col("doc_id").eqNullSafe(F.col("carried_id")) & F.col("carry").isNotNull()
    return joined.select("doc_id", "shard", "file", "offset", "n_tokens",
                         (F.col("repeat") + F.when(same, F.col("carry")).otherwise(0)).alias("repeat"))


def _columns(table: pa.Table):
    ids = table["doc_id"]
    return (
        np.asarray(ids.fill_null(0).to_numpy(), np.int64),
        np.asarray(ids.is_null().to_numpy(), bool),
        np.asarray(table["repeat"].to_numpy(), np.int64),
    )


def _build_bucket(table: pa.Table) -> pa.Table:
    keys = document_keys(*_columns(table))
    hashed = MinimalPerfectHash.build(keys)
    at = hashed.number(keys)
    slots = np.zeros(hashed.size, [("print", "<u4"), ("shard", "<u4"), ("offset", "<u8"), ("n", "<u4")])
    slots["print"][at] = fingerprints(keys)
    slots["shard"][at] = table["shard"].to_numpy()
    slots["offset"][at] = table["offset"].to_numpy()
    slots["n"][at] = table["n_tokens"].to_numpy()
    body = hashed.to_bytes() + slots.tobytes()
    return pa.table({"bucket": table["bucket"].slice(0, 1), "body": pa.array([body], pa.binary())})


def _lookup_bucket(keys: pa.Table, index: pa.Table) -> pa.Table:
    if not len(keys):
        return LOCATED.empty_table()
    number = document_keys(*_columns(keys))
    slots = np.zeros(len(keys), [("print", "<u4"), ("shard", "<u4"), ("offset", "<u8"), ("n", "<u4")])
    known = np.zeros(len(keys), bool)
    if len(index):
        body = index["body"][0].as_buffer().to_pybytes()
        hashed, used = MinimalPerfectHash.from_bytes(body)
        at = hashed.number(number)
        stored = np.frombuffer(body, slots.dtype, hashed.size, used)
        slots = stored[np.maximum(at, 0)]
        known = (at >= 0) & (slots["print"] == fingerprints(number))
    found = pa.array(known)
    take = lambda name, kind: pa.array(slots[name].astype(kind), mask=~known)
    return pa.table([keys["doc_id"].combine_chunks(), keys["repeat"].combine_chunks(), found,
                     take("shard", np.int32), take("offset", np.int64), take("n", np.int64)], schema=LOCATED)


LOCATED = pa.schema([("doc_id", pa.int64()), ("repeat", pa.int64()), ("found", pa.bool_()),
                     ("shard", pa.int32()), ("offset", pa.int64()), ("n_tokens", pa.int64())])
LOCATED_SQL = "doc_id long, repeat long, found boolean, shard int, offset long, n_tokens long"


def locate(store: TokenStore, keys: DataFrame) -> DataFrame:
    """Where each key (doc_id, repeat) lies; `found` is false for keys that the index lacks.

    A stranger passes for a key with a chance of 2^-32, the fingerprint's.
    """
    keyed = _bucketed(keys.select(F.col("doc_id").cast("long"), F.col("repeat").cast("long")), store.buckets)
    return keyed.groupBy("bucket").cogroup(store.index.groupBy("bucket")).applyInArrow(_lookup_bucket, LOCATED_SQL)


def read(store: TokenStore, keys: DataFrame, digest_only: bool = False, strangers: bool = False) -> DataFrame:
    """Ids of the documents with these keys, read from the id files through the index.

    A key that the index lacks makes the job fail, or is left out if `strangers` are allowed. Rows are sorted by place before reading, so each task walks through its files. Returns
    doc_id, repeat, start (ids of all documents before it), n_tokens, ids_crc32 and, unless
    `digest_only`, ids as array<int>.
    """
    spark = keys.sparkSession
    places = spark.createDataFrame([(s, f, b) for s, f, _, b in store.files], "shard int, file string, before long")
    lacking = F.lit(False) if strangers else F.raise_error(F.concat(F.lit("the index lacks key "), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit("/"), F.col("repeat").cast("string"))).cast("boolean")
    found = locate(store, keys).where(F.when(F.col("found"), True).otherwise(lacking)).join(places, "shard")
    ordered = found.repartition("shard", F.floor(F.col("offset") / (1 << 24))).sortWithinPartitions("shard", "offset")
    path, dtype = store.path, store.dtype
    schema = "doc_id long, repeat long, start long, n_tokens long, ids_crc32 long" + ("" if digest_only else ", ids array<int>")

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _filesystem(path)
        width, name, source = np.dtype(dtype).itemsize, None, None
        for batch in batches:
            row = batch.to_pydict()
            sums, ids, starts = [], [], []
            for file, before, offset, n in zip(row["file"], row["before"], row["offset"], row["n_tokens"], strict=True):
                if file != name:
                    name, source = file, system.open_input_file(f"{root}/{file}")
                tokens = np.frombuffer(source.read_at(n * width, offset * width), dtype).astype("<u4")
                sums.append(zlib.crc32(tokens))
                starts.append(before + offset)
                ids.append(None if digest_only else tokens.astype(np.int32))
            arrays = [batch.column("doc_id"), batch.column("repeat"), pa.array(starts, pa.int64()),
                      batch.column("n_tokens"), pa.array(sums, pa.int64())]
            names = ["doc_id", "repeat", "start", "n_tokens", "ids_crc32"]
            if not digest_only:
                arrays, names = [*arrays, pa.array(ids, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return ordered.mapInArrow(slices, schema)


def keys_of(docs: DataFrame, stretch: int = 10_000) -> DataFrame:
    """The keys (doc_id, repeat) that a store of `docs` has."""
    counted = docs.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.count("*").alias("copies"))
    # a doc_id of very many rows is spelled out stretch by stretch
    starts = counted.select("doc_id", "copies", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(stretch).cast("long"))).alias("start"))
    return starts.select("doc_id", F.explode(F.sequence("start", F.least(F.col("start") + stretch, "copies") - 1)).alias("repeat"))
