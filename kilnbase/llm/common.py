"""What the operators share: the shared folder, written tables, table access."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kilnbase.sources.scratch import shared_top

_WRITTEN: list[str] = []


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_top(spark)}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` written to the shared folder and read again: cuts lineage, survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, df: DataFrame) -> None:
    """Deletes the files behind a table made by `written`, once nothing reads them any more."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def sweep(spark: SparkSession) -> None:
    """Deletes every intermediate table of this process; call it when all results are stored."""
    while _WRITTEN:
        remove(spark, _WRITTEN.pop())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: Bytes and rows of an Arrow batch: texts may be long.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}


def bound_batches(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches in rows and bytes, for an application whose session it is."""
    for k, v in BATCH.items():
        spark.conf.set(k, v)


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Within, Arrow batches are bounded in rows and bytes; afterwards the caller's settings hold again.

    A plan follows the settings of the moment it runs, so operators write their results within.
    """
    before = {k: spark.conf.get(k, None) for k in BATCH}
    bound_batches(spark)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def narrowed(counts) -> bytes:
    """Counts as little-endian unsigned numbers of the least sufficient width, which comes first."""
    width = next(w for w in (1, 2, 4, 8) if w == 8 or int(counts.max(initial=0)) < 1 << 8 * w)
    return bytes([width]) + counts.astype(f"<u{width}").tobytes()


def widened(data):
    """The counts that `narrowed` wrote, as int64."""
    import numpy as np

    raw = np.frombuffer(data, np.uint8)
    return raw[1:].view(f"<u{raw[0]}").astype(np.int64)


def summed(parts: DataFrame) -> DataFrame:
    """Adds up rows (name string, block int, part int, counts binary) by (name, block); counts are `narrowed`.

    In three levels, by `part`, by 256 parts, then all: no task adds
    more than a few hundred rows, whatever the number of tasks that counted.
    """
    import pyarrow as pa

    def add(table):
        total = None
        for c in table["counts"]:
            total = widened(c.as_buffer()) if total is None else total + widened(c.as_buffer())
        names = [n for n in ("name", "block", "part") if n in table.column_names]
        return pa.table([*(table[n].slice(0, 1) for n in names), pa.array([narrowed(total)], pa.binary())], names=[*names, "counts"])

    schema = "name string, block int, part int, counts binary"
    fewer = parts.groupBy("name", "block", "part").applyInArrow(add, schema)
    fewer = fewer.withColumn("part", F.expr("cast(part div 256 as int)")).groupBy("name", "block", "part").applyInArrow(add, schema)
    return fewer.drop("part").groupBy("name", "block").applyInArrow(add, "name string, block int, counts binary")


def ranked(df: DataFrame, keys: list[str], order: list[str], name: str = "rank", rows: int | None = None, per_bucket: int = 50_000) -> DataFrame:
    """Adds the rank, from 0 and without gaps, of each row among those with equal `keys`.

    Rows are numbered within hash buckets of `order`, and buckets are offset by a running sum, so a key that
    a third of all rows share is spread over many tasks. Ranks ascend with `order` within a bucket only. The
    same rows in `df` must come back when it is read twice: give it a written table.
    """
    from pyspark.sql import Window as W

    count = df.count() if rows is None else rows
    least = min(count, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    buckets = max(1, least, -(-count // per_bucket))
    dealt = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    sizes = dealt.groupBy(*keys, "_bucket").agg(F.count("*").alias("_n"))
    over = W.partitionBy(*keys).orderBy("_bucket") if keys else W.orderBy("_bucket")
    offsets = sizes.withColumn("_before", F.sum("_n").over(over) - F.col("_n")).drop("_n")
    inner = dealt.withColumn("_rank", F.row_number().over(W.partitionBy(*keys, "_bucket").orderBy(*order)) - 1)
    joined = inner.join(offsets, [*keys, "_bucket"])
    return joined.withColumn(name, (F.col("_rank") + F.col("_before")).cast("long")).drop("_rank", "_before", "_bucket")
