"""A keyed table that micro-batches are merged into: hash buckets, and a log of commits that says which version of each bucket counts.

Batch k rewrites the buckets that its keys fall in, as `rows/version=k/bucket=b`, and then writes commit k: for every bucket, the version that counts. Readers go by the last
commit, so they see whole batches only. A batch that was stopped before its commit is merged again from commit k - 1 and replaces what it had left; one that was
committed is passed over. So a stream that is killed and started again from its checkpoint gives the same rows. Commit k then deletes commit k - 2 and the buckets
that only that one named; a reader of the commit before the last is not disturbed.

Scale. Bytes written follow the buckets touched, not the table: choose so many that one is a file's worth. The driver holds a number for each bucket. Keys of
one bucket are merged by an aggregate with partial sums, so a key that fills a batch is reduced before it is shuffled.

One stream writes a table. Rows with a null in the order column count as the oldest; a null key is a key; of rows that are equal in order any one stays, so the order
should tell rows apart. No batches: an empty table.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kilnbase.operators.windows import first_by_key
from kilnbase.sources.scratch import discard, is_there


@dataclass(frozen=True)
class KeyedTable:
    spark: SparkSession
    path: str
    schema: str
    keys: tuple[str, ...]
    first: Callable[[], Column]  # of the rows of a key the least under this order stays
    buckets: int = 32

    def commit(self, number: int) -> dict[int, int]:
        """Bucket and version, of commit `number`; empty before the first."""
        if number < 0:
            return {}
        return {r["bucket"]: r["version"] for r in self.spark.read.schema("bucket int, version long").parquet(self._log(number)).collect()}

    def last(self) -> int:
        """Number of the last commit, -1 if there is none."""
        if not is_there(self.spark, f"{self.path}/commits"):
            return -1
        found = self.spark.read.schema("bucket int, version long, n long").parquet(f"{self.path}/commits").agg(F.max("n")).first()[0]
        return -1 if found is None else found

    def read(self) -> DataFrame:
        return self._rows(self.commit(self.last())).drop("bucket", "version")

    def merge(self, batch: DataFrame, number: int) -> None:
        """For `foreachBatch`."""
        if is_there(self.spark, f"{self._log(number)}/_SUCCESS"):
            return
        kept = batch.select(*self._names(), F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int").alias("bucket")).persist()
        try:
            touched = [r["bucket"] for r in kept.select("bucket").distinct().collect()]
            before = self.commit(number - 1)
            old = self._rows({b: before[b] for b in touched if b in before}).select(*kept.columns)
            merged = first_by_key(kept.unionByName(old), ["bucket", *self.keys], self.first())
            merged.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/rows/version={number}")
        finally:
            kept.unpersist()
        self._commit(number, before | dict.fromkeys(touched, number))
        self._clear(number)

    def _commit(self, number: int, versions: dict[int, int]) -> None:
        rows = self.spark.createDataFrame(sorted(versions.items()), "bucket int, version long")
        rows.coalesce(1).write.mode("overwrite").parquet(self._log(number))

    def _clear(self, number: int) -> None:
        if number < 2 or not is_there(self.spark, self._log(number - 2)):
            return
        gone = self.commit(number - 2).items() - self.commit(number - 1).items()
        for bucket, version in gone:
            discard(self.spark, f"{self.path}/rows/version={version}/bucket={bucket}")
        discard(self.spark, self._log(number - 2))

    def _rows(self, versions: dict[int, int]) -> DataFrame:
        schema = f"{self.schema}, version long, bucket int"
        if not versions:
            return self.spark.createDataFrame([], schema)
        paths = [f"{self.path}/rows/version={v}/bucket={b}" for b, v in sorted(versions.items())]
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/rows").parquet(*paths)

    def _names(self) -> list[str]:
        return [c.name for c in self.spark.createDataFrame([], self.schema).schema]

    def _log(self, number: int) -> str:
        return f"{self.path}/commits/n={number}"


def upsert(stream: DataFrame, table: KeyedTable, log: str) -> KeyedTable:
    """Merges all that the stream holds by now; begun again with the same `log` it goes on where it was."""
    query = stream.writeStream.outputMode("append").option("checkpointLocation", log).trigger(availableNow=True).foreachBatch(table.merge).start()
    query.awaitTermination()
    return table
