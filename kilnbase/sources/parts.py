"""A Python data source over folders of Parquet files, batch and stream: `format("parquet_parts")`.

Option `path`: a file or a folder, in any store that Arrow opens by its address; `slice_mb` (64): files are read in slices of about so much. The
schema is to be declared. Planning lists the files and their sizes and opens none: slice j of n of a file is every n-th of its row groups from the j-th on, found
when the slice is read. So the driver holds a row for each slice, and a task one row group.

Comparisons with constants, IN and null tests on plain columns are pushed: row groups whose statistics rule them out are not read, and of the rest only the rows that
hold are handed over. What cannot be pushed is left to Spark. Pushing must be on (`enable`), as Spark leaves it off by default.

As a stream its offset is the last file by (time of change, name), and a batch is the files after the one offset up to the other. One writer at a time may add
files, in order of time; a file that comes with an earlier time than one already read is not seen.

Empty folders and files give no rows. Names that begin with `_` or `.` are no tables. Files must have the declared columns; others are not read, and types are cast. Nulls are kept.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql import datasource as D
from pyspark.sql.types import StructType

NAME = "parquet_parts"
COMPARISONS = {D.EqualTo: "__eq__", D.GreaterThan: "__gt__", D.GreaterThanOrEqual: "__ge__", D.LessThan: "__lt__", D.LessThanOrEqual: "__le__"}


def enable(spark: SparkSession) -> None:
    """Registers the source and turns the pushing of filters to Python sources on for the session."""
    spark.dataSource.register(ParquetParts)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


class Slice(D.InputPartition):
    def __init__(self, path: str, part: int, parts: int):
        self.path, self.part, self.parts = path, part, parts


def opened(path: str):
    """Arrow's file system and the path within it."""
    from pyarrow import fs

    if path.startswith("file:") or "://" not in path:
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path)


def files(path: str) -> list[tuple[int, str, int]]:
    """Time of change, path and bytes of each file, in order."""
    from pyarrow import fs

    store, top = opened(path)
    info = store.get_file_info(top)
    found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(top, recursive=True))
    return sorted((f.mtime_ns or 0, f.path, f.size) for f in found
                  if f.type == fs.FileType.File and not any(p[:1] in "_." for p in os.path.relpath(f.path, os.path.dirname(top)).split("/")[1:]))


def condition(pushed: D.Filter):
    """The filter as Arrow's expression; None where it cannot be one."""
    import pyarrow.dataset as ds

    if isinstance(pushed, D.Not):
        inner = condition(pushed.child)
        return None if inner is None else ~inner
    if len(getattr(pushed, "attribute", ())) != 1:
        return None
    column = ds.field(pushed.attribute[0])
    if isinstance(pushed, D.IsNotNull):
        return column.is_valid()
    if isinstance(pushed, D.IsNull):
        return column.is_null()
    if isinstance(pushed, D.In) and None not in pushed.value:
        return column.isin(list(pushed.value))
    # NaN is greater than all numbers to Spark and to none for Arrow: such comparisons stay with Spark
    if type(pushed) in COMPARISONS and not isinstance(pushed.value, float):
        return getattr(column, COMPARISONS[type(pushed)])(pushed.value)
    return None


class _Slices:
    """What batch and stream readers share."""

    def __init__(self, schema: StructType, options: dict):
        self.schema, self.path = schema, options["path"]
        self.slice_bytes = int(float(options.get("slice_mb", "64")) * 2**20)
        self.pushed: list[D.Filter] = []

    def slices(self, found: list[tuple[int, str, int]]) -> list[D.InputPartition]:
        out = []
        for _, path, size in found:
            parts = max(1, -(-size // self.slice_bytes))
            out += [Slice(path, k, parts) for k in range(parts)]
        return out

    def read(self, partition: Slice) -> Iterator:
        import pyarrow.dataset as ds
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(self.schema)
        keep = None
        for f in self.pushed:
            keep = condition(f) if keep is None else keep & condition(f)
        store, _ = opened(self.path)
        whole = ds.ParquetFileFormat().make_fragment(partition.path, filesystem=store)
        for group in whole.split_by_row_group(keep) if keep is not None else whole.split_by_row_group():
            if group.row_groups[0].id % partition.parts == partition.part:
                for batch in group.to_batches(columns=target.names, filter=keep, batch_size=8192, batch_readahead=0, fragment_readahead=0):
                    if batch.num_rows:
                        yield batch.cast(target)


class ParquetParts(D.DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        raise ValueError(f"{NAME}: declare the schema")

    def reader(self, schema: StructType) -> D.DataSourceReader:
        return _Batch(schema, self.options)

    def streamReader(self, schema: StructType) -> D.DataSourceStreamReader:
        return _Stream(schema, self.options)


class _Batch(_Slices, D.DataSourceReader):
    def pushFilters(self, filters: list[D.Filter]) -> Iterable[D.Filter]:
        for f in filters:
            if condition(f) is None:
                yield f
            else:
                self.pushed.append(f)

    def partitions(self) -> list[D.InputPartition]:
        return self.slices(files(self.path)) or [Slice("", 0, 0)]

    def read(self, partition: Slice) -> Iterator:
        return super().read(partition) if partition.parts else iter(())


class _Stream(_Slices, D.DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"time": -1, "file": ""}

    def latestOffset(self) -> dict:
        found = files(self.path)
        return {"time": found[-1][0], "file": found[-1][1]} if found else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[D.InputPartition]:
        low, high = ((o["time"], o["file"]) for o in (start, end))
        return self.slices([f for f in files(self.path) if low < f[:2] <= high])

    def commit(self, end: dict) -> None:
        pass
