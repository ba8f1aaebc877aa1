"""File formats, sinks and databases, all through Spark's reader and writer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

FORMATS = {"parquet": {}, "orc": {}, "json": {}, "csv": {"header": "true"}, "xml": {"rowTag": "row"}}


def write_files(df: DataFrame, path: str, kind: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.format(kind).options(**FORMATS[kind])
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def read_files(spark: SparkSession, path: str, kind: str, schema: StructType | str) -> DataFrame:
    """Typed reading: the schema is declared, never inferred."""
    return spark.read.format(kind).options(**FORMATS[kind]).schema(schema).load(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def read_binary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path)


def read_jdbc(spark: SparkSession, url: str, table: str, column: str | None = None, parts: int = 8, where: str | None = None, **options: str) -> DataFrame:
    """A table over JDBC; the driver's jar must be on the session's class path.

    With a `column` (named as the database holds it) of whole numbers, dates or times it is read in `parts` ranges of that column, one connection each, between the bounds that the database gives for the rows
    of `where`, which is in the database's own SQL; rows beyond bounds, or with a null, are in the outer ranges, so none is lost. Spark pushes filters, columns and limits to the database.
    An empty table, or one with nulls only, is read in one part.
    """
    source = f"(SELECT * FROM {table} WHERE {where}) rows_wanted" if where else table
    reader = spark.read.format("jdbc").options(url=url, **options)
    if column:
        name = spark._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(url).quoteIdentifier(column)
        ends = reader.option("dbtable", f"(SELECT MIN({name}) AS low, MAX({name}) AS high FROM {source}) bounds").load().first()
        if ends[0] is not None:
            reader = reader.options(partitionColumn=column, lowerBound=str(ends[0]), upperBound=str(ends[1]), numPartitions=parts)
    return reader.option("dbtable", source).load()


def write_jdbc(df: DataFrame, url: str, table: str, mode: str = "append", connections: int = 8, rows_a_batch: int = 10_000, **options: str) -> None:
    """Writes over at most `connections` connections, in batches of rows; a task that is run again may write its rows again, so load a table of its own and switch by name."""
    df.write.format("jdbc").mode(mode).options(url=url, dbtable=table, numPartitions=connections, batchsize=rows_a_batch, **options).save()


def read_external(spark: SparkSession, kind: str, **options: str) -> DataFrame:
    """Avro, Kafka and other connectors whose jars a cluster brings."""
    return spark.read.format(kind).options(**options).load()
