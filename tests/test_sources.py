"""The Python source and databases: what is pushed, how reading is split, and broken or empty input."""

import shutil
import uuid

import pytest
from pyspark.sql import functions as F

from kilnbase.sources import formats, parts
from kilnbase.sources.catalog import load
from kilnbase.streaming.events import run_append

SCHEMA = "id long, k string, v double"


@pytest.fixture
def folder(spark, tmp_path):
    parts.enable(spark)
    rows = spark.range(1000).selectExpr("id", "IF(id % 5 = 0, NULL, concat('k', id % 3)) k", "IF(id = 7, double('NaN'), double(id)) v", "id * 2 AS extra")
    rows.repartitionByRange(4, "id").write.option("parquet.block.size", "2000").parquet(f"{tmp_path}/t")
    return f"{tmp_path}/t"


def test_filters_are_pushed_and_rows_are_whole(spark, folder):
    read = lambda **o: spark.read.format(parts.NAME).schema(SCHEMA).options(path=folder, **o).load()
    plain = spark.read.parquet(folder).select("id", "k", "v")
    same = lambda a, b: sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))
    assert same(read(), plain) and same(read(slice_mb="0.001"), plain)
    assert read(slice_mb="0.001").rdd.getNumPartitions() > 4
    for where in ("id >= 900 AND k = 'k1'", "k IS NULL", "k IN ('k1', 'k2') AND id < 50", "v > 990.5", "NOT k = 'k1'", "id % 2 = 0 AND id <> 4", "k <=> NULL OR id = 3"):
        assert same(read().where(where), plain.where(where)), where
    found = read().where("id >= 900 AND k = 'k1'")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert found.count() > 0 and "Filter (" not in plan, plan
    scan = found._jdf.queryExecution().executedPlan()
    found.collect()
    assert plan.count("BatchScan") == 1 and scan.collectLeaves().head().metrics().apply("numOutputRows").value() <= 100


def test_the_stream_reads_new_files_only(spark, folder, tmp_path):
    stream = lambda: spark.readStream.format(parts.NAME).schema(SCHEMA).option("path", folder).load()
    assert run_append(stream(), "parts").count() == 1000
    out, log = f"{tmp_path}/out", f"{tmp_path}/log"
    run = lambda: stream().writeStream.format("parquet").option("path", out).option("checkpointLocation", log).trigger(availableNow=True).start().awaitTermination()
    run()
    spark.range(1000, 1010).selectExpr("id", "'new' k", "0.5D v").coalesce(1).write.parquet(f"{tmp_path}/more")
    shutil.copytree(f"{tmp_path}/more", f"{folder}/more", ignore=shutil.ignore_patterns("_*", ".*"), copy_function=shutil.copyfile)
    run()
    got = spark.read.parquet(out)
    assert got.count() == 1010 and got.where("k = 'new'").count() == 10 and got.select("id").distinct().count() == 1010


def test_an_empty_folder_and_no_schema(spark, tmp_path):
    parts.enable(spark)
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/none")
    assert spark.read.format(parts.NAME).schema(SCHEMA).option("path", f"{tmp_path}/none").load().count() == 0
    with pytest.raises(Exception, match="declare the schema"):
        spark.read.format(parts.NAME).option("path", f"{tmp_path}/none").load().count()


def test_orders_to_a_database_and_back_in_ranges(spark, sf_dir):
    url = f"jdbc:derby:memory:{uuid.uuid4().hex};create=true"
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    formats.write_jdbc(orders, url, "orders", rows_a_batch=500)
    back = formats.read_jdbc(spark, url, "orders", "o_orderkey", 4)
    assert back.columns == orders.columns
    assert back.rdd.getNumPartitions() == 4
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, orders.collect()))
    sizes = [r["count"] for r in back.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 4 and max(sizes) < 0.5 * sum(sizes)
    some = back.where("o_custkey < 20").select("o_orderkey")
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "LessThan(o_custkey,20)" in plan.split("PushedFilters")[1] and "o_totalprice" not in plan
    assert some.count() == orders.where("o_custkey < 20").count()
    assert formats.read_jdbc(spark, url, "orders", "o_orderkey", 4, where='"o_custkey" < 0').count() == 0
    part = formats.read_jdbc(spark, url, "orders", "o_orderkey", 3, where='"o_custkey" < 20')
    assert part.count() == some.count() and part.rdd.getNumPartitions() == 3
