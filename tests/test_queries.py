"""Every registered query with SQL gives DuckDB's rows."""

import pytest
from pyspark.sql import functions as F
from oracle import assert_same, database

from kilnbase.plans import registry


@pytest.fixture(scope="module")
def db(sf_dir):
    return database(sf_dir)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, sf_dir, db, name):
    assert_same(registry.QUERIES[name](spark, sf_dir), db, registry.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_without_sql_runs(spark, sf_dir, name):
    got = registry.QUERIES[name](spark, sf_dir).collect()
    if name == "sample_bernoulli":
        whole = spark.read.parquet(f"{sf_dir}/orders.parquet").count()
        assert 0.05 * whole < len(got) < 0.15 * whole and got == registry.QUERIES[name](spark, sf_dir).collect()
    elif name == "agg_sketches":
        lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
        exact = {r["l_returnflag"]: r["n"] for r in lines.groupBy("l_returnflag").agg(F.count_distinct("l_partkey").alias("n")).collect()}
        middle = {r["l_returnflag"]: r["m"] for r in lines.groupBy("l_returnflag").agg(F.median("l_partkey").alias("m")).collect()}
        assert {r["l_returnflag"] for r in got} == set(exact)
        for r in got:
            assert abs(r["parts"] - exact[r["l_returnflag"]]) <= 0.1 * exact[r["l_returnflag"]] + 1
            assert abs(r["median_part"] - middle[r["l_returnflag"]]) <= 0.1 * middle[r["l_returnflag"]] + 1
            assert r["sketch_bytes"] > 0 and r["heavy"] == 3
    else:
        raise AssertionError(f"{name} has neither SQL nor a check")


def test_a_wrong_type_fails(spark, db):
    with pytest.raises(AssertionError):
        assert_same(spark.sql("SELECT 1.0D AS x"), db, "SELECT 1 AS x")


def test_hints_take_effect(spark, sf_dir):
    plan = lambda name: registry.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan("join_broadcast_hint") and "SortMergeJoin" in plan("join_merge_hint")
    assert "CartesianProduct" in plan("join_replicate_hint") and "ShuffledHashJoin" in plan("join_shuffle_hash_hint")


def test_a_wrong_oracle_fails(spark, sf_dir, db):
    with pytest.raises(AssertionError):
        assert_same(registry.QUERIES["set_distinct"](spark, sf_dir), db, registry.ORACLES["set_distinct"] + " LIMIT 1")


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
