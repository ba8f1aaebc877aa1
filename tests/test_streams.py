"""Streams over files and folders, late rows, and batches that are run again."""

import datetime as dt
import os
import shutil

import pytest
from pyspark.sql import functions as F

from kilnbase.plans import registry
from kilnbase.sources.scratch import shared_path
from kilnbase.streaming import events as E
from kilnbase.streaming import keyed

STREAMS = sorted(n for n in registry.QUERIES if n.startswith("st_"))


@pytest.fixture(scope="module")
def folders(spark, sf_dir, tmp_path_factory):
    """The tables with events as a folder of several files."""
    top = tmp_path_factory.mktemp("tables")
    spark.read.parquet(f"{sf_dir}/events.parquet").repartition(5).write.parquet(f"{top}/events.parquet")
    shutil.copy(f"{sf_dir}/customer.parquet", top)
    return str(top)


@pytest.mark.parametrize("name", STREAMS)
def test_a_folder_streams_as_a_file_does(spark, sf_dir, folders, name):
    assert len([f for f in os.listdir(f"{folders}/events.parquet") if f.endswith(".parquet")]) == 5
    of_file, of_folder = (sorted(map(tuple, registry.QUERIES[name](spark, d).collect())) for d in (sf_dir, folders))
    assert of_folder == of_file and of_file


def write_batches(spark, top, batches):
    """One file for each batch, in order of time of change."""
    os.makedirs(f"{top}/events.parquet")
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    for k, rows in enumerate(batches):
        spark.createDataFrame([(i, ts, u, "view", 1.0, "{}") for i, ts, u in rows], schema).coalesce(1).write.parquet(f"{top}/part{k}")
        name = next(f for f in os.listdir(f"{top}/part{k}") if f.endswith(".parquet"))
        shutil.move(f"{top}/part{k}/{name}", f"{top}/events.parquet/{k}.parquet")
        os.utime(f"{top}/events.parquet/{k}.parquet", (1_700_000_000 + k, 1_700_000_000 + k))
    return str(top)


def at(hours):
    return dt.datetime(2024, 1, 1) + dt.timedelta(hours=hours)


def test_rows_beyond_the_watermark_are_dropped_and_closed_windows_are_emitted(spark, tmp_path):
    # batch 3 holds a row of hour 1 and one of hour 15; the watermark it goes by is that of batch 1, hour 20 less the delay
    top = write_batches(spark, tmp_path, [[(1, at(1), 1), (2, at(2), 1)], [(3, at(20), 1)], [(8, at(20), 1)], [(4, at(1), 1), (5, at(15), 1)], [(6, at(60), 1)], [(7, at(61), 1)]])
    stream = lambda late: E.tumbling(E.event_stream(spark, top, late, files_per_batch=1), "1 hour").select("start", "n")
    got = {r["start"]: r["n"] for r in E.run_append(stream("8 hours"), "late").collect()}
    assert got == {at(1): 1, at(2): 1, at(20): 2, at(15): 1}
    got = {r["start"]: r["n"] for r in E.run_append(stream("40 hours"), "late").collect()}
    assert got == {at(1): 2, at(2): 1, at(20): 2, at(15): 1}


def test_upserts_keep_the_last_event_of_each_user(spark, tmp_path):
    top = write_batches(spark, tmp_path, [[(1, at(5), 1), (2, at(2), 2)], [(3, at(4), 1), (4, at(3), 2)], [(5, at(3), 2)]])
    got = {r["user_id"]: r["event_id"] for r in E.latest_by_user(E.event_stream(spark, top, files_per_batch=1), "upsert").collect()}
    assert got == {1: 1, 2: 5}


def test_duplicates_within_the_watermark_go(spark, tmp_path):
    top = write_batches(spark, tmp_path, [[(1, at(1), 1), (1, at(1), 1)], [(1, at(2), 1), (2, at(2), 1)]])
    got = E.run_append(E.deduplicated(E.event_stream(spark, top, files_per_batch=1)), "dedup")
    assert sorted(r["event_id"] for r in got.collect()) == [1, 2]
    assert got.where(F.col("user_id") != 1).isEmpty()


def test_an_upsert_killed_before_its_commit_goes_on_and_writes_what_it_touches(spark, tmp_path, monkeypatch):
    users = range(200)
    batches = [[(u, at(1), u) for u in users], [(1000, at(5), 3), (1001, at(4), 3)], [(2000, at(9), 7), (2001, at(0), 8)], [(3000, at(9), 9)]]
    top = write_batches(spark, tmp_path, batches)
    table, log = E.latest_table(spark, shared_path(spark, "killed"), 64), shared_path(spark, "killed-log")
    write, failed = keyed.KeyedTable._commit, []

    def once(self, number, versions):
        if number == 1 and not failed:
            failed.append(number)
            raise RuntimeError("killed")
        write(self, number, versions)

    monkeypatch.setattr(keyed.KeyedTable, "_commit", once)
    with pytest.raises(Exception, match="killed"):
        keyed.upsert(E.event_stream(spark, top, files_per_batch=1), table, log)
    assert table.last() == 0 and table.read().count() == 200
    keyed.upsert(E.event_stream(spark, top, files_per_batch=1), table, log)
    want = {u: u for u in users} | {3: 1000, 7: 2000, 9: 3000}
    assert {r["user_id"]: r["event_id"] for r in table.read().collect()} == want and table.last() == 3
    assert spark.read.parquet(f"{table.path}/rows/version=3").count() < 20  # of 200 keys, those of one bucket of 64
    assert sorted(os.listdir(f"{table.path}/commits")) == ["n=2", "n=3"]
    assert keyed.upsert(E.event_stream(spark, top, files_per_batch=1), table, log).last() == 3


def test_an_empty_keyed_table(spark):
    table = E.latest_table(spark, shared_path(spark, "none"))
    assert table.last() == -1 and table.read().isEmpty()
