"""Stream queries, run to the end of the table, with the batch SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kilnbase.sources.catalog import load
from kilnbase.streaming import closing as C
from kilnbase.streaming import events as E

from .registry import query


@query("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def st_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.run_complete(E.tumbling(E.event_stream(spark, sf_dir), "1 day"), "st-tumbling")


@query("""SELECT start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM (
    SELECT time_bucket(INTERVAL 12 HOUR, ts) - o * INTERVAL 12 HOUR AS start, event_type, value FROM events, (VALUES (0), (1)) t(o)) GROUP BY 1, 2""")
def st_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.run_complete(E.tumbling(E.event_stream(spark, sf_dir), "1 day", "12 hours"), "st-sliding")


@query("""WITH s AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts > lag(ts) OVER w + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS st FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    n AS (SELECT *, sum(st) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM s)
    SELECT min(ts) AS started, user_id, count(*) AS n FROM n GROUP BY user_id, session""")
def st_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.run_complete(E.sessions(E.event_stream(spark, sf_dir), "30 minutes"), "st-session")


@query("SELECT DISTINCT event_id, user_id FROM events")
def st_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.run_append(E.deduplicated(E.event_stream(spark, sf_dir)), "st-dedup")


@query("""SELECT a.event_id AS click_id, b.event_id AS view_id FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'click' AND b.event_type = 'view'
    AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 6 HOUR""")
def st_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.run_append(E.click_then_view(E.event_stream(spark, sf_dir), E.event_stream(spark, sf_dir), "6 HOURS"), "st-join")


@query("SELECT event_id, c_mktsegment FROM events JOIN customer ON user_id = c_custkey")
def st_static_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = load(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return E.run_append(E.with_customer(E.event_stream(spark, sf_dir), customers), "st-static")


@query("SELECT user_id, max_by(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id")
def st_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A keyed table kept up to date with foreachBatch."""
    return E.latest_by_user(E.event_stream(spark, sf_dir, files_per_batch=1), "st-upsert").select("user_id", "event_id")


@query("SELECT user_id, count(*) AS n FROM events GROUP BY user_id")
def st_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arbitrary keyed state; the last totals of each user. The state store is RocksDB's, as it demands."""
    key, provider = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(key, None)
    spark.conf.set(key, provider)
    try:
        totals = E.running_totals(E.event_stream(spark, sf_dir))
        out = E.run_updates(totals, "st-state")
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)
    return out.groupBy("user_id").agg(F.max("n").alias("n"))


@query("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE ts IS NOT NULL GROUP BY 1, 2")
def st_closed_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each day's counts, emitted once when the day closes; the whole table comes again later, and all of it is late."""
    return C.replayed(spark, load(spark, sf_dir, "events"), lambda s: C.by_window(s, "1 day"), "st-closed-tumbling").rows()


@query("""WITH s AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts > lag(ts) OVER w + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS st FROM events WHERE ts IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    n AS (SELECT *, sum(st) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM s)
    SELECT min(ts) AS started, user_id, count(*) AS n FROM n GROUP BY user_id, session""")
def st_closed_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each session, emitted once when it can grow no more; a replay of the table is late."""
    return C.replayed(spark, load(spark, sf_dir, "events"), lambda s: C.by_session(s, "30 minutes"), "st-closed-session").rows()


@query("""WITH h AS (SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY 1, 2)
    SELECT date_trunc('day', hour) AS start, event_type, max(n) AS most, count(*) AS windows FROM h GROUP BY 1, 2""")
def st_closed_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The busiest hour of each day: hourly windows flow into daily ones, both closed by one watermark."""
    return C.replayed(spark, load(spark, sf_dir, "events"), lambda s: C.busiest(s, "1 hour", "1 day"), "st-closed-chain").rows()
