"""Queries on the composed operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kilnbase.operators import frames, joins, scans, windows
from kilnbase.operators.quantiles import quantiles
from kilnbase.sources.catalog import load

from .registry import query


@query("""SELECT p.event_id, p.user_id, v.event_id AS match_event_id FROM (SELECT * FROM events WHERE event_type = 'purchase') p
    ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON p.user_id = v.user_id AND p.ts >= v.ts""")
def join_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = load(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    bought = events.where("event_type = 'purchase'").drop("event_type")
    seen = events.where("event_type = 'view'").drop("event_type")
    return joins.asof_join(bought, seen, "user_id", "ts", "ts", "event_id").select("event_id", "user_id", "match_event_id")


@query("""WITH s AS (SELECT o_orderkey, o_totalprice AS low, o_totalprice + 40 AS high FROM orders WHERE o_orderpriority = '1-URGENT')
    SELECT c_custkey, o_orderkey FROM customer JOIN s ON c_acctbal * 30 BETWEEN low AND high""")
def join_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = load(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select("o_orderkey", "o_totalprice")
    points = load(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    price = F.col("o_totalprice")
    return joins.range_join(points, spans, F.col("c_acctbal") * 30, price, price + 40).select("c_custkey", "o_orderkey")


@query("""SELECT a.event_id, b.event_id AS later_id FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'click' AND b.event_type = 'view'
    AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 6 HOUR""")
def join_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = load(spark, sf_dir, "events")
    clicks = events.where("event_type = 'click'").select("event_id", "user_id", "ts")
    views = events.where("event_type = 'view'").select(F.col("event_id").alias("later_id"), "user_id", F.col("ts").alias("later"))
    return joins.interval_join(clicks, views, "user_id", "ts", "later", "6 HOURS").select("event_id", "later_id")


@query("SELECT event_type, count(*) AS n FROM events e JOIN (SELECT DISTINCT user_id FROM events WHERE event_type = 'signup') u ON e.user_id = u.user_id GROUP BY event_type")
def join_salted(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = load(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    users = events.where("event_type = 'signup'").select("user_id").distinct()
    return joins.salted_join(events, users, ["user_id"], ["event_id"]).groupBy("event_type").agg(F.count("*").alias("n"))


@query("""WITH s AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts > lag(ts) OVER w + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS st FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    n AS (SELECT *, sum(st) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM s)
    SELECT user_id, session::BIGINT AS session, min(ts) AS started, max(ts) AS ended, count(*) AS n FROM n GROUP BY user_id, session""")
def win_sessionize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.sessionize(load(spark, sf_dir, "events"), "user_id", "ts", "event_id", "30 MINUTES")


@query("""SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 2""")
def topk_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = load(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return windows.top_k_by_group(orders, ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 2)


@query("SELECT p_brand, min(p_partkey) AS p_partkey FROM part GROUP BY p_brand")
def drop_duplicates_least(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.first_by_key(load(spark, sf_dir, "part").select("p_brand", "p_partkey"), ["p_brand"], F.col("p_partkey"))


@query("SELECT n_name AS name, NULL::DOUBLE AS balance FROM nation UNION ALL SELECT s_name, s_acctbal FROM supplier")
def union_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = load(spark, sf_dir, "nation").select(F.col("n_name").alias("name"))
    suppliers = load(spark, sf_dir, "supplier").select(F.col("s_acctbal").alias("balance"), F.col("s_name").alias("name"))
    return nations.unionByName(suppliers, allowMissingColumns=True).select("name", "balance")


@query("""SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, quantile_cont(l_quantity, 0.5) AS median, true AS hll_within, true AS sketch_within, true AS percentile_within
    FROM lineitem GROUP BY l_returnflag""")
def agg_approximate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact figures, and for each estimate whether it is within three standard errors (HLL), or at the rank asked for (percentile)."""
    lines = load(spark, sf_dir, "lineitem")
    by = "l_returnflag"
    # beside a distinct count Spark would keep every sketch once for each of the distinct values, and a median gathers its values
    found = lines.groupBy(by).agg(
        F.approx_count_distinct("l_partkey", 0.02).alias("hll"), F.hll_sketch_estimate(F.hll_sketch_agg("l_partkey", F.lit(12))).alias("sketch"),
        F.percentile_approx("l_quantity", 0.5, 1000).alias("guess"))
    exact = lines.groupBy(F.col(by).alias("_parts_of")).agg(F.count_distinct("l_partkey").alias("exact"))
    middle = quantiles(lines, by, "l_quantity", {"median": 0.5}).withColumnRenamed(by, "_median_of")
    found = found.join(exact, F.col(by).eqNullSafe(F.col("_parts_of"))).join(middle, F.col(by).eqNullSafe(F.col("_median_of")), "left")
    near = lambda c, share: F.abs(F.col(c) - F.col("exact")) <= share * F.col("exact") + 1
    return found.select("l_returnflag", F.col("exact").alias("parts"), "median", near("hll", 0.06).alias("hll_within"), near("sketch", 0.06).alias("sketch_within"),
                        (F.col("median").eqNullSafe(F.col("guess")) | (F.abs(F.col("median") - F.col("guess")) <= 1)).alias("percentile_within"))


@query()
def agg_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Theta and KLL sketches, a count-min sketch and approximate top-k; no other engine gives the same bits."""
    return load(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(
        F.expr("theta_sketch_estimate(theta_sketch_agg(l_partkey))").alias("parts"),
        F.expr("kll_sketch_get_quantile_bigint(kll_sketch_agg_bigint(l_partkey), 0.5D)").alias("median_part"),
        F.length(F.expr("count_min_sketch(l_suppkey, 0.01D, 0.95D, 7)")).alias("sketch_bytes"),
        F.expr("size(approx_top_k(l_linenumber, 3))").alias("heavy"))


@query("SELECT r_name, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def join_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hints by the DataFrame API. `region` has five rows at every scale, so it may be broadcast."""
    nation, region = load(spark, sf_dir, "nation"), load(spark, sf_dir, "region")
    return nation.join(F.broadcast(region), nation.n_regionkey == region.r_regionkey).groupBy("r_name").agg(F.count("*").alias("n"))


@query()
def sample_bernoulli(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "orders").sample(fraction=0.1, seed=3).select("o_orderkey")


@query("""SELECT p.event_id, v.event_id AS match_event_id FROM (SELECT * FROM events WHERE event_type = 'purchase') p
    ASOF LEFT JOIN (SELECT ts, max(event_id) AS event_id FROM events WHERE event_type = 'signup' GROUP BY ts) v ON p.ts >= v.ts""")
def join_asof_one_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last signup of anyone before each purchase: all rows are of one key, scanned in parts."""
    events = load(spark, sf_dir, "events").select(F.lit(0).alias("k"), "event_id", "ts", "event_type")
    bought, seen = (events.where(F.col("event_type") == t).drop("event_type") for t in ("purchase", "signup"))
    return scans.asof_join(bought, seen, "k", "ts", "ts", "event_id").select("event_id", "match_event_id")


@query("""WITH s AS (SELECT ts, CASE WHEN lag(ts) OVER w IS NULL OR ts > lag(ts) OVER w + INTERVAL 1 MINUTE THEN 1 ELSE 0 END AS st FROM events WINDOW w AS (ORDER BY ts, event_id)),
    n AS (SELECT *, sum(st) OVER (ORDER BY ts) AS session FROM s)
    SELECT session::BIGINT AS session, min(ts) AS started, max(ts) AS ended, count(*) AS n FROM n GROUP BY session""")
def win_sessionize_one_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spells of activity of the whole site: all rows are of one key, scanned in parts."""
    events = load(spark, sf_dir, "events").select(F.lit(0).alias("k"), "ts")
    return scans.sessionize(events, "k", "ts", "1 MINUTES").drop("k")


def _excluding(exclude: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        lines = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", F.col("l_quantity").cast("decimal(15,2)").alias("q"))
        out = frames.excluding(lines, ["l_orderkey"], ["l_quantity"], "q", exclude, 2, 1)
        return out.select("l_orderkey", "l_linenumber", "l_partkey", F.col("sum").cast("decimal(30,2)").alias("total"), F.col("count").alias("n"), F.col("min").alias("low"), F.col("max").alias("high"))

    run.__name__ = f"win_exclude_{exclude.lower().replace(' ', '_')}"
    return query(f"""SELECT l_orderkey, l_linenumber, l_partkey, (sum(q) OVER w)::DECIMAL(30,2) AS total, count(q) OVER w AS n, min(q) OVER w AS low, max(q) OVER w AS high
        FROM (SELECT *, l_quantity::DECIMAL(15,2) AS q FROM lineitem)
        WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_quantity GROUPS BETWEEN 2 PRECEDING AND 1 FOLLOWING EXCLUDE {exclude})""")(run)


for _exclude in ("CURRENT ROW", "GROUP", "TIES"):
    _excluding(_exclude)


@query("""SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.1), 6) AS p10, round(quantile_cont(l_extendedprice, 0.5), 6) AS med, round(quantile_cont(l_extendedprice, 0.999), 6) AS p999
    FROM lineitem GROUP BY l_returnflag""")
def agg_percentile_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact percentiles of three very large groups, found by rank in parts."""
    found = quantiles(load(spark, sf_dir, "lineitem"), "l_returnflag", "l_extendedprice", {"p10": 0.1, "med": 0.5, "p999": 0.999})
    return found.select("l_returnflag", *[F.round(c, 6).alias(c) for c in ("p10", "med", "p999")])
