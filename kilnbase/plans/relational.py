"""Relational queries in SQL over the star schema: projection, joins, aggregation, windows, sets."""

from __future__ import annotations

from .registry import sql_query

sql_query("q1_pricing_summary", "lineitem", """
    SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS DECIMAL(15,2))) AS DECIMAL(30,2)) AS sum_qty,
           CAST(sum(CAST(l_extendedprice AS DECIMAL(15,2)) * (1 - CAST(l_discount AS DECIMAL(15,2)))) AS DECIMAL(30,4)) AS sum_disc_price,
           round(avg(l_discount), 6) AS avg_disc, count(*) AS count_order
    FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus""")

sql_query("q3_shipping_priority", "customer orders lineitem", """
    SELECT l_orderkey, CAST(sum(CAST(l_extendedprice AS DECIMAL(15,2)) * (1 - CAST(l_discount AS DECIMAL(15,2)))) AS DECIMAL(30,4)) AS revenue, o_orderdate
    FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
    WHERE c_mktsegment = 'BUILDING' AND o_orderdate < TIMESTAMP '1998-03-15 00:00:00' AND l_shipdate > TIMESTAMP '1998-03-15 00:00:00'
    GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, l_orderkey LIMIT 10""")

sql_query("q5_revenue_by_nation", "customer orders lineitem supplier nation region", """
    SELECT n_name, CAST(sum(CAST(l_extendedprice AS DECIMAL(15,2)) * (1 - CAST(l_discount AS DECIMAL(15,2)))) AS DECIMAL(30,4)) AS revenue
    FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
    JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey
    JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY n_name""")

sql_query("q6_forecast_revenue", "lineitem", """
    SELECT CAST(sum(CAST(l_extendedprice AS DECIMAL(15,2)) * CAST(l_discount AS DECIMAL(15,2))) AS DECIMAL(30,4)) AS revenue
    FROM lineitem WHERE l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24""")

sql_query("project_computed", "lineitem", """
    SELECT l_orderkey, l_linenumber, l_partkey, CAST(CAST(l_extendedprice AS DECIMAL(15,2)) * (1 - CAST(l_discount AS DECIMAL(5,2))) * (1 + CAST(l_tax AS DECIMAL(5,2))) AS DECIMAL(30,6)) AS charge FROM lineitem""")
sql_query("filter_predicates", "part", """
    SELECT p_partkey, p_brand, p_size FROM part
    WHERE p_size BETWEEN 5 AND 25 AND p_brand IN ('Brand#11', 'Brand#12', 'Brand#23', 'Brand#33') AND NOT p_name LIKE '%50!%%' ESCAPE '!'""")
sql_query("filter_rlike", "supplier", "SELECT s_suppkey, s_name FROM supplier WHERE s_name RLIKE '[02468]$'",
          "SELECT s_suppkey, s_name FROM supplier WHERE regexp_matches(s_name, '[02468]$')")
sql_query("filter_null_safe", "nation supplier", """
    SELECT n_nationkey, s_suppkey, (CASE WHEN n_nationkey > 12 THEN n_nationkey END <=> CASE WHEN s_nationkey > 12 THEN s_nationkey END) AS same
    FROM nation JOIN supplier ON n_regionkey = s_suppkey % 5""", """
    SELECT n_nationkey, s_suppkey, (CASE WHEN n_nationkey > 12 THEN n_nationkey END IS NOT DISTINCT FROM CASE WHEN s_nationkey > 12 THEN s_nationkey END) AS same
    FROM nation JOIN supplier ON n_regionkey = s_suppkey % 5""")
sql_query("case_when", "customer", """
    SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 5000 THEN 'low' ELSE 'high' END AS band FROM customer""")
sql_query("in_subquery", "orders customer", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 9000)")
sql_query("exists_subquery", "customer orders", """
    SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)""")
sql_query("not_in_with_null", "nation", """
    SELECT n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT CASE WHEN n_nationkey > 3 THEN n_nationkey END FROM nation)""")
sql_query("scalar_subquery", "part", """
    SELECT p_partkey, p_retailprice FROM part p WHERE p_retailprice > (SELECT avg(q.p_retailprice) FROM part q WHERE q.p_brand = p.p_brand)""")
sql_query("lateral_subquery", "nation customer", """
    SELECT n_name, t.n_cust FROM nation, LATERAL (SELECT count(*) AS n_cust FROM customer WHERE c_nationkey = n_nationkey) t""")
sql_query("cte_chain", "orders", """
    WITH y AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey), m AS (SELECT max(n) AS top FROM y)
    SELECT o_custkey, n FROM y JOIN m ON n = top""")
sql_query("recursive_cte", "region", """
    WITH RECURSIVE t(k, path) AS (
        SELECT r_regionkey, CAST(r_name AS STRING) FROM region UNION ALL SELECT k + 5, concat(path, '/', CAST(k AS STRING)) FROM t WHERE k < 20
    ) SELECT k, path FROM t""", """
    WITH RECURSIVE t(k, path) AS (
        SELECT r_regionkey, r_name::VARCHAR FROM region UNION ALL SELECT k + 5, concat(path, '/', k::VARCHAR) FROM t WHERE k < 20
    ) SELECT k, path FROM t""")
sql_query("pivot_counts", "lineitem", """
    SELECT * FROM (SELECT l_returnflag, l_linestatus FROM lineitem) PIVOT (count(*) FOR l_linestatus IN ('O' AS open, 'F' AS final))""", """
    SELECT l_returnflag, count(*) FILTER (WHERE l_linestatus = 'O') AS open, count(*) FILTER (WHERE l_linestatus = 'F') AS final FROM lineitem GROUP BY 1""")
sql_query("unpivot_columns", "supplier", """
    SELECT s_suppkey, what, v FROM (SELECT s_suppkey, CAST(s_nationkey AS DOUBLE) AS nation, s_acctbal AS balance FROM supplier)
    UNPIVOT (v FOR what IN (nation, balance))""")
sql_query("pipe_syntax", "orders", "FROM orders |> WHERE o_totalprice > 200000 |> AGGREGATE count(*) AS n GROUP BY o_orderstatus",
          "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_totalprice > 200000 GROUP BY 1")

# joins
sql_query("join_inner", "orders customer", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'MACHINERY'")
for kind in ("left", "right", "full"):
    sql_query(f"join_{kind}", "customer orders", f"""
        SELECT c_custkey, o_orderkey FROM (SELECT * FROM customer WHERE c_acctbal > 2000) c
        {kind.upper()} JOIN (SELECT * FROM orders WHERE o_totalprice > 100000) o ON c_custkey = o_custkey""")
sql_query("join_semi", "orders lineitem", "SELECT o_orderkey FROM orders LEFT SEMI JOIN lineitem ON o_orderkey = l_orderkey",
          "SELECT o_orderkey FROM orders SEMI JOIN lineitem ON o_orderkey = l_orderkey")
sql_query("join_anti", "orders lineitem", "SELECT o_orderkey FROM orders LEFT ANTI JOIN lineitem ON o_orderkey = l_orderkey",
          "SELECT o_orderkey FROM orders ANTI JOIN lineitem ON o_orderkey = l_orderkey")
sql_query("join_cross", "region nation", "SELECT r_name, n_name FROM region CROSS JOIN nation")
sql_query("join_theta", "nation region", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey > r_regionkey")
sql_query("join_self", "supplier", "SELECT a.s_suppkey AS x, b.s_suppkey AS y FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey")
sql_query("join_merge_hint", "lineitem part", "SELECT /*+ MERGE(part) */ p_brand, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand",
          "SELECT p_brand, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand")
# nation has 25 rows at every scale, so it may be broadcast
sql_query("join_broadcast_hint", "customer nation", "SELECT /*+ BROADCAST(nation) */ n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name",
          "SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
sql_query("join_replicate_hint", "nation region", "SELECT /*+ SHUFFLE_REPLICATE_NL(region) */ n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey",
          "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
sql_query("join_shuffle_hash_hint", "orders customer", "SELECT /*+ SHUFFLE_HASH(customer) */ c_mktsegment, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment",
          "SELECT c_mktsegment, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment")

# aggregation
sql_query("agg_basic", "orders", """
    SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 4) AS mean, min(o_totalprice) AS low, max(o_totalprice) AS high
    FROM orders GROUP BY o_orderpriority""")
sql_query("agg_distinct", "lineitem", "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, sum(DISTINCT l_linenumber) AS lines FROM lineitem GROUP BY l_returnflag",
          "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, sum(DISTINCT l_linenumber)::BIGINT AS lines FROM lineitem GROUP BY l_returnflag")
sql_query("agg_filter", "lineitem", "SELECT l_linestatus, count(*) FILTER (WHERE l_discount > 0.05) AS n FROM lineitem GROUP BY l_linestatus")
sql_query("agg_statistics", "lineitem", """
    SELECT l_returnflag, round(stddev(l_quantity), 6) AS sd, round(var_pop(l_quantity), 6) AS vp, round(corr(l_quantity, l_extendedprice), 6) AS r,
           round(covar_samp(l_quantity, l_tax), 6) AS cs, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2
    FROM lineitem GROUP BY l_returnflag""")
sql_query("agg_moments", "lineitem", "SELECT l_returnflag, round(skewness(l_extendedprice), 6) AS skew, round(kurtosis(l_extendedprice), 6) AS kurt FROM lineitem GROUP BY l_returnflag", """
    WITH m AS (SELECT l_returnflag, avg(l_extendedprice) AS mu FROM lineitem GROUP BY 1),
    p AS (SELECT l.l_returnflag, avg(pow(l_extendedprice - mu, 2)) m2, avg(pow(l_extendedprice - mu, 3)) m3, avg(pow(l_extendedprice - mu, 4)) m4
          FROM lineitem l JOIN m ON l.l_returnflag = m.l_returnflag GROUP BY 1)
    SELECT l_returnflag, round(m3 / pow(m2, 1.5), 6) AS skew, round(m4 / (m2 * m2) - 3, 6) AS kurt FROM p""")
sql_query("agg_percentile", "orders", "SELECT o_orderstatus, percentile(o_totalprice, 0.25) AS q1, median(o_totalprice) AS med FROM orders GROUP BY o_orderstatus",
          "SELECT o_orderstatus, quantile_cont(o_totalprice, 0.25) AS q1, median(o_totalprice) AS med FROM orders GROUP BY o_orderstatus")
sql_query("agg_mode", "lineitem", "SELECT l_returnflag, mode(n) AS top FROM (SELECT l_returnflag, 1 AS n FROM lineitem UNION ALL SELECT l_returnflag, 2 FROM lineitem WHERE l_tax > 0.05) GROUP BY l_returnflag")
sql_query("agg_argmax", "orders", "SELECT o_custkey, max_by(o_orderkey, struct(o_totalprice, o_orderkey)) AS dearest, min_by(o_orderkey, struct(o_totalprice, o_orderkey)) AS cheapest FROM orders GROUP BY o_custkey",
          "SELECT o_custkey, arg_max(o_orderkey, {'a': o_totalprice, 'b': o_orderkey}) AS dearest, arg_min(o_orderkey, {'a': o_totalprice, 'b': o_orderkey}) AS cheapest FROM orders GROUP BY o_custkey")
sql_query("agg_bool_bit", "lineitem", "SELECT l_returnflag, bool_and(l_quantity > 0) AS every_one, bool_or(l_tax > 0.07) AS any_one, bit_and(l_linenumber) AS ba, bit_or(l_linenumber) AS bo, bit_xor(l_linenumber) AS bx FROM lineitem GROUP BY l_returnflag")
sql_query("agg_collect", "nation", "SELECT n_regionkey, sort_array(collect_list(n_name)) AS names, size(collect_set(n_name)) AS n FROM nation GROUP BY n_regionkey",
          "SELECT n_regionkey, list_sort(list(n_name)) AS names, len(list(DISTINCT n_name))::INTEGER AS n FROM nation GROUP BY n_regionkey")
sql_query("agg_listagg", "nation", "SELECT n_regionkey, listagg(n_name, ',') WITHIN GROUP (ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey",
          "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
sql_query("agg_grouping_sets", "lineitem", """
    SELECT l_returnflag, l_linestatus, CAST(grouping(l_returnflag) AS INT) AS g, count(*) AS n FROM lineitem
    GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())""")
sql_query("agg_rollup", "orders", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
sql_query("agg_cube", "orders", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
sql_query("agg_having", "orders", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 15")

# windows
sql_query("win_rank", "customer", """
    SELECT c_custkey, row_number() OVER w AS rn, rank() OVER v AS rk, dense_rank() OVER v AS dr, round(percent_rank() OVER v, 6) AS pr,
           round(cume_dist() OVER v, 6) AS cd, ntile(4) OVER w AS nt FROM customer
    WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey), v AS (PARTITION BY c_nationkey ORDER BY c_mktsegment)""", """
    SELECT c_custkey, (row_number() OVER w)::INTEGER AS rn, (rank() OVER v)::INTEGER AS rk, (dense_rank() OVER v)::INTEGER AS dr, round(percent_rank() OVER v, 6) AS pr,
           round(cume_dist() OVER v, 6) AS cd, (ntile(4) OVER w)::INTEGER AS nt FROM customer
    WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey), v AS (PARTITION BY c_nationkey ORDER BY c_mktsegment)""")
sql_query("win_offset", "orders", """
    SELECT o_orderkey, lag(o_orderkey) OVER w AS before, lead(o_orderkey, 2) OVER w AS after, first_value(o_orderkey) OVER w AS first_key,
           nth_value(o_orderkey, 2) OVER w AS second_key FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
sql_query("win_ignore_nulls", "orders", """
    SELECT o_orderkey, last_value(CASE WHEN o_totalprice > 250000 THEN o_orderkey END) IGNORE NULLS OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS last_big FROM orders""",
    """SELECT o_orderkey, last_value(CASE WHEN o_totalprice > 250000 THEN o_orderkey END IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS last_big FROM orders""")
sql_query("win_rows_frame", "orders", """
    SELECT o_orderkey, CAST(sum(CAST(o_totalprice AS DECIMAL(15,2))) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS DECIMAL(30,2)) AS moving FROM orders""")
sql_query("win_range_frame", "events", """
    SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS n FROM events""",
    """SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS n FROM events""")
sql_query("win_groups_frame", "orders", """
    WITH d AS (SELECT o_orderkey, o_custkey, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderdate) AS g FROM orders)
    SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY g RANGE BETWEEN 1 PRECEDING AND CURRENT ROW) AS n FROM d""",
    """SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW) AS n FROM orders""")
sql_query("win_running_sum", "lineitem", """
    SELECT l_orderkey, l_linenumber, l_partkey, CAST(sum(CAST(l_quantity AS DECIMAL(15,2))) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS DECIMAL(30,2)) AS running FROM lineitem""")
sql_query("win_qualify", "orders", """
    SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn = 1""",
    "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1")

# sort, limit, top-k
sql_query("sort_nulls", "customer", """
    SELECT c_custkey, b FROM (SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS b FROM customer) ORDER BY b ASC NULLS LAST, c_custkey LIMIT 100 OFFSET 20""")
sql_query("topk_global", "orders", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
sql_query("topk_group", "part", """
    SELECT p_brand, p_partkey, rn FROM (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rn FROM part) WHERE rn <= 3""",
    """SELECT p_brand, p_partkey, rn::INTEGER AS rn FROM (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rn FROM part) WHERE rn <= 3""")

# sets
_A, _B = "SELECT l_suppkey AS k FROM lineitem WHERE l_quantity > 45", "SELECT s_suppkey AS k FROM supplier WHERE s_acctbal > 0"
for name, op in (("union_all", "UNION ALL"), ("union_distinct", "UNION"), ("intersect", "INTERSECT"), ("intersect_all", "INTERSECT ALL"), ("except", "EXCEPT"), ("except_all", "EXCEPT ALL")):
    sql_query(f"set_{name}", "lineitem supplier", f"{_A} {op} {_B}")
sql_query("set_distinct", "lineitem", "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem")
