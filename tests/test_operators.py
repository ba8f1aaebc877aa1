"""Composed operators on small tables with nulls, ties and empty sides."""

import datetime as dt

from pyspark.sql import functions as F

from kilnbase.functions import text as T
from kilnbase.operators import frames, graph, joins, scans, windows
from kilnbase.operators.quantiles import quantiles


def test_asof_ties_nulls_and_strict(spark):
    left = spark.createDataFrame([(1, "a", 10), (2, "a", 5), (3, "b", 7), (4, None, 7)], "id int, k string, t int")
    right = spark.createDataFrame([(11, "a", 5), (12, "a", 10), (13, "a", 10), (14, "c", 1)], "rid int, k string, t int")
    got = {r["id"]: r["match_rid"] for r in joins.asof_join(left, right, "k", "t", "t", "rid").collect()}
    assert got == {1: 13, 2: 11, 3: None, 4: None}
    got = {r["id"]: r["match_rid"] for r in joins.asof_join(left, right, "k", "t", "t", "rid", strict=True).collect()}
    assert got == {1: 11, 2: None, 3: None, 4: None}


def test_range_join_equals_nested_loop(spark):
    points = spark.createDataFrame([(k, float(k * 7 % 50)) for k in range(40)] + [(99, None)], "p int, x double")
    spans = spark.createDataFrame([(k, float(k * 3 % 40), float(k * 3 % 40 + k % 9)) for k in range(30)] + [(77, None, 3.0), (78, 9.0, 1.0)], "s int, a double, b double")
    got = joins.range_join(points, spans, F.col("x"), F.col("a"), F.col("b")).select("p", "s").collect()
    want = points.join(spans, F.expr("x between a and b")).select("p", "s").collect()
    assert sorted(got) == sorted(want) and got


def test_range_join_plan_has_no_nested_loop(spark):
    points, spans = spark.range(1000).selectExpr("id p", "double(id) x"), spark.range(1000).selectExpr("id s", "double(id) a", "double(id + 3) b")
    plan = joins.range_join(points, spans, F.col("x"), F.col("a"), F.col("b"))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_range_join_of_very_short_and_very_long_spans(spark):
    top = 10**9
    points = spark.createDataFrame([(k, float(k * k * 7919 % top)) for k in range(300)] + [(900, -0.5), (901, float("nan")), (902, float("inf")), (903, 1e300)], "p int, x double")
    spans = [(k, float(k * k * 7919 % top), float(k * k * 7919 % top + 10 ** (k % 10))) for k in range(300)]
    spans += [(900, float("-inf"), float("inf")), (901, 5.0, 5.0), (902, -1e308, 1e308), (903, float("nan"), 1.0), (904, -1.0, 0.0), (905, 0.0, float("nan"))]
    spans = spark.createDataFrame(spans, "s int, a double, b double")
    joined = joins.range_join(points, spans, F.col("x"), F.col("a"), F.col("b"))
    want = [(p, s) for p, x in points.collect() for s, a, b in spans.collect() if a <= x <= b]
    assert sorted((r["p"], r["s"]) for r in joined.select("p", "s").collect()) == sorted(want) and len(want) > 3000
    assert joins.range_join(points, spans.limit(0), F.col("x"), F.col("a"), F.col("b")).isEmpty()
    whole = points.selectExpr("p", "cast(9007199254740993 + p as decimal(20,0)) x"), spans.selectExpr("s", "cast(9007199254740993 + s as decimal(20,0)) a")
    got = joins.range_join(*whole, F.col("x"), F.col("a"), F.col("a")).select("p", "s").collect()
    assert got and all(r["p"] == r["s"] for r in got) and len(got) == 304


def test_a_span_gives_few_rows(spark):
    spans = spark.range(2000).selectExpr("double(id * 7919 % 1000003) a", "double(id * 7919 % 1000003 + power(10, id % 10)) b")
    lines = joins.range_join(spark.range(0).selectExpr("double(id) x"), spans, F.col("x"), F.col("a"), F.col("b"))._jdf.queryExecution().analyzed().toString()
    assert "sequence(" not in lines
    level = joins.span_level(F.col("a"), F.col("b"))
    assert spans.select(level).distinct().count() <= 31
    cells = spans.select(level.alias("k"), "a", "b").selectExpr("floor(b / power(2, k)) - floor(a / power(2, k)) + 1 n")
    assert cells.agg(F.max("n")).first()[0] <= 2


def test_sessionize_boundary(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [("u", t, 1), ("u", t + dt.timedelta(minutes=30), 2), ("u", t + dt.timedelta(minutes=61), 3), ("u", None, 4)]
    got = windows.sessionize(spark.createDataFrame(rows, "k string, ts timestamp, id int"), "k", "ts", "id", "30 MINUTES").collect()
    assert sorted(r["n"] for r in got) == [1, 2]


def test_scans_of_one_key_are_spread_and_equal_the_plain_ones(spark):
    rows = spark.range(4000).selectExpr("case when id % 4 > 0 then 'hot' when id % 8 = 0 then null else concat('k', id % 40) end k",
                                        "timestamp_seconds(1700000000 + (id * 7919 % 3001) * 60) ts", "id")
    rows = rows.withColumn("ts", F.when(F.col("id") % 97 > 0, F.col("ts")))
    left, right = rows.where("id % 3 = 0"), rows.where("id % 3 = 1")
    plain = joins.asof_join(left, right.where("k IS NOT NULL AND ts IS NOT NULL"), "k", "ts", "ts", "id").collect()
    got = scans.asof_join(left, right, "k", "ts", "ts", "id").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, plain), key=repr)
    for gap in ("1 MINUTES", "3 MINUTES"):
        plain = windows.sessionize(rows, "k", "ts", "id", gap).collect()
        got = scans.sessionize(rows, "k", "ts", gap).collect()
        assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, plain), key=repr)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = scans.dealt(rows, "k", "ts").where("k = 'hot'").groupBy("_part").count().collect()
        got = scans.sessionize(rows, "k", "ts", "3 MINUTES").collect()
        assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, plain), key=repr)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert len(parts) >= 3 and max(r["count"] for r in parts) < 2000


def test_quantiles_are_those_of_percentile(spark):
    df = spark.range(3000).selectExpr("case when id % 3 > 0 then 'hot' when id % 9 = 0 then null else concat('k', id % 7) end k", "if(id % 11 = 0, null, if(id % 2 = 0, 5, id * 7919 % 1009)) v")
    df = df.unionByName(spark.createDataFrame([("empty", None), ("one", 4)], "k string, v long"))
    got = {r["k"]: (r["a"], r["b"], r["c"]) for r in quantiles(df, "k", "v", {"a": 0.0, "b": 0.37, "c": 1.0}).collect()}
    want = {r["k"]: tuple(r["p"]) for r in df.groupBy("k").agg(F.expr("percentile(v, array(0.0, 0.37, 1.0)) p")).collect() if r["p"]}
    assert set(got) == set(want) and got["one"] == (4, 4, 4)
    for k in want:
        assert all(abs(a - b) < 1e-9 for a, b in zip(got[k], want[k], strict=True))
    assert quantiles(df.limit(0), "k", "v", {"m": 0.5}).isEmpty()


def test_exclusions_with_nulls_and_ties(spark):
    df = spark.createDataFrame([(1, 1, 5), (1, 1, None), (1, 2, 7), (1, 2, 9), (1, None, 1), (2, 1, None)], "k int, o int, v int")
    pick = lambda e, b, a: sorted(((r["k"], r["o"], r["v"], r["sum"], r["count"], r["min"], r["max"]) for r in frames.excluding(df, ["k"], ["o"], "v", e, b, a).collect()), key=repr)
    assert (1, 2, 9, 12, 2, 5, 7) in pick("CURRENT ROW", 1, 0) and (2, 1, None, None, 0, None, None) in pick("CURRENT ROW", 1, 1)
    assert (1, 2, 9, 5, 1, 5, 5) in pick("GROUP", 1, 0) and (1, 1, 5, None, 0, None, None) in pick("GROUP", 0, 0)
    assert (1, 2, 9, 14, 2, 5, 9) in pick("TIES", 1, 0) and (1, 1, None, None, 0, None, None) in pick("TIES", 0, 0)
    assert (1, 2, 9, 21, 3, 5, 9) in pick("NO OTHERS", 1, 0)


def test_top_k_by_group_is_pruned_before_the_shuffle(spark):
    df = spark.range(100).selectExpr("id % 3 k", "id v")
    out = windows.top_k_by_group(df, ["k"], [F.desc("v")], 2)
    assert sorted((r["k"], r["v"]) for r in out.collect()) == [(0, 96), (0, 99), (1, 94), (1, 97), (2, 95), (2, 98)]
    assert "WindowGroupLimit" in out._jdf.queryExecution().executedPlan().toString()


def test_first_by_key_and_salted_join(spark):
    df = spark.createDataFrame([(1, 5, "x"), (1, 3, "y"), (2, 9, "z")], "k int, v int, s string")
    assert sorted(windows.first_by_key(df, ["k"], F.col("v")).collect()) == [(1, 3, "y"), (2, 9, "z")]
    assert joins.salted_join(df, df.select("k", F.col("s").alias("s2")), ["k"], ["v"]).count() == 5
    salts = joins.salted_join(spark.range(400).selectExpr("1 k", "id"), spark.createDataFrame([(1,)], "k int"), ["k"], ["id"])
    assert "rand(" not in salts._jdf.queryExecution().analyzed().toString() and salts.count() == 400


def test_page_rank_of_a_star_and_of_nothing(spark):
    star = spark.createDataFrame([(k, 0) for k in (1, 2, 3)] + [(0, 1)], "src int, dst int")
    got = {r["node"]: r["rank"] for r in graph.page_rank(star, 1).collect()}
    assert {k: round(v, 6) for k, v in got.items()} == {0: 2.7, 1: 1.0, 2: 0.15, 3: 0.15}
    assert graph.page_rank(star.limit(0), 2).count() == 0


def test_chunks_cover_the_text(spark):
    for text in ("", "a", "abcdefghij" * 7):
        parts = spark.createDataFrame([(text,)], "t string").select(T.chunks(F.col("t"), 10, 3).alias("c")).first()["c"]
        whole = "".join(p if k == 0 else p[3:] for k, p in enumerate(parts))
        assert whole == text


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    from kilnbase.plans import registry

    plan = registry.QUERIES["q6_forecast_revenue"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_discount)" in plan and "l_comment" not in plan and "l_shipdate" not in plan


def test_frames_are_dealt_by_rows_and_sorted_twice(spark, monkeypatch):
    df = spark.range(2000).selectExpr("id % 50 k", "id * 7 % 9 o", "id % 13 v")
    want = frames.excluding(df, ["k"], ["o"], "v", "CURRENT ROW", 2, 1).orderBy("k", "o", "v", "sum", "min", "max").collect()
    monkeypatch.setattr(frames, "ROWS", 100, raising=False)
    got = frames.excluding(df, ["k"], ["o"], "v", "CURRENT ROW", 2, 1)
    got.collect()
    plan = got._jdf.queryExecution().executedPlan().toString()
    final = plan[: plan.index("Initial Plan")] if "Initial Plan" in plan else plan
    assert "hashpartitioning(k" in final and ", 20), REPARTITION_BY_NUM" in final and final.count(" Sort [") == 2
    assert got.orderBy("k", "o", "v", "sum", "min", "max").collect() == want


def test_estimates_are_not_kept_for_each_distinct_value(spark, tmp_path):
    from kilnbase.plans import registry

    rows = [("a", k, float(k % 9)) for k in range(90)] + [(None, k % 4, 2.0) for k in range(8)] + [("void", None, None)]
    spark.createDataFrame(rows, "l_returnflag string, l_partkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    out = registry.QUERIES["agg_approximate"](spark, str(tmp_path))
    got = {r[0]: tuple(r)[1:] for r in out.collect()}
    assert got == {"a": (90, 4.0, True, True, True), None: (4, 2.0, True, True, True), "void": (0, None, True, True, True)}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.split("\n") if "Aggregate [" in x and "l_partkey" in x.split("]")[0] and ("approx" in x or "sketch" in x or "percentile" in x)]
