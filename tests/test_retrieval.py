"""The stored index: what a search reads, and that its results are those of a plain count."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from kilnbase.functions import text as T
from kilnbase.operators import retrieval
from kilnbase.sources.catalog import load
from kilnbase.sources.scratch import shared_path


def plain(docs, terms, k):
    """BM25 by loops: docs are (doc_id, words)."""
    docs = [(d, Counter(w)) for d, w in docs if w]
    mean = sum(sum(c.values()) for _, c in docs) / max(1, len(docs))
    out = []
    for d, c in docs:
        hits = [t for t in set(terms) if c[t]]
        n = sum(c.values())
        if hits:
            df = {t: sum(1 for _, o in docs if o[t]) for t in hits}
            out.append((-round(sum(math.log(1 + (len(docs) - df[t] + 0.5) / (df[t] + 0.5)) * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * n / mean)) for t in hits), 6), d))
    return [(d, -s) for s, d in sorted(out)[:k]]


@pytest.fixture(scope="module")
def stored(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select("doc_id", T.words(F.col("text")).alias("words"))
    return retrieval.build(docs, shared_path(spark, "index"), buckets=64, block=8), [tuple(r) for r in docs.collect()]


def test_results_of_many_queries(spark, stored):
    index, docs = stored
    df = Counter(t for _, w in docs for t in set(w))
    by_df = sorted(df, key=lambda t: (df[t], t))
    queries = {q: [by_df[(q * 37 + j * 101) % len(by_df)] for j in range(3)] + [by_df[-1 - q]] for q in range(6)}
    queries[6] = ["the", "the", "no such word"]
    queries[7] = ["no such word"]
    got = {}
    for r in retrieval.search(index, queries, 5).orderBy("query", "rank").collect():
        got.setdefault(r["query"], []).append((r["doc_id"], r["score"]))
    for q, terms in queries.items():
        assert [d for d, _ in got.get(q, [])] == [d for d, _ in plain(docs, terms, 5)]
        assert [s for _, s in got.get(q, [])] == pytest.approx([s for _, s in plain(docs, terms, 5)], abs=2e-6)


def rows_read(df) -> int:
    df.collect()
    return df._jdf.queryExecution().executedPlan().collectLeaves().head().metrics().apply("numOutputRows").value()


def test_a_search_reads_its_terms_only(stored):
    index, _ = stored
    rare = index.read("terms").where("df = 2").orderBy("term").first()["term"]
    some = index.read("postings", [rare])
    assert rows_read(some) <= index.read("postings").count() / 20
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan
    assert "PushedFilters: [" in plan and "term" in plan.split("PushedFilters")[1]


def test_bounds_read_no_lists_and_prune(spark, stored):
    index, _ = stored
    terms = ["the", "tion"]
    weights = index.weights({1: terms})
    limits = retrieval.bounds(index, weights, terms)
    assert "held" not in limits._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1].split(">")[0]
    floor = retrieval.floors(index, weights, limits, terms, 3)
    left = retrieval.reachable(limits, floor).count()
    assert 0 < left < limits.count()


def test_edges(spark, tmp_path):
    rows = [(1, ["a", "b"]), (1, ["a"]), (2, []), (3, None), (None, ["b", "c"]), (5, ["a"] * 5000 + ["b"])]
    index = retrieval.build(spark.createDataFrame(rows, "doc_id long, words array<string>"), shared_path(spark, "index"), 4, 2)
    assert index.docs == 3
    assert {r["term"]: r["df"] for r in index.read("terms").collect()} == {"a": 2, "b": 3, "c": 1}
    held = index.read("postings", ["a"]).select(F.explode("held").alias("h")).select("h.*").collect()
    assert sorted(tuple(r) for r in held) == [(1, 2, 3), (5, 5000, 5001)]
    assert [r["doc_id"] for r in retrieval.search(index, {0: ["c"]}, 5).collect()] == [None]
    empty = retrieval.build(spark.createDataFrame([], "doc_id long, words array<string>"), shared_path(spark, "index"), 4, 2)
    assert empty.docs == 0 and retrieval.search(empty, {0: ["a"]}, 5).count() == 0
    with pytest.raises(Exception, match="figures"):
        retrieval.open_index(spark, str(tmp_path))


def test_lists_meet_their_terms_whole_and_unsorted(spark, sf_dir):
    from kilnbase.plans import registry

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for a large table of terms
    try:
        plan = registry.QUERIES["kb_index"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" not in plan and plan.index("Generate explode(held") < plan.index("ShuffledHashJoin")


def test_repeated_documents_and_many_parts(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "WORDS", 64, raising=False)
    rows = [(k % 5 or None, [f"w{k % 3}", "all", f"x{k % 7}"] * (k % 4)) for k in range(200)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        index = retrieval.build(spark.createDataFrame(rows, "doc_id long, words array<string>").repartition(5), shared_path(spark, "index"), 2, 2)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    whole = {}
    for d, w in rows:
        whole.setdefault(d, Counter()).update(w)
    held = index.read("postings").select("term", "docs", "top", F.inline("held")).collect()
    assert sorted(((r["term"], r["doc_id"], r["tf"], r["n"]) for r in held), key=repr) == sorted(
        ((t, d, k, sum(c.values())) for d, c in whole.items() for t, k in c.items()), key=repr)
    assert {r["term"]: r["df"] for r in index.read("terms").collect()} == Counter(t for c in whole.values() for t in c)
    files = index.read("postings").select(F.input_file_name().alias("f")).distinct().count()
    assert files > index.buckets and index.docs == 5
    tops = [(retrieval.share(r["tf"], r["n"], index.mean), r["top"]) for r in held]
    assert all(s <= top + 1e-12 for s, top in tops)
