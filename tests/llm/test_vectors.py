"""Top-k search and embedding near-dedup against brute force, with broken vectors."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from kilnbase.llm import embed_dedup, topk_search

SCHEMA = "vec_id long, embedding array<float>, label int, rank int, score string, cell int"


def clustered(n: int, dims: int, seed: int = 0, labels: int = 3):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n // 4, dims))
    x = np.vstack([base, base + 0.1 * rng.standard_normal(base.shape), base + 0.3 * rng.standard_normal(base.shape), base])
    return [(k, [float(v) for v in np.float32(x[k] / np.linalg.norm(x[k]))], int(k % (n // 4)) % labels) for k in range(len(x))]


BROKEN = [(1000, None, 0), (1050, [float("nan")] * 16, 0), (1100, [None] + [0.1] * 15, 0), (1150, [float("inf")] * 16, 1), (1200, [], 1),
          (1250, [0.0] * 16, 2), (1300, [0.5, 0.5], 2), (None, [0.25] * 16, 1), (1400, [0.25] * 16, None), (1450, [0.25] * 16, None)]


@pytest.fixture(scope="module")
def rows():
    return clustered(240, 16) + BROKEN


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA)


def brute_top_k(rows, k):
    fit = [(i, [math.floor(256 * v) for v in e]) for i, e, _ in rows if i is not None and e is not None and all(v is not None and math.isfinite(v) for v in e)]
    out = []
    for q, a in fit:
        if q % 50 == 0:
            found = sorted((-sum(x * y for x, y in zip(a, b)), c) for c, b in fit if c != q and len(a) == len(b))[:k]
            out += [(q, r, c, -s) for r, (s, c) in enumerate(found, 1)]
    return sorted(out)


@pytest.mark.parametrize("block", [8192, 4, 2])
def test_top_k_equals_brute_force(spark, rows, block):
    got = topk_search.search(frame(spark, rows), F.col("vec_id") % 50 == 0, 5, 256.0, query_block=block)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, got.collect())) == brute_top_k(rows, 5)


def test_top_k_ties_repeats_and_small_tables(spark):
    same = [(k, [0.5, 0.5], 0) for k in (0, 7, 3, 9)]
    got = sorted(map(tuple, topk_search.search(frame(spark, same), F.col("vec_id") % 50 == 0, 2).collect()))
    assert got == [(0, 1, 3, 32768), (0, 2, 7, 32768)]
    twice = same[:2] + same[1:2]
    assert [r["vec_id"] for r in topk_search.search(frame(spark, twice), F.col("vec_id") % 50 == 0, 5).collect()] == [7, 7]
    assert topk_search.search(frame(spark, []), F.col("vec_id") % 50 == 0).count() == 0
    assert topk_search.search(frame(spark, same[:1]), F.col("vec_id") % 50 == 0).count() == 0


def test_bounds_prune_but_lose_nothing():
    rng = np.random.default_rng(2)
    x = np.floor(256 * rng.standard_normal((5000, 64)) / 8).astype(np.int64)
    search = topk_search.BranchAndBound(np.arange(20), x[:20], 3)
    search.search(np.arange(5000), x)
    q, c, s = search.result()
    for k in range(20):
        score = x @ x[k]
        score[k] = -(1 << 60)
        want = sorted(zip(-score, range(5000)))[:3]
        assert [(-s[i], c[i]) for i in np.flatnonzero(q == k)] == [(int(a), b) for a, b in want]


def brute_near(rows, least):
    ids = [r[0] for r in rows]
    fit = [k for k, (i, e, label) in enumerate(rows) if i is not None and label is not None and e and all(v is not None and math.isfinite(v) for v in e) and any(e)]
    links = {k: set() for k in range(len(rows))}
    for a in fit:
        for b in fit:
            if a != b and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
                x, y = np.array(rows[a][1], float), np.array(rows[b][1], float)
                if x @ y / math.sqrt((x @ x) * (y @ y)) >= least:
                    links[a].add(b)
    out = []
    for k in range(len(rows)):
        seen, todo = {k}, [k]
        while todo:
            for b in links[todo.pop()] - seen:
                seen.add(b)
                todo.append(b)
        low = min((ids[b] for b in seen if ids[b] is not None), default=None)
        out.append((ids[k], len(links[k]), low, ids[k] is not None and low == ids[k]))
    return sorted(out, key=repr)


@pytest.mark.parametrize("cell_bytes,grid", [(1 << 20, None), (1 << 20, 0), (1024, 0), (1 << 20, 3), (1024, 2)])
def test_near_duplicates_equal_brute_force(spark, rows, cell_bytes, grid):
    got = embed_dedup.near_duplicates(frame(spark, rows), 0.93, cell_bytes=cell_bytes, grid=grid)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute_near(rows, 0.93)


def test_near_duplicates_of_nothing(spark):
    assert embed_dedup.near_duplicates(frame(spark, [])).count() == 0


def test_a_hot_cell_is_cut_and_a_grid_is_chosen_where_it_helps(spark):
    rng = np.random.default_rng(4)
    centre = np.repeat(np.eye(16), 60, 0)
    spread = [(k, [float(v) for v in x], 0) for k, x in enumerate(np.float32(centre + 0.008 * rng.standard_normal(centre.shape)))]
    alike = [(k, [float(v) for v in x], 0) for k, x in enumerate(np.float32(rng.standard_normal((300, 16))))]
    members = lambda rows: frame(spark, rows).selectExpr("vec_id rep", "1L weight", "string(label) label", "embedding")
    assert embed_dedup.plan(members(spread), 0.998) > 0 == embed_dedup.plan(members(alike), 0.93)
    got = embed_dedup.near_duplicates(frame(spark, spread), 0.998, cell_bytes=1024)
    assert sorted(map(tuple, got.collect()), key=repr) == brute_near(spread, 0.998)


def test_one_block_of_queries_is_live_at_a_time(spark, rows, monkeypatch):
    live, most, made = set(), [], type(spark.sparkContext).broadcast

    def broadcast(self, value):
        out = made(self, value)
        live.add(id(out))
        most.append(len(live))
        end = out.destroy
        out.destroy = lambda *a: (live.discard(id(out)), end(*a))
        return out

    monkeypatch.setattr(type(spark.sparkContext), "broadcast", broadcast)
    got = topk_search.search(frame(spark, rows), F.col("vec_id") % 50 == 0, 5, 256.0, query_block=5)
    assert got.count() and len(most) >= 3 and max(most) == 1


def test_every_block_budget_sums_to_the_whole():
    hole = embed_dedup.Pigeonhole(10, 0.93, blocks=4)
    assert abs(sum(hole.budget) - 0.14) < 1e-6
    rng = np.random.default_rng(1)
    x = rng.standard_normal((300, 10))
    x = hole.unit(np.vstack([x, x + 0.08 * rng.standard_normal(x.shape)]))
    near = x @ x.T >= 0.93
    for block in range(len(hole.blocks)):
        near &= ~hole.within(x.astype(np.float32), x.astype(np.float32), block)
    assert not near.any()
