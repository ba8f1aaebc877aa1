"""Exact top-k by inner product over whole-number vectors: columnar branch and bound.

Method. Candidates lie in vertical layout, a row for each dimension. A tile of queries against a
batch of candidates accumulates scores a block of dimensions at a time, the dimensions of greatest
query mass first. After each block the Cauchy-Schwarz bound of what remains, |query rest| x
|candidate rest|, tells which pairs can still reach the query's k-th best score so far; the
survivors are compacted and only they go on. Survivors of the last block are scored in 64-bit
integers. Nothing is approximate: a pair goes only if its bound is below the k-th best.

Scale. Candidates never move: each scan task keeps k rows for each query, and those few rows meet
in one aggregation. Queries go out in blocks of some `QUERY_BLOCK` rows, one after the other: a block's
rows are written and its broadcast is destroyed before the next is collected, which bounds what the
driver holds. Each block is one pass over the candidates.

Edge cases. Vectors without components score 0 with each other. Null vectors and vectors with null or non-finite components take no part, nor do rows
with a null vec_id; vectors of different lengths don't meet. A query's own rows are those of its
vec_id. Repeated candidate rows count each; of repeated query rows the smallest vector asks. Ties
go to the smaller vec_id. Empty table: no rows. Further columns are ignored. Scores must fit
64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

QUERY_BLOCK = 8192
DIM_BLOCK = 16
QUERY_TILE, CANDIDATE_TILE = 512, 4096
#: Share of surviving pairs above which the next block is cheaper for the whole tile.
DENSE = 0.15


def usable(vector: Column) -> Column:
    """No null vector, no null or non-finite component."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return vector.isNotNull() & ~bad


def whole_numbers(vector: Column, factor: float) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(factor)))


class _Best:
    """The k best (score, smaller id first) of each query."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.score = np.zeros((n, k), np.int64)
        self.id = np.zeros((n, k), np.int64)
        self.held = np.zeros(n, np.int64)

    def floor(self, at: slice) -> np.ndarray:
        """The score below which nothing counts any more."""
        return np.where(self.held[at] == self.k, self.score[at, -1].astype(np.float64), -np.inf)

    def add(self, q: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        if not len(q):
            return
        touched = np.unique(q)
        old = np.repeat(touched, self.held[touched])
        slot = np.concatenate([np.arange(h) for h in self.held[touched]]) if len(old) else np.zeros(0, np.int64)
        q = np.concatenate([old, q])
        ids = np.concatenate([self.id[old, slot], ids])
        score = np.concatenate([self.score[old, slot], score])
        order = np.lexsort((ids, -score, q))
        q, ids, score = q[order], ids[order], score[order]
        first = np.searchsorted(q, touched)
        rank = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
        keep = rank < self.k
        q, ids, score, rank = q[keep], ids[keep], score[keep], rank[keep]
        self.score[q, rank], self.id[q, rank] = score, ids
        self.held[touched] = np.bincount(q, minlength=len(self.held))[touched]


class BranchAndBound:
    """Searches for a block of queries over batches of candidates."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.k = ids, k
        self.order = np.argsort(-(vectors.astype(np.float64) ** 2).sum(0), kind="stable")
        self.whole = np.ascontiguousarray(vectors[:, self.order].astype(np.int64))
        self.part = self.whole.astype(np.float64)
        self.cuts = [*range(0, vectors.shape[1], DIM_BLOCK), vectors.shape[1]]
        self.rest = self._rests(self.part.T)
        self.best = _Best(len(ids), k)

    def _rests(self, columns: np.ndarray) -> list[np.ndarray]:
        """Norms of what lies beyond each cut, a hair enlarged against rounding."""
        square = columns**2
        return [np.sqrt(square[c:].sum(0)) * (1 + 1e-9) for c in self.cuts[1:]]

    def search(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        for a in range(0, len(ids), CANDIDATE_TILE):
            own = ids[a : a + CANDIDATE_TILE]
            whole = np.ascontiguousarray(vectors[a : a + CANDIDATE_TILE, self.order].T.astype(np.int64))
            columns = whole.astype(np.float64)
            rests = self._rests(columns)
            for b in range(0, len(self.ids), QUERY_TILE):
                self._tile(slice(b, b + QUERY_TILE), own, whole, columns, rests)

    def _tile(self, at: slice, own: np.ndarray, whole: np.ndarray, columns: np.ndarray, rests: list[np.ndarray]) -> None:
        floor, queries = self.best.floor(at), self.part[at]
        total = np.zeros((len(queries), len(own)))
        pairs = None
        for k, (low, high) in enumerate(zip(self.cuts, self.cuts[1:], strict=False)):
            if pairs is None:
                total += queries[:, low:high] @ columns[low:high]
                alive = total + self.rest[k][at][:, None] * rests[k][None, :] >= floor[:, None]
                if high < len(columns) and alive.mean() > DENSE:
                    continue
                q, c = np.nonzero(alive)
                pairs, total = (q, c), total[q, c]
            else:
                q, c = pairs
                for d in range(low, high):
                    total += queries[q, d] * columns[d, c]
                keep = total + self.rest[k][at][q] * rests[k][c] >= floor[q]
                pairs, total = (q[keep], c[keep]), total[keep]
        q, c = np.nonzero(np.ones_like(total, bool)) if pairs is None else pairs  # None: vectors without dimensions
        q, c = (x[self.ids[at][q] != own[c]] for x in (q, c))
        if len(q) > 8 * self.k * len(queries):  # the first tile has no bound: cut it before scoring
            q, c = self._shortlist(q, c, queries, columns)
        score = np.zeros(len(q), np.int64)
        for a in range(0, len(q), 1 << 18):
            x, y = q[a : a + (1 << 18)], c[a : a + (1 << 18)]
            score[a : a + (1 << 18)] = np.einsum("ij,ji->i", self.whole[at][x], whole[:, y])
        self.best.add(q + at.start, own[c], score)

    def _shortlist(self, q: np.ndarray, c: np.ndarray, queries: np.ndarray, columns: np.ndarray):
        """Pairs that reach their query's k-th best in this tile, ties included."""
        score = np.full((len(queries), columns.shape[1]), -np.inf)
        score[q, c] = (queries @ columns)[q, c]
        kth = min(self.k, score.shape[1])
        least = np.partition(score, score.shape[1] - kth, axis=1)[:, -kth]
        slack = 1e-9 * np.abs(np.where(np.isfinite(least), least, 0)) + 1e-6
        return np.nonzero((score >= (least - slack)[:, None]) & np.isfinite(score))

    def result(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.repeat(np.arange(len(self.ids)), self.best.held)
        slot = np.concatenate([np.arange(h) for h in self.best.held]) if len(at) else np.zeros(0, np.int64)
        return self.ids[at], self.best.id[at, slot], self.best.score[at, slot]


def search(vectors: DataFrame, query_set: Column, k: int = 5, factor: float = 256.0, query_block: int = QUERY_BLOCK) -> DataFrame:
    """Top `k` of all rows of `vectors` (vec_id, embedding) for those that `query_set` selects.

    Returns query_id, rank, vec_id, score.
    """
    spark = vectors.sparkSession
    rows = (
        vectors.select(F.col("vec_id").cast("long"), "embedding")
        .where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
        .select("vec_id", whole_numbers(F.col("embedding"), factor).alias("v"))
    )
    queries = rows.where(query_set).groupBy("vec_id").agg(F.min("v").alias("v"))
    blocks = max(1, -(-queries.count() // max(1, query_block * 9 // 10)))
    dealt = common.written(queries.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks))), "topk-queries")
    found = None
    for b in range(blocks):
        part = _block(spark, rows, dealt.where(F.col("block") == b), k)
        found = part if found is None else found.unionAll(part)
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def _block(spark, rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Each scan task's k best for one block of queries; the block is bounded, so it may be broadcast."""
    table = queries.select("vec_id", "v").toArrow()
    shared = spark.sparkContext.broadcast(_by_length(table["vec_id"], table["v"]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searches = {n: BranchAndBound(ids, v, k) for n, (ids, v) in shared.value.items()}
        for batch in batches:
            for n, (ids, v) in _by_length(batch.column("vec_id"), batch.column("v")).items():
                if n in searches:
                    searches[n].search(ids, v)
        for found in searches.values():
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in found.result()], names=["query_id", "vec_id", "score"])

    out = common.written(rows.mapInArrow(scan, "query_id long, vec_id long, score long"), "topk-part")
    shared.destroy()
    return out


def _by_length(ids, vectors) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    if isinstance(vectors, pa.ChunkedArray):
        ids, vectors = ids.combine_chunks(), vectors.combine_chunks()
    if not len(vectors):
        return {}
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    size = np.diff(vectors.offsets.to_numpy())
    start = np.cumsum(size) - size
    ids, out = ids.to_numpy(zero_copy_only=False), {}
    for n in np.unique(size).tolist():
        at = np.flatnonzero(size == n)
        out[n] = (ids[at], flat[start[at][:, None] + np.arange(n)])
    return out
