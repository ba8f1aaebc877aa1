"""Quality selection by importance resampling.

Method. Two generative models of hashed word unigrams and bigrams are counted: one of the target, documents
labelled good, and one of the raw corpus. A document's log weight is the sum over its n-grams of the log
ratio of the models. Adding Gumbel noise to the log weights and taking the k greatest draws k documents
without replacement in proportion to their weights. k is the number of documents above the cut that
best tells good labels from bad ones.

The raw model and the labels' histogram cover all rows. Labels are dealt into four folds by a hash of doc_id: two
train the target model, of which it takes at most `target_rows` good documents, so their ids may be
broadcast; one sets the cut; one does neither, and `evaluate` reports precision and recall on it.

Log ratios are whole multiples of 2^-20, so a document's weight does not depend on how rows are batched
or added, and may be made again in a later pass.

Scale. Two passes over the texts without shuffle, three where documents are returned. Counts are summed as arrays of
fixed size. The k-th key is found by histograms that narrow, over a table of ids and weights; nothing is sorted.

Edge cases. Null or empty texts: weight 0. No good label to learn from: all weights 0. No label for the cut: every row
is drawn. Repeated rows draw each, with one noise for one doc_id. Rows whose key equals the k-th are drawn together. Null
doc_ids are kept. Empty table: no rows. Further columns are ignored, or kept by `keep_selected`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .mph import mix
from .shingles import SAME, WHITE, byte_classes, token_hashes

BITS = 15
TARGET_ROWS = 20_000
#: Log ratios are multiples of its inverse.
GRAIN = 1 << 20
FOLDS = 4
BIN = 0.5
BIN_LIMIT = 8192
#: What losing a good document weighs against keeping a bad one, when the cut is set.
CARE = 20.0
SLACK = 0.02


def ngrams(texts: pa.Array, bits: int = BITS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Chunk by chunk: buckets of unigrams, buckets of bigrams (by their first word), token bounds of the rows.

    The bigram from one text's last word to the next text's first is there too; callers leave it out.
    """
    classes = byte_classes(WHITE, punctuation=True)
    shift = np.uint64(64 - bits)
    for _, words, bounds in token_hashes(texts, SAME, classes):
        with np.errstate(over="ignore"):
            pairs = mix(words[:-1] * np.uint64(0xBF58476D1CE4E5B9) + words[1:] * np.uint64(0x94D049BB133111EB), 9) if len(words) else words
        yield (words >> shift).astype(np.int64), (pairs >> shift).astype(np.int64), bounds


def _sums(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Sums of values[low:high] for each pair of bounds."""
    total = np.concatenate([np.zeros(1, np.int64), np.cumsum(values)])
    return total[np.maximum(high, low)] - total[low]


def models(docs: DataFrame, target_ids: np.ndarray, bits: int = BITS) -> np.ndarray | None:
    """Log ratio target / raw for each bucket, in grains; None without target."""
    if not len(target_ids):
        return None
    shared = docs.sparkSession.sparkContext.broadcast(np.sort(target_ids))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        good_ids, size = shared.value, 1 << bits
        raw, good = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for batch in batches:
            ids = batch.column(0)
            known = np.isin(ids.fill_null(0).to_numpy(zero_copy_only=False), good_ids) & ~ids.is_null().to_numpy(zero_copy_only=False)
            row = 0
            for words, pairs, bounds in ngrams(batch.column(1), bits):
                rows = len(bounds) - 1
                inner = np.ones(len(pairs), bool)
                inner[(bounds[1:-1] - 1)[(bounds[1:-1] > 0) & (bounds[1:-1] < len(words))]] = False
                raw += np.bincount(words, minlength=size) + np.bincount(pairs[inner], minlength=size)
                picked = np.repeat(known[row : row + rows], np.diff(bounds))
                good += np.bincount(words[picked], minlength=size) + np.bincount(pairs[inner & picked[: len(pairs)]], minlength=size)
                row += rows
        part = TaskContext.get().partitionId() // 256
        yield pa.RecordBatch.from_arrays(
            [pa.array(["raw", "good"]), pa.array([0, 0], pa.int32()), pa.array([part] * 2, pa.int32()), pa.array([common.narrowed(raw), common.narrowed(good)], pa.binary())],
            names=["name", "block", "part", "counts"])

    parts = docs.select("doc_id", "text").mapInArrow(count, "name string, block int, part int, counts binary")
    found = {r["name"]: common.widened(r["counts"]).astype(np.float64) for r in common.summed(parts).collect()}
    if not found or not found["good"].sum():
        return None
    raw = (found["raw"] + 1) / (found["raw"] + 1).sum()
    prior = 0.01 * len(raw)
    good = (found["good"] + prior * raw) / (found["good"].sum() + prior)
    return np.rint(np.log(good / raw) * GRAIN).astype(np.int64)


def weighed(texts: pa.Array, ratio: np.ndarray | None, bits: int = BITS) -> np.ndarray:
    """The log weight of each text."""
    if ratio is None:
        return np.zeros(len(texts))
    parts = [np.zeros(0, np.int64)]
    for words, pairs, bounds in ngrams(texts, bits):
        low, high = bounds[:-1], bounds[1:]
        parts.append(_sums(ratio[words], low, high) + _sums(ratio[pairs], low, np.maximum(high - 1, low)) if len(words) else np.zeros(len(low), np.int64))
    return np.concatenate(parts) / GRAIN


def log_weight(docs: DataFrame, ratio: np.ndarray | None) -> Column:
    """The log weight of the column `text`; texts go to Python, weights alone come back."""
    shared = docs.sparkSession.sparkContext.broadcast(ratio)

    @F.arrow_udf("double")
    def weigh(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in texts:
            yield pa.array(weighed(part, shared.value))

    return weigh(F.col("text").cast("string"))


def fold(doc_id: Column) -> Column:
    """0: evaluation, 1: the cut, 2 and 3: the target model."""
    return F.pmod(F.xxhash64(doc_id.cast("long"), F.lit(11)), F.lit(FOLDS))


def target_sample(labels: DataFrame, target_rows: int = TARGET_ROWS) -> np.ndarray:
    """Ids of good documents in the target model's folds: all, or the `target_rows` of least hash."""
    good = labels.where("quality = 1 and doc_id is not null").where(fold(F.col("doc_id")) >= 2).select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    good = common.written(good, "quality-target")
    # some more than asked for are drawn by hash, and those of least hashes stay
    rate = (target_rows + 8 * target_rows**0.5) / max(1, good.count())
    draw = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = good.withColumn("draw", draw).where(F.col("draw") < rate).orderBy("draw", "doc_id").limit(target_rows)
    return drawn.select("doc_id").toArrow()["doc_id"].to_numpy()


def _labels(labels: DataFrame, which: int) -> DataFrame:
    known = labels.where("quality is not null and doc_id is not null").where(fold(F.col("doc_id")) == which)
    return known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("quality"))


def how_many(scored: DataFrame, labels: DataFrame) -> int:
    """Documents at or above the cut that best tells good labels from bad, by histogram."""
    place = F.least(F.greatest(F.floor(F.col("log_weight") / BIN), F.lit(-BIN_LIMIT)), F.lit(BIN_LIMIT)).alias("bin")
    rows = scored.select("doc_id", place).join(_labels(labels, 1), "doc_id").groupBy("bin", "quality").agg(F.count("*").alias("n")).collect()
    good, bad = {}, {}
    for r in rows:
        (good if r["quality"] == 1 else bad)[r["bin"]] = r["n"]
    gains, lost, gone, below = [], 0, 0, None
    for b in sorted({*good, *bad}):
        middle = b if below is None else (below + 1 + b) // 2  # of the gap without labels
        gains.append((gone / max(1, sum(bad.values())) - CARE * lost / max(1, sum(good.values())), middle))
        below = b
        lost, gone = lost + good.get(b, 0), gone + bad.get(b, 0)
    best = max((g for g, _ in gains), default=0)
    # the lowest cut that is nearly as good: unlabelled good documents spread wider than labelled ones
    cut = min((b for g, b in gains if g >= best - SLACK), default=None) if best > 0 else None
    total = scored.count()
    return total if cut is None else scored.where(F.col("log_weight") >= F.lit(cut * BIN)).count()


def gumbel_key(doc_id: Column, weight: Column, seed: int = 17) -> Column:
    bits = F.pmod(F.xxhash64(doc_id.cast("long"), F.lit(seed)), F.lit(1 << 52))
    uniform = (bits + F.lit(0.5)) / F.lit(float(1 << 52))
    return weight - F.log(-F.log(uniform))


def kth_key(keyed: DataFrame, k: int, leaf: int = 10_000) -> float | None:
    """The k-th greatest `gumbel_key`, by histograms that narrow until at most `leaf` keys are left or all are equal; None
    if there are no more than k rows. `keyed` gives the same rows whenever it is read."""
    ends = keyed.agg(F.min("gumbel_key").alias("a"), F.max("gumbel_key").alias("b"), F.count("*").alias("n")).first()
    if k >= ends["n"]:
        return None
    if k <= 0:
        return float("inf")
    low, high, need, inside = ends["a"], ends["b"], k, ends["n"]
    while inside > leaf and high > low:
        step = (high - low) / 1024
        at = F.least(F.floor((F.col("gumbel_key") - F.lit(low)) / F.lit(step)), F.lit(1023))
        rows = keyed.where(F.col("gumbel_key").between(low, high)).groupBy(at.alias("bin")).agg(
            F.min("gumbel_key").alias("a"), F.max("gumbel_key").alias("b"), F.count("*").alias("n")).orderBy(F.desc("bin")).collect()
        for r in rows:
            if r["n"] >= need:
                low, high, inside = r["a"], r["b"], r["n"]
                break
            need -= r["n"]
    if low == high:
        return low
    keys = keyed.where(F.col("gumbel_key").between(low, high)).select("gumbel_key").toArrow()["gumbel_key"].to_numpy()
    return float(np.sort(keys)[-need])


def gumbel_top_k(scored: DataFrame, k: int, seed: int = 17, leaf: int = 10_000) -> DataFrame:
    """The k rows of greatest log_weight + Gumbel noise, with gumbel_key; those equal to the k-th as well."""
    keyed = scored.withColumn("gumbel_key", gumbel_key(F.col("doc_id"), F.col("log_weight"), seed))
    least = kth_key(keyed, k, leaf)
    return keyed if least is None else keyed.where(F.col("gumbel_key") >= F.lit(least))


def score(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, np.ndarray | None]:
    """A table of doc_id and log_weight, and the log ratios they come from."""
    with common.small_batches(docs.sparkSession):
        rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
        ratio = models(rows, target_sample(labels))
        return common.written(rows.select("doc_id", log_weight(rows, ratio).alias("log_weight")), "quality-scores"), ratio


def select(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """`docs` (doc_id, text), `labels` (doc_id, quality): the rows drawn, as doc_id, log_weight, gumbel_key."""
    scored, _ = score(docs, labels)
    return gumbel_top_k(scored, how_many(scored, labels)).select("doc_id", "log_weight", "gumbel_key")


def keep_selected(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that `select` draws, with all their columns, whatever their names."""
    scored, ratio = score(docs, labels)
    keyed = scored.select(gumbel_key(F.col("doc_id"), F.col("log_weight")).alias("gumbel_key"))
    least = kth_key(keyed, how_many(scored, labels))
    return docs if least is None else docs.where(gumbel_key(F.col("doc_id"), log_weight(docs, ratio)) >= F.lit(least))


def evaluate(docs: DataFrame, labels: DataFrame) -> dict[str, float]:
    """Precision and recall of the draw on the fold of labels that neither trained nor set the cut, and the share of the
    drawn rows that the k greatest weights without noise have too."""
    scored, _ = score(docs, labels)
    k = how_many(scored, labels)
    drawn = common.written(gumbel_top_k(scored, k), "quality-drawn")
    got = {(r["quality"], r["in"]): r["n"] for r in scored.join(_labels(labels, 0), "doc_id").join(
        drawn.select("doc_id", F.lit(True).alias("in")).distinct(), "doc_id", "left").groupBy("quality", "in").agg(F.count("*").alias("n")).collect()}
    good, bad, lost = got.get((1, True), 0), got.get((0, True), 0), got.get((1, None), 0)
    plain = kth_key(scored.select(F.col("log_weight").alias("gumbel_key")), k)
    same = drawn.count() if plain is None else drawn.where(F.col("log_weight") >= F.lit(plain)).count()
    return {"precision": good / max(1, good + bad), "recall": good / max(1, good + lost), "bad_dropped": got.get((0, None), 0) / max(1, bad + got.get((0, None), 0)),
            "as_plain_top_k": same / max(1, drawn.count())}
