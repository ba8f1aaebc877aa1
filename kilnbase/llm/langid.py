"""Language identification by hierarchical discrimination.

Method. A softmax regression over hashed character n-grams predicts the language family; within
it, linear support vector machines, one for each pair of the family's languages, vote and the one with
most votes wins, ties by summed margin. The score is the family's probability times the winner's mean
pairwise probability.

Training takes at most `per_language` documents of each language and `total` in all, those of least hash
of doc_id and text, from the labelled documents that are not held out. Prediction reads whole texts only.

Scale. Two passes: one draws the training sample, of which alone texts are shuffled, one reads all texts. The
model's size follows from the number of languages and of hash buckets.

Edge cases. Null text or no letter: `und`, score 0. No labelled document: all `und`. One language: it
is predicted everywhere else. Null doc_id: not held out, not learned from. Repeated rows are predicted
each. Empty table: no rows. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common
from .shingles import _text_bytes

BUCKETS = 2048
PER_LANGUAGE = 800
TOTAL = 6400
#: Families of common languages. Others join the family whose centroid is nearest.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "is"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca"),
    "slavic": ("ru", "pl", "cs", "uk", "bg", "sr"),
}
_ROWS = 256
_BYTES = 1 << 20


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def features(texts: pa.Array, buckets: int = BUCKETS) -> Iterator[np.ndarray]:
    """Rows of unit length, in order: damped counts of byte pairs and triples of the lower-cased text.

    ASCII signs that are no letters count as one space; runs of spaces alone don't count.
    """
    keep = np.full(256, 32, np.uint8)
    keep[97:123] = np.arange(97, 123)
    keep[128:] = np.arange(128, 256)
    data, offsets = _text_bytes(pc.utf8_lower(texts.fill_null("").cast(pa.large_string())))
    row, count = 0, len(texts)
    while row < count:
        stop = min(row + _ROWS, max(row + 1, int(np.searchsorted(offsets, offsets[row] + _BYTES, side="right")) - 1))
        out = np.zeros((stop - row) * buckets)
        b = keep[data[offsets[row] : offsets[stop]]].astype(np.uint32)
        doc = np.repeat(np.arange(stop - row), np.diff(offsets[row : stop + 1]))
        for n in (2, 3):
            if len(b) < n:
                continue
            code, inside = b[: len(b) - n + 1].copy(), doc[: len(b) - n + 1] == doc[n - 1 :]
            blank = code == 32
            for k in range(1, n):
                code = code * np.uint32(256) + b[k : len(b) - n + 1 + k]
                blank &= b[k : len(b) - n + 1 + k] == 32
            at = ((code + np.uint32(n)) * np.uint32(2654435761) >> np.uint32(32 - buckets.bit_length() + 1)).astype(np.int64)
            ok = inside & ~blank
            out += np.bincount(doc[: len(at)][ok] * buckets + at[ok], minlength=len(out))
        part = np.log1p(out.reshape(stop - row, buckets))
        norm = np.linalg.norm(part, axis=1, keepdims=True)
        yield part / np.where(norm > 0, norm, 1)
        row = stop


def _descend(gradient, start: np.ndarray, curvature: float, steps: int = 400) -> np.ndarray:
    """Accelerated gradient descent on a smooth convex function."""
    w, v = start, start
    for k in range(steps):
        after = v - gradient(v) / curvature
        v = after + k / (k + 3) * (after - w)
        w = after
    return w


def _curvature(x: np.ndarray, weight: np.ndarray) -> float:
    """The greatest eigenvalue of x' diag(weight) x, a hair enlarged."""
    v = np.ones(x.shape[1], x.dtype)
    for _ in range(20):
        v = x.T @ (weight * (x @ v))
        v /= np.linalg.norm(v)
    return 1.01 * float(v @ (x.T @ (weight * (x @ v))))


def softmax_regression(x: np.ndarray, y: np.ndarray, classes: int, ridge: float = 1e-4) -> np.ndarray:
    """Weights of a softmax regression, all classes of equal weight; `x` has the constant column."""
    target = np.eye(classes, dtype=x.dtype)[y]
    weight = (1 / (classes * np.maximum(1, np.bincount(y, minlength=classes))[y])[:, None]).astype(x.dtype)

    def gradient(w):
        z = x @ w
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        return x.T @ ((p - target) * weight) + ridge * w

    return _descend(gradient, np.zeros((x.shape[1], classes), x.dtype), _curvature(x, weight[:, 0]) / 2 + ridge)


def linear_svm(x: np.ndarray, sign: np.ndarray, ridge: float = 1e-4) -> np.ndarray:
    """Squared hinge loss, both classes of equal weight; `x` has the constant column."""
    sign = sign.astype(x.dtype)
    weight = (np.where(sign > 0, 1 / max(1, (sign > 0).sum()), 1 / max(1, (sign < 0).sum())) / 2).astype(x.dtype)

    def gradient(w):
        slack = np.maximum(0, 1 - sign * (x @ w))
        return -2 * x.T @ (weight * sign * slack) + ridge * w

    return _descend(gradient, np.zeros(x.shape[1], x.dtype), 2 * _curvature(x, weight) + ridge)


@dataclass
class LanguageModel:
    languages: list[str]
    families: list[list[int]]
    family_weights: np.ndarray
    pair_weights: dict[tuple[int, int], np.ndarray]

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Language numbers and scores."""
        x = np.hstack([x, np.ones((len(x), 1))])
        z = x @ self.family_weights
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        family = p.argmax(1)
        language, score = np.zeros(len(x), np.int64), p.max(1)
        for f, members in enumerate(self.families):
            rows = np.flatnonzero(family == f)
            language[rows] = members[0]
            if len(members) == 1 or not len(rows):
                continue
            votes, margins, chance = (np.zeros((len(rows), len(members))) for _ in range(3))
            for i, a in enumerate(members):
                for j, b in enumerate(members[i + 1 :], i + 1):
                    m = x[rows] @ self.pair_weights[a, b]
                    votes[:, i] += m > 0
                    votes[:, j] += m <= 0
                    margins[:, i] += m
                    margins[:, j] -= m
                    q = 1 / (1 + np.exp(-3 * np.clip(m, -20, 20)))
                    chance[:, i] += q
                    chance[:, j] += 1 - q
            best = (votes + 1e-6 * np.tanh(margins)).argmax(1)
            language[rows] = np.array(members)[best]
            score[rows] *= chance[np.arange(len(rows)), best] / (len(members) - 1)
        return language, score


def fit(features: np.ndarray, y: list[str]) -> LanguageModel:
    """From rows of features, in single precision so that the driver holds little more than the sample once."""
    x = np.ones((len(features), features.shape[1] + 1), np.float32)
    x[:, :-1] = features
    languages = sorted(set(y))
    number = np.array([languages.index(v) for v in y], np.int64)
    centre = np.vstack([x[number == k, :-1].mean(0) for k in range(len(languages))])
    named = {v: name for name, group in FAMILIES.items() for v in group}
    of = [named.get(v) for v in languages]
    for k, v in enumerate(languages):
        if of[k] is None:
            near = [(float(centre[k] @ centre[j]), named[languages[j]]) for j in range(len(languages)) if languages[j] in named]
            of[k] = max(near)[1] if near else v
    families = [[k for k, f in enumerate(of) if f == name] for name in sorted(set(of))]
    family_of = np.zeros(len(languages), np.int64)
    for f, members in enumerate(families):
        family_of[members] = f
    family_weights = softmax_regression(x, family_of[number], len(families), ridge=1e-5)
    pairs = {}
    for members in families:
        for i, a in enumerate(members):
            for b in members[i + 1 :]:
                rows = (number == a) | (number == b)
                pairs[a, b] = linear_svm(x[rows], np.where(number[rows] == a, 1.0, -1.0))
    return LanguageModel(languages, families, family_weights, pairs)


def train(docs: DataFrame, per_language: int = PER_LANGUAGE, total: int = TOTAL) -> LanguageModel | None:
    """From `docs` (doc_id, text, lang): documents not held out with a language; None if there are none."""
    pool = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string")).where(
        F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    counts = {r["lang"]: r["n"] for r in pool.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    share = min(per_language, max(1, total // len(counts)))
    draw = F.pmod(F.xxhash64("doc_id", F.crc32(F.col("text").cast("binary"))), F.lit(1 << 30)) / F.lit(float(1 << 30))
    # some more than the share are drawn by hash, and the share of least hashes stays
    rate = F.create_map(*(x for v, n in counts.items() for x in (F.lit(v), F.lit((share + 8 * share**0.5) / n))))
    sample = pool.withColumn("draw", draw).where(F.col("draw") < rate[F.col("lang")])
    nth = F.row_number().over(W.partitionBy("lang").orderBy("draw", "doc_id"))
    sample = sample.withColumn("nth", nth).where(F.col("nth") <= share).select("doc_id", "text", "lang")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r.astype("<f2").tobytes() for block in features(batch.column("text")) for r in block]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), pa.array(rows, pa.binary())], names=["doc_id", "lang", "x"])

    rows = sample.mapInArrow(make, "doc_id long, lang string, x binary").toArrow().sort_by([("doc_id", "ascending"), ("lang", "ascending")])
    if not len(rows):
        return None
    packed = rows["x"].combine_chunks()
    packed = packed.chunk(0) if isinstance(packed, pa.ChunkedArray) else packed
    start = int(np.frombuffer(packed.buffers()[1], np.int32, 1, 4 * packed.offset)[0])
    x = np.frombuffer(packed.buffers()[2], "<f2", len(rows) * BUCKETS, start).reshape(len(rows), BUCKETS)
    return fit(x, rows["lang"].to_pylist())


def _labelled(model: LanguageModel | None, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Language and score of each text."""
    known = np.array([model is not None and t.is_valid and any(map(str.isalpha, t.as_py())) for t in texts], bool)
    names, scores = np.full(len(texts), "und", object), np.zeros(len(texts))
    if known.any():
        found = [model.predict(x) for x in features(texts)]
        languages = np.array(model.languages, object)
        names[known] = languages[np.concatenate([f[0] for f in found])][known]
        scores[known] = np.concatenate([f[1] for f in found])[known]
    return names, scores


def predict(docs: DataFrame, per_language: int = PER_LANGUAGE, total: int = TOTAL) -> DataFrame:
    """`docs` (doc_id, text, lang): doc_id, held_out, lang_pred, score."""
    with common.small_batches(docs.sparkSession):
        shared = docs.sparkSession.sparkContext.broadcast(train(docs, per_language, total))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                names, scores = _labelled(shared.value, batch.column(2))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(scores)],
                                                 names=["doc_id", "held_out", "lang_pred", "score"])

        rows = docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string"))
        return common.written(rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double"), "languages")


def keep_identified(docs: DataFrame) -> DataFrame:
    """The documents whose language can be told; rejected are those predicted `und`. Columns stay, whatever their names.

    Texts go to Python once and don't come back: the prediction alone does.
    """
    with common.small_batches(docs.sparkSession):
        shared = docs.sparkSession.sparkContext.broadcast(train(docs))

    @F.arrow_udf("string")
    def language(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in texts:
            yield pa.array(_labelled(shared.value, part)[0], pa.string())

    return docs.where(language(F.col("text").cast("string")) != "und")
