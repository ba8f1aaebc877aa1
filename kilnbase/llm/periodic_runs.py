"""Periodic runs of words in texts, found through the runs theorem.

A run is a stretch of words with smallest period q, at least two periods long, that no neighbouring word extends.

Method. By the runs theorem every run holds a Lyndon root that is the longest Lyndon word at its first place, under an order of the
words or under the reverse order. At place i the longest Lyndon word ends before the next smaller value of the inverse suffix
array, so both arrays (one for each order) list all roots. A root of period p at i is extended to the right by the longest common
extension of i and i + p, to the left by that of the reversed text: minima of the LCP array over a range of ranks, from a sparse
table of block minima. What comes out at least two periods long is a run; there are fewer of them than words.

What cannot be in a run is left out before, which changes no run: a word that comes once in its text ends every period, so
only stretches of words that repeat within the stretch count; a run's first root matches at least its first word to the right, and
only stretches with such roots are extended.

Scale. One pass, no shuffle. The texts of an Arrow batch (rows and bytes are bounded) are worked on together, each stretch under
symbols of its own and closed by a mark smaller than any word in both orders, so nothing reaches from one text into another.
Work is O(n log n) in a text's words, however they repeat; memory some 300 bytes a word of a batch's stretches.

Edge cases. Null or empty text: no runs, empty collapsed text. Null doc_id: kept; its tail is not repeated. Repeated rows: one
result each. Very long texts: whole. Empty table: no rows. Further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Fixed value: what a word is.
WORD = regex.compile(r"[^\x20\x09-\x0D]+")
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
ANNOTATED = "doc_id long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
#: Values of one block of the range minimum table.
BLOCK = 16


def suffix_ranks(symbols: np.ndarray) -> np.ndarray:
    """Inverse suffix array (a suffix that begins another is the smaller one), by prefix doubling among ties only."""
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    rank = np.empty(n, np.int64)
    ordered = symbols[order]
    first = np.concatenate([[True], ordered[1:] != ordered[:-1]])[:n]
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    tied = np.flatnonzero(~(first & np.append(first[1:], True)[:n]))
    reach = 1
    while len(tied):
        at = order[tied]
        ahead = at + reach
        second = np.where(ahead < n, rank[np.minimum(ahead, n - 1)], -1)
        key = rank[at] * (n + 1) + second + 1
        within = np.argsort(key, kind="stable")
        at, key = at[within], key[within]
        order[tied] = at
        first = np.concatenate([[True], key[1:] != key[:-1]])
        rank[at] = np.maximum.accumulate(np.where(first, tied, 0))
        tied = tied[~(first & np.append(first[1:], True))]
        reach *= 2
    return rank


def next_smaller(values: np.ndarray) -> np.ndarray:
    """For each place the next one with a smaller value, n where there is none."""
    v, n = values.tolist(), len(values)
    after = [n] * n
    for i in range(n - 2, -1, -1):
        j, x = i + 1, v[i]
        while j < n and v[j] > x:
            j = after[j]
        after[i] = j
    return np.array(after, np.int64)


def common_prefixes(symbols: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """LCP array: for each rank, what its suffix shares with the one of the rank before."""
    n = len(symbols)
    s, r = symbols.tolist(), rank.tolist()
    order = np.empty(n, np.int64)
    order[rank] = np.arange(n)
    order = order.tolist()
    lcp, h = [0] * n, 0
    for i in range(n):
        if r[i]:
            j = order[r[i] - 1]
            most = n - max(i, j)
            while h < most and s[i + h] == s[j + h]:
                h += 1
            lcp[r[i]] = h
            h = h - 1 if h else 0
        else:
            h = 0
    return np.array(lcp, np.int32)


class RangeMinimum:
    """Minima of ranges: running minima within blocks, a sparse table over the blocks' minima."""

    def __init__(self, values: np.ndarray):
        self.n = len(values)
        padded = np.full((-(-self.n // BLOCK) + 1, BLOCK), np.iinfo(values.dtype).max, values.dtype)
        padded.ravel()[: self.n] = values
        self.values = padded.ravel()
        self.head = np.minimum.accumulate(padded, axis=1).ravel()
        self.tail = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
        self.table, width = [padded.min(axis=1)], 1
        while 2 * width <= len(padded):
            last = self.table[-1]
            self.table.append(np.minimum(last[:-width], last[width:]))
            width *= 2

    def __call__(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Minimum over low..high, both included, for arrays of both."""
        a, b = low // BLOCK, high // BLOCK
        out = np.minimum(self.tail[low], self.head[high])
        between = b - a - 1
        level = np.frexp(np.maximum(between, 1))[1] - 1
        for k in np.unique(level[between > 0]):
            q = np.flatnonzero((between > 0) & (level == k))
            row = self.table[k]
            out[q] = np.minimum(out[q], np.minimum(row[a[q] + 1], row[b[q] - (1 << int(k))]))
        q = np.flatnonzero(a == b)
        if len(q):
            spot = low[q, None] + np.arange(BLOCK)
            inside = spot <= high[q, None]
            out[q] = np.where(inside, self.values[np.minimum(spot, len(self.values) - 1)], np.iinfo(self.values.dtype).max).min(axis=1)
        return out


class Extension:
    """Longest common extension to the right of two different places."""

    def __init__(self, symbols: np.ndarray, rank: np.ndarray | None = None):
        self.rank = suffix_ranks(symbols) if rank is None else rank
        self.minimum = RangeMinimum(common_prefixes(symbols, self.rank))

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        a, b = self.rank[i], self.rank[j]
        return self.minimum(np.minimum(a, b) + 1, np.maximum(a, b)).astype(np.int64)


def repeating_stretches(text: np.ndarray, word: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, stretch of each place): longest stretches within a text of at least `least` words, each of which the stretch holds twice.

    `text` and `word` number the text and the word at every place, texts one after the other.
    """
    place, group = np.arange(len(text)), text.astype(np.int64)
    while len(place):
        _, which, count = np.unique(group * (int(word.max()) + 1) + word[place], return_inverse=True, return_counts=True)
        keep = count[which] >= 2
        kept, old = place[keep], group[keep]
        if not len(kept):
            return kept, old
        new = np.concatenate([[True], (kept[1:] != kept[:-1] + 1) | (old[1:] != old[:-1])])
        stretch = np.cumsum(new) - 1
        long = np.bincount(stretch)[stretch] >= least
        kept, stretch = kept[long], stretch[long]
        if len(kept) == len(place):
            return kept, stretch
        place, group = kept, stretch
    return place, group


def _closed(stretch: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of stretches, each under numbers of its own and closed by its own mark, below all words; the same under the reverse order; where the marks are."""
    number = np.cumsum(np.concatenate([[True], stretch[1:] != stretch[:-1]])) - 1
    marks = int(number[-1]) + 1
    _, letter = np.unique(number * (int(word.max()) + 1) + word, return_inverse=True)
    closing = np.ones(len(word) + marks, bool)
    closing[np.arange(len(word)) + number] = False
    up = np.empty(len(closing), np.int64)
    up[closing] = np.arange(marks)
    down = up.copy()
    up[~closing] = marks + letter
    down[~closing] = marks + int(letter.max()) - letter
    return up, down, closing


def runs_of(text: np.ndarray, word: np.ndarray, least: int = 12) -> np.ndarray:
    """Rows (place, length, period), by place, then period, of all runs of at least max(least, 2 * period) words."""
    none = np.zeros((0, 3), np.int64)
    if not len(text):
        return none
    place, stretch = repeating_stretches(text, word, least)
    if not len(place):
        return none
    up, down, closing = _closed(stretch, word[place])
    spot, rank = np.flatnonzero(~closing), suffix_ranks(up)
    roots = [np.stack([spot, next_smaller(r)[spot] - spot]) for r in (rank, suffix_ranks(down))]
    i, p = np.unique(np.concatenate(roots, axis=1), axis=1)
    # a run's first root begins within its first period and is followed by its own first word
    match = up[i] == up[i + p]
    i, p = i[match], p[match]
    if not len(i):
        return none
    right = Extension(up, rank)(i, i + p)
    wide = 2 * p - 1 + right >= np.maximum(least, 2 * p)
    i, p, right = i[wide], p[wide], right[wide]
    if not len(i):
        return none
    # to the left: the stretches that have such roots, read backwards
    number = np.cumsum(closing) - closing
    chosen = np.zeros(int(closing.sum()), bool)
    chosen[number[i]] = True
    part = np.flatnonzero(chosen[number])
    back = np.full(len(up), -1, np.int64)
    back[part] = np.arange(len(part))[::-1]
    backwards, left = Extension(up[part][::-1].copy()), np.zeros(len(i), np.int64)
    inner = np.flatnonzero((i > 0) & (back[i - 1] >= 0))
    left[inner] = backwards(back[i[inner] - 1], back[i[inner] + p[inner] - 1])
    length = left + p + right
    found = length >= np.maximum(least, 2 * p)
    begin = place[np.searchsorted(spot, (i - left)[found])]
    runs = np.unique(np.stack([begin, p[found], length[found]], axis=1), axis=0)
    return runs[:, [0, 2, 1]]


def repeat_tail(key: int, n: int) -> np.ndarray | None:
    """Of one key in ten: which word stands at each place once the words from some place on repeat with a period; None for other keys."""
    h = zlib.crc32(str(key).encode())
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    i = np.arange(n)
    return np.where(i < a, i, a + (i - a) % p)


def annotate(docs: DataFrame, least: int = 12, repeat_tails: bool = False) -> DataFrame:
    """`docs` (doc_id, text) -> doc_id, runs by start, then period, and the text without the words that a run repeats.

    Runs of at least max(`least`, 2 * period) words; start is a word's number, from 0. `repeat_tails` first makes some texts
    periodic (`repeat_tail`), so that runs of every size occur.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, numbers, words, ids = batch.column(0).to_pylist(), {}, [], []
            for key, text in zip(keys, batch.column(1), strict=True):
                own = WORD.findall(text.as_py() or "")
                tail = repeat_tail(key, len(own)) if repeat_tails and key is not None else None
                if tail is not None:
                    own = [own[k] for k in tail.tolist()]
                words.append(own)
                ids.append(np.array([numbers.setdefault(w, len(numbers)) for w in own], np.int64))
            sizes = np.array([len(w) for w in words], np.int64)
            first = np.cumsum(sizes) - sizes
            of_text = np.repeat(np.arange(len(words)), sizes)
            runs = runs_of(of_text, np.concatenate(ids), least) if ids else np.zeros((0, 3), np.int64)
            owner = np.searchsorted(first + sizes, runs[:, 0], side="right")
            # +1 where a run's repetition begins, -1 where it ends
            depth = np.zeros(len(of_text) + 1, np.int64)
            np.add.at(depth, runs[:, 0] + runs[:, 2], 1)
            np.add.at(depth, runs[:, 0] + runs[:, 1], -1)
            dropped = np.cumsum(depth)[:-1] > 0
            collapsed = []
            for own, begin in zip(words, first.tolist(), strict=True):
                gone = dropped[begin : begin + len(own)]
                collapsed.append(" ".join([w for w, g in zip(own, gone.tolist(), strict=True) if not g] if gone.any() else own))
            ends = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(words)))]).astype(np.int32)
            fields = [pa.array(runs[:, 0] - first[owner]), pa.array(runs[:, 1]), pa.array(runs[:, 2])]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(fields, fields=list(RUN))), pa.array(collapsed, pa.string())],
                names=["doc_id", "runs", "collapsed"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, ANNOTATED)


def digests(docs: DataFrame, least: int = 12, repeat_tails: bool = True) -> DataFrame:
    """The number of runs, the longest one, and digests of all runs and of the collapsed text."""
    longest = F.expr("array_max(transform(runs, r -> struct(r.length, -r.start as before, -r.period as shorter)))")
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    out = annotate(docs, least, repeat_tails).select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("best"),
                                                     F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    start, length, period = -F.col("best.before"), F.col("best.length"), -F.col("best.shorter")
    out = out.select("doc_id", "n_runs", start.alias("start"), length.alias("length"), period.alias("period"),
                     F.expr("1000 * best.length div -best.shorter").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
    with common.small_batches(docs.sparkSession):
        return common.written(out, "periodic-runs")
