"""Word and shingle hashes of whole Arrow columns of texts, without a Python object per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .mph import mix

#: Bytes hashed at a time: bounds memory, whatever the batch.
CHUNK = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_MULTIPLIERS = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F,
                         0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F], np.uint64)


def byte_classes(white: bytes, punctuation: bool = False) -> np.ndarray:
    """0 for white space, 1 for word bytes and, if asked for, 2 for other ASCII signs."""
    out = np.ones(256, np.uint8)
    if punctuation:
        for b in range(128):
            out[b] = 1 if chr(b).isalnum() else 2
    out[list(white)] = 0
    return out


WHITE = b" \t\n\x0b\f\r"
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SAME = np.arange(256, dtype=np.uint8)


class _Powers:
    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def reach(self, n: int) -> None:
        if len(self.up) < n:
            size = max(n, CHUNK + 1)
            self.up, self.down = (np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size - 1, b, np.uint64))]) for b in (_BASE, _INVERSE))


_POWERS = _Powers()


def _text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and where each begins, with the end; null is empty."""
    texts = texts.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def token_hashes(texts: pa.Array, fold: np.ndarray = LOWER, classes: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, token hashes, for each row where its tokens begin, with the end), chunk by chunk.

    A token is a run of bytes of one class other than white space. Equal tokens have equal
    64-bit hashes; unequal ones differ but for a chance of about 2^-64.
    """
    classes = byte_classes(WHITE) if classes is None else classes
    data, offsets = _text_bytes(texts)
    row = 0
    while row < len(texts):
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + CHUNK, side="right")) - 1)
        low, high = offsets[row], offsets[stop]
        yield row, *_hash_chunk(fold[data[low:high]], offsets[row : stop + 1] - low, classes)
        row = stop


def _hash_chunk(data: np.ndarray, offsets: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    kind = classes[data]
    breaks = np.empty(n + 1, bool)
    breaks[0] = breaks[n] = True
    np.not_equal(kind[1:], kind[:-1], out=breaks[1:n])
    breaks[offsets] = True
    edges = np.flatnonzero(breaks)
    words = kind[edges[:-1]] > 0
    starts, ends = edges[:-1][words], edges[1:][words]
    _POWERS.reach(n + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _POWERS.up[:n], out=sums[1:])
        hashes = mix((sums[ends] - sums[starts]) * _POWERS.down[starts], 3)
    return hashes, np.searchsorted(starts, offsets)


def shingle_sets(texts: pa.Array, size: int) -> Iterator[np.ndarray]:
    """For each text its distinct `size`-word shingles as sorted hashes; fewer words are one shingle."""
    for _, words, bounds in token_hashes(texts):
        with np.errstate(over="ignore"):
            n = max(0, len(words) - size + 1)
            runs = np.zeros(n, np.uint64)
            for k in range(size):
                runs += words[k : k + n] * _MULTIPLIERS[k]
            runs = mix(runs, 5)
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                if b - a >= size:
                    yield np.unique(runs[a : b - size + 1])
                elif b > a:
                    yield mix((words[a:b] * _MULTIPLIERS[: b - a]).sum(dtype=np.uint64)[None], 20 + b - a)
                else:
                    yield runs[:0]
