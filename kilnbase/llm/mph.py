"""Minimal perfect hash over 64-bit keys: cascaded bit arrays, about 3 bits a key.

Level by level every remaining key hashes to a bit; keys alone on their bit are placed, the
others go on to the next level. A key's number is the rank of its bit. A stranger also gets some
number, so the table that is addressed by it stores a fingerprint of each key.
"""

from __future__ import annotations

import numpy as np

_LOAD = 1.6
_MAX_LEVELS = 60


def mix(x: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit bijective finaliser of x shifted by the seed."""
    with np.errstate(over="ignore"):
        z = x.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def document_keys(ids: np.ndarray, absent: np.ndarray, repeat: np.ndarray) -> np.ndarray:
    """64-bit keys of (doc_id or null, number of the repeat); distinct for distinct ids at repeat 0."""
    with np.errstate(over="ignore"):
        base = mix(ids.astype(np.int64).view(np.uint64), 1) + absent.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        return base ^ mix(repeat.astype(np.uint64), 7) * (repeat > 0)


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mix(keys, 1000) >> np.uint64(32)).astype(np.uint32)


class MinimalPerfectHash:
    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.starts, before = [], 0
        self.ranks = []
        for bits in levels:
            ones = np.cumsum(bits, dtype=np.int64)
            self.ranks.append(ones + before)
            before += int(ones[-1]) if len(ones) else 0
        self.size = before

    @classmethod
    def build(cls, keys: np.ndarray) -> "MinimalPerfectHash":
        """Keys must be distinct."""
        levels, left = [], keys.astype(np.uint64)
        while len(left):
            if len(levels) > _MAX_LEVELS:
                raise ValueError("keys are not distinct")
            size = max(64, int(_LOAD * len(left)))
            at = (mix(left, len(levels) + 2) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone)
            left = left[~alone[at]]
        return cls(levels)

    def number(self, keys: np.ndarray) -> np.ndarray:
        """0 to size - 1 for the keys it was built from; -1 where no level has the key's bit."""
        out = np.full(len(keys), -1, np.int64)
        todo = np.arange(len(keys))
        keys = keys.astype(np.uint64)
        for k, bits in enumerate(self.levels):
            at = (mix(keys[todo], k + 2) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[at]
            out[todo[hit]] = self.ranks[k][at[hit]] - 1
            todo = todo[~hit]
        return out

    def to_bytes(self) -> bytes:
        sizes = np.array([len(self.levels), *map(len, self.levels)], "<u4").tobytes()
        return sizes + b"".join(np.packbits(b, bitorder="little").tobytes() for b in self.levels)

    @classmethod
    def from_bytes(cls, data: bytes) -> tuple["MinimalPerfectHash", int]:
        """The hash and how many bytes it took."""
        count = int(np.frombuffer(data, "<u4", 1)[0])
        sizes = np.frombuffer(data, "<u4", count, 4)
        at, levels = 4 + 4 * count, []
        for size in sizes.tolist():
            length = (size + 7) // 8
            packed = np.frombuffer(data, np.uint8, length, at)
            levels.append(np.unpackbits(packed, count=size, bitorder="little").astype(bool))
            at += length
        return cls(levels), at
