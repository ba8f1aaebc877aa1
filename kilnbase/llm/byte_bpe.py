"""Byte-level BPE from a rank file, encoded by prefix dynamic programming, and decoding.

Method. The encoding of every prefix of a piece ends in one token, and two tokens may stand side by
side exactly if the pair encodes to itself. So a table of the last token of each byte prefix is
filled left to right: of the tokens that end here, the one that may follow the table's entry at its
start. Reading the table backwards gives the ids. Appending fills further entries and changes none;
an edit refills from its start until the table repeats the old one for as many bytes as the
longest token has.

Texts are first cut by the vocabulary's pattern and each match is encoded on its own. No match runs on over a
space that is followed by other than white space, so texts are cut at such spaces and the ids of
each part are remembered, within a bound on bytes. Texts under any other pattern than `KNOWN` are not cut.

Scale. One pass without shuffle. The vocabulary is read once per worker.

Edge cases. Null or empty text: no ids, and the digest of nothing. Repeated rows and null doc_ids
are kept. Empty table: no rows. Further columns are ignored. Very long pieces take time in
proportion to their length.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .caches import LONGEST, Remembered

#: Bytes that remembered parts of texts and prefixes of pieces may take in a worker, and the number of remembered pairs.
PARTS_ROOM = 128 << 20
PIECES_ROOM = 128 << 20
CACHE_PAIRS = 500_000
#: Fixed value: the pattern that the cut at spaces holds for.
KNOWN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space for the pattern, the Unicode property. Fixed values.
WHITE = "\\t\\n\\x0b\\f\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def read_ranks(path: str) -> dict[bytes, int]:
    ranks = {}
    with open(path, "rb") as lines:
        for line in lines:
            if line.strip():
                token, rank = line.split()
                ranks[base64.b64decode(token)] = int(rank)
    return ranks


class PrefixBPE:
    """Encoding of single pieces and decoding."""

    def __init__(self, ranks: dict[bytes, int], cache_pairs: int = CACHE_PAIRS):
        self.ranks = ranks
        self.spelling = {rank: token for token, rank in ranks.items()}
        self.reach = [0] * 256  # longest token that ends in this byte
        for token in ranks:
            self.reach[token[-1]] = max(self.reach[token[-1]], len(token))
        self.longest = max(map(len, ranks))
        self.pairs: dict[tuple[int, int], bool] = {}
        self.cache_pairs = cache_pairs

    def may_follow(self, left: int, right: int) -> bool:
        """Whether the two tokens' bytes together encode to just these two tokens."""
        known = self.pairs.get((left, right))
        if known is None:
            known = self._merge(self.spelling[left] + self.spelling[right]) == [self.spelling[left], self.spelling[right]]
            if len(self.pairs) < self.cache_pairs:
                self.pairs[left, right] = known
        return known

    def _merge(self, data: bytes) -> list[bytes]:
        """The definition: join the neighbours of lowest rank, the leftmost first, until none join."""
        parts = [data[k : k + 1] for k in range(len(data))]
        none = len(self.ranks)
        joins = [self.ranks.get(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
        while joins:
            low = min(joins)
            if low == none:
                break
            k = joins.index(low)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            del joins[k]
            if k < len(joins):
                joins[k] = self.ranks.get(parts[k] + parts[k + 1], none)
            if k:
                joins[k - 1] = self.ranks.get(parts[k - 1] + parts[k], none)
        return parts

    def last_token(self, data: bytes, table: list[int], end: int) -> int:
        """Last token of the encoding of data[:end], given the table of the shorter prefixes."""
        for size in range(min(end, self.reach[data[end - 1]]), 0, -1):
            token = self.ranks.get(data[end - size : end])
            if token is not None and (size == end or self.may_follow(table[end - size - 1], token)):
                return token
        raise ValueError("the vocabulary lacks a single byte")

    def table(self, data: bytes) -> list[int]:
        out: list[int] = []
        for end in range(1, len(data) + 1):
            out.append(self.last_token(data, out, end))
        return out

    def read_back(self, table: list[int]) -> list[int]:
        ids, end = [], len(table)
        while end:
            ids.append(table[end - 1])
            end -= len(self.spelling[table[end - 1]])
        return ids[::-1]

    def encode(self, data: bytes) -> list[int]:
        whole = self.ranks.get(data)
        return [whole] if whole is not None else self.read_back(self.table(data))

    def decode(self, ids) -> bytes:
        return b"".join(map(self.spelling.__getitem__, ids))


class PrefixText:
    """One piece with its table, for exact appends and edits."""

    def __init__(self, bpe: PrefixBPE, data: bytes = b""):
        self.bpe, self.data = bpe, data
        self.last = bpe.table(data)

    def ids(self) -> list[int]:
        return self.bpe.read_back(self.last)

    def append(self, more: bytes) -> None:
        self.data += more
        for end in range(len(self.last) + 1, len(self.data) + 1):
            self.last.append(self.bpe.last_token(self.data, self.last, end))

    def replace(self, start: int, stop: int, new: bytes) -> int:
        """Puts `new` for data[start:stop]; returns how many entries of the table were refilled."""
        if not 0 <= start <= stop <= len(self.data):
            raise ValueError(f"no stretch {start}:{stop} in {len(self.data)} bytes")
        old, shift = self.last, len(new) - (stop - start)
        self.data = self.data[:start] + new + self.data[stop:]
        self.last, same, end = old[:start], 0, start
        while end < len(self.data):
            end += 1
            token = self.bpe.last_token(self.data, self.last, end)
            self.last.append(token)
            was = end - 1 - shift
            same = same + 1 if end > start + len(new) and old[was] == token else 0
            if same >= self.bpe.longest:
                self.last += old[was + 1 :]
                return end - start
        return end - start


class _Pieces:
    """Ids of pieces and of their prefixes, as little-endian uint32.

    A prefix's ids are those of the shorter prefix before its last token, and the last token; pieces
    share prefixes, so the table is one for all pieces of a worker, up to a bound on its bytes.
    """

    def __init__(self, bpe: PrefixBPE, room: int):
        self.bpe, self.table = bpe, Remembered(lambda data: None, room)
        self.packed = {rank: rank.to_bytes(4, "little") for rank in bpe.spelling}
        self.last = {ids: rank for rank, ids in self.packed.items()}

    def __getitem__(self, piece: str) -> bytes:
        data = piece.encode()
        found = self.table.get(data)
        if found is None:
            if len(data) > LONGEST:
                return b"".join(map(self.packed.__getitem__, self.bpe.encode(data)))
            found = self._prefix(data, {})
        return found

    def _prefix(self, data: bytes, fresh: dict[bytes, bytes]) -> bytes:
        ranks, end = self.bpe.ranks, len(data)
        for size in range(min(end, self.bpe.reach[data[-1]]), 0, -1):
            token = ranks.get(data[end - size :])
            if token is None:
                continue
            if size == end:
                ids = self.packed[token]
                break
            shorter = data[: end - size]
            before = self.table.get(shorter) or fresh.get(shorter) or self._prefix(shorter, fresh)
            if self.bpe.may_follow(self.last[before[-4:]], token):
                ids = before + self.packed[token]
                break
        else:
            raise ValueError("the vocabulary lacks a single byte")
        if self.table.room > 0:
            self.table.keep(data, ids)
        else:
            fresh[data] = ids
        return ids


class TextEncoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str, parts_room: int = PARTS_ROOM, pieces_room: int = PIECES_ROOM):
        self.bpe = PrefixBPE(ranks)
        self.cuts = pattern == KNOWN
        self.pattern = regex.compile(_with_white(pattern))
        self.white_after_space = regex.compile(f" (?:[{WHITE}]|$)")
        self.pieces = _Pieces(self.bpe, pieces_room)
        # what stands between two spaces -> ids of it with the space before it
        self.parts = Remembered(lambda part: self.encode_plainly(" " + part), parts_room)
        self.spelling = Spelling(self.bpe.spelling)
        self.decimals = Spelling({rank: b"%d " % rank for rank in self.bpe.spelling})

    def encode_plainly(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.pattern.findall(text)))

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian uint32."""
        if not text:
            return b""
        first, *rest = text.split(" ") if self.cuts else [text]
        if any(not part or part[0] < "!" or (part[0] > "~" and self.white_after_space.match(" " + part)) for part in rest):
            return self.encode_plainly(text)
        return self.encode_plainly(first) + b"".join(map(self.parts.__getitem__, rest))


def _with_white(pattern: str) -> str:
    """The pattern with white space spelled out, as the `regex` module's own class has four controls more."""
    out, at, inside = [], 0, False
    while at < len(pattern):
        two = pattern[at : at + 2]
        if two == r"\s":
            out.append(WHITE if inside else f"[{WHITE}]")
        elif two == r"\S":
            if inside:
                raise ValueError("a pattern with \\S within brackets is not supported")
            out.append(f"[^{WHITE}]")
        elif two[0] == "\\":
            out.append(two)
        else:
            inside = two[0] == "[" or (inside and two[0] != "]")
            out.append(two[0])
            at -= 1
        at += 2
    if "(" in pattern.replace("(?", ""):
        raise ValueError("a pattern with capturing groups is not supported")
    return "".join(out)


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> TextEncoder:
    return TextEncoder(read_ranks(path), pattern)


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """`docs` (doc_id, text): doc_id, ids array<int>."""
    return _run(docs, path, pattern, "doc_id long, ids array<int>", lambda ids, texts: (ids.astype(np.int32),), [pa.list_(pa.int32())], ["ids"])


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids) -> (doc_id, bytes); null ids give null, ids that the vocabulary lacks fail."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = PrefixBPE(read_ranks(path))
        for batch in batches:
            out = [None if ids is None else bpe.decode(ids) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["doc_id", "bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, bytes binary")


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encodes, decodes the ids again, and keeps digests of both: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    with common.small_batches(docs.sparkSession):
        return common.written(_run(docs, path, pattern, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string",
                                   _digest, [pa.int64(), pa.string(), pa.string()], ["n_tokens", "ids_sha256", "decoded_sha256"]), "bpe-digests")


class Spelling:
    """Joins the spellings of ids, all at once: a table of bytes and where each id's bytes lie."""

    def __init__(self, spelled: dict[int, bytes]):
        known = max(spelled) + 1
        self.size = np.array([len(spelled.get(k, b"")) for k in range(known)], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(spelled.get(k, b"") for k in range(known)), np.uint8)

    def join(self, ids: np.ndarray) -> bytes:
        size = self.size[ids]
        ends = np.cumsum(size)
        if not len(ids):
            return b""
        return self.flat[np.repeat(self.start[ids] - ends + size, size) + np.arange(ends[-1])].tobytes()


def _digest(ids: np.ndarray, texts: TextEncoder) -> tuple:
    return len(ids), hashlib.sha256(texts.decimals.join(ids)[:-1]).hexdigest(), hashlib.sha256(texts.spelling.join(ids)).hexdigest()


def _run(docs: DataFrame, path: str, pattern: str, schema: str, make, kinds, names) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = encoder(path, pattern)
        for batch in batches:
            rows = [make(np.frombuffer(texts.encode(t.as_py()), "<u4"), texts) for t in batch.column(1)]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["doc_id", *names])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)
