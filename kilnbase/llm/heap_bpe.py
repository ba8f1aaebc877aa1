"""BPE with word ends by a priority queue over a linked list of symbols, exactly as the tokenizers library encodes.

Method. A piece of text starts as a doubly linked list of symbols. Every adjacent pair that can merge lies in a heap
under (rank, position); the best is taken out and, unless stale (a symbol of it is gone, or the pair there is another by now), its
symbols become one, whose pairs with its two neighbours enter the heap. So n symbols take O(n log n), whatever they are.
Decoding concatenates the vocabulary's strings, one space between them, as the library does where no decoder is set.

Before the merges come the vocabulary's own steps: its special tokens are cut out of the raw text, texts are normalised (NFC,
white space, lower case), split by the pattern and spelled in the byte alphabet. Below U+0250 these are done here, in other
words by the library's normaliser and pre-tokeniser. None joins text across white space, so words are
encoded one by one; short ones are remembered within a bound on bytes.

Scale. One pass, no shuffle, nothing broadcast but a file name. A worker remembers up to 160 MB.

Edge cases. Null text: empty, no ids. Very long texts and words: whole. Repeated rows and doc_ids: one row each. Null
doc_id: kept. Names of special tokens within a text: their ids. Empty table: no rows. Further columns are ignored. A vocabulary with
other steps than these, or without every byte, raises ValueError: no text is encoded wrongly.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .byte_bpe import WHITE, Spelling
from .byte_bpe import _with_white as with_white
from .caches import Remembered
from .word_encoder import LETTERS_WHOLE
from .word_encoder import _byte_alphabet as byte_alphabet

#: Bytes for remembered words and pieces in a worker.
ROOM = 160 << 20
#: Control characters that Python, but no Unicode property, counts as white space.
SEPARATORS = "\x1c\x1d\x1e\x1f"
DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class HeapBPE:
    """Merges of a vocabulary: `merge(symbols)` gives ids."""

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str):
        self.suffix = suffix
        self.vocab = vocab
        self.size = max(vocab.values()) + 1
        # pair of ids -> rank; rank -> id of the merged symbol
        self.ranks: dict[int, int] = {}
        self.merged: list[int] = []
        for left, right in merges:
            self.ranks.setdefault(vocab[left] * self.size + vocab[right], len(self.merged))
            self.merged.append(vocab[left + right])

    def merge(self, ids: list[int]) -> list[int]:
        """The symbols of one piece, merged."""
        n, size, rank_of, merged = len(ids), self.size, self.ranks.get, self.merged
        if n < 2:
            return ids
        heap = []
        for at in range(n - 1):
            rank = rank_of(ids[at] * size + ids[at + 1])
            if rank is not None:
                heap.append(rank * n + at)
        if not heap:
            return ids
        heapify(heap)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        while heap:
            rank, at = divmod(heappop(heap), n)
            right = after[at]
            # stale: the left symbol is gone or last, or the pair at this place has changed
            if ids[at] < 0 or right < 0 or rank_of(ids[at] * size + ids[right]) != rank:
                continue
            new = ids[at] = merged[rank]
            ids[right] = -1
            beyond = after[at] = after[right]
            if beyond >= 0:
                before[beyond] = at
                rank = rank_of(new * size + ids[beyond])
                if rank is not None:
                    heappush(heap, rank * n + at)
            previous = before[at]
            if previous >= 0:
                rank = rank_of(ids[previous] * size + new)
                if rank is not None:
                    heappush(heap, rank * n + previous)
        return [i for i in ids if i >= 0]

    def piece(self, spelled: str) -> list[int]:
        """Ids of a piece spelled in the byte alphabet; its last symbol bears the word end."""
        vocab = self.vocab
        return self.merge([*map(vocab.__getitem__, spelled[:-1]), vocab[spelled[-1] + self.suffix]])


class TextEncoder:
    """`encode(text)` gives ids as little-endian uint32 bytes, `decode(ids)` the text of ids."""

    def __init__(self, path: str, room: int = ROOM):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        spec = json.loads(tokenizer.to_str())
        model, added = spec["model"], spec["added_tokens"]
        pattern = _pattern(spec)
        self.bpe = HeapBPE(model["vocab"], [m.split(" ", 1) if isinstance(m, str) else m for m in model["merges"]], model["end_of_word_suffix"])
        self.alphabet = byte_alphabet()
        self.letters_whole = pattern == LETTERS_WHOLE
        self.packed = [i.to_bytes(4, "little") for i in range(self.bpe.size)]
        if any(c + end not in model["vocab"] for c in self.alphabet.values() for end in ("", self.bpe.suffix)):
            raise ValueError("the vocabulary lacks a byte")
        self.normal, self.split = tokenizer.normalizer.normalize_str, tokenizer.pre_tokenizer.pre_tokenize_str
        self.pattern = regex.compile(with_white(pattern))
        self.words_of = regex.compile(f"[^{WHITE}]+").findall
        self.special = {t["content"]: t["id"] for t in added}
        longest_first = sorted(self.special, key=len, reverse=True)
        self.special_of = regex.compile("(" + "|".join(map(regex.escape, longest_first)) + ")") if added else None
        self.pieces = Remembered(self._piece, room // 3)
        self.words = Remembered(self._word, room - room // 3)
        strings = {i: s.encode() + b" " for s, i in [*model["vocab"].items(), *self.special.items()]}
        self.strings = Spelling(strings)
        self.decimals = Spelling({i: b"%d " % i for i in strings})

    def _piece(self, piece: str) -> bytes:
        """Ids of a piece of normalised text."""
        spelled = piece if piece.isascii() and piece.isprintable() else piece.encode().decode("latin-1").translate(self.alphabet)
        return self._packed(self.bpe.piece(spelled))

    def _packed(self, ids: list[int]) -> bytes:
        packed = self.packed
        return b"".join([packed[i] for i in ids])

    def _word(self, word: str) -> bytes:
        if self.letters_whole and word.isascii() and word.isalpha():
            return self.pieces[word.lower()]
        # Below U+0250 text is in NFC already, and lower case is letter by letter but for U+0130.
        if word.isascii() or (max(word) < "ɐ" and "İ" not in word):
            return b"".join(map(self.pieces.__getitem__, self.pattern.findall(word.lower())))
        return b"".join(self._packed(self.bpe.piece(spelled)) for spelled, _ in self.split(self.normal(word)))

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.special_of is not None and self.special_of.search(text):
            return b"".join(self.special[part].to_bytes(4, "little") if part in self.special else self._plain(part) for part in self.special_of.split(text))
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        words = self.words_of(text) if any(c in text for c in SEPARATORS) else text.split()
        return b"".join(map(self.words.__getitem__, words))

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the vocabulary's strings, one space between them."""
        return self.strings.join(ids)[:-1]


def _pattern(spec: dict) -> str:
    """The pre-tokeniser's pattern, if the vocabulary has the steps that are done here."""
    model, level = spec["model"], (spec["pre_tokenizer"] or {}).get("pretokenizers", ())
    normal = (spec["normalizer"] or {}).get("normalizers", ())
    sound = (
        model["type"] == "BPE"
        and model["end_of_word_suffix"]
        and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
        and [n["type"] for n in normal] == ["NFC", "Replace", "Lowercase"]
        and normal[1]["pattern"] == {"Regex": r"\s+"}
        and normal[1]["content"] == " "
        and [s["type"] for s in level] == ["Split", "ByteLevel"]
        and level[0]["behavior"] == "Removed" and level[0]["invert"]
        and not level[1]["add_prefix_space"] and not level[1]["use_regex"]
        and spec["decoder"] is None
        and not any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in spec["added_tokens"])
    )
    if not sound:
        raise ValueError("a vocabulary of another kind: not encoded here")
    return level[0]["pattern"]["Regex"]


@lru_cache(maxsize=1)
def encoder(path: str, room: int = ROOM) -> TextEncoder:
    """One encoder per worker process and vocabulary."""
    return TextEncoder(path, room)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """`docs` (doc_id, text): doc_id, ids array<int>."""
    return _run(docs, path, "doc_id long, ids array<int>", lambda ids, texts: (ids.astype(np.int32),), [pa.list_(pa.int32())])


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids) -> (doc_id, text); null ids give null, ids that the vocabulary lacks fail."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = encoder(path)
        for batch in batches:
            out = [None if ids is None else texts.decode(np.array(ids, np.int64)).decode() for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """Encodes, decodes the ids again, and keeps digests of both."""
    with common.small_batches(docs.sparkSession):
        return common.written(_run(docs, path, DIGESTS, _digest, [pa.int64(), pa.string(), pa.string()]), "heap-bpe-digests")


def _digest(ids: np.ndarray, texts: TextEncoder) -> tuple:
    return len(ids), _sha256(texts.decimals, ids), _sha256(texts.strings, ids)


def _sha256(spelling: Spelling, ids: np.ndarray, step: int = 1 << 18) -> str:
    """Of the ids' spellings less the last space, a stretch of a long text at a time."""
    out = hashlib.sha256()
    for k in range(0, len(ids), step):
        part = spelling.join(ids[k : k + step])
        out.update(part if k + step < len(ids) else part[:-1])
    return out.hexdigest()


def _run(docs: DataFrame, path: str, schema: str, make, kinds) -> DataFrame:
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = encoder(path)
        for batch in batches:
            rows = [make(np.frombuffer(texts.encode(t.as_py()), "<u4"), texts) for t in batch.column(1)]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)
