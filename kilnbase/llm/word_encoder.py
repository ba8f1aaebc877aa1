"""Fast exact encoding with a lower-casing word-level BPE of the tokenizers library.

The library's pipeline for such a vocabulary never joins text across white space, so a text's ids
are the ids of its white-space separated words one after the other. Words repeat; each is
encoded once per worker and remembered, within a bound on bytes. What the shortcut does not cover goes through the
library's whole pipeline: separator controls that only Python counts as white space, texts that
hold the name of a special token, words with letters beyond Latin, other vocabularies.
"""

from __future__ import annotations

import json
import os
from functools import lru_cache

import regex

from .caches import Remembered

#: Bytes that remembered words and pieces of words may take in a worker.
ROOM = 256 << 20
#: Fixed value: a pre-tokeniser's pattern under which a run of letters is one piece.
LETTERS_WHOLE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _byte_alphabet() -> dict[int, str]:
    """Byte-level spelling: printable bytes stand for themselves, the others follow from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class WordEncoder:
    """`encode(text)` gives the library's ids as little-endian uint32 bytes."""

    def __init__(self, path: str, room: int = ROOM):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.vocab_size = self.tokenizer.get_vocab_size()
        self.model = self.tokenizer.model
        spec = json.loads(self.tokenizer.to_str())
        self.specials = [t["content"] for t in spec.get("added_tokens", ())]
        self.pattern = self._split_pattern(spec)
        self.letters_whole = self.pattern is not None and self.pattern.pattern == LETTERS_WHOLE
        self.alphabet = _byte_alphabet()
        self.packed = [k.to_bytes(4, "little") for k in range(self.vocab_size)]
        self.pieces = Remembered(self._piece, room // 3)
        self.words = Remembered(self.encode_word, room - room // 3)

    @staticmethod
    def _split_pattern(spec: dict):
        """The pre-tokeniser's pattern if the pipeline is one the shortcut holds for, else None."""
        normal = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", ())]
        before = (spec.get("pre_tokenizer") or {}).get("pretokenizers", ())
        if normal != ["NFC", "Replace", "Lowercase"] or [b["type"] for b in before] != ["Split", "ByteLevel"]:
            return None
        split, level = before
        if split["behavior"] != "Removed" or not split["invert"] or level["add_prefix_space"] or level["use_regex"]:
            return None
        return regex.compile(split["pattern"]["Regex"])

    def _whole(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return b"".join(i.to_bytes(4, "little") for i in ids)

    def _piece(self, piece: str) -> bytes:
        """Ids of a piece of a word after pre-tokenisation, as little-endian uint32."""
        # printable ASCII is spelled as it is
        spelled = piece if piece.isascii() and piece.isprintable() else piece.encode().decode("latin-1").translate(self.alphabet)
        packed = self.packed
        return b"".join([packed[t.id] for t in self.model.tokenize(spelled)])

    def encode_word(self, word: str) -> bytes:
        if word.isascii() and word.isalpha() and self.letters_whole:
            return self.pieces[word.lower()]
        # Below U+0250 texts are in NFC already and lower case is letter by letter, but for U+0130.
        if not word.isascii() and (max(word) >= "ɐ" or "İ" in word):
            return self._whole(word)
        return b"".join(map(self.pieces.__getitem__, self.pattern.findall(word.lower())))

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if (
            self.pattern is None
            or any(c in text for c in "\x1c\x1d\x1e\x1f")
            or any(s in text for s in self.specials)
        ):
            return self._whole(text)
        return b"".join(map(self.words.__getitem__, text.split()))


@lru_cache(maxsize=1)
def encoder(path: str, room: int = ROOM) -> WordEncoder:
    """One encoder per worker process and vocabulary."""
    return WordEncoder(path, room)
