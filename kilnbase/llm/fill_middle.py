"""Fill-in-middle transformation with offsets from the tokenizers library's Split pre-tokeniser.

Method. An untrained `Split` pre-tokeniser with isolated matches of a pattern gives every token's code-point
offsets. The length of the offset array is n, the number of tokens; a document's hash picks two ranks in
0..n, and the offsets at these ranks cut the text into prefix, middle and suffix. The pieces are put in
order around sentinels: prefix, suffix, middle (psm) or suffix, prefix, middle (spm). A share of the documents, and
those that are empty or hold a sentinel, stay as they are (plain). `restore` rebuilds the text from output and form.

Scale. One pass, no shuffle: each row depends on its own doc_id and text. Offsets are taken in stretches of some
64 thousand characters which end where no token crosses, of which only the counts are kept, so a long text costs little beside itself.

Edge cases. Null text: empty. Empty text: plain, n = 0. Null doc_id: hashed as the word `null`, kept as null.
Repeated doc_ids: the same ranks by hash, applied to each row's own text. Very long texts: whole, in stretches; a run of
letters is one token of any length. Empty table: no rows. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Fixed values of the transformation.
LETTERS = "A-Za-z"
SENTINELS = ("<P>", "<S>", "<M>")
TRANSFORMED = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
#: Characters whose offsets are taken at a time.
STRETCH = 1 << 16


@lru_cache(maxsize=1)
def _splitter():
    """Tokens are runs of letters and single other characters, all of them isolated matches."""
    from tokenizers import Regex
    from tokenizers.pre_tokenizers import Split

    return Split(Regex(f"[{LETTERS}]+|[^{LETTERS}]"), behavior="isolated")


_NO_LETTER = regex.compile(f"[^{LETTERS}]")


def _stretches(text: str, least: int) -> Iterator[tuple[int, str]]:
    """(start, stretch) of at least `least` characters each; a stretch but the last ends with a character that is a token of its own."""
    at = 0
    while at < len(text):
        stop = _NO_LETTER.search(text, at + least - 1)
        end = stop.end() if stop else len(text)
        yield at, text[at:end]
        at = end


class Offsets:
    """Token offsets of a text: their number and the one of any rank. Of a text of several stretches only their counts are kept."""

    def __init__(self, text: str, stretch: int = STRETCH):
        self.text, self.split = text, _splitter().pre_tokenize_str
        self.parts, self.spans = [], []
        for at, part in _stretches(text, stretch):
            self.spans = self.split(part)
            self.parts.append((at, len(self.spans)))
        self.n = sum(n for _, n in self.parts)

    def __getitem__(self, rank: int) -> int:
        """Code-point offset at which the token of this rank starts; the text's length for n."""
        if rank == self.n:
            return len(self.text)
        for k, (at, n) in enumerate(self.parts):
            if rank < n:
                last = k == len(self.parts) - 1
                spans = self.spans if last else self.split(self.text[at : self.parts[k + 1][0]])
                return at + spans[rank][1][0]
            rank -= n
        raise IndexError(rank)


def draws(doc_id: int | None, seed: int = 1) -> tuple[int, int, int, int]:
    """Four numbers of 32 bits from a document's key."""
    digest = hashlib.sha256(f"{seed}:{'null' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[4 * k : 4 * k + 4]) for k in range(4))


def transform_text(doc_id: int | None, text: str, seed: int = 1, plain_percent: int = 10, spm_percent: int = 20) -> tuple:
    """n, form, prefix_chars, middle_chars, output."""
    h1, h2, h3, h4 = draws(doc_id, seed)
    starts = Offsets(text)
    n = starts.n
    if not text or any(s in text for s in SENTINELS) or h3 % 100 >= 100 - plain_percent:
        return n, "plain", None, None, text
    low, high = (starts[r] for r in sorted((h1 % (n + 1), h2 % (n + 1))))
    prefix, middle, suffix = text[:low], text[low:high], text[high:]
    p, s, m = SENTINELS
    if h4 % 100 < spm_percent:
        return n, "spm", low, high - low, f"{s}{suffix}{p}{prefix}{m}{middle}"
    return n, "psm", low, high - low, f"{p}{prefix}{s}{suffix}{m}{middle}"


def transform(docs: DataFrame, seed: int = 1, plain_percent: int = 10, spm_percent: int = 20) -> DataFrame:
    """`docs` (doc_id, text) -> doc_id, n, form, prefix_chars, middle_chars, output."""
    names = [f.split()[0] for f in TRANSFORMED.split(", ")]
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(d, *transform_text(d, t.as_py() or "", seed, plain_percent, spm_percent))
                    for d, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True)]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, TRANSFORMED)


def restored() -> Column:
    """The exact text, from the columns `output` and `form`. A plain text may hold sentinels; no other holds more than its three."""
    part = F.split("output", "|".join(SENTINELS))
    return (
        F.when(F.col("form") == "psm", F.concat(part[1], part[3], part[2]))
        .when(F.col("form") == "spm", F.concat(part[2], part[3], part[1]))
        .otherwise(F.col("output"))
    )


def digests(docs: DataFrame, seed: int = 1) -> DataFrame:
    """Digests of output and restored text in place of the texts."""
    out = transform(docs, seed).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(), 256).alias("restored_sha256"))
    with common.small_batches(docs.sparkSession):
        return common.written(out, "fill-middle")
