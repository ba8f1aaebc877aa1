"""Fill-in-middle, heap BPE and periodic runs against plain versions and the library."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kilnbase.llm import fill_middle, heap_bpe, periodic_runs
from kilnbase.llm.word_encoder import WordEncoder

WORDS = P.path("word_bpe_49k.json")
ROWS = [(5, "The cat sat.\nOn the mat"), (3, None), (9, ""), (1, "Élan café 12 don't  x"), (7, "word " * 3000), (7, "word " * 3000), (7, "other"), (8, "\x1ca\x1db <|endoftext|> # !"),
        (None, "no id"), (2, "日本語 テキスト İstanbul ΑΣ ﬁn é"), (11, "a" * 5000), (12, "holds <S> itself"), (13, "<"), (14, "<P"), (15, "S>M>")]
ROWS += [(20 + k, f"a b{k}, c. " * k) for k in range(40)]
#: Columns whose names clash with those the operators make.
SCHEMA = "doc_id long, text string, n int, runs string, form string, output string, ids string, start int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 0, "x", "y", "z", "i", 1) for r in rows], SCHEMA)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


TEXT = st.text(alphabet=st.one_of(st.sampled_from(list("abcXYZ '.,!?\n\t 019-#éßİΣςΑ\x1c\x1f\x85\xa0̧́<>|PSM가각")), st.characters(codec="utf-8")), max_size=40)


# fill-in-middle

def plain_fill(doc_id, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    tokens = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    n = len(tokens)
    if not text or "<P>" in text or "<S>" in text or "<M>" in text or h3 % 100 >= 90:
        return (doc_id, n, "plain", None, None, text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    spm = h4 % 100 < 20
    return (doc_id, n, "spm" if spm else "psm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}")


def test_fill_in_middle_equals_a_plain_version(spark):
    want = [plain_fill(*r) for r in ROWS]
    assert {w[2] for w in want} == {"plain", "psm", "spm"}
    assert rows_of(fill_middle.transform(frame(spark, ROWS))) == sorted(want, key=repr)


def test_fill_in_middle_restores_every_text(spark):
    out = fill_middle.transform(frame(spark, ROWS)).select("doc_id", fill_middle.restored().alias("text"))
    assert rows_of(out) == sorted(((d, t or "") for d, t in ROWS), key=repr)
    digests = fill_middle.digests(frame(spark, ROWS))
    want = [(*w[:5], sha(w[5]), sha(t or "")) for w, (_, t) in zip([plain_fill(*r) for r in ROWS], ROWS, strict=True)]
    assert rows_of(digests) == sorted(want, key=repr)
    assert fill_middle.digests(frame(spark, [])).count() == 0


def test_token_offsets_do_not_depend_on_the_stretch():
    @settings(max_examples=300, deadline=None)
    @given(TEXT, st.integers(1, 8))
    def check(text, stretch):
        want = [*(m.start() for m in re.finditer("[A-Za-z]+|[^A-Za-z]", text)), len(text)]
        for offsets in (fill_middle.Offsets(text), fill_middle.Offsets(text, stretch)):
            assert offsets.n == len(want) - 1 and [offsets[k] for k in range(len(want))] == want

    check()


# heap BPE

@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(WORDS)


def test_heap_bpe_equals_the_library(library):
    texts = heap_bpe.TextEncoder(WORDS, room=20_000)

    @settings(max_examples=400, deadline=None)
    @given(TEXT)
    def check(text):
        ids = library.encode(text, add_special_tokens=False).ids
        got = np.frombuffer(texts.encode(text), "<u4")
        assert got.tolist() == ids
        assert texts.decode(got).decode() == library.decode(ids, skip_special_tokens=False)

    check()
    for _, text in [*ROWS, (0, "<|startoftext|>a<|endoftext|><|endoftext|> b"), (0, "aaaa" * 2000 + "the" * 900)]:
        assert np.frombuffer(texts.encode(text), "<u4").tolist() == library.encode(text or "", add_special_tokens=False).ids


def test_heap_bpe_agrees_on_every_code_point_block(library):
    texts = heap_bpe.TextEncoder(WORDS)
    rng = random.Random(5)
    points = [c for c in [*range(0x3000), *(rng.randrange(0x3000, 0x110000) for _ in range(20_000))] if not 0xD800 <= c < 0xE000]
    samples = [f"Ab{chr(c)}c1 {chr(c)}" for c in points]
    for text, want in zip(samples, library.encode_batch(samples, add_special_tokens=False), strict=True):
        assert np.frombuffer(texts.encode(text), "<u4").tolist() == want.ids, repr(text)


def test_heap_merges_like_a_plain_loop():
    """Against merging the lowest rank, leftmost first, by a scan for each merge."""
    vocab = {c: k for k, c in enumerate(["a", "b", "a!", "b!"])}
    merges = [("a", "b"), ("b", "a"), ("ab", "ab"), ("a", "a"), ("ab", "a!"), ("b", "b!"), ("aa", "aa"), ("ba", "b")]
    for left, right in merges:
        vocab[left + right] = len(vocab)
    bpe = heap_bpe.HeapBPE(vocab, merges, "!")
    rank = {m: k for k, m in enumerate(merges)}
    rng = random.Random(2)
    for _ in range(2000):
        word = "".join(rng.choices("ab", k=rng.randint(1, 14)))
        parts = [*word[:-1], word[-1] + "!"]
        while True:
            best = min(((rank[p], k) for k, p in enumerate(zip(parts, parts[1:])) if p in rank), default=None)
            if best is None:
                break
            parts[best[1] : best[1] + 2] = ["".join(parts[best[1] : best[1] + 2])]
        assert bpe.piece(word) == [vocab[p] for p in parts]


def test_heap_bpe_rejects_other_vocabularies():
    with pytest.raises(ValueError):
        heap_bpe.TextEncoder(P.path("byte_bpe_50k.json"))


def test_heap_bpe_queries(spark, library):
    docs = frame(spark, ROWS)
    ids = {(d, t): library.encode(t or "", add_special_tokens=False).ids for d, t in ROWS}
    encoded = heap_bpe.encode(docs, WORDS)
    assert rows_of(encoded.selectExpr("doc_id", "ids")) == sorted(((d, ids[d, t]) for d, t in ROWS), key=repr)
    assert rows_of(heap_bpe.decode(encoded, WORDS)) == sorted(((d, library.decode(ids[d, t], skip_special_tokens=False)) for d, t in ROWS), key=repr)
    want = [(d, len(i), sha(" ".join(map(str, i))), sha(library.decode(i, skip_special_tokens=False))) for (d, t), i in ((r, ids[r]) for r in ROWS)]
    assert rows_of(heap_bpe.digests(docs, WORDS)) == sorted(want, key=repr)
    assert heap_bpe.digests(frame(spark, []), WORDS).count() == 0


def test_digest_of_long_ids_by_stretches(library):
    texts = heap_bpe.TextEncoder(WORDS)
    ids = np.arange(49_000, dtype=np.uint32)
    whole = hashlib.sha256(" ".join(map(str, ids.tolist())).encode()).hexdigest()
    assert heap_bpe._sha256(texts.decimals, ids, 7) == heap_bpe._sha256(texts.decimals, ids) == whole
    assert heap_bpe._sha256(texts.decimals, ids[:0]) == sha("")


def test_both_word_encoders_agree():
    a, b = heap_bpe.TextEncoder(WORDS), WordEncoder(WORDS)
    for _, text in ROWS:
        assert a.encode(text) == b.encode(text)


# periodic runs

def plain_runs(w, least=12):
    n, out = len(w), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            size = j + q - i
            if size >= max(least, 2 * q) and not any(all(w[k] == w[k + r] for k in range(i, i + size - r)) for r in range(1, q)):
                out.append((i, size, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_words(doc_id, text, tails):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if tails and doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return words


def test_runs_equal_a_plain_search():
    rng = random.Random(3)
    for _ in range(1500):
        texts = []
        for _ in range(rng.randint(1, 5)):
            k, n = rng.choice([1, 2, 2, 3, 5]), rng.randint(0, 40)
            w = [rng.randrange(k) for _ in range(n)]
            if n and rng.random() < 0.4:
                p = rng.randint(1, n)
                w = [w[i % p] for i in range(n)]
            texts.append(w)
        least = rng.choice([2, 4, 12])
        of_text = np.array([k for k, w in enumerate(texts) for _ in w], np.int64)
        got = periodic_runs.runs_of(of_text, np.array([x for w in texts for x in w], np.int64), least).tolist()
        want, base = [], 0
        for w in texts:
            want += [[base + i, size, q] for i, size, q in plain_runs(w, least)]
            base += len(w)
        assert got == want


def test_runs_of_fibonacci_words_and_squares():
    """Texts full of runs that overlap, each under many periods."""
    a, b = "a", "ab"
    for _ in range(10):
        a, b = b, b + a
    for text in (b[:300], "ab" * 60 + "abc" * 30, "a" * 200, "aab" * 20 + "ab" * 20 + "aab" * 20):
        word = np.array([ord(c) for c in text], np.int64)
        for least in (2, 12):
            assert periodic_runs.runs_of(np.zeros(len(word), np.int64), word, least).tolist() == [list(r) for r in plain_runs(text, least)]


def test_suffix_ranks_prefixes_and_minima():
    rng = np.random.default_rng(1)
    for size, letters in ((1, 1), (50, 2), (300, 3), (200, 1)):
        s = rng.integers(0, letters, size)
        suffixes = sorted(range(size), key=lambda k: s[k:].tolist())
        rank = periodic_runs.suffix_ranks(s)
        assert rank.tolist() == [suffixes.index(k) for k in range(size)]
        lcp = periodic_runs.common_prefixes(s, rank)
        minimum = periodic_runs.RangeMinimum(lcp)
        low = rng.integers(0, size, 100)
        high = np.minimum(low + rng.integers(0, size, 100), size - 1)
        assert minimum(low, high).tolist() == [int(lcp[x : y + 1].min()) for x, y in zip(low, high, strict=True)]
        for k in range(1, size):
            a, b = s[suffixes[k - 1] :].tolist(), s[suffixes[k] :].tolist()
            assert lcp[k] == next((h for h, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


RUNNING = [*ROWS, (30, "x y z " * 10), (30, "x y z " * 10), (31, " ".join(f"w{k % 7} w{k % 5}" for k in range(200))), (None, "a b " * 9), (32, "one two " * 40), (33, " \t\n"),
           *[(100 + k, " ".join(f"u{(j * j) % 11}" for j in range(k * 3))) for k in range(60)]]


@pytest.mark.parametrize("tails", [False, True])
def test_runs_and_collapsed_texts(spark, tails):
    want, digests = [], []
    for d, t in RUNNING:
        words = plain_words(d, t, tails)
        runs = plain_runs(words)
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        want.append((d, runs, kept))
        best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        digests.append((d, len(runs), *((*best, 1000 * best[1] // best[2]) if best else (None,) * 4), sha(lines), sha(kept)))
    assert sum(len(r) for _, r, _ in want) > 50
    got = [(r["doc_id"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in periodic_runs.annotate(frame(spark, RUNNING), 12, tails).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    out = periodic_runs.digests(frame(spark, RUNNING), 12, tails)
    assert rows_of(out) == sorted(digests, key=repr)
    assert out.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert periodic_runs.digests(frame(spark, []), 12, tails).count() == 0
