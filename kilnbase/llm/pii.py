"""Personal data by weak supervision.

Method. Base spans follow fixed patterns and always stand: email, ip, card, phone. Wider patterns propose
further candidates: secrets, names, numbers written like phones or cards, spelled-out addresses. Three kinds
of labelers vote for, against or not at all on each candidate: regex labelers look at its form, gazetteer
labelers look it up in word and prefix lists, context labelers at the words before it. Expectation maximisation
over the counts of vote patterns estimates how reliable each labeler is and how likely each pattern means
personal data. A logistic regression over hashed features of spans and context, trained on a sample of
candidates with these likelihoods as soft labels, decides on every candidate that is no base span.

Scale. One pass over the texts writes candidates, a small table; patterns are counted as an aggregate of at most
`len(KINDS) * 3 ** labelers` rows; training takes at most `sample_rows` candidates drawn by hash; a pass over
the candidates classifies. No shuffle of texts. Patterns take time in proportion to a text's length, also where
it is one long run of digits or letters. No pattern ends a span after a number of signs: a long secret is masked whole.

Edge cases. Null text: empty, no spans. Repeated rows and null doc_ids are kept. No candidates at all: base spans
only, of which there are none. Candidates that overlap a base span or an earlier candidate are left out. Empty
table: no rows. Further columns are ignored, or kept by `redact`. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret", "name", "number", "spelled")
SAMPLE_ROWS = 20_000
FEATURES = 1 << 12

# The base patterns. Those of email and ip are applied by `_emails` and `_ips` in linear time.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

# The wider patterns.
SECRET = re.compile(r"(?i:token|password|passwd|secret|api[_-]?key)[\"']?\x20?[:=]\x20?[\"']?([A-Za-z0-9+/_-]{8,})")
KEYED = re.compile(r"(?<![A-Za-z0-9_-])(?:AKIA|ASIA|ghp_|gho_|sk-|xoxb-|xoxp-|eyJ|AIza)[A-Za-z0-9+/_-]{12,}")
PEM_BEGIN = re.compile(r"-----BEGIN(?:\x20[A-Z]+)*\x20PRIVATE\x20KEY-----")
PEM_END = re.compile(r"-----END(?:\x20[A-Z]+)*\x20PRIVATE\x20KEY-----")
SPELLED_AT = re.compile(r"\x20?[\[(]at[\])]|\x20at\x20")
SPELLED_DOMAIN = re.compile(r"\x20?[A-Za-z0-9-]++(?:\x20?[\[(]dot[\])]\x20?[A-Za-z0-9-]++)*\x20?[\[(]dot[\])]\x20?[A-Za-z]{2,}+(?![0-9-])")
PLAIN_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\x20dot\x20[A-Za-z0-9-]++)*\x20dot\x20(?:com|org|net|edu|gov|de|fr|es|uk|io|info)(?![A-Za-z0-9-])")
SPELLED_LOCAL = LOCAL - frozenset("%+")
LOCAL_PHONE = re.compile(r"\(?[0-9]{3}\)?[\x20.-][0-9]{3}[.-][0-9]{4}")

# Gazetteers.
GIVEN_NAMES = frozenset((
    "Alice Anna Antonio Carlos Charles Claire David Elena Emma Fritz Hans Heinrich Ivan James Jean John "
    "Jose Juan Julia Karl Laura Louis Lucia Maria Marie Mark Mary Michael Paul Pedro Peter Pierre Robert "
    "Sarah Sofia Susan Thomas William"
).split())
ISSUERS = ("4", "34", "35", "37", "51", "52", "53", "54", "55", "6011", "65")
TOP_DOMAINS = "com org net edu gov de fr es uk io info".split()
COUNTRY_CODES = ("1", "33", "34", "39", "41", "43", "44", "49")
SECRET_WORDS = ("token", "password", "passwd", "secret", "api", "key")
SECRET_PREFIXES = ("-----BEGIN", "AKIA", "ASIA", "ghp_", "gho_", "sk-", "xoxb-", "xoxp-", "eyJ", "AIza")
PLACEHOLDERS = ("changeme", "example", "placeholder", "password", "undefined", "redacted", "required", "your")
FOR_WORDS = frozenset("author by call dear regards sincerely phone tel telephone fax mobile mail email e-mail contact card visa mastercard iban name mr mrs ms dr herr frau monsieur madame signed token password secret login user ip host".split())
AGAINST_WORDS = frozenset("version isbn issn order page figure table chapter section rfc build release no nr".split())
# two different words with capitals
NAME = re.compile(r"(?<![\w'-])([A-ZÀ-ÖØ-Þ][\w'-]+)\x20(?!\1(?![\w'-]))[A-ZÀ-ÖØ-Þ][\w'-]+")
TITLE_CASE = re.compile(r"[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ]+(?:['-][A-ZÀ-ÖØ-Þ]?[a-zß-öø-ÿ]+)*")
NOT_NAMES = frozenset(
    "a an and at by for from he her his i in it of on or our she that the their these they this those to was we what when where who with you your "
    "der die das ein eine und von le la les un une des et el los las y "
    "january february march april may june july august september october november december monday tuesday wednesday thursday friday saturday sunday "
    "north south east west new old great united states city street road river lake sea mount university institute company license licensed copyright apache version "
    "chapter section figure table part volume".split()
)
WORD = re.compile(r"[\w-]+")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            end = domain.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def _ips(text: str) -> Iterator[tuple[int, int]]:
    """Every four parts of a dotted run are one match; a match with a part over 255 is dropped."""
    for run in DOTTED.finditer(text):
        if run.group().count(".") < 3:
            continue
        parts, start = run.group().split("."), run.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            length = sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in four):
                yield start, start + length
            start += length + 1


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        total += d if k % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def _digits(span: str) -> str:
    return "".join(c for c in span if "0" <= c <= "9")


def base_spans(text: str) -> list[list[tuple[int, int]]]:
    """For each of `BASE_KINDS` the spans in order."""
    emails = list(_emails(text)) if "@" in text else []
    if not DOTTED.search(text):
        return [emails, [], [], []]
    cards = [m.span() for m in CARD.finditer(text) if 16 <= len(d := _digits(m.group())) <= 19 and luhn(d)]
    phones = [m.span() for m in PHONE.finditer(text) if 8 <= len(_digits(m.group())) <= 15] if "+" in text else []
    return [emails, list(_ips(text)), cards, phones]


def listed(spans: list[tuple[str, int, int]]) -> str:
    """kind:start:end by kind as in `KINDS`, then start, comma-joined."""
    order = {kind: k for k, kind in enumerate(KINDS)}
    return ",".join(f"{kind}:{a}:{b}" for kind, a, b in sorted(spans, key=lambda s: (order[s[0]], s[1], s[2])))


def _spelled(text: str) -> Iterator[tuple[int, int]]:
    """Addresses spelled like name (at) host (dot) org, to the left and right of each "at": no sign is looked at more than twice."""
    end = 0
    for at in SPELLED_AT.finditer(text):
        start = at.start()
        while start > end and text[start - 1] in SPELLED_LOCAL:
            start -= 1
        shape = PLAIN_DOMAIN if at.group() == " at " else SPELLED_DOMAIN
        domain = shape.match(text, at.end()) if start < at.start() else None
        if domain:
            end = domain.end()
            yield start, end


def _private_keys(text: str) -> Iterator[tuple[int, int]]:
    """Private keys between their marks, or to the end of the text where the closing mark is lacking."""
    at = text.find("-----BEGIN")
    while at >= 0:
        begin, end = PEM_BEGIN.match(text, at), at + 1
        if begin:
            close = PEM_END.search(text, begin.end())
            end = close.end() if close else len(text)
            yield at, end
        at = text.find("-----BEGIN", end)


def _wider(text: str) -> Iterator[tuple[str, int, int]]:
    lower_signs = "=" in text or ":" in text
    if lower_signs:
        for m in SECRET.finditer(text):
            yield "secret", *m.span(1)
    if any(prefix in text for prefix in SECRET_PREFIXES):
        for m in KEYED.finditer(text):
            yield "secret", *m.span()
    for span in _private_keys(text):
        yield "secret", *span
    if "(at)" in text or "[at]" in text or " at " in text:
        for span in _spelled(text):
            yield "spelled", *span
    if DOTTED.search(text):
        for m in LOCAL_PHONE.finditer(text):
            yield "number", *m.span()
        for m in CARD.finditer(text):
            if 9 <= len(_digits(m.group())) <= 19:
                yield "number", *m.span()
    for m in NAME.finditer(text):
        yield "name", *m.span()


def candidates(text: str) -> tuple[list[list[tuple[int, int]]], list[tuple[str, int, int, bool]]]:
    """Base spans, and all candidates (kind, start, end, is base) without overlaps, base spans first."""
    base = base_spans(text)
    out = [(kind, a, b, True) for kind, spans in zip(BASE_KINDS, base, strict=True) for a, b in spans]
    wider = sorted(set(_wider(text)), key=lambda s: (s[1], -s[2], KINDS.index(s[0])))
    if wider:
        taken = sorted((a, b) for _, a, b, _ in out)
        at, end = 0, 0
        for kind, a, b in wider:
            while at < len(taken) and taken[at][1] <= a:
                at += 1
            if a >= end and not (at < len(taken) and taken[at][0] < b):
                out.append((kind, a, b, False))
                end = b
    return base, out


# --- labelers: each gives 1, -1 or 0 -------------------------------------------------------------

def _entropy(s: str) -> float:
    _, n = np.unique(list(s), return_counts=True)
    return float(-(n / len(s) * np.log2(n / len(s))).sum())


def regex_labeler(kind: str, span: str, before: list[str]) -> int:
    if kind == "spelled":
        return 1 if "(" in span or "[" in span else 0
    if kind == "name":
        return 0 if all(TITLE_CASE.fullmatch(w) for w in span.split(" ")) else -1
    if kind in ("email", "ip", "phone"):
        return 1
    if kind in ("card", "number"):
        d = _digits(span)
        if len(d) >= 13:
            return 1 if luhn(d) else -1
        return 1 if LOCAL_PHONE.fullmatch(span) else -1
    if kind == "secret":
        return 1 if len(span) >= 16 and _entropy(span) > 3 else -1
    return 0


def gazetteer_labeler(kind: str, span: str, before: list[str]) -> int:
    if kind in ("card", "number"):
        d = _digits(span)
        return 0 if len(d) < 13 else 1 if d.startswith(ISSUERS) else -1
    if kind == "phone":
        return 1 if span[1:].startswith(COUNTRY_CODES) else 0
    if kind in ("email", "spelled"):
        return 1 if re.split(r"[^A-Za-z]+", span)[-1].lower() in TOP_DOMAINS else 0
    if kind == "ip":
        return -1 if span.startswith(("0.", "127.")) else 0
    if kind == "name":
        words = span.split(" ")
        return -1 if any(w.lower() in NOT_NAMES for w in words) else 1 if words[0] in GIVEN_NAMES else 0
    return -1 if span.lower().startswith(PLACEHOLDERS) else 1 if span.startswith(SECRET_PREFIXES) else 0


def context_labeler(kind: str, span: str, before: list[str]) -> int:
    # the word that makes a secret a candidate says nothing more about it
    words = {w for w in before if kind != "secret" or not w.startswith(SECRET_WORDS)}
    if kind == "name":  # two capitals alone are no name
        return 1 if words & FOR_WORDS and not words & AGAINST_WORDS else -1
    return 1 if words & FOR_WORDS else -1 if words & AGAINST_WORDS else 0


def form_labeler(kind: str, span: str, before: list[str]) -> int:
    """Regex labeler on repetition: filler such as 0000000000 is not personal."""
    if kind == "name":
        return 0
    signs = set(span) - set(" -.()+")
    return -1 if len(signs) <= 2 else 1 if len(signs) >= 5 else 0


LABELERS = (regex_labeler, gazetteer_labeler, context_labeler, form_labeler)


def describe(text: str, kind: str, a: int, b: int) -> tuple[int, list[int]]:
    """The vote pattern as a number in base 3, and hashed features."""
    span = text[a:b]
    before = [w.lower() for w in WORD.findall(text[max(0, a - 40) : a])][-4:]
    votes = 0
    for labeler in LABELERS:
        votes = 3 * votes + labeler(kind, span, before) + 1
    shape = re.sub("[0-9]+", "9", re.sub("[A-Z]+", "A", re.sub("[a-z]+", "a", span)))[:24]
    parts = [f"kind {kind}", f"shape {kind} {shape}", f"length {kind} {min(40, b - a)}", f"prefix {kind} {span[:2]}",
             f"luhn {kind} {luhn(_digits(span))}", f"listed {kind} {gazetteer_labeler(kind, span, before)}", f"signs {kind} {min(8, len(set(span)))}", *(f"before {kind} {w}" for w in before if w in FOR_WORDS or w in AGAINST_WORDS)]
    return votes, [zlib.crc32(p.encode()) % FEATURES for p in parts]


# --- estimation ----------------------------------------------------------------------------------

def _no_worse_than_chance(votes: np.ndarray) -> None:
    """Of a labeler's distributions [other or personal, vote]: of the votes it casts, those for must not be a smaller share on
    personal spans than on others; where they are, its votes tell nothing. So no labeler is turned round."""
    cast = votes[:, 0] + votes[:, 2]
    if votes[1, 2] / cast[1] < votes[0, 2] / cast[0]:
        votes[:, 2] = cast * votes[:, 2].sum() / cast.sum()
        votes[:, 0] = cast - votes[:, 2]


def reliabilities(patterns: dict[tuple[str, int], int], rounds: int = 100) -> tuple[np.ndarray, dict[tuple[str, int], float]]:
    """Expectation maximisation over counts of (kind, vote pattern).

    Each labeler has, for personal and for other spans, a distribution over its three votes, shared by
    all kinds; each kind has its own share of personal spans. No labeler is taken to be worse than chance. Returns the distributions
    [labeler, personal or not, vote] and the likelihood that a pattern is personal.
    """
    keys = sorted(patterns)
    n = np.array([patterns[k] for k in keys], float)
    votes = np.array([[v // 3 ** (len(LABELERS) - 1 - j) % 3 for j in range(len(LABELERS))] for _, v in keys])
    kinds = np.array([KINDS.index(k) for k, _ in keys])
    personal = 1 / (1 + np.exp(-1.0 * (votes - 1).sum(1)))
    table = np.zeros((len(LABELERS), 2, 3))
    for _ in range(rounds):
        for j in range(len(LABELERS)):
            for v in range(3):
                hit = votes[:, j] == v
                table[j, 1, v] = 1 + (n * personal)[hit].sum()
                table[j, 0, v] = 1 + (n * (1 - personal))[hit].sum()
            table[j] /= table[j].sum(1, keepdims=True)
            _no_worse_than_chance(table[j])
        share = np.array([(1 + (n * personal)[kinds == k].sum()) / (2 + n[kinds == k].sum()) for k in range(len(KINDS))])
        logs = np.log(share[kinds]) - np.log(1 - share[kinds])
        for j in range(len(LABELERS)):
            # a labeler that does not vote, as some never do on a kind, tells nothing
            given = np.log(table[j] / (table[j, :, :1] + table[j, :, 2:]))
            logs = logs + np.where(votes[:, j] == 1, 0.0, given[1, votes[:, j]] - given[0, votes[:, j]])
        personal = 1 / (1 + np.exp(-np.clip(logs, -30, 30)))
    return table, dict(zip(keys, personal.tolist(), strict=True))


def span_classifier(features: list[list[int]], target: np.ndarray, steps: int = 300, ridge: float = 1e-3) -> np.ndarray:
    """Weights of a logistic regression on hashed features with soft labels."""
    weights = np.zeros(FEATURES)
    if not len(features):
        return weights
    row = np.repeat(np.arange(len(features)), [len(f) for f in features])
    column = np.concatenate([np.array(f) for f in features])
    widest = max(map(len, features))
    speed = np.zeros(FEATURES)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, weights[column], len(features)), -30, 30)))
        slope = np.bincount(column, (p - target)[row], FEATURES) / len(features) + ridge * weights
        speed = 0.9 * speed - 4.0 / widest * slope
        weights = weights + speed
    return weights


FOUND = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long"
CANDIDATES = "doc_id long, base string, kinds array<int>, starts array<int>, ends array<int>, is_base array<boolean>, votes array<int>, features array<array<int>>"


def _found(text: str | None):
    """The base spans and described candidates of a text."""
    text = text or ""
    base, spans = candidates(text)
    return base, spans, [describe(text, kind, a, b) for kind, a, b, _ in spans]


def _candidate_table(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), *(pa.list_(pa.int32()),) * 3, pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.list_(pa.list_(pa.int32()))]
        for batch in batches:
            columns: list[list] = [[] for _ in kinds]
            for text in batch.column(1):
                base, spans, described = _found(text.as_py())
                row = (listed([(k, a, b) for k, s in zip(BASE_KINDS, base, strict=True) for a, b in s]), [KINDS.index(s[0]) for s in spans], [s[1] for s in spans], [s[2] for s in spans],
                       [s[3] for s in spans], [d[0] for d in described], [d[1] for d in described])
                for column, value in zip(columns, row, strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
                                             names=["doc_id", "base", "kinds", "starts", "ends", "is_base", "votes", "features"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return common.written(rows.mapInArrow(run, CANDIDATES), "pii-candidates")


def learn(table: DataFrame, sample_rows: int = SAMPLE_ROWS) -> np.ndarray:
    """Weights of the span classifier, from the candidates of the whole corpus."""
    spans = table.select("doc_id", F.explode(F.arrays_zip("kinds", "votes", "features", "starts")).alias("c")).select("doc_id", "c.*")
    patterns = {(KINDS[r["kinds"]], r["votes"]): r["n"] for r in spans.groupBy("kinds", "votes").agg(F.count("*").alias("n")).collect()}
    if not patterns:
        return np.zeros(FEATURES)
    _, likely = reliabilities(patterns)
    # some more than asked for are drawn by hash, and those of least hashes stay
    rate = (sample_rows + 8 * sample_rows**0.5) / sum(patterns.values())
    draw = F.pmod(F.xxhash64("doc_id", "starts", "features"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = spans.withColumn("draw", draw).where(F.col("draw") < rate).orderBy("draw", "doc_id", "starts").limit(sample_rows)
    drawn = drawn.select("starts", "kinds", "votes", "features").toArrow().to_pydict()
    target = np.array([likely[KINDS[k], v] for k, v in zip(drawn["kinds"], drawn["votes"], strict=True)])
    return span_classifier(drawn["features"], target)


def accepted(weights: np.ndarray, features: list[int]) -> bool:
    return float(weights[features].sum()) > 0


def detect(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """`docs` (doc_id, text): doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans (spans of all kinds)."""
    with common.small_batches(docs.sparkSession):
        table = _candidate_table(docs)
        shared = docs.sparkSession.sparkContext.broadcast(learn(table, sample_rows))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            weights = shared.value
            for batch in batches:
                row = batch.to_pydict()
                counts: dict[str, list[int]] = {k: [] for k in BASE_KINDS}
                digests, spans, sizes = [], [], []
                for base, kinds, starts, ends, is_base, features in zip(row["base"], row["kinds"], row["starts"], row["ends"], row["is_base"], row["features"], strict=True):
                    digests.append(hashlib.sha256(base.encode()).hexdigest())
                    for k, kind in enumerate(BASE_KINDS):
                        counts[kind].append(sum(1 for x, own in zip(kinds, is_base, strict=True) if own and x == k))
                    chosen = [(KINDS[k], a, b) for k, a, b, own, f in zip(kinds, starts, ends, is_base, features, strict=True) if own or accepted(weights, f)]
                    spans.append(listed(chosen))
                    sizes.append(len(chosen))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), *(pa.array(counts[k], pa.int64()) for k in BASE_KINDS), pa.array(digests, pa.string()), pa.array(spans, pa.string()), pa.array(sizes, pa.int64())],
                    names=["doc_id", *(f"n_{k}" for k in BASE_KINDS), "base_sha256", "spans", "n_spans"])

        out = common.written(table.mapInArrow(run, FOUND), "pii-spans")
        common.discard(docs.sparkSession, table)
    return out


def mask(text: str | None, weights: np.ndarray) -> str | None:
    """The text with its personal spans replaced by <KIND>."""
    if not text:
        return text
    _, spans, described = _found(text)
    chosen = sorted((a, b, kind) for (kind, a, b, own), (_, f) in zip(spans, described, strict=True) if own or accepted(weights, f))
    out, end = [], 0
    for a, b, kind in chosen:
        if a < end:  # base spans of different kinds may overlap: the earlier one's mask covers both
            end = max(end, b)
            continue
        out += [text[end:a], f"<{kind.upper()}>"]
        end = b
    return "".join(out) + text[end:]


def redact(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """All documents and columns, whatever their names, personal spans masked in `text`; `n_chars`, if there, follows."""
    with common.small_batches(docs.sparkSession):
        table = _candidate_table(docs)
        shared = docs.sparkSession.sparkContext.broadcast(learn(table, sample_rows))
        common.discard(docs.sparkSession, table)

    @F.arrow_udf("string")
    def masked(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in texts:
            yield pa.array([mask(t.as_py(), shared.value) for t in part], pa.string())

    out = docs.withColumn("text", masked(F.col("text").cast("string")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text")).cast(dict(docs.dtypes)["n_chars"]))
    return out
