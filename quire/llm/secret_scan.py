"""Secret scans: fixed patterns, and a log-likelihood ratio of two character Markov models for what has no pattern.

Both are trained from labelled samples: random strings are drawn from the alphabets of keys, with what the patterns found
in the corpus beside them; ordinary identifiers are all words of the corpus of the same shape that no pattern found. A
word whose log-likelihood ratio is high enough, by character and in all, is a secret.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches

#: Kinds of base spans in their order, and their patterns (letters of the key in either case, ASCII only).
KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # runs are maximal, so a shorter one never hides a longer one
KEYS = ("passw", "secret", "token", "api")
#: What the models learn from and judge: words of this alphabet, not shorter, that no other word character touches.
LEAST = 8
WORD = re.compile(rf"(?<![\w+/=-])[A-Za-z0-9+/_=-]{{{LEAST},}}(?![\w+/=-])")
ALPHABET = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-."
SIZE = len(ALPHABET) + 1
#: Log-likelihood ratio by transition and in all from which a word is a secret (so a short word must be the more unlike others), and pseudo-count of a transition.
THRESHOLD, IN_ALL, SMOOTH = 1.0, 20.0, 0.5
#: Weight of the single characters' shares beside what follows a character, as a part of a character's mean count: secrets are most of
#: what follows a rare character, and must not teach that it is ordinary.
BACKOFF = 0.2
#: Labelled random strings: so many of each alphabet, of LEAST to 64 characters.
DRAWN, KEY_ALPHABETS = 1000, (ALPHABET[:62], ALPHABET[:26] + ALPHABET[52:62], ALPHABET[26:62], ALPHABET[:64], ALPHABET[:62] + b"_-", ALPHABET[52:62] + b"abcdef")

_CODE = np.full(256, SIZE - 1, np.int64)
_CODE[np.frombuffer(ALPHABET, np.uint8)] = np.arange(len(ALPHABET))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) in code points, by start, then kind as listed."""
    out = []
    lower = text.lower()
    if any(k in lower for k in KEYS):
        out += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return [(s, e, KINDS[k]) for s, e, k in sorted(out, key=lambda x: (x[0], x[2], x[1]))]


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def transitions(word: str) -> np.ndarray:
    code = _CODE[np.frombuffer(word.encode("ascii", "replace"), np.uint8)]
    return code[:-1] * SIZE + code[1:]


def free_words(pattern: re.Pattern, text: str, taken: list[tuple[int, int, str]]) -> Iterator[re.Match]:
    """Matches of pattern that touch none of the taken spans, which are in order."""
    at, most = 0, 0
    for m in pattern.finditer(text):
        while at < len(taken) and taken[at][0] < m.end():
            most = max(most, taken[at][1])
            at += 1
        if most <= m.start():
            yield m


@dataclass
class Model:
    ratio: np.ndarray | None  # log P(random) - log P(ordinary) of each transition; None if there was nothing random to learn from

    def score(self, word: str) -> float:
        return float(self.ratio[transitions(word)].mean())

    def is_random(self, word: str) -> bool:
        if word.isdigit():  # a plain number is no key
            return False
        ratio = self.ratio[transitions(word)]
        total = ratio.sum()
        return bool(total >= IN_ALL and total >= THRESHOLD * len(ratio))

    def spans(self, text: str | None) -> list[tuple[int, int, str]]:
        """Base spans, and the words that the models hold for secrets."""
        text = text or ""
        base = base_spans(text)
        if self.ratio is None:
            return base
        more = [(m.start(), m.end(), "random") for m in free_words(WORD, text, base) if self.is_random(m[0])]
        return sorted(base + more, key=lambda x: (x[0], KINDS.index(x[2]), x[1])) if more else base


def fit_counts(random: np.ndarray, ordinary: np.ndarray) -> Model:
    if not random.sum():
        return Model(None)
    log = []
    for c in (random.reshape(SIZE, SIZE).astype(float), ordinary.reshape(SIZE, SIZE).astype(float)):
        single = (c.sum(axis=0) + SMOOTH) / (c.sum() + SMOOTH * SIZE)
        shared = BACKOFF * c.sum() / SIZE + SMOOTH * SIZE
        log.append(np.log((c + shared * single) / (c.sum(axis=1, keepdims=True) + shared)).ravel())
    return Model(log[0] - log[1])


def drawn_counts(seed: int = 5) -> np.ndarray:
    """Transition counts of random strings, labelled so by construction."""
    rng = np.random.default_rng(seed)
    sums = np.zeros(SIZE * SIZE, np.int64)
    for alphabet in KEY_ALPHABETS:
        for size in rng.integers(LEAST, 65, DRAWN):
            np.add.at(sums, transitions(rng.choice(np.frombuffer(alphabet, np.uint8), size).tobytes().decode()), 1)
    return sums


def fit(docs: DataFrame) -> Model:
    """Transition counts over all documents; each task sends two small tables of sums."""
    texts = docs.select(F.col("text").cast("string").alias("text")).where("text is not null")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, SIZE * SIZE), np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                base = base_spans(text)
                found = [transitions(text[s:e] if k != "assign" else ASSIGN.match(text, s)[2]) for s, e, k in base]
                plain = [transitions(m[0]) for m in free_words(WORD, text, base)]
                for i, parts in enumerate((found, plain)):
                    if parts:
                        sums[i] += np.bincount(np.concatenate(parts), minlength=SIZE * SIZE)
        which, place = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(which.astype(np.int32)), pa.array(place.astype(np.int32)), pa.array(sums[which, place])], ["which", "place", "n"])

    sums = np.stack([drawn_counts(), np.zeros(SIZE * SIZE, np.int64)])
    for r in map_batches(texts, count, "which int, place int, n long").groupBy("which", "place").agg(F.sum("n").alias("n")).collect():  # 2 * SIZE * SIZE rows at most
        sums[r.which, r.place] = r.n
    return fit_counts(*sums)


def scan_secrets(docs: DataFrame, model: Model | None = None, with_text: bool = True) -> DataFrame:
    """doc_id, secrets (kind, start, end; code points, end exclusive) and, with_text, redacted text of each row of docs.

    docs needs doc_id and text; other columns are left aside. A null text counts as empty, has no spans and stays null
    when redacted. Texts are read whole, however long. Repeated rows come back as often as given. Spans of different kinds may overlap; redaction
    replaces each overlapping run once. The model is fitted on docs unless given.
    """
    model = fit(docs) if model is None else model
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            spans = [model.spans(t) for t in texts]
            columns = {"doc_id": batch.column(0), "secrets": pa.array([[{"kind": k, "start": s, "end": e} for s, e, k in x] for x in spans], kind)}
            if with_text:
                columns["redacted"] = pa.array([redact(t, x) for t, x in zip(texts, spans, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([*columns.values()], [*columns])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_batches(docs, run, "doc_id long, secrets array<struct<kind: string, start: int, end: int>>" + ", redacted string" * with_text)


def redacted_documents(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """docs, all columns and rows, with the secrets of each text replaced, and n_chars (if there) of a changed text counted anew.

    Null texts stay null, empty ones empty; long ones are read whole; repeated rows come back as often as given; an empty
    table gives an empty one.
    """
    model, names = fit(docs) if model is None else model, docs.columns
    at, chars = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            old = batch.column(at).to_pylist()
            new = [redact(t, model.spans(t)) for t in old]
            columns = list(batch.columns)
            columns[at] = pa.array(new, batch.schema.field(at).type)
            if chars is not None:
                columns[chars] = pa.array([n if t is u or t == u else len(u) for n, t, u in zip(columns[chars].to_pylist(), old, new, strict=True)], batch.schema.field(chars).type)
            yield pa.RecordBatch.from_arrays(columns, names)

    return map_batches(docs, run, docs.schema)


def redact(text: str | None, spans: list[tuple[int, int, str]], mark: str = "[secret]") -> str | None:
    if not spans:
        return text
    out, at = [], 0
    for s, e, _ in spans:
        if e <= at:
            continue
        if s >= at:
            out += [text[at:s], mark]
        at = e
    return "".join(out) + text[at:]


def secret_digest(found: DataFrame) -> DataFrame:
    """The digest columns of a scan."""
    of = lambda kinds: F.expr(f"array_join(transform(filter(secrets, x -> x.kind in ({kinds})), x -> concat(x.kind, ':', x.start, ':', x.end)), ',')")
    number = lambda k: F.expr(f"cast(size(filter(secrets, x -> x.kind = '{k}')) as long)").alias(f"n_{k}")
    return found.select("doc_id", *map(number, KINDS[:3]), F.sha2(of("'assign', 'access', 'hex'"), 256).alias("base_sha256"), of(", ".join(f"'{k}'" for k in KINDS)).alias("spans"))


def digest_of(text: str | None, model: Model) -> tuple[int, int, int, str, str]:
    """The digest of one text, for tests."""
    base = base_spans(text or "")
    n = [sum(k == x for _, _, k in base) for x in KINDS[:3]]
    return *n, hashlib.sha256(joined(base).encode()).hexdigest(), joined(model.spans(text))
