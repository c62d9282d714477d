"""Byte-level BPE encoding and decoding in batched numpy merge rounds.

A batch's words that are not yet known are laid out in one flat array of symbols. In each round the rank of every
neighbouring pair is found by binary search over the sorted pair keys, each word's lowest pair is merged wherever it
stands in the word, and finished words leave. Words of over LONG bytes, whose rounds would grow with
the square of their length, are merged with a heap instead, with the same result.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches

#: Fixed value: how the byte-level scheme cuts text into words.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
LONG = 512
#: Bytes of words and ids, with what Python adds to each, that a task keeps: known words are not merged again.
CACHE_BYTES, EACH = 48 << 20, 200
_NONE = np.int64(1) << 40


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary: itself if it is printable Latin-1, else one from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        vocab = whole["model"]["vocab"]
        letters = byte_letters()
        self.added = {t["content"]: t["id"] for t in whole["added_tokens"]}
        self.bytes_of = {i: t.encode() if t in self.added else bytes(letters[c] for c in t) for t, i in (vocab | self.added).items()}
        self.first = np.zeros(256, np.int64)
        for c, b in letters.items():
            self.first[b] = vocab[c]
        self.size = max(self.bytes_of) + 1
        merges = [m.split(" ") if isinstance(m, str) else m for m in whole["model"]["merges"]]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in merges], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], np.arange(len(keys))[order]
        self.into = np.array([vocab[a + b] for a, b in merges], np.int64)  # by rank
        self.split = regex.compile("(" + "|".join(regex.escape(a) for a in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self.forget()

    def forget(self) -> None:
        self.cache: dict[str, bytes] = {}
        self.held = 0

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _NONE)

    def merge_words(self, words: list[bytes]) -> list[np.ndarray]:
        """The ids of each word."""
        done: list[np.ndarray] = [np.zeros(0, np.int64)] * len(words)
        for i, w in enumerate(words):
            if len(w) > LONG:
                done[i] = self.merge_long(w)
        name = np.array([i for i, w in enumerate(words) if 0 < len(w) <= LONG], np.int64)
        if not len(name):
            return done
        size = np.array([len(words[i]) for i in name])
        symbol = self.first[np.frombuffer(b"".join(words[i] for i in name), np.uint8)]
        while len(name):
            start = np.cumsum(size) - size
            owner = np.repeat(np.arange(len(name)), size)
            last = np.zeros(len(symbol), bool)
            last[start + size - 1] = True
            rank = np.full(len(symbol), _NONE)
            inner = np.flatnonzero(~last)
            rank[inner] = self.rank(symbol[inner], symbol[inner + 1])
            lowest = np.minimum.reduceat(rank, start)
            over = lowest == _NONE
            if over.any():
                for j in np.flatnonzero(over):
                    done[name[j]] = symbol[start[j] : start[j] + size[j]]
                keep = ~over[owner]
                symbol, rank, lowest = symbol[keep], rank[keep], lowest[~over]
                name, size = name[~over], size[~over]
                if not len(name):
                    break
                owner = np.repeat(np.arange(len(name)), size)
            hit = rank == lowest[owner]
            # Of hits that overlap (one symbol, repeated) every other one counts, from the left.
            at = np.flatnonzero(hit)
            fresh = np.r_[True, (np.diff(at) > 1) | (owner[at[1:]] != owner[at[:-1]])]
            head = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - head) % 2 == 0]
            symbol[at] = self.into[rank[at]]
            keep = np.ones(len(symbol), bool)
            keep[at + 1] = False
            symbol = symbol[keep]
            size = size - np.bincount(owner[at], minlength=len(name))
        return done

    def merge_long(self, word: bytes) -> np.ndarray:
        symbol = self.first[np.frombuffer(word, np.uint8)]
        n = len(symbol)
        rank = self.rank(symbol[:-1], symbol[1:])
        symbol, after, before = symbol.tolist(), [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(int(r), i) for i, r in enumerate(rank.tolist()) if r != _NONE]
        now = {i: r for r, i in heap}
        heapq.heapify(heap)
        known: dict[tuple[int, int], int] = {}
        while heap:
            r, i = heapq.heappop(heap)
            if now.get(i) != r:
                continue
            j = after[i]
            symbol[i], symbol[j] = int(self.into[r]), -1
            now.pop(i), now.pop(j, None)
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for a in (before[i], i):
                if a >= 0 and after[a] >= 0:
                    pair = symbol[a], symbol[after[a]]
                    if pair not in known:
                        known[pair] = int(self.rank(np.array([pair[0]]), np.array([pair[1]]))[0])
                    now.pop(a, None)
                    if known[pair] != _NONE:
                        now[a] = known[pair]
                        heapq.heappush(heap, (known[pair], a))
        return np.array([s for s in symbol if s >= 0], np.int64)

    def pieces(self, text: str) -> list[str]:
        """Words of a text; added tokens stand alone."""
        if self.split is None or not any(a in text for a in self.added):
            return WORDS.findall(text)
        return [w for i, part in enumerate(self.split.split(text)) for w in ([part] if i % 2 else WORDS.findall(part))]

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids (unsigned 32-bit, little-endian) of each text."""
        if self.held > CACHE_BYTES:
            self.forget()
        pieces = [self.pieces(t) if t else [] for t in texts]
        cache = self.cache
        new = list({w for p in pieces for w in p if w not in cache})
        plain = [w for w in new if w not in self.added]
        for w in new:
            if w in self.added:
                cache[w] = np.array([self.added[w]], "<u4").tobytes()
        for w, ids in zip(plain, self.merge_words([w.encode("utf-8", "surrogatepass") for w in plain]), strict=True):
            cache[w] = ids.astype("<u4").tobytes()
        self.held += sum(len(w) + len(cache[w]) + EACH for w in new)
        return [np.frombuffer(b"".join([cache[w] for w in p]), "<u4") for p in pieces]

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def loaded(path: str) -> Bpe:
    """One for each Python worker and vocabulary file, which every machine has at the same path."""
    return Bpe(path)


def bpe_encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids of each row of docs (doc_id, text), by the vocabulary file at path.

    A null or empty text has no ids. Texts are encoded whole, however long; of equal ranks the leftmost pair merges first.
    Repeated rows come back as often as given; other columns are left aside; an empty table gives an empty result.
    """
    return _encode(docs, path, "doc_id long, ids array<long>", lambda _, ids: [pa.array([x.astype(np.int64) for x in ids], pa.list_(pa.int64()))])


def bpe_decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text of each row of encoded (doc_id, ids). Null ids give a null text, no ids an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = loaded(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if x is None else model.decode(np.array(x, np.int64)) for x in batch.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return map_batches(encoded.select("doc_id", "ids"), run, "doc_id long, text string")


def bpe_digest(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, and hashes of the ids and of the text decoded from them: for corpora whose ids need not be kept.

    Rows are treated as bpe_encode says; a null text has 0 tokens and the hashes of empty ones.
    """

    def digest(model: Bpe, ids: list[np.ndarray]) -> list[pa.Array]:
        sha = lambda b: hashlib.sha256(b).hexdigest()
        return [pa.array([len(x) for x in ids], pa.int64()), pa.array([sha(x.tobytes()) for x in ids], pa.string()), pa.array([sha(model.decode(x).encode()) for x in ids], pa.string())]

    return _encode(docs, path, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", digest)


def _encode(docs: DataFrame, path: str, schema: str, columns) -> DataFrame:
    names = [c.split(" ")[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = loaded(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                yield pa.RecordBatch.from_arrays([part.column(0), *columns(model, model.encode(part.column(1).to_pylist()))], names)
        model.forget()  # the worker lives on beside other stages

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_batches(docs, run, schema)
