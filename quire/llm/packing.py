"""Best-fit packing of documents into training sequences, with vector capacities.

A sequence has residual tokens, document count and attention cost (sum of squared lengths). Pieces are taken longest
first; of the open sequences that can take a piece under every constraint, the one with the least weighted residual
norm after it, or the greatest weighted dot product with it, gets it. Pieces are dealt by hash into shards of
about SHARD_SEQUENCES sequences, each packed in a task of its own: only a shard's last sequences stay unfilled.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, materialize

TOKENS, DOCUMENTS, END_ID = 4096, 4096, 1
#: Weights of tokens, document count and attention cost in the score.
WEIGHTS = (1.0, 0.001, 0.001)
#: A shard's tokens, as full sequences, and its most pieces: at least that many short texts share few unfilled sequences.
SHARD_SEQUENCES, SHARD_PIECES = 512, 65_536
#: Bytes of words and ids, with what Python adds to each, that a task keeps.
CACHE_BYTES, EACH = 48 << 20, 200
#: New words that are encoded as one text.
TOGETHER = 100
#: Fixed values, for texts of this alphabet only: there lower case and normal form are simple, and these are the words.
PLAIN = re.compile(r"[\t\n\r\x20-\x7e\xa1-\xa7\xa9-\xac\xae-\xb3\xb5-\xb7\xb9-\xff]*")
WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼½¾]|[^\sa-zªµºß-öø-ÿ0-9²³¹¼½¾]+")


class WordTokenizer:
    """The ids of the library's tokenizer at path. In plain texts each distinct word is encoded once and kept.

    New words are encoded many at a time, by the same model without the normalizer, which leaves lower-cased plain words
    as they are. Where a word ends is told by its last id: that one alone stands for a token with the model's suffix.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.words = Tokenizer(self.library.model)  # shares the model
        self.words.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocab, suffix = self.library.get_vocab(with_added_tokens=False), self.library.model.end_of_word_suffix
        self.last = np.zeros(max(vocab.values()) + 1, bool)
        self.last[[i for token, i in vocab.items() if suffix and token.endswith(suffix)]] = True
        self.forget()

    def forget(self) -> None:
        self.cache: dict[str, bytes] = {}
        self.held = 0

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def apart(self, words: list[str]) -> list[bytes]:
        """The ids of each of these plain words."""
        out: list[bytes] = []
        parts = [words[at : at + TOGETHER] for at in range(0, len(words), TOGETHER)]
        for part, e in zip(parts, self.words.encode_batch_fast([" ".join(p) for p in parts], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u4")
            ends = (4 * np.flatnonzero(self.last[ids]) + 4).tolist()
            whole = ids.tobytes()
            out += [whole[a:b] for a, b in zip([0, *ends], ends)] if len(ends) == len(part) else self.whole(part)
        return out

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        texts = [t or "" for t in texts]
        if self.held > CACHE_BYTES:
            self.forget()
        cache = self.cache
        words = [WORDS.findall(t.lower()) if "<|" not in t and PLAIN.fullmatch(t) else None for t in texts]
        new = list(set().union(*filter(None, words)).difference(cache))
        cache.update(zip(new, self.apart(new), strict=True))
        self.held += sum(len(w) + len(cache[w]) + EACH for w in new)
        out = [None if ws is None else b"".join(map(cache.__getitem__, ws)) for ws in words]
        rest = [i for i, x in enumerate(out) if x is None]
        for i, x in zip(rest, self.whole([texts[i] for i in rest]), strict=True):
            out[i] = x
        return [np.frombuffer(x, "<u4") for x in out]


@lru_cache(maxsize=2)
def loaded(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def pieces_of(docs: DataFrame, path: str, tokens: int = TOKENS, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) of each piece of at most so many tokens, end_id included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = loaded(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows: list[tuple] = []
                for doc, ids in zip(part.column(0).to_pylist(), model.encode(part.column(1).to_pylist()), strict=True):
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    rows += [(doc, i, s, len(x), zlib.crc32(x.tobytes()), x) for i, s in enumerate(range(0, len(ids), tokens)) for x in (ids[s : s + tokens],)]
                columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array([r[5].astype(np.int64) for r in rows], pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)
        model.forget()  # the worker lives on beside other stages

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_batches(docs, run, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids)


def best_fit(lengths: np.ndarray, capacity: tuple[float, float, float], weights: tuple[float, float, float] = WEIGHTS, rule: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each piece. rule: `norm` or `dot`. A piece beyond a capacity raises ValueError."""
    n, cap, w = len(lengths), np.array(capacity, float), np.array(weights, float)
    items = np.stack([lengths.astype(float), np.ones(n), lengths.astype(float) ** 2], axis=1)
    if (items > cap).any():
        raise ValueError("a piece is larger than a sequence")
    sequence, offset = np.zeros(n, np.int64), np.zeros(n, np.int64)
    left = np.empty((n, 3))
    score = np.empty(n)  # residual norm of each open sequence as it stands
    opened = count = 0  # sequences from `opened` on can still take something
    smallest = items.min(axis=0) if n else cap
    names = np.empty(n, np.int64)
    for i in np.argsort(-lengths, kind="stable"):
        x = items[i]
        room = left[:opened]
        fits = np.flatnonzero((room[:, 0] >= x[0]) & (room[:, 1] >= x[1]) & (room[:, 2] >= x[2]))
        if len(fits):
            unit = room[fits] / cap
            value = -((w * (unit - x / cap) ** 2).sum(axis=1)) if rule == "norm" else (w * unit * (x / cap)).sum(axis=1)
            j = int(fits[np.argmax(value)])
        else:
            j = opened
            left[j], names[j], score[j] = cap, count, 0
            opened, count = opened + 1, count + 1
        sequence[i], offset[i] = names[j], int(cap[0] - left[j, 0])
        left[j] -= x
        if (left[j] < smallest).any():  # closed: the last open one takes its place
            opened -= 1
            left[j], names[j] = left[opened], names[opened]
    return sequence, offset


def pack(pieces: DataFrame, tokens: int = TOKENS, documents: int = DOCUMENTS, attention: float | None = None, weights: tuple[float, float, float] = WEIGHTS, rule: str = "norm") -> DataFrame:
    """pieces with sequence_id and offset. attention: most cost of a sequence; None for tokens squared, which binds nothing more.

    A sequence's pieces stand gapless from offset 0. Repeated rows are packed each on its own; an empty table gives an
    empty result. Other columns stay.
    """
    pieces = materialize(pieces)
    count, held = pieces.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    shards = max(1, -(-count // SHARD_PIECES), -(-held // (SHARD_SEQUENCES * tokens)))
    capacity = (float(tokens), float(documents), float(tokens) ** 2 if attention is None else float(attention))

    def fill(key: tuple, table: pd.DataFrame) -> pd.DataFrame:
        table = table.sort_values(["doc_id", "piece", "ids_crc32"], kind="stable", ignore_index=True)
        sequence, offset = best_fit(table.length.to_numpy(), capacity, weights, rule)
        return table.drop(columns="shard").assign(sequence_id=sequence + (int(key[0]) << 32), offset=offset)

    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in pieces.schema)}, sequence_id long, offset long"
    return pieces.withColumn("shard", F.expr(f"cast(pmod(xxhash64(doc_id, piece, ids_crc32), {shards}) as int)")).groupBy("shard").applyInPandas(fill, schema)


def pack_documents(docs: DataFrame, path: str) -> DataFrame:
    """Pieces of docs (doc_id, text), with the sequence and offset of each.

    A null or empty text is the end id alone. Texts are read whole, however long: what is over a sequence is cut into
    pieces. Repeated rows and null ids are packed each on its own; ties go by doc_id and piece; other columns are left
    aside; an empty table gives an empty result.
    """
    return pack(pieces_of(docs, path))
