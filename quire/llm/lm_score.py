"""LM scoring by cross-entropy difference: a target and a background bigram model over one shared vocabulary.

The target is the rows that `labels` marks as of good quality, the background all rows. Every word and every bigram
of every document is counted, however rare, so what the models hold grows with the input. The background is matched
to the target's size: its counts are scaled to the target's number of tokens, so both are smoothed alike. Both models
are bigrams with a Dirichlet prior, P(w | h) = (n(h, w) + PRIOR * P(w)) / (n(h) + PRIOR), over add-one unigrams in which
words below WORD_SHARE of all tokens have one common probability each. A document's score is its mean background minus
target loss a token: above 0, the target model finds it likelier. A document is never judged by itself: its own
bigrams are taken out of the counts that score it.

Words and bigrams of at least WORD_SHARE and PAIR_SHARE of all tokens are few (at most 1 / share of each), so their
counts are broadcast and scored where the text is read. All others are dealt by bigram to parts of about PART_BYTES of
text (by first word where that is a rare one), each of which counts and scores its bigrams in one step; no single
one of them is large. What a part finds goes back packed, 16 bytes a document that it met, and is summed by document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, materialize, mix, word_hashes

#: Least share of all tokens of a word and of a bigram whose counts are broadcast: these bound the broadcast tables, not the models.
WORD_SHARE, PAIR_SHARE = 2e-6, 2e-6
#: Tokens that the unigram is worth after each word.
PRIOR = 10.0
#: Bytes of text whose rarer bigrams make up a part.
PART_BYTES = 12 << 20
#: Target ids up to this count are broadcast (9 bytes each); beyond it they are shuffled with the texts.
BROADCAST_IDS = 1_000_000
#: Tokens in a round of numpy work.
_ROUND = 1 << 19
#: Set in the 32 bits of a word that stand for a hash, not for a place in the broadcast vocabulary.
_RARE = np.uint64(1 << 31)
_LOW = np.uint64((1 << 31) - 1)
_HALF = np.uint64(32)
TARGET, COUNTED, SCORED = 1, 2, 4


def sorted_counts(keys: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, how often each is there, and how often in the target."""
    u, at = np.unique(keys, return_inverse=True)
    return u, np.bincount(at, minlength=len(u)), np.bincount(at, target, minlength=len(u)).astype(np.int64)


def place(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Places of keys in the sorted table; -1 for those that are not in it."""
    if not len(table):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[at] == keys, at, -1)


def heads_of(words: np.ndarray, start: int) -> np.ndarray:
    """The word before each word; start before the first."""
    return np.r_[words.dtype.type(start), words[:-1]] if len(words) else words


@dataclass
class Models:
    vocab: np.ndarray  # sorted hashes (as signed) of the words that are broadcast; a word's place is one more, a text's start comes after all
    unigram: np.ndarray  # probabilities [2, words + 1]; at place 0 those of each rarer word
    heads: np.ndarray  # how often a word follows each place, and the start [2, words + 2]
    hot: np.ndarray  # sorted keys of the bigrams that are broadcast
    seen: np.ndarray  # their counts [2, bigrams]
    scale: np.ndarray  # what matches the counts of target and background in size [2]

    @property
    def start(self) -> int:
        return len(self.vocab) + 1

    def losses(self, keys: np.ndarray, seen: np.ndarray, heads: np.ndarray, own: np.ndarray, own_head: np.ndarray, flags: np.ndarray) -> np.ndarray:
        """Loss in nats [2, keys] of one use of each bigram in a document that has it `own` times and its first word `own_head` times."""
        word = keys & np.uint64(0xFFFFFFFF)
        prior = PRIOR * self.unigram[:, np.where(word & _RARE, np.uint64(0), word).astype(np.int64)]
        counted = (flags & COUNTED) > 0
        mine = np.stack([counted & ((flags & TARGET) > 0), counted]).astype(np.float64)
        scale = self.scale[:, None]
        return np.log(scale * (heads - own_head * mine) + PRIOR) - np.log(scale * (seen - own * mine) + prior)


def _summed(batches: Iterator[pa.RecordBatch], keys_of) -> Iterator[pa.RecordBatch]:
    """Keys of the batches' texts, summed over rounds of about _ROUND tokens."""

    def send() -> pa.RecordBatch:
        u, n, t = sorted_counts(np.concatenate(held).view(np.int64), np.repeat(np.array(flags, np.float64), [len(h) for h in held]))
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(n), pa.array(t)], ["key", "n", "t"])

    held, flags, size = [], [], 0
    for batch in batches:
        for text, target in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            k = keys_of(text)
            held.append(k)
            flags.append(bool(target))
            size += len(k)
            if size >= _ROUND:
                yield send()
                held, flags, size = [], [], 0
    if held:
        yield send()


def _counts(docs: DataFrame, keys_of) -> DataFrame:
    """(key, n, t): how often each key of the counted texts is there, and in the target."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _summed(batches, keys_of)

    counted = docs.where("counted").select("text", "target")
    return materialize(map_batches(counted, run, "key long, n long, t long").groupBy("key").agg(F.sum("n").alias("n"), F.sum("t").alias("t")))


def fit(docs: DataFrame, word_share: float = WORD_SHARE, pair_share: float = PAIR_SHARE) -> Models:
    """The part of the models that is broadcast, from docs (text, target, counted): at most 1 / word_share words and 1 / pair_share bigrams come to the driver."""
    words = _counts(docs, word_hashes)
    distinct, total, total_t = words.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("t"), F.lit(0))).first()
    got = words.where(F.col("n") >= max(2, int(np.ceil(word_share * total)))).toPandas().sort_values("key")
    vocab = got.key.to_numpy(np.int64)
    totals = np.array([total_t, total], np.float64)
    scale = np.minimum(1.0, totals[::-1] / np.maximum(totals, 1))
    rarer = distinct - len(vocab) + 1  # and one for all words never met
    common = np.stack([got.t, got.n]).astype(np.float64).reshape(2, -1)
    rest = (totals - common.sum(axis=1)) / rarer
    unigram = (scale[:, None] * np.concatenate([rest[:, None], common], axis=1) + 1) / (scale * totals + len(vocab) + rarer)[:, None]
    start = len(vocab) + 1
    shared = docs.sparkSession.sparkContext.broadcast(vocab)

    def bigrams(text: str | None) -> np.ndarray:  # those of a rare first word are counted in their part
        w = place(shared.value, word_hashes(text).view(np.int64)).astype(np.int64) + 1
        h = heads_of(w, start)
        return ((h << np.int64(32)) | w)[h > 0]

    pairs = _counts(docs, bigrams)
    got = pairs.where((F.col("n") >= max(2, int(np.ceil(pair_share * total)))) & F.expr("key & 4294967295 <> 0")).toPandas().sort_values("key")
    ahead = pairs.groupBy(F.expr("shiftright(key, 32)").alias("h")).agg(F.sum("n").alias("n"), F.sum("t").alias("t")).toPandas()  # a row a word of the vocabulary
    shared.destroy()
    heads = np.zeros((2, start + 1))
    heads[:, ahead.h.to_numpy(np.int64)] = np.stack([ahead.t, ahead.n])
    return Models(vocab, unigram, heads, got.key.to_numpy(np.int64).view(np.uint64), np.stack([got.t, got.n]).astype(np.float64).reshape(2, -1), scale)


#: The columns of a message, one after the other: keys, uses in the document, uses of the first word there, document, flags; and of an answer.
_FIELDS = (("key", np.uint64), ("own", np.uint32), ("own_head", np.uint32), ("ref", np.uint64), ("flags", np.uint8))
_ANSWER = (("ref", np.uint64), ("target", np.float32), ("background", np.float32))


def pack(columns: dict[str, np.ndarray], part: slice, fields=_FIELDS) -> bytes:
    return b"".join(columns[name][part].astype(kind).tobytes() for name, kind in fields)


def unpack(blobs: list[bytes], fields=_FIELDS) -> dict[str, np.ndarray]:
    out: dict[str, list[np.ndarray]] = {name: [] for name, _ in fields}
    width = sum(np.dtype(kind).itemsize for _, kind in fields)
    for blob in blobs:
        rows, at = len(blob) // width, 0
        for name, kind in fields:
            out[name].append(np.frombuffer(blob, kind, rows, at))
            at += rows * np.dtype(kind).itemsize
    return {name: np.concatenate(v) if v else np.zeros(0, kind) for (name, kind), v in zip(fields, out.values(), strict=True)}


def document_ref(doc_id: int | None, text: str | None) -> int:
    """64 bits for a row; equal for rows of equal id and text, which also score alike."""
    seed = 0x9E3779B97F4A7C15 if doc_id is None else (doc_id * 2 + 1) & 0xFFFFFFFFFFFFFFFF
    return xxhash.xxh3_64_intdigest((text or "").encode("utf-8", "surrogatepass"), seed)


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Places where a run of equal rows begins."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


#: A document's own row, or a message or answer (blob) to a part.
_NAMES = ["part", "blob", "ref", "doc_id", "n_tokens", "target_loss", "background_loss"]
_ROWS = "part int, blob binary, ref long, doc_id long, n_tokens long, target_loss double, background_loss double"
_TYPES = pa.schema(list(zip(_NAMES, (pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()), strict=True)))


def _packed(columns: dict[str, np.ndarray], part: np.ndarray, fields) -> pa.Table:
    """A row with the packed columns for each part; part is sorted."""
    cuts = _starts(part)
    blobs = [pack(columns, slice(a, b), fields) for a, b in zip(cuts, np.r_[cuts, len(part)][1:], strict=True)]
    rows = pa.table({"part": pa.array(part[cuts], pa.int32()), "blob": pa.array(blobs, pa.binary())})
    for field in list(_TYPES)[2:]:
        rows = rows.append_column(field, pa.nulls(len(blobs), field.type))
    return rows


def _deal(rows: list[tuple], models: Models, parts: int) -> pa.Table:
    """A row for each document with the losses of its broadcast bigrams, and a message for each part with its other bigrams."""
    refs = np.array([document_ref(d, t) for d, t, _, _ in rows], np.uint64)
    sizes = np.array([len(h) for _, _, _, h in rows])
    doc = np.repeat(np.arange(len(rows)), sizes)
    hashes = np.concatenate([h for _, _, _, h in rows]) if rows else np.zeros(0, np.uint64)
    at = place(models.vocab, hashes.view(np.int64))
    codes = np.where(at >= 0, (at + 1).astype(np.uint64), _RARE | (hashes & _LOW))
    head, before = np.r_[np.uint64(0), codes[:-1]], np.r_[np.uint64(0), hashes[:-1]]
    first = np.cumsum(sizes) - sizes
    head[first[sizes > 0]] = models.start
    keys = (head << _HALF) | codes
    order = np.lexsort((keys, doc))
    keys, doc, before = keys[order], doc[order], before[order]
    runs = _starts(keys, doc)
    own = np.diff(np.r_[runs, len(keys)])
    keys, doc, before = keys[runs], doc[runs], before[runs]
    same_head = _starts(keys >> _HALF, doc)
    own_head = np.repeat(np.add.reduceat(own, same_head), np.diff(np.r_[same_head, len(keys)])) if len(keys) else own
    flags = np.array([f for _, _, f, _ in rows], np.uint8)
    hot = place(models.hot, keys)
    loss = np.zeros((2, len(rows)))
    on = np.flatnonzero((hot >= 0) & ((flags[doc] & SCORED) > 0))
    if len(on):
        got = models.losses(keys[on], models.seen[:, hot[on]], models.heads[:, (keys[on] >> _HALF).astype(np.int64)], own[on], own_head[on], flags[doc[on]]) * own[on]
        loss = np.stack([np.bincount(doc[on], got[i], minlength=len(rows)) for i in (0, 1)])
    off = np.flatnonzero(hot < 0)
    rare = (keys[off] >> _HALF) & _RARE > 0
    part = (mix(np.where(rare, before[off], keys[off]), 11) % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    off, part = off[order], part[order]
    columns = {"key": keys[off], "own": own[off], "own_head": own_head[off], "ref": refs[doc[off]], "flags": flags[doc[off]]}
    kept = np.flatnonzero(flags & SCORED)
    own_rows = [pa.array((refs[kept] % np.uint64(parts)).astype(np.int32)), pa.nulls(len(kept), pa.binary()), pa.array(refs[kept].view(np.int64)), pa.array([rows[i][0] for i in kept], pa.int64()), pa.array(sizes[kept], pa.int64()), pa.array(loss[0, kept]), pa.array(loss[1, kept])]
    return pa.concat_tables([pa.Table.from_arrays(own_rows, schema=_TYPES), _packed(columns, part, _FIELDS)])


def _score_part(table: pa.Table, models: Models, parts: int) -> pa.Table:
    """The losses of a part's bigrams by document, packed for the documents' parts, and the documents' own rows as they are."""
    plain = table.filter(table["blob"].is_null()).select(_NAMES).cast(_TYPES)
    m = unpack(table["blob"].drop_null().to_pylist())
    keys, flags, own = m["key"], m["flags"], m["own"].astype(np.float64)
    _, at = np.unique(keys, return_inverse=True)
    mine = [own * ((flags & both) == both) for both in (COUNTED | TARGET, COUNTED)]
    head = keys >> _HALF
    rare = head & _RARE > 0
    _, of = np.unique(head, return_inverse=True)
    on = np.flatnonzero(flags & SCORED)
    seen = np.stack([np.bincount(at, x)[at[on]] if len(at) else x for x in mine])
    inside = np.stack([np.bincount(of, x)[of[on]] if len(of) else x for x in mine])  # all uses of a rare first word are here
    heads = np.where(rare[on], inside, models.heads[:, np.where(rare[on], np.uint64(0), head[on]).astype(np.int64)])
    loss = models.losses(keys[on], seen, heads, own[on], m["own_head"][on].astype(np.float64), flags[on]) * own[on]
    refs, to = np.unique(m["ref"][on], return_inverse=True)
    by_doc = [np.bincount(to, x, minlength=len(refs)) if len(on) else np.zeros(0) for x in loss]
    part = (refs % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    return pa.concat_tables([plain, _packed({"ref": refs[order], "target": by_doc[0][order], "background": by_doc[1][order]}, part[order], _ANSWER)])


def _sum_part(table: pa.Table) -> pa.Table:
    """The scores of a part's documents from their own rows and all parts' answers."""
    plain = table.filter(table["blob"].is_null())
    m = unpack(table["blob"].drop_null().to_pylist(), _ANSWER)
    own = plain["ref"].to_numpy().view(np.uint64)
    refs, at, copies = np.unique(own, return_inverse=True, return_counts=True)
    to = place(refs, m["ref"])  # every answer has its document here
    tokens = plain["n_tokens"].to_numpy()
    mean = []
    for name in ("target", "background"):
        more = np.bincount(to, m[name], minlength=len(refs)) if len(to) else np.zeros(len(refs))
        mean.append((plain[f"{name}_loss"].to_numpy() + more[at] / copies[at]) / np.maximum(tokens, 1))
    none = tokens == 0
    losses = [pa.array(x, pa.float64(), mask=none) for x in mean]
    return pa.Table.from_arrays([plain["doc_id"], plain["n_tokens"], *losses, pa.array(np.where(none, 0.0, mean[1] - mean[0]))], ["doc_id", "n_tokens", "target_loss", "background_loss", "score"])


def score_documents(docs: DataFrame, corpus: DataFrame | None = None, word_share: float = WORD_SHARE, pair_share: float = PAIR_SHARE, part_bytes: int = PART_BYTES) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss (mean nats a token) and score, their difference, for each row of docs.

    docs (doc_id, text, target) are the corpus themselves and each is scored by all the others, unless another corpus
    (text, target) is given: then that one alone is counted. A text that is null or without words has no tokens, null
    losses and score 0. Repeated rows come back as often as given, each scored with its copies in the corpus; tied and
    null ids are scored by their texts. A very long text is one row of numpy work. With an empty corpus or target,
    all words are alike or rarer words are. Other columns are left aside; an empty table gives an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce("target", F.lit(False)).alias("target") if corpus is None else F.lit(False).alias("target"), F.lit(corpus is None).alias("counted"), F.lit(True).alias("scored"))
    if corpus is not None:
        docs = docs.union(corpus.select(F.lit(None).cast("long"), F.col("text").cast("string"), F.coalesce("target", F.lit(False)), F.lit(True), F.lit(False)))
    models = docs.sparkSession.sparkContext.broadcast(fit(docs, word_share, pair_share))
    parts = (docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // part_bytes + 1

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            ids, texts, flags = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()
            for doc_id, text, flag in zip(ids, texts, flags, strict=True):
                rows.append((doc_id, text, flag, word_hashes(text)))
                size += len(rows[-1][3])
                if size >= _ROUND:
                    yield from _deal(rows, models.value, parts).to_batches()
                    rows, size = [], 0
        if rows:
            yield from _deal(rows, models.value, parts).to_batches()

    flags = F.expr(f"if(target, {TARGET}, 0) + if(counted, {COUNTED}, 0) + if(scored, {SCORED}, 0)").alias("flags")
    dealt = map_batches(docs.select("doc_id", "text", flags), deal, _ROWS)
    answered = dealt.groupBy("part").applyInArrow(lambda table: _score_part(table, models.value, parts), _ROWS)
    # The answers are for other parts; the column's new name tells Spark so.
    return answered.withColumnRenamed("part", "shard").groupBy("shard").applyInArrow(lambda table: _sum_part(table), "doc_id long, n_tokens long, target_loss double, background_loss double, score double")


def marked(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs' doc_id and text, and whether labels has the row as of good quality (quality 1)."""
    good = labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct().withColumn("target", F.lit(True))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    good = materialize(good)
    good = F.broadcast(good) if good.count() <= BROADCAST_IDS else good
    return docs.join(good, "doc_id", "left").select("doc_id", "text", F.coalesce("target", F.lit(False)).alias("target"))
