"""Toxicity by the nearest labelled examples: exact TF-IDF cosine through a block-max inverted index, weighted votes.

Fitting: a bounded sample of labelled documents gives the examples (MAX_EXAMPLES of each class and MAX_POSTINGS words
of all examples, by hash). Every word of the whole text of an example enters its vector; how many documents hold a
word is counted over all documents. A word weighs (1 + ln tf) * idf * rf. rf, the relevance frequency of
text categorisation, is log2(2 + a / max(1, c)) for a word that a examples of label 1 and c of label 0 hold: without it,
the few words that make a text toxic hardly count among all the others, and half of the toxic texts are missed.

The index keeps postings by word. Lists of words that few examples hold are read whole. Long lists are kept by block
of examples with each block's greatest weight; what a block can reach at most is known before its weights are read,
so blocks that hold no better neighbour than the K found are skipped: the neighbours are exact.

Scoring: votes weighted by cosine give a raw score. It is calibrated by a monotone curve that was fitted on the
examples themselves, each scored without its own vote.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, map_batches, materialize, words_of

#: Documents of each class that serve as examples, at most about, and distinct words of all examples: the bounds of the fitted sample.
MAX_EXAMPLES, MAX_POSTINGS = 4096, 6_000_000
#: Neighbours that vote, and examples in a block.
K, BLOCK = 25, 32
#: A word that more than this share of the examples hold has a long list, which is kept by block.
LONG_SHARE = 1 / 8
#: Texts scored together, and blocks read before the first bound is known.
TOGETHER, FIRST = 64, 4
#: Above this share of blocks left, all are read at once.
MANY = 1 / 4
#: Words that are counted together: a task sends one row for so many, and the driver gets one row.
WIDE = 4096
#: Stripped from both ends of a word.
EDGES = b".,;:!?\"'()[]{}<>*#$%&@|-_~`"
SLACK = 1e-5  # of single precision

Vector = tuple[np.ndarray, np.ndarray]


def bag(text: str | None) -> Vector:
    """Sorted hashes of a text's distinct words, and how often each is there."""
    words = [w.strip(EDGES) for w in words_of(text)]
    return np.unique(np.fromiter(map(xxhash.xxh3_64_intdigest, filter(None, words)), np.uint64), return_counts=True)


@dataclass
class Index:
    """Examples' unit vectors: postings of words with short lists, blocks of long ones with block maxima."""

    words: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))  # sorted hashes
    weight: np.ndarray = field(default_factory=lambda: np.zeros(0))
    #: Short lists: word w's examples and weights are at starts[w] to starts[w + 1]; none for a long list.
    starts: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))
    places: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    values: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))
    #: Long lists: the row of each word (-1: short), weights by (row, example), and maxima by (row, block).
    row_of: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    rows: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.float32))
    tops: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.float32))
    labels: np.ndarray = field(default_factory=lambda: np.zeros(0))
    ids: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    prior: float = 0.0
    curve: tuple[np.ndarray, np.ndarray] = (np.zeros(0), np.zeros(0))

    def vector(self, words: np.ndarray, counts: np.ndarray) -> Vector:
        """Places and unit-length weights of a text's words; words of no example have none."""
        if not len(self.words):
            return np.zeros(0, np.int64), np.zeros(0)
        at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        known = self.words[at] == words
        at = at[known]
        weight = (1 + np.log(counts[known])) * self.weight[at]
        return at, weight / max(np.sqrt(weight @ weight), 1e-300)

    def nearest(self, vectors: list[Vector], k: int = K, without: list[int] | None = None) -> Iterator[Vector]:
        """For each vector the k examples of greatest cosine above 0, and these cosines; ties go to the lower place. without: an example left out of each."""
        width, blocks = len(self.labels), self.tops.shape[1]
        if not width:
            yield from ((np.zeros(0, np.int64), np.zeros(0)) for _ in vectors)
            return
        first = min(max(FIRST, -(-2 * k // BLOCK)), blocks)
        by_block = self.rows.reshape(len(self.rows), blocks, BLOCK)
        for begin in range(0, len(vectors), TOGETHER):
            part = vectors[begin : begin + TOGETHER]
            short, long = np.zeros((len(part), blocks * BLOCK), np.float32), np.zeros((len(part), len(self.rows)), np.float32)
            for i, (at, weight) in enumerate(part):
                row = self.row_of[at]
                long[i, row[row >= 0]] = weight[row >= 0]
                start, size = self.starts[at], self.starts[at + 1] - self.starts[at]
                if total := int(size.sum()):
                    entry = np.arange(total) + np.repeat(start - (np.cumsum(size) - size), size)
                    short[i] = np.bincount(self.places[entry], self.values[entry] * np.repeat(weight, size), minlength=blocks * BLOCK)
            bound = short.reshape(len(part), blocks, BLOCK).max(axis=2) + long @ self.tops
            whole: list[int] = []
            found: dict[int, Vector] = {}
            for i in range(len(part)):
                left_out = without[begin + i] if without else -1
                ahead = np.argpartition(-bound[i], first - 1)[:first]
                best = self._pick(*self._read(by_block, short[i], long[i], ahead), k, left_out)
                worst = best[1][-1] if len(best[0]) == k else 0.0
                more = bound[i] >= max(worst - SLACK, SLACK)
                more[ahead] = True
                if more.sum() > MANY * blocks:
                    whole.append(i)
                elif more.sum() > first:
                    found[i] = self._pick(*self._read(by_block, short[i], long[i], np.flatnonzero(more)), k, left_out)
                else:
                    found[i] = best
            if whole:
                cosines = short[whole] + long[whole] @ self.rows
                for i, cosine in zip(whole, cosines, strict=True):
                    found[i] = self._pick(np.arange(width), cosine[:width], k, without[begin + i] if without else -1)
            yield from (found[i] for i in range(len(part)))

    def _read(self, by_block: np.ndarray, short: np.ndarray, long: np.ndarray, blocks: np.ndarray) -> Vector:
        """Examples of these blocks, and their cosines."""
        cosine = short.reshape(-1, BLOCK)[blocks] + np.einsum("w,wbe->be", long, by_block[:, blocks])
        return (blocks[:, None] * BLOCK + np.arange(BLOCK)).ravel(), cosine.ravel()

    @staticmethod
    def _pick(rows: np.ndarray, cosine: np.ndarray, k: int, without: int) -> Vector:
        cosine = np.round(cosine.astype(np.float64), 6)  # copies tie, however their weights were added
        if len(rows) > 4 * k:
            least = np.partition(cosine, len(rows) - k - 1)[len(rows) - k - 1]  # one more than k: one may be left out
            rows, cosine = rows[cosine >= least], cosine[cosine >= least]
        keep = (cosine > 0) & (rows != without)
        rows, cosine = rows[keep], cosine[keep]
        order = np.lexsort((rows, -cosine))[:k]
        return rows[order], cosine[order]

    def raws(self, vectors: list[Vector], without: list[int] | None = None) -> Iterator[tuple[float, Vector]]:
        """Vote of the nearest examples (-1: there are none), and these."""
        for best, cosine in self.nearest(vectors, K, without):
            yield (float((cosine * self.labels[best]).sum() / cosine.sum()) if len(best) else -1.0), (best, cosine)

    def scores(self, texts: list[str | None]) -> Iterator[tuple[float, list[int], list[float]]]:
        """Calibrated score, and the evidence: the ids of the voting examples and their cosines."""
        x, y = self.curve
        for raw, (best, cosine) in self.raws([self.vector(*bag(t)) for t in texts]):
            p = float(np.interp(raw, x, y)) if len(x) else self.prior
            yield min(1.0, max(0.0, p)), self.ids[best].tolist(), cosine.tolist()


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Non-decreasing means of y over x: pool adjacent violators, one point for each pool's mean x."""
    values, at = np.unique(x, return_inverse=True)
    pools: list[list[float]] = []  # mean y, weight, weighted x
    for v, a, b in zip(values, np.bincount(at, w * y), np.bincount(at, w), strict=True):
        pools.append([a / b, b, v * b])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            m, n, s = pools.pop()
            pools[-1] = [(pools[-1][0] * pools[-1][1] + m * n) / (pools[-1][1] + n), pools[-1][1] + n, pools[-1][2] + s]
    return np.array([p[2] / p[1] for p in pools]), np.array([p[0] for p in pools])


def build(keys: np.ndarray, ids: np.ndarray, labels: np.ndarray, sizes: np.ndarray, bags: Vector, words: np.ndarray, held: np.ndarray, total: int, share: float) -> Index:
    """The index of examples, without its curve. bags: words and counts of all examples, one after the other, sizes of each.

    words: sorted; held: how many of total documents hold each. share: of label 1 among all labelled rows.
    """
    out = Index(words=words, prior=share)
    at = np.searchsorted(words, bags[0]).astype(np.int32)
    owner = np.repeat(np.arange(len(keys), dtype=np.int32), sizes)
    toxic = labels[owner] == 1
    marks = [np.bincount(at[own], minlength=len(words)) for own in (toxic, ~toxic)]
    out.weight = np.log((1 + total) / (1 + np.minimum(held, total))) * np.log2(2 + marks[0] / np.maximum(1, marks[1])) + 1e-9
    value = ((1 + np.log(bags[1])) * out.weight[at]).astype(np.float32)
    value /= np.sqrt(np.bincount(owner, value.astype(np.float64) ** 2, minlength=len(keys)))[owner].astype(np.float32)
    # Examples of a label with the same leading word stand together, so that block maxima are sharp.
    some = np.flatnonzero(sizes)
    top = np.maximum.reduceat(value, (np.cumsum(sizes) - sizes)[some]) if len(some) else value
    greatest = np.zeros(len(keys), np.float32)
    greatest[some] = top
    leading = np.full(len(keys), len(words))
    leads = np.flatnonzero(value == greatest[owner])
    np.minimum.at(leading, owner[leads], at[leads])
    order = some[np.lexsort((keys[some], leading[some], labels[some]))]
    out.labels, out.ids, out.keys = labels[order].astype(np.float64), ids[order], keys[order]
    place = np.zeros(len(keys), np.int32)
    place[order] = np.arange(len(order))
    place = place[owner]
    blocks = -(-len(order) // BLOCK)
    often = np.flatnonzero(np.bincount(at, minlength=len(words)) > LONG_SHARE * len(order))
    out.row_of = np.full(len(words), -1, np.int32)
    out.row_of[often] = np.arange(len(often))
    out.rows = np.zeros((len(often), blocks * BLOCK), np.float32)
    row = out.row_of[at]
    out.rows[row[row >= 0], place[row >= 0]] = value[row >= 0]
    out.tops = out.rows.reshape(len(often), blocks, BLOCK).max(axis=2, initial=0)
    at, place, value = at[row < 0], place[row < 0], value[row < 0]
    by = np.lexsort((place, at))
    out.starts, out.places, out.values = np.searchsorted(at[by], np.arange(len(words) + 1)), place[by], value[by]
    return out


def training_rows(docs: DataFrame, labels: DataFrame, seed: int = 7) -> tuple[DataFrame, float]:
    """(doc_id, text, toxic) of at most about MAX_EXAMPLES documents of each class, and the share of class 1 among all labels.

    Of a document that is labelled more than once, the greatest label counts.
    """
    labels = labels.where("toxic in (0, 1) and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    count = {r.toxic: r["count"] for r in labels.groupBy("toxic").count().collect()}  # two rows
    cut = F.lit(0)
    for y, n in count.items():
        cut = F.when(F.col("toxic") == y, int(min(1.0, MAX_EXAMPLES / n) * 1_000_000)).otherwise(cut)
    chosen = labels.where(F.expr(f"pmod(xxhash64(doc_id, {seed}), 1000000)") < cut)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")  # at most MAX_EXAMPLES of a class
    return rows.select("doc_id", "text", "toxic"), count.get(1, 0) / max(1, sum(count.values()))


def bags_of(rows: DataFrame) -> DataFrame:
    """key, doc_id, toxic, words and counts (little-endian) of rows (doc_id, text, toxic); rows that repeat come once, at most about MAX_POSTINGS words in all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [bag(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *(pa.array([x.astype(t).tobytes() for x in column], pa.binary()) for t, column in zip(("<u8", "<u4"), [*zip(*got, strict=True)] or [(), ()], strict=True))], ["doc_id", "toxic", "words", "counts"])

    bags = map_batches(rows, run, "doc_id long, toxic int, words binary, counts binary").withColumn("key", F.xxhash64("doc_id", "toxic", "words", "counts"))
    bags = materialize(bags.dropDuplicates(["key"]))
    held = bags.agg(F.coalesce(F.sum(F.expr("octet_length(words) div 8")), F.lit(0))).first()[0]
    return bags if held <= MAX_POSTINGS else bags.where(F.expr(f"pmod(xxhash64(key, 11), 1000000) < {int(MAX_POSTINGS / held * 1_000_000)}"))


def vectors_in(batch: pa.RecordBatch) -> list[Vector]:
    return [(np.frombuffer(w, "<u8"), np.frombuffer(n, "<u4")) for w, n in zip(batch.column("words").to_pylist(), batch.column("counts").to_pylist(), strict=True)]


def documents_with(docs: DataFrame, words: np.ndarray) -> tuple[int, np.ndarray]:
    """How many documents there are, and how many of them hold each of words (sorted hashes). Counts travel as arrays: rows for single words would be most of what the JVMs hold."""
    shared = docs.sparkSession.sparkContext.broadcast(words)  # the examples' words: MAX_POSTINGS bounds them

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        n = np.zeros(len(words) + 1, np.int64)  # the last counts documents
        for batch in batches:
            for text in batch.column(0).to_pylist():
                own, _ = bag(text)
                at = np.minimum(np.searchsorted(words, own), len(words) - 1)
                n[at[words[at] == own]] += 1
            n[-1] += batch.num_rows
        some = np.flatnonzero(n)
        first = np.flatnonzero(np.diff(some // WIDE, prepend=-1))
        parts = [np.split(x, first[1:]) for x in ((some % WIDE).astype("<u2"), n[some].astype("<i8"))]
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array((some // WIDE)[first].astype(np.int32)), *(pa.array([x.tobytes() for x in part], pa.binary()) for part in parts)], ["block", "places", "n"])

    def add(table: pa.Table) -> pa.Table:
        places, n = (np.frombuffer(b"".join(table.column(c).to_pylist()), t) for c, t in (("places", "<u2"), ("n", "<i8")))
        sums = np.zeros(WIDE, np.int64)
        np.add.at(sums, places, n)
        return pa.table({"block": table.column("block")[:1], "n": pa.array([sums.astype("<i8").tobytes()], pa.binary())})

    tables = map_batches(docs.select(F.col("text").cast("string").alias("text")), run, "block int, places binary, n binary")
    counts = tables.groupBy("block").applyInArrow(add, "block int, n binary").toArrow()
    shared.destroy()
    n = np.zeros((len(words) // WIDE + 1) * WIDE, np.int64)
    for block, sums in zip(counts.column("block").to_pylist(), counts.column("n"), strict=True):
        n[block * WIDE : (block + 1) * WIDE] = np.frombuffer(sums.as_buffer(), "<i8")
    n = n[: len(words) + 1]
    return int(n[-1]), n[:-1]


def fit_on(docs: DataFrame, labels: DataFrame) -> Index:
    """The index of a sample of the labelled documents, with words counted over all of docs. Texts are read in Spark's tasks; the driver gets the examples' bags."""
    rows, share = training_rows(docs, labels)
    bags = bags_of(rows)
    table = bags.select("key", "doc_id", "toxic", "words", "counts").toArrow()
    keys, ids, labels = (table.column(i).to_numpy() for i in range(3))
    sizes = pc.binary_length(table.column("words")).to_numpy() // 8
    flat = tuple(np.frombuffer(b"".join(table.column(c).to_pylist()), t) for c, t in (("words", "<u8"), ("counts", "<u4")))
    del table
    words = np.unique(flat[0])
    if not len(words):
        return Index(prior=share)
    total, held = documents_with(docs, words)
    index = build(keys, ids, labels, sizes, flat, words, held, total, share)
    del flat
    give_back()
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        place = {k: i for i, k in enumerate(model.keys.tolist())}
        for batch in batches:
            got = model.raws([model.vector(*v) for v in vectors_in(batch)], [place.get(k, -1) for k in batch.column(0).to_pylist()])
            yield pa.RecordBatch.from_arrays([pa.array([raw for raw, _ in got], pa.float64()), batch.column(1)], ["raw", "toxic"])

    votes = map_batches(bags.select("key", "toxic", "words", "counts"), vote, "raw double, toxic int").toArrow()  # two numbers an example
    shared.destroy()
    raw, labels = votes.column("raw").to_numpy(), votes.column("toxic").to_numpy().astype(np.float64)
    weight = np.where(labels > 0, share / max(labels.mean(), 1e-9), (1 - share) / max(1 - labels.mean(), 1e-9))
    index.curve = isotonic(raw, labels, np.maximum(weight, 1e-9))
    return index


def toxicity_scores(docs: DataFrame, index: Index) -> DataFrame:
    """doc_id, score (0 to 1), evidence_ids and evidence_cosines for each row of docs.

    docs needs doc_id and text; other columns are left aside. Texts are read whole, however long. Null and empty texts,
    and texts without a word of an example, get the rate of label 1 among such examples and no evidence. Without
    examples every score is the share of label 1, 0 if there are no labels. Repeated rows come back as often as
    given; ties between examples go to the lower place in the index.
    """
    shared = docs.sparkSession.sparkContext.broadcast(index)  # MAX_EXAMPLES and MAX_POSTINGS bound it

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [*shared.value.scores(batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([g[0] for g in got], pa.float64()), pa.array([g[1] for g in got], pa.list_(pa.int64())), pa.array([g[2] for g in got], pa.list_(pa.float64()))],
                ["doc_id", "score", "evidence_ids", "evidence_cosines"],
            )

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_batches(docs, run, "doc_id long, score double, evidence_ids array<long>, evidence_cosines array<double>")


def keep_clean(docs: DataFrame, index: Index, threshold: float = 0.5) -> DataFrame:
    """docs, all columns and repeated rows, without the documents whose score is threshold or more.

    Null and empty texts score as toxicity_scores says; with more clean than toxic labels they stay. Texts are read
    whole. An empty table gives an empty one.
    """
    shared, at = docs.sparkSession.sparkContext.broadcast(index), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([s[0] < threshold for s in shared.value.scores(batch.column(at).to_pylist())], pa.bool_()))

    return map_batches(docs, run, docs.schema)
