"""Document fingerprints: one-permutation MinHash with optimal densification, packed low-order bits.

Each shingle is hashed once; the top bits choose its bin and a bin keeps its lowest hash. An empty bin takes the
value of the bin that a hash of (bin, attempt) names, the first that is not empty. Of each value BITS low-order bits
are stored. The likeness of two fingerprints is the share of equal bins, corrected for chance agreement.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_batches, mix, shingle_hashes, shuffle_width

#: 2 ** BIN_BITS bins of BITS bits each: 256 bytes. WIDTH: words in a shingle.
BIN_BITS, BITS, WIDTH = 8, 8, 5
BINS = 1 << BIN_BITS
_NAMED = [mix(np.arange(BINS, dtype=np.uint64) + np.uint64(t << 32), 61).astype(np.int64) & (BINS - 1) for t in range(64)]


def fingerprint(text: str | None, width: int = WIDTH) -> bytes:
    """BINS * BITS bits; empty for a text without words."""
    s = shingle_hashes(text, width)  # sorted, so each bin's first is its lowest
    if not len(s):
        return b""
    s = np.sort(mix(s, 67))
    bins = (s >> np.uint64(64 - BIN_BITS)).astype(np.int64)
    full, first = np.unique(bins, return_index=True)
    value, have = np.zeros(BINS, np.uint64), np.zeros(BINS, bool)
    value[full], have[full] = mix(s[first], 71), True
    out, empty, t = value.copy(), np.flatnonzero(~have), 0
    while len(empty):
        named = _NAMED[t][empty] if t < len(_NAMED) else mix(empty.astype(np.uint64) + np.uint64(t << 32), 61).astype(np.int64) & (BINS - 1)
        ok = have[named]
        out[empty[ok]] = value[named[ok]]
        empty, t = empty[~ok], t + 1
    return (out & np.uint64((1 << BITS) - 1)).astype(np.uint8).tobytes()


def likeness(a: bytes, b: bytes) -> float:
    """Estimated Jaccard similarity, 0 to 1. Two texts without words are alike; one without is unlike any other."""
    if not a or not b:
        return float(a == b)
    same = float((np.frombuffer(a, np.uint8) == np.frombuffer(b, np.uint8)).mean())
    chance = 2.0**-BITS
    return min(1.0, max(0.0, (same - chance) / (1 - chance)))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint (binary) of each row of docs (doc_id, text); a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([fingerprint(t) for t in batch.column(1).to_pylist()], pa.binary())], ["doc_id", "fingerprint"])

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, "doc_id long, fingerprint binary")


def with_next(docs: DataFrame) -> DataFrame:
    """(part, doc_id, text, ghost): docs in parts by descending doc_id, each part followed by a copy (ghost) of the row after it.

    The bounds of the parts are a few quantiles of doc_id. Rows of one id stay in one part. Only each part's first rows
    are copied. After the last row comes the first. Order: part, then doc_id descending (null last), then text.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    parts = 2 * shuffle_width(docs.sparkSession)
    marks = docs.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], 10_000)).first()[0] or []
    marks = sorted(set(marks), reverse=True)
    part = F.when(F.col("doc_id").isNull(), len(marks) + 1)
    for i, m in enumerate(marks):
        part = part.when(F.col("doc_id") > m, i)
    docs = docs.withColumn("part", part.otherwise(len(marks)).cast("int"))
    tops = {r.part: r.top for r in docs.groupBy("part").agg(F.max("doc_id").alias("top")).collect()}  # a row for each part
    there = sorted(tops)
    ghosts = docs.sparkSession.createDataFrame([(tops[b], b, a) for a, b in zip(there, there[1:] + there[:1], strict=True)], "top long, here int, part int")
    first = docs.join(F.broadcast(ghosts), docs.doc_id.eqNullSafe(ghosts.top) & (docs.part == ghosts.here)).select(ghosts.part, docs.doc_id, "text", F.lit(1).alias("ghost"))
    # Of rows with the same id only the first in order is the next part's head.
    first = first.withColumn("n", F.row_number().over(Window.partitionBy("part").orderBy("text"))).where("n = 1").drop("n")
    return docs.select("part", "doc_id", "text", F.lit(0).alias("ghost")).union(first)


def fingerprint_report(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text: the last third replaced by as much of the next document.

    Next: by descending doc_id, then text, null ids last; after the last row comes the first. Null texts count as empty.
    A table of one row is its own next. Repeated rows come back as often as given; an empty table gives an empty result.
    """
    rows = with_next(docs).repartition(2 * shuffle_width(docs.sparkSession), "part").sortWithinPartitions("part", "ghost", F.desc_nulls_last("doc_id"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None  # part, doc_id, text, fingerprint: the row whose next comes now
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        for batch in batches:
            out = []
            for part, doc, text, ghost in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = fingerprint(text)
                if before is not None and before[0] == part:
                    _, d, t, f = before
                    cut = len(t) // 3
                    edited = t[: len(t) - cut] + text[:cut]
                    e = fingerprint(edited)
                    out.append((d, len(t), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), f.hex(), e.hex(), likeness(f, e), likeness(f, own)))
                before = None if ghost else (part, doc, text, own)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names)

    return map_batches(rows, run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")

