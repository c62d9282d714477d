"""Periodic runs: stretches of words that repeat with a period at least twice, found by an all-lag vectorised scan.

The words of a document become numbers, and the array is compared with itself moved by every lag up to half its length
(in general by n / min_exponent). A stretch of agreement of `a` words at lag q is a run of a + q words with period q. The
comparisons grow with the square of the words, so Spark deals long documents as ranges of lags over all machines, and
brings their runs together again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, materialize, shuffle_width

#: Shortest run, in words, and how often its period must fit into it.
MIN_LENGTH, MIN_EXPONENT = 12, 2
#: Comparisons made at a time: their result stays in a core's cache.
CELLS = 1 << 18
#: Texts of so many characters and more are dealt as ranges of lags: of RANGE comparisons, and for longer documents of
#: RANGE_LAGS lags at least, so that the words sent with each range stay few beside its comparisons.
LONG_TEXT, RANGE, RANGE_LAGS = 100_000, 1 << 26, 1 << 12

_RUNS = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32()), ("period", pa.int32())]))
RUNS = "array<struct<start: int, length: int, period: int>>"


def split_words(text: str | None) -> list[bytes]:
    r"""The words `[^\x20\x09-\x0D]+` of a text as UTF-8: bytes.split knows just these separators."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def word_ids(words: list[bytes]) -> np.ndarray:
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int32, len(words))


def agreements(ids: np.ndarray, low: int, high: int, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> np.ndarray:
    """(start, length, lag), one a row, of all stretches that repeat at a lag of low to high - 1 and are long enough for a run. The lag need not be the smallest period."""
    n = len(ids)
    high = min(high, n // min_exponent + 1)
    found = [np.zeros((0, 3), np.int64)]
    while low < high:
        width = n - low + 1  # its last word meets the filling, so that no stretch goes on in the next row
        rows = min(high - low, max(1, CELLS // width))
        moved = np.concatenate([ids[low:], np.full(rows, -1, np.int32)])
        same = np.lib.stride_tricks.sliding_window_view(moved, width)[:rows] == ids[:width]
        hits = np.flatnonzero(same)
        if len(hits):
            cut = np.flatnonzero(np.diff(hits) != 1)
            first, last = hits[np.r_[0, cut + 1]], hits[np.r_[cut, len(hits) - 1]]
            lag = low + first // width
            length = last - first + 1 + lag
            keep = length >= np.maximum(min_length, min_exponent * lag)
            found.append(np.stack([first % width, length, lag], axis=1)[keep])
        low += rows
    return np.concatenate(found)


def primitive(found: np.ndarray) -> np.ndarray:
    """Runs of agreements of all lags, by start, then period, each with its smallest period.

    Two periods of a stretch that is twice as long as either have their greatest common divisor as a period, so a lag that
    is no smallest period is a multiple of one that agrees on the same stretch.
    """
    if not len(found):
        return found
    found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
    new = np.r_[True, (np.diff(found[:, :2], axis=0) != 0).any(axis=1)]
    found = found[new]
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def collapse(words: list[bytes], runs: np.ndarray) -> str:
    """Words without those that a run has after its first period, joined by one space."""
    if len(runs):
        edge = np.zeros(len(words) + 1, np.int64)
        np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
        np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
        words = [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]
    return b" ".join(words).decode("utf-8", "surrogatepass")


def _as_arrow(runs: list[np.ndarray]) -> pa.Array:
    offsets = np.cumsum([0, *map(len, runs)], dtype=np.int32)
    flat = np.concatenate([np.zeros((0, 3), np.int64), *runs]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], fields=list(_RUNS.value_type)))


def periodic_runs(docs: DataFrame, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT, long_text: int = LONG_TEXT) -> DataFrame:
    """doc_id, n_words, runs (start, length, period in words, by start, then period) and collapsed (the text's words without repeats) for each row of docs (doc_id, text).

    A run is a stretch with smallest period q, of max(min_length, min_exponent * q) words or more, that no neighbouring
    word extends. Words are compared as they stand. Null and empty texts, and texts of separators, have no words, no
    runs and an empty collapsed text. Texts of any length are scanned whole, at every lag. Repeated rows and rows
    without doc_id come back as often as given, each by its own text; other columns are left aside; an empty table
    gives an empty result.
    """
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    is_long = F.coalesce(F.length("text") >= long_text, F.lit(False))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, runs, collapsed = [], [], []
            for text in batch.column(1):
                words = split_words(text.as_py())
                now = primitive(agreements(word_ids(words), 1, len(words), min_length, min_exponent))
                sizes.append(len(words))
                runs.append(now)
                collapsed.append(collapse(words, now))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int32()), _as_arrow(runs), pa.array(collapsed, pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    of_id = docs.schema["doc_id"].dataType.simpleString()
    short = map_batches(docs.where(~is_long), scan, f"doc_id {of_id}, n_words int, runs {RUNS}, collapsed string")
    long = materialize(docs.where(is_long).select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, text in zip(batch.column(0), batch.column(1), strict=True):
                ids = word_ids(split_words(text.as_py()))
                step = max(RANGE_LAGS, RANGE // max(len(ids), 1))
                for low in range(1, len(ids) // min_exponent + 1, step):
                    yield pa.RecordBatch.from_arrays([pa.array([row.as_py()], pa.int64()), pa.array([low], pa.int32()), pa.array([low + step], pa.int32()), pa.array([ids.tobytes()], pa.binary())], ["row", "low", "high", "ids"])

    def scan_range(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, low, high, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                now = agreements(np.frombuffer(ids, np.int32), low, high, min_length, min_exponent).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(now), row, np.int64)), *(pa.array(now[:, i]) for i in range(3))], ["row", "start", "length", "period"])

    ranges = map_batches(long.select("row", "text"), deal, "row long, low int, high int, ids binary").repartition(shuffle_width(docs.sparkSession), "row", "low")
    found = map_batches(ranges, scan_range, "row long, start int, length int, period int")
    # The smallest lag of a stretch counts: least by key before anything is gathered. A document has fewer runs than words.
    found = found.groupBy("row", "start", "length").agg(F.min("period").alias("period"))
    found = found.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "period", "length"))).alias("runs"))
    found = long.join(found, "row", "left").select("doc_id", "text", F.coalesce(F.transform("runs", lambda r: F.struct(r["start"], r["length"], r["period"])), F.array().cast(RUNS)).alias("runs"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                words = split_words(batch.column(1)[i].as_py())
                runs = batch.column(2).slice(i, 1)
                flat = np.stack([c.to_numpy() for c in runs.flatten().flatten()], axis=1).astype(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.array([len(words)], pa.int32()), runs, pa.array([collapse(words, flat)], pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    return short.unionByName(map_batches(found, finish, f"doc_id {of_id}, n_words int, runs {RUNS}, collapsed string"))


#: As a Java pattern in SQL.
SEPARATORS = r"[\\x09-\\x0D\\x20]+"


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id and text, where a tenth of the documents, by checksum of their ids, repeat a stretch from some word to their end; those have single spaces. Rows without doc_id or words stay as they are."""
    rows = docs.select("doc_id", "text", F.crc32(F.col("doc_id").cast("string")).alias("_h"))
    chosen = F.expr("_h % 10 = 0")
    words = F.when(chosen, F.expr(f"filter(split(coalesce(text, ''), '{SEPARATORS}'), w -> w <> '')"))
    rows = rows.withColumn("_words", words).withColumn("_n", F.size("_words").cast("long")).withColumn("_g", F.expr("_h div 10"))
    rows = rows.withColumn("_a", F.expr("cast(_g % greatest(_n, 1) as int)")).withColumn("_p", F.expr("cast(1 + (_n - _a) div (3 + _g % 8) as int)"))
    rows = rows.withColumn("_rest", F.expr("cast(_n - _a as int)"))
    edited = F.expr("array_join(concat(slice(_words, 1, _a), slice(flatten(array_repeat(slice(_words, _a + 1, _p), cast(ceil(_rest / _p) as int))), 1, _rest)), ' ')")
    return rows.select("doc_id", F.when(chosen & (F.col("_n") > 0), edited).otherwise(F.col("text")).alias("text"))


def runs_digest(found: DataFrame) -> DataFrame:
    """periodic_runs as digests: doc_id, n_runs, start, length, period and exponent_milli of the longest run, runs_sha256 and collapsed_sha256."""
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    line = F.concat(F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("best"), F.sha2(F.encode(line, "UTF-8"), 256).alias("runs_sha256"), F.sha2(F.encode("collapsed", "UTF-8"), 256).alias("collapsed_sha256"))
    length, period = (-F.col("best.less")).cast("long"), F.col("best.period").cast("long")
    return rows.select("doc_id", "n_runs", F.col("best.start").cast("long").alias("start"), length.alias("length"), period.alias("period"), F.expr("1000L * -best.less div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
