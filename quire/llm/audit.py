"""Filter interaction audit: what each of several filters removes in every order in which they can be applied.

Exact duplicates are found by a range sort on text fingerprint, full text and doc_id, in which each row is compared with
its predecessor; what a range needs of the ranges before it is a few bytes. Every document then has a mask of the filters
that it fails. Masks are counted by part, and the counts, which add up over any split of the data, give all orders.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import permutations
from math import factorial

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_batches, materialize

_SEEN = pa.schema([("range", pa.int32()), ("leads", pa.bool_()), ("doc_id", pa.int64()), ("part", pa.string()), ("mask", pa.int32()), ("repeats", pa.bool_()), ("first", pa.binary()), ("last", pa.binary()), ("last_id", pa.int64())])
SEEN = "range int, leads boolean, doc_id long, part string, mask int, repeats boolean, first binary, last binary, last_id long"


def words_of(text: Column) -> Column:
    r"""The words `[^\x20\x09-\x0D]+` of a text."""
    return F.filter(F.split(text, r"[\x09-\x0D\x20]+"), lambda w: w != "")


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one range, sorted by fingerprint, text and doc_id: whether an equal text with a smaller doc_id stands before each. At last one row that says where the range begins and ends."""
    here = TaskContext.get().partitionId()
    first = print_before = text_before = first_id = None
    for batch in batches:
        if not batch.num_rows:
            continue
        prints, texts, ids = batch.column("print"), batch.column("text"), batch.column("doc_id").to_pylist()
        if first is None:
            first = prints[0].as_py()
        same = [prints[0].as_py() == print_before and texts[0].as_py() == text_before]
        same += pc.and_(pc.equal(prints[1:], prints[:-1]), pc.equal(texts[1:], texts[:-1])).to_pylist()
        repeats = []
        for equal, id_ in zip(same, ids, strict=True):
            if not equal:
                first_id = id_
            repeats.append(id_ is not None and first_id is not None and first_id < id_)
        yield pa.RecordBatch.from_arrays(
            [pa.array([here] * len(ids), pa.int32()), pc.equal(prints, pa.scalar(first, pa.binary())), batch.column("doc_id"), batch.column("part"), batch.column("mask"), pa.array(repeats, pa.bool_()), *(pa.nulls(len(ids), t) for t in (pa.binary(), pa.binary(), pa.int64()))], schema=_SEEN
        )
        print_before, text_before = prints[-1].as_py(), texts[-1].as_py()
    if first is not None:
        yield pa.RecordBatch.from_pylist([{"range": here, "first": first, "last": print_before, "last_id": first_id}], _SEEN)


def failure_masks(docs: DataFrame, conditions: dict[str, Column], part: Column, duplicate: str | None = None) -> DataFrame:
    """doc_id, part and mask of each row of docs (doc_id, text): bit i is set if it fails the i-th of conditions, which are named, are expressions of text and are true for rows that fail.

    duplicate names one more condition, the last bit: the text, null counting as empty, equals that of a row with a
    smaller doc_id. A row without doc_id is no duplicate and makes none, and rows that repeat an id and a text are not duplicates of each
    other. A condition that is null is not failed.
    """
    bit = lambda i, fails: F.when(F.coalesce(fails, F.lit(False)), 1 << i).otherwise(0)
    mask = sum((bit(i, fails) for i, fails in enumerate(conditions.values())), F.lit(0)).cast("int")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), part.alias("part"))
    if duplicate is None:
        return docs.select("doc_id", "part", mask.alias("mask"))
    # The ranges' bounds are sampled for the driver, so they are made of fingerprint (sha-256) and doc_id, not of texts.
    rows = docs.select("doc_id", "part", "text", F.unhex(F.sha2(F.encode("text", "UTF-8"), 256)).alias("print"))
    id_last = F.col("doc_id").asc_nulls_last()
    rows = rows.repartitionByRange("print", id_last).sortWithinPartitions("print", "text", id_last).select("doc_id", "part", mask.alias("mask"), "print", "text")
    seen = materialize(map_batches(rows, _compare, SEEN))
    ends = seen.where("first is not null").select("range", "first", "last", "last_id")  # a row a range
    begun = ends.groupBy(F.col("last").alias("first")).agg(F.min("range").alias("from"), F.min_by("last_id", "range").alias("before"))
    before = ends.select("range", "first").join(begun, "first").where("`from` < range").select("range", "before")
    rows = seen.where("first is null").join(F.broadcast(before), "range", "left")
    repeats = F.col("repeats") | F.coalesce(F.col("leads") & (F.col("before") < F.col("doc_id")), F.lit(False))
    return rows.select("doc_id", "part", (F.col("mask") + bit(len(conditions), repeats)).alias("mask"))


def counters(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, good, toxic and n (documents) of failure_masks: good and toxic say if some row of labels (doc_id, quality, toxic) has a 1 for the document. Counts of any split of the documents add up."""
    known = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    same = masks.groupBy("doc_id", "part", "mask").agg(F.count("*").alias("n"))  # an id that many rows share is one row here
    no = F.lit(False)
    return same.join(known, "doc_id", "left").groupBy("part", "mask", F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic")).agg(F.sum("n").alias("n"))


def report(counts: DataFrame, names: str) -> DataFrame:
    """For each part, each order of the filters (letters of names, by bit) and each step: kept, removed, redundant, unique_fails, good_lost, toxic_lost and shapley."""
    steps = [
        {"o": "".join(order), "s": i + 1, "b": 1 << names.index(name), "e": sum(1 << names.index(x) for x in order[:i])}
        for order in permutations(names) for i, name in enumerate(order)
    ]
    rows = counts.select("*", F.inline(F.from_json(F.lit(json.dumps(steps)), "array<struct<o: string, s: int, b: int, e: int>>")))
    total = lambda when, value="n": F.sum(F.when(F.expr(when), F.expr(value)).otherwise(0)).cast("long")
    fails, here = "mask & b <> 0", "mask & b <> 0 and mask & e = 0"
    return rows.groupBy("part", F.col("o").alias("filter_order"), F.col("s").alias("step")).agg(
        total("mask & (b | e) = 0").alias("kept"), total(here).alias("removed"), total(f"{fails} and mask & e <> 0").alias("redundant"), total("mask = b").alias("unique_fails"),
        total(f"{here} and good").alias("good_lost"), total(f"{here} and toxic").alias("toxic_lost"),
        # Of the filters that a document fails, each comes first in as many orders.
        total(fails, f"n * ({factorial(len(names))} div greatest(bit_count(mask), 1))").alias("shapley"),
    )


def filter_audit(docs: DataFrame, labels: DataFrame, conditions: dict[str, Column], part: str = "lang", duplicate: str | None = None) -> DataFrame:
    """The report over docs (doc_id, text, part), one row for each value of part (null: empty), order and step, zeros included.

    Names of filters are single letters; see failure_masks for rows that are null, repeated or without doc_id. Texts
    count whole, however long. Labels that repeat a doc_id count once, those of other documents not at all, and a row without doc_id has none. Other columns may
    have any name. An empty table has no parts and gives an empty result.
    """
    names = "".join([*conditions, *([duplicate] if duplicate else [])])
    return report(counters(failure_masks(docs, conditions, F.coalesce(F.col(part).cast("string"), F.lit("")), duplicate), labels), names)


def quality_conditions(text: Column) -> dict[str, Column]:
    """Documents that fail: A short ones, B those of repeated words, C those in capitals, D those with signs of markup."""
    words = words_of(text)
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * (F.length(text) - F.length(F.regexp_replace(text, "[A-Z]", ""))) > 3 * F.length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }
