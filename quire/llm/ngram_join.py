"""N-gram Jaccard join by PartEnum signatures.

A document's set holds the hashes of its distinct word shingles. Sets are put into size bands whose ends differ
by the threshold. For a band, two sets similar enough differ in at most k elements. The hash domain is cut into n1
first-level partitions of N2 = 3 second-level ones each, with (K2 + 1) * n1 > k for K2 = 1: some first-level partition
has at most K2 of its second-level ones touched by a difference, so of its subsets of N2 - K2 = 2 second-level partitions at
least one is the same in both sets. All three such subsets of each first-level partition are enumerated; a
subset's content, hashed, is a signature. A pair meets in the band of its smaller set, so a set signs for its own
band and the one below.

No pair is lost, and few are looked at without need:

* Equal sets are one class and signed once.
* Signatures of empty subsets would gather strangers. How many others a set shares with each partner at least follows
  from what k differences can touch; where that is none, and only there, the empty subsets are signed too.
* A set that shares fewer signatures with all others together than with each partner has no partner. Any other keeps
  its rarest signatures only: of what it must share, all but one may be left out, the most frequent first (the
  prefix filter, with signatures as tokens).
* Signatures that the same sets have count as one.
* Each set is compared with one hub of its signatures, then the members of each signature with its hub, then with
  a second one; components are extended in between, and only pairs that share a signature but lie in different components
  are compared further, at last one by one, those that parity sketches do not show to be too far apart.

Every candidate is checked on its whole sets, in integers.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import extended, map_batches, materialize, mix, shingle_hashes, shuffle_width

#: First-level partitions as a multiple of the (k + 1) / (K2 + 1) that the pigeonhole principle needs: the more, the more frequent signatures can be left out.
SPARE = 1.1
#: Second-level partitions of a first-level one, those that a difference may touch, and the subsets of the others.
N2, K2 = 3, 1
SUBSETS = [*combinations(range(N2), N2 - K2)]
#: Elements of sets in a round of numpy work.
ELEMENTS = 1 << 18
#: 64-bit words in a set's parity sketch, which shows that most pairs are too far apart before their sets are brought together.
SKETCH = 16
#: Signatures in a group that one task sorts.
BUCKET = 1_000_000
#: Candidates' ids up to this count are broadcast (24 bytes each) to pick their texts; beyond it a shuffled join does.
BROADCAST_IDS = 1_000_000


def bands(top: int, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Last sizes of the bands up to size top, and the most differences of a pair whose smaller set lies in each."""
    last, first = [], 1
    while first <= top:
        last.append(first * den // num)
        first = last[-1] + 1
    last = np.array(last or [1], dtype=np.int64)
    return last, (den - num) * (last + last * den // num) // (den + num)


def signatures(sets: list[np.ndarray], num: int, den: int, needs_only: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For the sets' own bands, then for those below: how many signatures each set shares with a partner at least, the signatures, and the place in the list of the set of each."""
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    last, most = bands(int(sizes.max(initial=1)), num, den)
    own = np.searchsorted(last, np.maximum(sizes, 1))
    for band in (own, own - 1):
        at = np.maximum(band, 0)
        k = most[at]
        ok = (band >= 0) & (sizes > 0) & (k > 0) & (sizes <= last[at] * den // num)  # k = 0: equal sets only, which are one class already
        n1 = np.where(ok, np.ceil(SPARE * (k + 1) / (K2 + 1)).astype(np.int64), 0)
        start = np.cumsum(n1) - n1
        here = ok[owner]
        element, of = flat[here], owner[here]
        where = N2 * start[of] + (mix(element ^ mix(at[of].astype(np.uint64), 31), 37) % (N2 * n1[of]).astype(np.uint64)).astype(np.int64)
        used = np.zeros(N2 * int(n1.sum()), bool)
        used[where] = True
        used = used.reshape(-1, N2)
        signed = np.repeat(np.arange(len(sets)), n1)
        filled = used.sum(axis=1)
        some, more = (np.bincount(signed[filled >= least], minlength=len(sets)) for least in (1, 2))
        # A first difference in a partition takes two of its signatures that are not empty, a second one the third, if there is one.
        need = 2 * some + more - 2 * np.minimum(k, some) - np.minimum(np.maximum(k - some, 0), more)
        scarce = ok & (need <= 0)
        need = np.where(ok, np.maximum(need, 1), 0)
        if needs_only:
            yield need, element[:0], of[:0]
            continue
        content = np.zeros(used.size, dtype=np.uint64)
        np.add.at(content, where, mix(element, 11))
        content = mix(content, 41).reshape(-1, N2)
        place = (np.arange(len(signed)) - np.repeat(start, n1)).astype(np.uint64)
        base = mix(mix(at[signed].astype(np.uint64), 23) ^ place, 29)
        sig, of = [], []
        for i, subset in enumerate(SUBSETS):
            emit = used[:, subset].any(axis=1) | scarce[signed]
            both = base[emit] + np.uint64(i)
            for j in subset:
                both = mix(both ^ content[emit, j], 43)
            sig.append(both)
            of.append(signed[emit])
        yield need, np.concatenate(sig), np.concatenate(of)


def set_key(s: np.ndarray, seed: int) -> int | None:
    return int(mix(s, seed).sum(dtype=np.uint64).view(np.int64)) if len(s) else None


def rounds(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[list[tuple], list[np.ndarray]]]:
    """The columns before the text of rows (..., text), and the texts' shingles, about ELEMENTS of them at a time."""
    heads, sets, held = [], [], 0
    for batch in batches:
        for *head, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            heads.append(head)
            sets.append(shingle_hashes(text, width))
            held += len(sets[-1])
            if held >= ELEMENTS:
                yield [*zip(*heads, strict=True)], sets
                heads, sets, held = [], [], 0
    if heads:
        yield [*zip(*heads, strict=True)], sets


def features(docs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """doc_id, text_key, n_shingles, a 128-bit key of the set (null for empty sets), and what it needs to share in its own band and the one below."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (ids, keys), sets in rounds(batches, width):
            (own, _, _), (below, _, _) = signatures(sets, num, den, needs_only=True)
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(x, pa.int64()) for x in (ids, keys, [len(s) for s in sets], [set_key(s, 3) for s in sets], [set_key(s, 5) for s in sets])), pa.array(own.astype(np.int32)), pa.array(below.astype(np.int32))],
                ["doc_id", "text_key", "n_shingles", "k1", "k2", "need_0", "need_1"],
            )

    return map_batches(docs, run, "doc_id long, text_key long, n_shingles long, k1 long, k2 long, need_0 int, need_1 int")


def shared_signatures(docs: DataFrame, width: int, buckets: int, num: int, den: int) -> DataFrame:
    """(sig, doc, below): the signatures that two or more of docs (doc, text) have, with the classes that have them, and whether it is for the band below.

    A task first looks for repeats among its own rows: of those one goes on to the signature's bucket and the others
    go, by document, past it. So a bucket gets a signature once from each round however many documents share it.
    """

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (ids,), sets in rounds(batches, width):
            ids = np.array(ids, dtype=np.int64)
            (_, own, own_of), (_, low, low_of) = signatures(sets, num, den)
            sig, doc = np.concatenate([own, low]), ids[np.concatenate([own_of, low_of])]
            flag = np.repeat(np.array([0, 4], np.uint8), [len(own), len(low)])  # 4: for the band below
            order = np.argsort(sig, kind="stable")
            same = np.zeros(len(sig), bool)
            same[order[1:]] = sig[order[1:]] == sig[order[:-1]]
            flag[same] |= 2  # known to be shared, goes past
            first = np.zeros(len(sig), bool)
            first[order[:-1]] = same[order[1:]] & ~same[order[:-1]]
            flag[first] |= 1  # known to be shared, stands for this round
            to = np.where(same, mix(doc.view(np.uint64), 47), mix(sig, 53)) % np.uint64(buckets)
            by = np.argsort(to, kind="stable")
            sig, doc, flag, to = sig[by], doc[by], flag[by], to[by]
            cut = np.flatnonzero(np.diff(to)) + 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(to[np.r_[0, cut]].astype(np.int32) if len(to) else [], pa.int32()), *(pa.array([p.tobytes() for p in np.split(x, cut)] if len(to) else [], pa.binary()) for x in (sig, doc, flag))], ["bucket", "sig", "doc", "flag"]
            )

    def meet(table: pa.Table) -> pa.Table:
        sig, doc, flag = (np.frombuffer(b"".join(table.column(c).to_pylist()), dtype=t) for c, t in (("sig", np.uint64), ("doc", np.int64), ("flag", np.uint8)))
        keep = (flag & 3) > 0
        here = np.flatnonzero((flag & 2) == 0)
        order = here[np.argsort(sig[here], kind="stable")]
        same = sig[order[1:]] == sig[order[:-1]]
        keep[order[1:]] |= same
        keep[order[:-1]] |= same
        return pa.table({"sig": sig[keep].view(np.int64), "doc": doc[keep], "below": (flag[keep] & 4) > 0})

    signed = map_batches(docs, sign, "bucket int, sig binary, doc binary, flag binary")
    return signed.groupBy("bucket").applyInArrow(meet, "sig long, doc long, below boolean")


def rare_signatures(shared: DataFrame, classes: DataFrame) -> DataFrame:
    """(sig, doc, n): of each set that shares enough signatures with others, the rarest ones that its partners cannot all miss."""
    often = shared.groupBy("sig").agg(F.count("*").alias("often"))
    rows = shared.join(often, "sig").join(classes.select("doc", "n", "need_0", "need_1"), "doc").withColumn("need", F.when(F.col("below"), F.col("need_1")).otherwise(F.col("need_0")))
    by = Window.partitionBy("doc", "below")
    rows = rows.withColumn("place", F.row_number().over(by.orderBy("often", "sig"))).withColumn("held", F.count("*").over(by))
    return rows.where("place <= held - need + 1").select("sig", "doc", "n")


def distinct_groups(members: DataFrame) -> DataFrame:
    """members without signatures that only one set has left, and with one signature of those that the same sets have."""
    groups = members.groupBy("sig").agg(F.count("*").alias("held"), F.expr("bit_xor(xxhash64(doc))").alias("x"), F.expr("sum(pmod(xxhash64(doc, 1), 1099511627776))").alias("y"))
    return members.join(groups.where("held > 1").groupBy("held", "x", "y").agg(F.min("sig").alias("sig")).select("sig"), "sig")


def still_open(rows: DataFrame, parts: DataFrame) -> DataFrame:
    """rows (sig, doc, n, component) with the components as they are now, of signatures whose sets lie in more than one."""
    rows = rows.drop("component").join(parts.selectExpr("node doc", "component"), "doc", "left").withColumn("component", F.coalesce("component", "doc"))
    mixed = rows.groupBy("sig").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("sig")
    return rows.join(mixed, "sig").select("sig", "doc", "n", "component")


def sketch(s: np.ndarray) -> list[int]:
    """64 * SKETCH parities: bit i is set if an odd number of the set's elements falls on it. Sets that differ in d elements differ in d bits at most."""
    bits = np.bincount((mix(s, 59) % np.uint64(64 * SKETCH)).astype(np.int64), minlength=64 * SKETCH) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64).tolist()


def shingle_sets(docs: DataFrame, width: int) -> DataFrame:
    """doc, shingles and sketch of docs (doc, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (ids,), sets in rounds(batches, width):
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array([sketch(s) for s in sets], pa.list_(pa.int64()))], ["doc", "shingles", "sketch"])

    return map_batches(docs, run, "doc long, shingles binary, sketch array<long>")


def verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Those of pairs (a, b) with den * intersection >= num * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                both = int((y[np.minimum(at, len(y) - 1)] == x).sum()) if len(x) else 0
                keep.append(both > 0 and den * both >= num * (len(x) + len(y) - both))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["a", "b"])

    one, two = sets.selectExpr("doc a", "shingles x"), sets.selectExpr("doc b", "shingles y")
    return map_batches(pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y"), run, "a long, b long")


def ngram_jaccard_join(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """Each row's doc_id, n_shingles and component_id: the smallest doc_id reachable by links den * |x & y| >= num * |x | y|; and text_key, a hash of its text.

    docs needs doc_id and text; other columns are left aside. Null and empty texts, and texts without words, have
    n_shingles 0 and link with nothing. Rows with the same set are in one component, and repeated rows come
    back as often as given. A row without doc_id links with nothing and comes back with a null component_id.
    An empty table gives an empty result.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("text_key"), F.col("text").cast("string").alias("text"))
    feats = materialize(features(docs, width, num, den))
    total, volume, ids = feats.agg(F.count("doc_id"), F.coalesce(F.sum("n_shingles"), F.lit(0)), F.countDistinct("doc_id")).first()
    # A class of equal sets gets a number of its own, doc, when it is written; first is its first row.
    grouped = feats.where("n_shingles > 0 and doc_id is not null").groupBy("k1", "k2", "n_shingles")
    classes = grouped.agg(F.min(F.struct("doc_id", "text_key")).alias("first"), F.first("need_0").alias("need_0"), F.first("need_1").alias("need_1"))
    classes = materialize(classes.selectExpr("monotonically_increasing_id() doc", "k1", "k2", "n_shingles n", "first.doc_id", "first.text_key", "need_0", "need_1"))
    buckets = max(volume // BUCKET, 2 * shuffle_width(spark))
    once = (lambda df, *by: df) if ids == total else (lambda df, *by: df.dropDuplicates([*by]))  # a class is read once unless ids repeat
    shared = materialize(once(shared_signatures(pick(docs, classes, total), width, buckets, num, den), "sig", "doc", "below"))
    members = materialize(distinct_groups(rare_signatures(shared, classes)))
    candidates = classes.join(members.select("doc").distinct(), "doc", "left_semi")
    sets = materialize(once(shingle_sets(pick(docs, candidates, total), width), "doc"))

    fits = f"least(n, m) * {den} >= greatest(n, m) * {num}"
    differ = f"{' + '.join(f'bit_count(sketch[{i}] ^ drawn[{i}])' for i in range(SKETCH))} <= ({den - num} * (n + m)) div {den + num}"
    rows = members.withColumn("component", F.col("doc"))
    tried = parts = None
    for step in ("nearest", "hub", "hub", "rest"):
        if parts is not None:
            rows = materialize(still_open(rows, parts))
        hubs = rows.groupBy("sig").agg(F.expr("min(struct(xxhash64(doc) p, doc other, n m, component oc))").alias("h")).select("sig", "h.*")
        if step == "rest":  # what the hubs left, one by one
            drawn = rows.join(sets.select("doc", "sketch"), "doc")
            pairs = drawn.join(drawn.selectExpr("sig", "doc other", "n m", "component oc", "sketch drawn"), "sig").where("doc < other and component <> oc").where(fits).where(differ)
        else:
            met = rows.join(hubs, "sig").where("doc <> other")
            pairs = met.where("component <> oc").where(fits)
            if step == "nearest":  # each set with one hub only: most of a group of copies comes together here
                pairs = pairs.groupBy("doc").agg(F.expr("min(struct(p, other))").alias("h")).selectExpr("doc", "h.other")
            else:  # done with the hubs
                rows = met.select("sig", "doc", "n", "component")
        pairs = pairs.selectExpr("least(doc, other) a", "greatest(doc, other) b").distinct()
        pairs = materialize(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"))
        found = materialize(verified(pairs, sets, num, den))
        tried, parts = pairs if tried is None else tried.union(pairs), extended(parts, found)
    named = classes.join(parts.withColumnRenamed("node", "doc"), "doc", "left").withColumn("component", F.coalesce("component", "doc"))
    lowest = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = materialize(named.join(lowest, "component").select("k1", "k2", "n", "component_id"))
    known = feats.doc_id.isNotNull() & (feats.k1 == named.k1) & (feats.k2 == named.k2) & (feats.n_shingles == named.n)
    return feats.join(named, known, "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), "text_key")


def pick(docs: DataFrame, classes: DataFrame, count: int) -> DataFrame:
    """doc and text of the rows of docs that stand for one of classes: at most count ids, broadcast up to BROADCAST_IDS, and shuffled with the texts beyond."""
    classes = classes.select("doc", "doc_id", "text_key")
    return docs.join(F.broadcast(classes) if count <= BROADCAST_IDS else classes, ["doc_id", "text_key"]).select("doc", "text")


def one_of_each(docs: DataFrame, joined: DataFrame) -> DataFrame:
    """docs without near-duplicates: of each component of joined (from ngram_jaccard_join) the row with the smallest doc_id.

    Rows that link with nothing stay, among them all without words or without doc_id. Of rows that repeat an id and
    a text with words, one stays. All columns of docs come back.
    """
    names, own = docs.columns, "kept_"
    while any(c.lower().startswith(own) for c in names):
        own += "_"
    words = "max(n_shingles) > 0 and doc_id is not null"
    kept = joined.where("doc_id is null or doc_id = component_id").groupBy("doc_id", "text_key").agg(F.expr(f"case when {words} then count(*) else 1 end").alias("copies"))
    kept = materialize(kept.select(*(F.col(c).alias(own + c) for c in kept.columns)))
    rows = docs.join(F.broadcast(kept) if kept.count() <= BROADCAST_IDS else kept, docs["doc_id"].cast("long").eqNullSafe(F.col(own + "doc_id")) & (F.xxhash64(docs["text"].cast("string")) == F.col(own + "text_key")))
    again = rows.where(F.col(own + "copies") > 1).dropDuplicates([own + "doc_id", own + "text_key"])
    return rows.where(F.col(own + "copies") == 1).select(*names).unionByName(again.select(*names))
