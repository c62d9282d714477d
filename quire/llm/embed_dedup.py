"""Embedding near-duplicates: iterative quantisation, multi-index Hamming tables, exact rerank.

A rotation of the principal axes is learned on a bounded sample so that the signs of the rotated coordinates make
balanced binary codes. Coordinates are not centred, as links are cosines around zero: the angle of a link flips few
bits wherever the vectors lie. A code is cut into chunks, one table each, the more the smaller its label is; vectors of
a label meet in a table where their chunks differ in at most one bit, or two if chunks are wider than 8 bits. Candidates
within a Hamming radius are reranked by the cosine of the original vectors in double precision. Labels whose vectors
crowd into few chunks, as around a common mean, would make candidates of most pairs: those are compared whole, in
blocks of vectors, which count their links where they are found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, map_batches, materialize

#: Vectors, by hash of the id, that the rotation is fitted on, and rounds of fitting.
MAX_SAMPLE, ROUNDS = 4096, 30
CODE_BITS = 64
#: Greatest Hamming distance of a candidate: a cosine of 0.93 flips 7.7 of 64 bits on average, 18 is four deviations more.
RADIUS = 18
#: A label is compared in blocks if its tables' chunks hold CROWDED times as many pairs as it has, or more; values of one block.
CROWDED, BLOCK_VALUES = 0.5, 1 << 19


def clean(vector: list | None) -> np.ndarray | None:
    """The vector in double precision at unit length; None if it is null, empty, zero, or has a null or non-finite component."""
    if not vector or any(x is None for x in vector):
        return None
    v = np.array(vector, np.float64)
    if not np.isfinite(v).all():
        return None
    top = np.abs(v).max()
    if top == 0:
        return None
    v = v / top
    return v / np.sqrt(v @ v)


def fit_itq(sample: np.ndarray, bits: int = CODE_BITS, rounds: int = ROUNDS, seed: int = 3) -> np.ndarray:
    """Projection: code bit i of x is (x @ projection)[i] > 0."""
    rng = np.random.default_rng(seed)
    dim = sample.shape[1]
    if len(sample) < 2:
        return rng.normal(size=(dim, bits))
    _, axes = np.linalg.eigh(sample.T @ sample)
    blocks = []
    while sum(b.shape[1] for b in blocks) < bits:  # with fewer dimensions than bits, further rotations give the rest
        width = min(dim, bits - sum(b.shape[1] for b in blocks))
        pca = axes[:, ::-1][:, :width]
        v = sample @ pca
        r = np.linalg.qr(rng.normal(size=(width, width)))[0]
        for _ in range(rounds):
            u, _, w = np.linalg.svd(np.where(v @ r >= 0, 1.0, -1.0).T @ v)
            r = (u @ w).T
        blocks.append(pca @ r)
    return np.concatenate(blocks, axis=1)[:, :bits]


def encode(vectors: np.ndarray, projection: np.ndarray) -> np.ndarray:
    """64-bit codes as signed integers."""
    on = (vectors @ projection > 0).astype(np.uint8)
    on = np.pad(on, ((0, 0), (0, CODE_BITS - on.shape[1])))
    return np.packbits(on, axis=1).view(">u8").astype(np.uint64).view(np.int64).ravel()


def chunks_for(rows: int) -> list[tuple[int, int]]:
    """(shift, bits) of the tables' chunks: about log2 of the rows in bits, 8 to 16."""
    bits = int(min(16, max(8, np.ceil(np.log2(max(rows, 2))))))
    count = -(-CODE_BITS // bits)
    edges = [CODE_BITS * i // count for i in range(count + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def tables(rows: F.Column) -> F.Column:
    """Array of (t, bits, chunk, probes) of a code, one for each table of a label with so many rows."""
    chosen = None
    for bits in range(16, 7, -1):
        cut = chunks_for(1 << bits)
        part = F.array(*(F.struct(F.lit(t).alias("t"), F.lit(b).alias("bits"), F.expr(f"shiftrightunsigned(code, {s}) & {(1 << b) - 1}").alias("chunk"), F.lit(1 if b <= 8 else 2).alias("probes")) for t, (s, b) in enumerate(cut)))
        chosen = part if chosen is None else F.when(rows <= 1 << bits, part).otherwise(chosen)
    return chosen


def block_links(x: np.ndarray, copies: np.ndarray, y: np.ndarray | None, other_copies: np.ndarray | None, threshold: float) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Of two blocks of unit vectors, or of one with itself (y is None): how many copies each vector of the one and of the other links with, and links that connect what is linked, as places in both blocks together. Links are fewer than vectors."""
    alone = y is None
    y, weight = (x, copies) if alone else (y, other_copies)
    shift = 0 if alone else len(x)
    mine, theirs = np.zeros(len(x), np.int64), np.zeros(len(y), np.int64)
    part = np.arange(shift + len(y))
    links = []
    for start in range(0, len(x), 256):
        near = x[start : start + 256] @ y.T >= threshold
        if alone:
            near[np.arange(len(near)), np.arange(start, start + len(near))] = False
        mine[start : start + 256] = near @ weight
        if not alone:
            theirs += copies[start : start + 256] @ near
        for row in np.flatnonzero(near.any(axis=1)):
            i, to = start + row, shift + np.flatnonzero(near[row])
            apart, first = np.unique(part[to], return_index=True)
            for at in to[first[apart != part[i]]]:
                links.append((i, int(at)))
                part[part == part[at]] = part[i]
    return mine, theirs, links


def compare_in_blocks(vectors: DataFrame, threshold: float) -> DataFrame:
    """a, b and linked of vectors (num, embedding, copies, label, dim, rows), all pairs of a label and dim: rows with b are links that connect what is linked, rows without say how many copies a links with in two blocks.

    A vector goes to one of rows / (BLOCK_VALUES / dim) blocks, and with it to one task for each other block.
    """
    blocks = F.ceil(F.col("rows") / F.greatest(F.lit(256), F.lit(BLOCK_VALUES) / F.col("dim"))).cast("int")
    dealt = vectors.withColumn("n", blocks).withColumn("mine", F.expr("cast(pmod(xxhash64(num, 11), n) as int)"))
    dealt = dealt.withColumn("other", F.explode(F.expr("sequence(0, n - 1)"))).selectExpr("num", "embedding", "copies", "label", "dim", "mine", "least(mine, other) low", "greatest(mine, other) high")

    def compare(table: pa.Table) -> pa.Table:
        own = np.array(table["mine"].to_pylist()) == table["low"][0].as_py()
        num, copies = np.array(table["num"].to_pylist(), np.int64), np.array(table["copies"].to_pylist(), np.int64)
        x = np.stack([clean(v) for v in table["embedding"].to_pylist()])
        alone = table["low"][0].as_py() == table["high"][0].as_py()
        mine, theirs, links = block_links(x[own], copies[own], None if alone else x[~own], None if alone else copies[~own], threshold)
        ids = num[own] if alone else np.concatenate([num[own], num[~own]])
        counts = mine if alone else np.concatenate([mine, theirs])
        some = counts > 0
        a, b = (pa.array([int(ids[link[i]]) for link in links], pa.int64()) for i in (0, 1))
        return pa.table({"a": pa.concat_arrays([pa.array(ids[some]), a]), "b": pa.concat_arrays([pa.nulls(int(some.sum()), pa.int64()), b]), "linked": pa.concat_arrays([pa.array(counts[some]), pa.nulls(len(links), pa.int64())])})

    return dealt.groupBy("label", "dim", "low", "high").applyInArrow(compare, "a long, b long, linked long")


def embedding_dedup(vectors: DataFrame, threshold: float = 0.93) -> DataFrame:
    """vec_id, n_links, component_id and kept for each row of vectors (vec_id, embedding, label).

    Vectors are compared only where labels are equal and not null, and dimensions agree. Those that are null, empty,
    zero, or hold a null or non-finite component link with nothing. Rows with the same label and components are
    one class, each linked with the others, and searched once. Repeated rows come back as often as given and count
    as links of each other; rows that share a vec_id but not label or components are vectors of their own. A row without vec_id links with nothing and has a null component. Other columns are
    left aside; an empty table gives an empty result.
    """
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("string").alias("label"))
    usable = F.expr("vec_id is not null and label is not null and size(embedding) > 0 and not exists(embedding, x -> x is null or isnan(x) or abs(x) = double('infinity')) and exists(embedding, x -> x <> 0)")
    rows = materialize(vectors.withColumn("usable", F.coalesce(usable, F.lit(False))).withColumn("key", F.expr("case when usable then sha2(to_json(struct(label, embedding)), 256) end")))
    plain = rows.where("usable").select("vec_id", "label", "key", F.size("embedding").alias("dim"), "embedding")
    groups = plain.groupBy("key").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("embedding").alias("embedding"), F.first("dim").alias("dim"))
    groups = materialize(groups.withColumn("num", F.monotonically_increasing_id()))  # classes have numbers, as ids may repeat
    total = groups.count()
    share = int(min(1.0, MAX_SAMPLE / max(total, 1)) * 1_000_000) + 1
    models: dict[int, np.ndarray] = {}
    for dim in [r.dim for r in groups.select("dim").distinct().collect()]:
        sample = groups.where(F.expr(f"dim = {dim} and pmod(xxhash64(key, 5), 1000000) < {share}")).select("key", "embedding").collect()
        models[dim] = fit_itq(np.stack([clean(r.embedding) for r in sorted(sample, key=lambda r: r.key)]) if sample else np.zeros((0, dim)))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nums, out, keep = batch.column(0), np.zeros(batch.num_rows, np.int64), batch.column(1).to_pylist()
            dims = np.array([len(v) for v in keep])
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                out[at] = encode(np.stack([clean(keep[i]) for i in at]), models[int(dim)])
            yield pa.RecordBatch.from_arrays([nums, batch.column(2), batch.column(3), pa.array(out)], ["num", "label", "dim", "code"])

    coded = materialize(map_batches(groups.select("num", "embedding", "label", "dim"), code, "num long, label string, dim int, code long"))
    sizes = coded.groupBy("label", "dim").agg(F.count("*").alias("rows"))
    parts = coded.join(sizes, ["label", "dim"]).select("num", "label", "dim", "rows", "code", F.inline(tables(F.col("rows"))))
    met = parts.groupBy("label", "dim", "rows", "t", "chunk").agg(F.count("*").alias("n")).groupBy("label", "dim", "rows").agg(F.sum(F.col("n").cast("double") * F.col("n")).alias("pairs"))
    crowded = materialize(met.where(F.col("pairs") >= CROWDED * F.col("rows").cast("double") * F.col("rows")).select("label", "dim", "rows"))
    whole = compare_in_blocks(groups.join(crowded, ["label", "dim"]).select("num", "embedding", "copies", "label", "dim", "rows"), threshold)
    parts = parts.join(crowded.select("label", "dim"), ["label", "dim"], "left_anti")
    # Bits are flipped on one side for a distance of one, on both for two, the lower bit first: a pair meets once a table.
    flips = "concat(array(struct(-1 as {0}, chunk as met)), transform(sequence(0, bits - 1), i -> struct(i as {0}, chunk ^ shiftleft(1L, i) as met)))"
    index = parts.select("num", "code", "label", "dim", "t", F.inline(F.expr(f"if(probes = 2, {flips.format('mine')}, array(struct(-1 as mine, chunk as met)))")))
    probe = parts.select(F.col("num").alias("other"), F.col("code").alias("theirs"), "label", "dim", "t", F.inline(F.expr(flips.format("flipped"))))
    near = index.join(probe, ["label", "dim", "t", "met"]).where(f"num < other and (mine < flipped or mine = -1 and flipped = -1) and bit_count(code ^ theirs) <= {RADIUS}")
    pairs = near.select(F.col("num").alias("a"), F.col("other").alias("b")).distinct()
    one, two = groups.selectExpr("num a", "embedding x"), groups.selectExpr("num b", "embedding y")

    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            dims, keep = np.array([len(v) for v in x]), np.zeros(batch.num_rows, bool)
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                keep[at] = (np.stack([clean(x[i]) for i in at]) * np.stack([clean(y[i]) for i in at])).sum(axis=1) >= threshold
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep)), batch.column(1).filter(pa.array(keep))], ["a", "b"])

    links = map_batches(pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y"), rerank, "a long, b long")
    links = materialize(links.select("a", "b", F.lit(None).cast("long").alias("linked")).union(whole))
    found = links.where("linked is null").select("a", "b")
    single = found.join(groups.join(crowded, ["label", "dim"], "left_anti").selectExpr("num b", "copies copies_b"), "b").join(groups.selectExpr("num a", "copies copies_a"), "a")
    degree = single.selectExpr("a num", "copies_b linked").union(single.selectExpr("b num", "copies_a linked")).union(links.where("linked is not null").selectExpr("a num", "linked"))
    degree = degree.groupBy("num").agg(F.sum("linked").alias("linked"))
    parts = materialize(components(found)).withColumnsRenamed({"node": "num", "component": "of"})
    least = parts.join(groups.select("num", "id"), "num").groupBy("of").agg(F.min("id").alias("component"))
    named = groups.select("key", "num", "id", "copies").join(degree, "num", "left").join(parts.join(least, "of"), "num", "left")
    named = materialize(named.select("key", (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("component")))
    return rows.select("vec_id", "key").join(named, "key", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"), F.coalesce(F.expr("vec_id = coalesce(component, vec_id)"), F.lit(False)).alias("kept")
    )
