"""What several corpus operators share: shared-folder tables, word shingles as numpy hashes, connected components."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Odd multipliers, one for each place of a word in a shingle.
_PLACE = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], dtype=np.uint64)
_word_hash = xxhash.xxh3_64_intdigest


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in a local session without it a temporary folder. On a cluster it must be set."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """df, written once to the shared folder and read again: the lineage is cut there, and a lost executor costs nothing of it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quire-{uuid.uuid4().hex}"
    df.write.parquet(path)
    give_back()
    return spark.read.schema(df.schema).parquet(path)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def give_back() -> None:
    """Freed memory goes back to the machine: the JVM beside this process may need it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)


#: Bounds of a batch that goes to a Python worker.
BATCH_ROWS, BATCH_BYTES = 1024, 4 << 20


def size_of(setting: str) -> int:
    """A setting of rows or bytes as a number: `64MB` and `67108864b` too."""
    number = setting.rstrip("bBkKmMgG")
    return int(number) << {"k": 10, "m": 20, "g": 30}.get(setting[len(number) : len(number) + 1].lower(), 0)


def map_batches(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """df through function in the Python workers, in batches of at most BATCH_ROWS rows and BATCH_BYTES bytes (a longer row alone).

    A batch is held three times (by the JVM, as Arrow and as Python objects), so its size bounds a task's memory. The
    workers give freed memory back at a task's end, as they live on beside the JVM's next stages.
    """
    conf = df.sparkSession.conf
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        if not 0 < size_of(conf.get(f"spark.sql.execution.arrow.{key}")) <= most:
            conf.set(f"spark.sql.execution.arrow.{key}", most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from function(batches)
        give_back()

    return df.mapInArrow(run, schema)


# --- words and shingles ---------------------------------------------------------------------------------


def words_of(text: str | None) -> list[bytes]:
    r"""The words `[^\x20\x09-\x0D]+` of a text with A-Z lower-cased, as UTF-8. bytes.lower and bytes.split know ASCII only."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser; different seeds give independent hashes."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def word_hashes(text: str | None) -> np.ndarray:
    return np.fromiter(map(_word_hash, words_of(text)), dtype=np.uint64)


def shingle_hashes(text: str | None, width: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles; with fewer words than width, of the whole sequence as one; without words, none."""
    h = word_hashes(text)
    if len(h) == 0:
        return h
    with np.errstate(over="ignore"):
        if len(h) < width:
            return mix(np.array([(h * _PLACE[: len(h)]).sum(dtype=np.uint64)], dtype=np.uint64), len(h))
        n = len(h) - width + 1
        total = np.zeros(n, dtype=np.uint64)
        for i in range(width):
            total += h[i : i + n] * _PLACE[i % len(_PLACE)] + np.uint64(i // len(_PLACE))
    return np.unique(mix(total))


# --- components -----------------------------------------------------------------------------------------


def _star(pairs: DataFrame) -> DataFrame:
    """A large-star step and a small-star step over pairs (a, b), a > b."""
    both = pairs.union(pairs.selectExpr("b a", "a b"))
    lowest = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    large = pairs.selectExpr("b u", "a v").join(lowest.withColumnRenamed("a", "u"), "u").selectExpr("v a", "m b")  # v > u
    pairs = large.union(lowest.where("m < a").selectExpr("a", "m b")).where("a > b").distinct()
    lowest = pairs.groupBy("a").agg(F.min("b").alias("m"))
    small = pairs.join(lowest, "a").where("b > m").selectExpr("b a", "m b")
    return small.union(lowest.selectExpr("a", "m b")).distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of edges (a, b) as (node, component): alternating large-star and small-star steps.

    component is the smallest node reachable. Nodes without an edge do not appear. Each step is a min by key and
    a join, both distributed; a hub's row count is pre-aggregated by the min and split by the skew join.
    """
    pairs, state = edges.where("a is not null and b is not null and a <> b").selectExpr("greatest(a, b) a", "least(a, b) b").distinct(), None
    for _ in range(max_rounds):
        pairs = materialize(_star(pairs))
        now = pairs.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))"), F.expr("bit_xor(xxhash64(b, a, 7))")).first()
        if now == state or not now[0]:
            break
        state = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    nodes = pairs.selectExpr("a node", "b component")
    return nodes.union(pairs.selectExpr("b node", "b component").distinct())


def extended(parts: DataFrame | None, edges: DataFrame) -> DataFrame:
    """(node, component) of the graph that parts (from here, or None) describes, with edges (a, b) added: only links between components are followed."""
    if parts is None:
        return materialize(components(edges))
    of = [parts.selectExpr(f"node {x}", f"component c{x}") for x in "ab"]
    between = edges.join(of[0], "a", "left").join(of[1], "b", "left").selectExpr("coalesce(ca, a) a", "coalesce(cb, b) b").where("a <> b")
    more = materialize(components(between))
    moved = parts.join(more.selectExpr("node component", "component now"), "component", "left").select("node", F.coalesce("now", "component").alias("component"))
    return materialize(moved.union(more.join(parts, "node", "left_anti").select("node", "component")))
