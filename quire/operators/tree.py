"""Trees as relations: flattening in order, inheritance from the nearest ancestor, numbering of leaves."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_held: ContextVar[list[DataFrame] | None] = ContextVar("held", default=None)


def held(df: DataFrame, level: StorageLevel = StorageLevel.DISK_ONLY) -> DataFrame:
    """df, cached, until the end of a surrounding released()."""
    df = df.persist(level)
    if (frames := _held.get()) is not None:
        frames.append(df)
    return df


def computed(df: DataFrame) -> DataFrame:
    """df, held on disk (compressed, where a checkpoint is not) and computed now, so that jobs which read it side by side don't wait for each other's parts."""
    df = held(df)
    df.count()
    return df


@contextmanager
def released() -> Iterator[None]:
    """What plans cache inside is given back at the end: for jobs that run again and again, such as the batches of a stream."""
    frames: list[DataFrame] = []
    token = _held.set(frames)
    try:
        yield
    finally:
        _held.reset(token)
        for df in frames:
            df.unpersist()


def cut(df: DataFrame) -> DataFrame:
    """df as a checkpoint, computed now: plans that read it several times stay small, and a lost executor costs nothing of it.

    It lies in the folder that spark.checkpoint.dir names; a local session without that setting gets a temporary folder.
    With spark.cleaner.referenceTracking.cleanCheckpoints, Spark deletes it when nothing refers to it any more.
    """
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return df.checkpoint()


def flatten(nodes: DataFrame, roots: DataFrame, inherited: tuple[str, ...] = ()) -> DataFrame:
    """The leaves below roots (tree, node), in order: tree, node, place (positions of children on the way) and inherited columns.

    nodes: tree, node, kids (array of nodes, null for a leaf) and the inherited columns, whose nearest non-null value
    counts. A node that several parents name stands below each of them; one that is its own ancestor is not followed again.

    Pointer doubling: a row is a node with the way down to it from an ancestor, and a round puts the way to that
    ancestor before it. So there are as many joins on (tree, node) as the depth of the deepest tree has binary digits,
    and ways that lead to no root, or in a circle, come to an end.
    """
    kind = nodes.schema["node"].dataType.simpleString()
    own = nodes.select("tree", "node", F.col("kids").isNull().alias("leaf"), *inherited)
    seen = F.array("node").cast(f"array<{kind}>").alias("seen")
    tops = roots.select("tree", "node").join(own, ["tree", "node"]).select("tree", "node", "leaf", F.lit(None).cast(kind).alias("top"), F.array().cast("array<int>").alias("place"), seen, *inherited)
    links = nodes.select("tree", F.col("node").alias("top"), F.posexplode("kids").alias("at", "node"))
    ways = links.join(own, ["tree", "node"]).select("tree", "node", "leaf", "top", F.array("at").alias("place"), seen, *inherited)
    ways = cut(tops.unionByName(ways))
    while not ways.where("top is not null").isEmpty():
        up = ways.where("not leaf").alias("u")
        down = ways.where("top is not null").alias("d")
        met = down.join(up, (F.col("d.tree") == F.col("u.tree")) & (F.col("d.top") == F.col("u.node")) & ~F.arrays_overlap("d.seen", "u.seen"))
        longer = met.select("d.tree", "d.node", "d.leaf", "u.top", F.concat("u.place", "d.place").alias("place"), F.concat("u.seen", "d.seen").alias("seen"), *(F.coalesce(f"d.{c}", f"u.{c}").alias(c) for c in inherited))
        ways = cut(ways.where("top is null").unionByName(longer))
    return ways.where("leaf").select("tree", "node", "place", *inherited)


def numbered(leaves: DataFrame, out: str = "page_index") -> DataFrame:
    """leaves with their zero-based number in each tree, by place."""
    return leaves.withColumn(out, (F.row_number().over(Window.partitionBy("tree").orderBy("place", "node")) - 1).cast("int"))
