"""Streaming ingest: files as they arrive, through the same plans. Nothing is kept from one batch to the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.tree import released
from ..plans.text import layout_text
from ..sources.files import sized

_FILES = "path string, modificationTime timestamp, length long, content binary"


def file_stream(spark: SparkSession, path: str, pattern: str = "*.pdf", files_per_batch: int = 1000) -> DataFrame:
    stream = spark.readStream.format("binaryFile").schema(_FILES).option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_batch)
    return sized(stream.load(path))


def ingest_text(spark: SparkSession, path: str, out: str, checkpoint: str, plan: Callable[[DataFrame], DataFrame] = layout_text) -> StreamingQuery:
    """Reads what has arrived below path and writes each batch's pages to its own folder below out, so that a batch run again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        with released():
            plan(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return file_stream(spark, path).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
