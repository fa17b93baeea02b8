"""Continuous ingestion: files that appear in a folder are ingested batch by batch, each content once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

FILES = "path string, modificationTime timestamp, length bigint, content binary"


def watch(spark: SparkSession, folder: str, checkpoint: str, handle: Callable[[DataFrame, int], None], files_per_batch: int = 100) -> StreamingQuery:
    """Hands over each batch of new files (``path, checksum_sha256, content``), repeats within it left out. ``handle`` must replace
    by key, since a batch is given again after a failure; contents of earlier batches are its own to skip (by checksum)."""
    files = (
        spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", "*.pdf").option("maxFilesPerTrigger", files_per_batch).load(folder)
        .select("path", F.sha2("content", 256).alias("checksum_sha256"), "content")
    )

    def batch(df: DataFrame, number: int) -> None:
        handle(df.dropDuplicates(["checksum_sha256"]), number)

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
