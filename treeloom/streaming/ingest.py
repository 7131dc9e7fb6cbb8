"""Streams of XML files to node tables.

A document is parsed whole within one micro-batch and nothing is carried between batches, so there is no state and no
watermark. Each batch is written under its own number: a batch that runs again replaces what it wrote before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from treeloom import schema as S
from treeloom.sources.shred import shred

_FILES = "path string, modificationTime timestamp, length bigint, content binary"


def read_stream(spark: SparkSession, folder: str, flags: int = S.DEFAULT, encoding: str = "auto", files_per_batch: int = 1000) -> DataFrame:
    """A streaming node table of the files that appear in a folder; doc_id is a hash of the path."""
    files = spark.readStream.format("binaryFile").schema(_FILES).option("maxFilesPerTrigger", files_per_batch).load(folder)
    return shred(files.select(F.xxhash64("path").alias("doc_id"), "content"), "doc_id", "content", flags, encoding)


def write_stream(nodes: DataFrame, folder: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Write a streaming node table as Parquet, a folder batch=N a micro-batch."""

    def put(batch: DataFrame, number: int) -> None:
        batch.sortWithinPartitions("doc_id", "pre").write.mode("overwrite").parquet(f"{folder}/batch={number}")

    writer = nodes.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")).start()
