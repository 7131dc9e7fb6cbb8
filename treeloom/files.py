"""Rows that Python makes, written by Python into the files of a table in buckets by doc_id."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq

#: Rows, and bytes in memory, of a row group.
GROUP_ROWS, GROUP_BYTES = 1 << 18, 1 << 26


def make(folder: str) -> None:
    fs, path = pyarrow.fs.FileSystem.from_uri(folder)
    fs.create_dir(path)


def buckets(doc_id: np.ndarray, n: int) -> np.ndarray:
    """pmod(hash(doc_id), n) as Spark has it: Murmur3 of the lower and the upper half, seed 42."""
    bits = doc_id.astype(np.int64).view(np.uint64)
    turned = lambda x, by: (x << np.uint32(by)) | (x >> np.uint32(32 - by))
    h = np.full(len(bits), 42, np.uint32)
    for half in ((bits & np.uint64(0xFFFFFFFF)).astype(np.uint32), (bits >> np.uint64(32)).astype(np.uint32)):
        h = turned(h ^ (turned(half * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593)), 13) * np.uint32(5) + np.uint32(0xE6546B64)
    h ^= np.uint32(8)
    for by, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        h = (h ^ (h >> np.uint32(by))) * np.uint32(factor)
    return (h ^ (h >> np.uint32(16))).view(np.int32).astype(np.int64) % n


def write(source: Iterator[pa.RecordBatch], folder: str, n: int) -> Iterator[pa.RecordBatch]:
    """Write a task's rows to a file for each bucket that they fall in, and give their number.

    A file gets its name when it is whole, the same one whenever the task runs again; Spark doesn't see those that begin
    with an underscore.
    """
    from pyspark import TaskContext

    fs, path = pyarrow.fs.FileSystem.from_uri(folder)
    part, mark = TaskContext.get().partitionId(), uuid.uuid4().hex
    held: list[pa.RecordBatch] = []
    writers: dict[int, pq.ParquetWriter] = {}
    rows = n_held = size = 0
    temporary = lambda bucket: f"{path}/_{mark}-{bucket}"

    def flush() -> None:
        table = pa.Table.from_batches(held).combine_chunks()
        of = buckets(table.column("doc_id").to_numpy(), n)
        for bucket in [int(of[0])] if (of == of[0]).all() else np.unique(of).tolist():
            if bucket not in writers:
                writers[bucket] = pq.ParquetWriter(temporary(bucket), table.schema, filesystem=fs, compression="snappy")
            writers[bucket].write_table(table.filter(pa.array(of == bucket)) if len(table) != (of == bucket).sum() else table, row_group_size=GROUP_ROWS)

    try:
        for batch in source:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows, n_held, size = rows + batch.num_rows, n_held + batch.num_rows, size + batch.nbytes
            if n_held >= GROUP_ROWS or size >= GROUP_BYTES:
                flush()
                held, n_held, size = [], 0, 0
        if held:
            flush()
        for writer in writers.values():
            writer.close()
        for bucket in writers:
            fs.move(temporary(bucket), f"{path}/part-{part:05d}-treeloom_{bucket:05d}.c000.snappy.parquet")
    except BaseException:
        for bucket in writers:
            if fs.get_file_info(temporary(bucket)).type != pyarrow.fs.FileType.NotFound:
                fs.delete_file(temporary(bucket))
        raise
    yield pa.RecordBatch.from_arrays([pa.array([rows], pa.int64())], ["rows"])
