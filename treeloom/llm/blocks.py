"""Vectors in blocks: rows dealt by hash to blocks of bounded size, each one binary matrix."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeloom.llm.common import lean, partitions, written

#: About how many vectors a block holds.
ROWS = 4096

SCHEMA = "block int, dims int, ids binary, vectors binary"


def usable(vectors: DataFrame, key: str, column: str, zero: bool) -> DataFrame:
    """(id, v) with v an array of doubles: without null keys, null or empty vectors, null or non-finite components, and, if not ``zero``, zero vectors."""
    v = F.col("v")
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(column).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & (F.size(v) > 0))
    rows = rows.where(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    return rows if zero else rows.where(F.exists(v, lambda x: x != 0))


def packed(rows: DataFrame, n_blocks: int, parts: int) -> DataFrame:
    """A written table of blocks (block, dims, ids, vectors) of rows (id, v); a block holds vectors of one length, and is split where it grows beyond twice ROWS."""
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(n_blocks)).cast("int")).repartition(parts, "block")

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], tuple[list[int], list[np.ndarray]]] = {}
        for batch in source:
            ids, block = batch.column(0).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False)
            values, edges = batch.column(1).values.to_numpy(zero_copy_only=False), batch.column(1).offsets.to_numpy()
            for k in range(len(ids)):
                v = values[edges[k] : edges[k + 1]]
                own = held.setdefault((int(block[k]), len(v)), ([], []))
                own[0].append(int(ids[k]))
                own[1].append(v.copy())
                if len(own[0]) >= 2 * ROWS:
                    yield _pack(int(block[k]), len(v), *held.pop((int(block[k]), len(v))))
        for (b, dims), own in held.items():
            yield _pack(b, dims, *own)

    return written(dealt.mapInArrow(lean(run), SCHEMA), "blocks")  # written once: a second run could pack rows in another order, under other names


def _pack(block: int, dims: int, ids: list[int], vectors: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([dims], pa.int32()), pa.array([np.array(ids, np.int64).tobytes()], pa.binary()), pa.array([np.stack(vectors).tobytes()], pa.binary())], names=["block", "dims", "ids", "vectors"])


def unpacked(dims: int, ids: bytes, vectors: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(ids, np.int64), np.frombuffer(vectors, np.float64).reshape(-1, dims)


def met(rows: DataFrame, queries: DataFrame, run: Callable[[Iterator[tuple[int, np.ndarray, np.ndarray, Callable]]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """run over the blocks (dims, ids, vectors, query blocks) of each task: a query set against all rows, in blocks.

    rows and queries are written tables of blocks. No row moves more than once: tasks hold a block of rows and read the
    query blocks from the shared folder, one at a time; query blocks() gives those (ids, vectors) of a block's length.
    """
    spark = rows.sparkSession
    folder = queries._written_at
    parts = max(1, min(2 * partitions(spark), rows.count()))

    def task(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = pyarrow.fs.FileSystem.from_uri(folder)
        files = sorted(f.path for f in fs.get_file_info(pyarrow.fs.FileSelector(path)) if f.path.endswith(".parquet"))

        def of_length(dims: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for file in files:
                with fs.open_input_file(file) as opened:
                    for batch in pq.ParquetFile(opened).iter_batches(1, columns=["dims", "ids", "vectors"]):
                        for own, ids, vectors in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                            if own == dims:
                                yield unpacked(dims, ids, vectors)

        def each() -> Iterator[tuple]:
            for batch in source:
                for dims, ids, vectors in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                    yield (dims, *unpacked(dims, ids, vectors), lambda d=dims: of_length(d))

        yield from run(each())

    return rows.select("dims", "ids", "vectors").repartition(parts).mapInArrow(lean(task), schema)


def best(partial: DataFrame, k: int, order: list) -> DataFrame:
    """(query_id, rank, vec_id, score): the k first of each query's partial results, each vector once."""
    from pyspark.sql import Window

    once = partial.dropDuplicates(["query_id", "vec_id"])
    return once.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
