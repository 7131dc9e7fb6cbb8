"""Texts, bytes and files to node tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeloom import schema as S
from treeloom.session import ship
from treeloom.sources import encoding as E
from treeloom.sources import parser as P
from treeloom.sources import plain
from treeloom.tables import mapped, merged

#: Bytes of text that are looked at together.
TOGETHER = 1 << 20


def shred(docs: DataFrame, doc_id: str = "doc_id", xml: str = "xml", flags: int = S.DEFAULT, encoding: str = "auto", string_values: bool = True) -> DataFrame:
    """The node table of a column of texts or of bytes.

    A text is taken as it is; bytes are decoded by their marks or the given encoding. A null is a document that couldn't
    be read (status io_error). string_values=False leaves sval null, for documents that are deep and large at once.
    """
    ship(docs.sparkSession)
    binary = docs.schema[xml].dataType.typeName() == "binary"

    def trees(keys: list, contents: list) -> Iterator[tuple[int, str, P.Tree]]:
        for key, content in zip(keys, contents, strict=True):
            if content is None:
                tree, found = P.Tree(status="io_error"), "utf8"
                tree.add("document", -1)
            else:
                text, found = E.decode(content, encoding) if binary else (content.removeprefix("\ufeff"), "utf8")
                tree = P.parse(text, flags)
            yield key, found, tree

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if binary or not string_values or flags & plain.CHANGING:
            yield from P.batches((tree for batch in source for tree in trees(batch.column(0).to_pylist(), batch.column(1).to_pylist())), string_values)
            return
        for keys, texts in _together(source):
            yield from _nodes(keys, texts, lambda k, t: P.batches(trees(k.to_pylist(), t.to_pylist())))

    docs = docs if docs.columns == [doc_id, xml] and docs.schema[doc_id].dataType.typeName() == "long" else docs.select(F.col(doc_id).cast("long"), xml)
    return mapped(docs, run, S.NODES)


def _together(source: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Keys and texts, of which TOGETHER bytes or one text are given at once."""
    held: list[pa.RecordBatch] = []
    size = 0

    def cut() -> Iterator[tuple[pa.Array, pa.Array]]:
        keys, texts = (pa.concat_arrays([b.column(c) for b in held]) for c in (0, 1))
        edges = _edges(texts)
        a = 0
        while a < len(texts):
            b = max(a + 1, int(np.searchsorted(edges, edges[a] + TOGETHER, "right")) - 1)
            yield keys[a:b], texts[a:b]
            a = b

    for batch in source:
        held.append(batch)
        size += batch.column(1).nbytes
        if size >= TOGETHER:
            yield from cut()
            held, size = [], 0
    if held:
        yield from cut()


def _edges(texts: pa.Array) -> np.ndarray:
    form = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    return np.frombuffer(texts.buffers()[1], form)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)


def _nodes(keys: pa.Array, texts: pa.Array, parsed: Callable[[pa.Array, pa.Array], Iterator[pa.RecordBatch]]) -> Iterator[pa.RecordBatch]:
    """The node table of texts: stretches of plain ones at once, the others by parsed."""
    if not len(texts):
        return
    edges = _edges(texts)
    whole = texts.buffers()[2]
    data = np.frombuffer(whole, np.uint8)[edges[0] : edges[-1]] if whole else np.zeros(0, np.uint8)
    strange, found = plain.scan(data, edges - edges[0], keys.to_numpy()) if not texts.null_count and not keys.null_count else (~texts.is_valid().to_numpy(False), None)
    if found is not None:
        yield from found
        return
    cuts = np.flatnonzero(strange[1:] != strange[:-1]) + 1
    if len(cuts) > 1 + len(texts) // 64 or not strange.any():
        yield from parsed(keys, texts)
        return
    for a, b in zip([0, *cuts], [*cuts, len(texts)], strict=True):
        yield from (parsed if strange[a] else lambda k, t: _nodes(k, t, parsed))(keys[a:b], texts[a:b])


def documents(nodes: DataFrame) -> DataFrame:
    """(doc_id, status, status_code, description, error_offset, encoding, n_nodes) of each document of a node table."""
    code, text = {n: c for n, c in S.CODES.items()}, dict(S.STATUSES)
    lookup = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])
    return nodes.where("kind = 'document'").select("doc_id", "status", F.element_at(lookup(code), F.col("status")).alias("status_code"), F.element_at(lookup(text), F.col("status")).alias("description"), "error_offset", "encoding", (F.col("size") + 1).alias("n_nodes"))


def read_files(spark: SparkSession, paths: str | list[str], flags: int = S.DEFAULT, encoding: str = "auto") -> tuple[DataFrame, DataFrame]:
    """(nodes, files): the node table of all files, and (doc_id, path, status). A path given that has no file is a row with the status file_not_found."""
    given = [paths] if isinstance(paths, str) else list(paths)
    exact = [p for p in given if not any(c in p for c in "*?[{")]
    found = spark.read.format("binaryFile").option("ignoreMissingFiles", True)
    there = [p for p in given if p not in exact or _exists(spark, p)]
    files = found.load(there) if there else spark.createDataFrame([], "path string, modificationTime timestamp, length long, content binary")
    files = files.select(F.xxhash64("path").alias("doc_id"), "path", "content")
    nodes = shred(files, "doc_id", "content", flags, encoding)
    missing = spark.createDataFrame([(p,) for p in exact if p not in there], "path string").select(F.xxhash64("path").alias("doc_id"), "path", F.lit("file_not_found").alias("status"))
    status = files.select("doc_id", "path").join(merged(documents(nodes).select("doc_id", "status")), "doc_id")
    return nodes, status.unionByName(missing)


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A node table that write_table wrote."""
    return spark.read.schema(S.NODES).parquet(path)


def write_table(nodes: DataFrame, path: str, mode: str = "error") -> None:
    """Node table as Parquet, one document's nodes together and in order, so that later reads by doc_id, kind or name skip row groups."""
    nodes.repartition("doc_id").sortWithinPartitions("doc_id", "pre").write.mode(mode).parquet(path)
