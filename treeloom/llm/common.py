"""What the operators share: the cluster's shared folder, written tables, size-checked broadcasts."""

from __future__ import annotations

import contextlib
import ctypes
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treeloom.session import shared_folder

#: Bytes of a table that may be broadcast; larger ones are joined by a shuffle.
BROADCAST_BYTES = 10_000_000

#: Rows of an Arrow batch between the engine and Python: texts can be long.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> SparkSession:
    """Have Arrow batches hold BATCH_ROWS rows at most; a lower setting of the session stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))
    return spark


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, which goes through the batches of a task, with what it frees given back to the system: workers outlive their tasks, and several share an executor's memory."""

    def wrapped(source: Iterator) -> Iterator:
        libc = None
        with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such calls
            libc = ctypes.CDLL("libc.so.6")
            libc.mallopt(-3, 1 << 18)  # M_MMAP_THRESHOLD: larger blocks are mapped, and unmapped when they are freed
        try:
            yield from run(source)
        finally:
            pa.default_memory_pool().release_unused()
            if libc is not None:
                with contextlib.suppress(AttributeError):
                    libc.malloc_trim(0)

    return wrapped


def by_batch(run: Callable[[], Callable], kind: str) -> Callable:
    """A scalar function of columns: run() is called once a task and gives what goes from an Arrow array of values to one of results. Workers load no pandas for it, which they would hold as long as they live."""

    def each(source: Iterator) -> Iterator:
        own = run()
        for batch in source:
            yield own(batch)

    return F.arrow_udf(lean(each), kind, F.ArrowUDFType.SCALAR_ITER)


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other call uses."""
    return f"{shared_folder(spark)}/treeloom/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: cuts the lineage, survives lost executors."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def forget(table: DataFrame) -> None:
    """Delete a table that written() returned; nothing reads it any more."""
    spark = table.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(table._written_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _width(column: F.Column, kind: T.DataType) -> F.Column:
    """About how many bytes a value takes."""
    if isinstance(kind, T.StructType):
        return sum((_width(column.getField(f.name), f.dataType) for f in kind), F.lit(16))
    if isinstance(kind, T.StringType | T.BinaryType):
        return F.coalesce(F.octet_length(column), F.lit(0)) + 16
    if isinstance(kind, T.ArrayType):
        each = F.transform(column, lambda x: _width(x, kind.elementType).cast("long"))
        return F.coalesce(F.aggregate(each, F.lit(32).cast("long"), lambda a, x: a + x), F.lit(16))
    return F.lit(8)


def small(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if its rows take at most that many bytes, else df as it is, for a shuffled join. df should be a cheap or written table."""
    size = sum((_width(F.col(f"`{f.name}`"), f.dataType) for f in df.schema), F.lit(16))
    return F.broadcast(df) if (df.agg(F.sum(size)).first()[0] or 0) <= most else df.hint("merge")


def free_heaps(spark: SparkSession) -> None:
    """Have the executors collect their garbage now, so that their heaps shrink to about what is in use: heaps keep the size they once grew to, while Python workers need room beside them.

    One task a core, which an idle cluster deals to all executors; one that gets none keeps its heap, results are the same. A heap may grow again up to its limit.
    """
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.expr("java_method('java.lang.System', 'gc')")).collect()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def labels_of(labels: DataFrame, column: str, pick: str = "max") -> DataFrame:
    """One row (doc_id, column) per labelled document; rows with nulls are dropped, of contradicting rows the largest (or smallest) value holds."""
    value = F.max(column) if pick == "max" else F.min(column)
    return labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull()).groupBy("doc_id").agg(value.alias(column))


def batches(rows: Iterable[tuple], schema: pa.Schema, size: int = 8192) -> Iterator[pa.RecordBatch]:
    """Record batches of tuples."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


_ASCII_ALNUM = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))


def lower_words(text: str | None) -> list[bytes]:
    """The words of a text, lower-cased, in UTF-8: stretches of ASCII letters and digits and of all other characters beyond ASCII."""
    return text.lower().encode("utf-8", "surrogatepass").translate(_ASCII_ALNUM).split() if text else []


def free_name(taken: Iterable[str], wanted: str) -> str:
    """wanted, with underscores before it until no column of this name (in any case) is taken."""
    names = {c.lower() for c in taken}
    while wanted.lower() in names:
        wanted = f"_{wanted}"
    return wanted
