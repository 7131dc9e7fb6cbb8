"""Node tables that queries share: shredded once an application, written by document into buckets."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from treeloom import files
from treeloom.session import shared_folder, ship

_made: dict[tuple[str, str], str] = {}


def merged(df: DataFrame) -> DataFrame:
    """df as a side of a join that sorts and merges.

    What Spark knows of a node table is its size as Parquet or as a shuffle, a twentieth of its size in memory; joins
    that it chooses by that send up to all nodes through the driver.
    """
    return df.hint("merge")


def mapped(df: DataFrame, run: Callable[[Iterator], Iterator], schema: StructType | str) -> DataFrame:
    """df.mapInArrow(run, schema), which remembers how it was made: what comes after it in Python then gets its batches without a way through the JVM."""
    before, own = getattr(df, "_mapped", None) or (df, None)
    whole = run if own is None else lambda source: run(own(source))
    out = before.mapInArrow(whole, schema)
    out._mapped = (before, whole)
    return out


def dealt(df: DataFrame, name: str) -> DataFrame:
    """Write df, of which each partition holds the rows of pmod(hash(doc_id), partitions), as a table in buckets by doc_id, and read it again.

    The partitions are written as they come: no shuffle, no sort. What Python makes, Python writes, where Arrow knows the
    file system of the shared folder: rows of nodes on their way through the JVM took most of the time.
    """
    spark = df.sparkSession
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    before, run = getattr(df, "_mapped", None) or (None, None)
    folder, n = f"{shared_folder(spark)}/treeloom/{name}", partitions(spark)
    if run is not None and _known(folder):
        folder = f"{folder}-{uuid.uuid4().hex}"  # what an earlier call left there is none of this table
        files.make(folder)
        before.mapInArrow(lambda source: files.write(run(source), folder, n), "rows long").agg({"rows": "sum"}).collect()
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
        spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet OPTIONS (path '{folder}') CLUSTERED BY (doc_id) INTO {n} BUCKETS")
        return spark.table(name)
    most = "spark.sql.maxConcurrentOutputFileWriters"
    kept = spark.conf.get(most)
    spark.conf.set(most, "2")  # one for the bucket; without it rows are sorted by bucket
    try:
        df.write.mode("overwrite").option("path", folder).bucketBy(n, "doc_id").saveAsTable(name)
    finally:
        spark.conf.set(most, kept)
    return spark.table(name)


def _known(folder: str) -> bool:
    try:
        pyarrow.fs.FileSystem.from_uri(folder)
    except (pa.ArrowException, OSError, ValueError):
        return False
    return True


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def node_table(spark: SparkSession, key: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The node table that build() gives, written in the shared folder in buckets by doc_id at the first call for the key.

    build() keeps documents where publish.spread() put them. Joins on the document, alone or with further columns, then
    read their buckets side by side and move nothing.
    """
    ship(spark)
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    mark = (spark.sparkContext.applicationId, key)
    if mark not in _made or not spark.catalog.tableExists(_made[mark]):
        name = "treeloom_" + hashlib.sha1(repr(mark).encode()).hexdigest()[:16]
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        dealt(build(), name)
        _made[mark] = name
    return spark.table(_made[mark])
