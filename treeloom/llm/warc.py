"""WARC archives with a two-level capture index.

Writing: pages are put in order of their reversed-host URL keys, each task writes one archive of records, each a gzip
member of its own, and passes on the captures (sort key, file, offset, length). The captures, in the same order, are the
first level: files of compressed blocks of ``BLOCK_LINES`` lines. The second level is a sparse directory with the first
key and the place of each block.

Reading: a binary search in the directory gives the blocks of a key, a range read gets a block, a binary search in its
lines gives the captures, and range reads get the records, neighbours in one.

Files are read and written through Arrow's file systems, so the folder can be any store that they know; a task that
runs again writes a new file, and captures always name the file of the attempt that passed them on.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeloom.llm.common import BROADCAST_BYTES, batches, fresh_path, lean, partitions, small, small_batches, written

BLOCK_LINES = 1000
#: Bytes of neighbouring records that are read at once.
READ = 4_000_000
#: zlib level: speed before size.
LEVEL = 1
#: The version line and the date that all records carry.
VERSION, DATE = b"WARC/1.1", "2026-01-01T00:00:00Z"

_URL = re.compile(r"^(?:([a-zA-Z][a-zA-Z0-9+.-]*):)?(?://)?([^/?#]*)([^#]*)")


def url_key(url: str | None) -> str:
    """Sort key of a URL: host labels reversed and joined by commas, ')', path and query, in lower case; '' for null."""
    if not url:
        return ""
    m = _URL.match(url.strip())
    host = m[2].rpartition("@")[2].lower()
    host, _, port = host.partition(":")
    if host.startswith("www."):
        host = host[4:]
    port = "" if port in ("", "80", "443") else f":{port}"
    return f"{','.join(reversed(host.split('.')))}{port}){(m[3] or '/').lower()}".replace("\n", "%0a").replace("\t", "%09")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str, payload: bytes, payload_digest: str, revisit: bool = False, refers_to: int | None = None, own: str = "") -> bytes:
    """One WARC record as a gzip member. A revisit holds the HTTP header only, which says how long the payload was. Responses are named by page and digest, and ``own`` tells apart what has the same."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    target = url.replace("\r", "%0d").replace("\n", "%0a")
    name = lambda page, more="": f"<urn:page:{'' if page is None else page}:{payload_digest}{more and ':'}{more}>"
    head = [f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {name(page_id, own)}", f"WARC-Target-URI: {target}", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{payload_digest}"]
    if revisit:
        head += [f"WARC-Refers-To: {name(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return gzip.compress(VERSION + b"\r\n" + "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n", LEVEL, mtime=0)


def parse(member: bytes) -> dict:
    """type, page_id, payload (None for a revisit), payload_bytes, digest and refers_to of one record; the payload of a response is checked against its digest."""
    raw = gzip.decompress(member)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if lines[0].encode() != VERSION:
        raise ValueError(f"not a WARC record: {lines[0]!r}")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(re.search(rb"Content-Length: (\d+)", http)[1])
    kind, named = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response" and (len(payload) != length or digest(payload) != named):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")

    def page(name: str) -> int | None:
        number = fields[name].split(":")[2] if name in fields else ""
        return int(number) if number else None

    return {"type": kind, "page_id": page("WARC-Record-ID"), "payload": payload if kind == "response" else None, "payload_bytes": length, "digest": named, "refers_to": page("WARC-Refers-To")}


class _Store:
    """Files of one folder, opened once a task."""

    def __init__(self, folder: str) -> None:
        self.fs, self.path = pyarrow.fs.FileSystem.from_uri(folder)
        self.open: dict[str, pyarrow.NativeFile] = {}

    def create(self, name: str) -> pyarrow.NativeFile:
        self.fs.create_dir(self.path, recursive=True)
        return self.fs.open_output_stream(f"{self.path}/{name}", compression=None)

    def read(self, name: str, offset: int, length: int) -> bytes:
        if name not in self.open:
            if len(self.open) >= 64:
                self.close()
            self.open[name] = self.fs.open_input_file(f"{self.path}/{name}")
        return self.open[name].read_at(length, offset)

    def read_all(self, places: list[tuple[str, int, int]]) -> Iterator[bytes]:
        """What lies at the places (file, offset, length), in their order there; neighbours are read together, up to READ bytes."""
        places = sorted(places)
        k = 0
        while k < len(places):
            name, begin, length = places[k]
            end, last = begin + length, k + 1
            while last < len(places) and places[last][:2] == (name, end) and end + places[last][2] - begin <= READ:
                end += places[last][2]
                last += 1
            found = self.read(name, begin, end - begin)
            for _, offset, size in places[k:last]:
                yield found[offset - begin : offset - begin + size]
            k = last

    def close(self) -> None:
        for f in self.open.values():
            f.close()
        self.open.clear()


CAPTURE = pa.schema([("key", pa.string()), ("page_id", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
DIRECTORY = pa.schema([("first_key", pa.string()), ("first_page", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("lines", pa.int64())])


def planned(pages: DataFrame, least: int = 0) -> DataFrame:
    """(page_id, url, html, revisit, refers_to) per row of pages: null urls and html are empty ones.

    Of the rows with equal payloads of at least ``least`` bytes that with the largest page_id (nulls are the smallest) is
    the response, the others are revisits of it; of rows that repeat that page_id as well, one is. All smaller payloads
    are responses.
    """
    html = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), html.alias("html"), F.sha1(F.encode(html, "utf-8")).alias("sha"), F.octet_length(html).alias("n"))
    counts = rows.where(f"n >= {int(least)}").groupBy("sha", "page_id").agg(F.count(F.lit(1)).alias("times"))
    groups = counts.groupBy("sha").agg(F.max("page_id").alias("last"), F.sum("times").alias("times"), F.max_by("times", "page_id").alias("ties"))
    groups = written(groups.where("times > 1").select("sha", "last", F.coalesce("ties", "times").alias("ties")), "payloads")
    joined = rows.join(small(groups), "sha", "left").withColumn("latest", F.col("ties").isNull() | F.col("page_id").eqNullSafe(F.col("last")))
    out = ("page_id", "url", "html", "revisit", "refers_to")
    refers = F.when(F.col("revisit"), F.col("last")).alias("refers_to")
    single = joined.where("not latest or coalesce(ties, 1) = 1").withColumn("revisit", ~F.col("latest")).select(*out[:-1], refers)
    if groups.where("ties > 1").isEmpty():
        return single
    tied = written(joined.where("latest and ties > 1").withColumn("number", F.monotonically_increasing_id()), "tied")
    chosen = written(tied.groupBy("sha").agg(F.min("number").alias("number")).select("number", F.lit(False).alias("revisit")), "chosen")
    tied = tied.join(small(chosen), "number", "left").withColumn("revisit", F.coalesce("revisit", F.lit(True)))
    return single.union(tied.select(*out[:-1], refers))


def write_archives(pages: DataFrame, folder: str, least: int = 0) -> DataFrame:
    """Write a record per row of pages (page_id, url, html) and return the captures; see planned().

    The payload is moved between tasks once, into the order of URL keys.
    """
    rows = planned(pages, least).withColumn("key", url_keys("url"))
    rows = rows.repartitionByRange(partitions(pages.sparkSession), "key", "page_id").sortWithinPartitions("key", "page_id")

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        store, name, out, at = _Store(folder), f"{uuid.uuid4().hex}.warc.gz", None, 0
        for batch in source:
            for page, url, html, revisit, refers, key in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
                payload = html.encode("utf-8", "surrogatepass")
                member = record(page, url, payload, digest(payload), revisit, refers, f"{name}:{at}" if revisit or len(payload) < least else "")
                out = out or store.create(name)
                out.write(member)
                yield key, page, name, at, len(member)
                at += len(member)
        if out:
            out.close()

    return rows.mapInArrow(lean(lambda source: batches(run(source), CAPTURE, 2000)), "key string, page_id long, file string, offset long, length long")


def write_index(captures: DataFrame, folder: str) -> DataFrame:
    """Write the captures, sorted by key and page, as compressed blocks and return the directory of blocks."""
    spark = captures.sparkSession

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        store, name, out, at = _Store(folder), f"{uuid.uuid4().hex}.cdx", None, 0
        held: list[str] = []
        first: tuple[str, int | None] = ("", None)

        def block() -> tuple:
            nonlocal out, at
            out = out or store.create(name)
            data = zlib.compress("\n".join(held).encode("utf-8", "surrogatepass"), LEVEL)
            out.write(data)
            row = (*first, name, at, len(data), len(held))
            at += len(data)
            held.clear()
            return row

        for batch in source:
            for key, page, file, offset, length in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if not held:
                    first = (key, page)
                held.append(f"{key}\t{'' if page is None else page}\t{file}\t{offset}\t{length}")
                if len(held) >= BLOCK_LINES:
                    yield block()
        if held:
            yield block()
        if out:
            out.close()

    ordered = captures.repartitionByRange(partitions(spark), "key", "page_id").sortWithinPartitions("key", "page_id")
    return ordered.mapInArrow(lean(lambda source: batches(run(source), DIRECTORY, 500)), "first_key string, first_page long, file string, offset long, length long, lines long")


def _bytes(directory: DataFrame) -> int:
    return directory.agg(F.sum(F.octet_length("first_key") + F.octet_length("file") + 64)).first()[0] or 0


def _mark(key: str, page: int | None) -> tuple[bytes, int, int]:
    """Places in the order of the index: by bytes, as Spark sorts strings, with nulls first."""
    return key.encode("utf-8", "surrogatepass"), page is not None, page or 0


_PLACED = "key string, page_id long, block_file string, block_offset long, block_length long"


def _located(wanted: DataFrame, directory: DataFrame) -> DataFrame:
    """wanted (key, page_id), which don't repeat, with file, offset and length of each index block that may hold it: the last that begins before it, and those that begin with it."""
    schema = pa.schema([("key", pa.string()), ("page_id", pa.int64()), ("block_file", pa.string()), ("block_offset", pa.int64()), ("block_length", pa.int64())])
    if _bytes(directory) <= BROADCAST_BYTES:
        rows = sorted((_mark(r["first_key"], r["first_page"]), r["file"], r["offset"], r["length"]) for r in directory.collect())
        shared = wanted.sparkSession.sparkContext.broadcast(([r[0] for r in rows], [r[1:] for r in rows]))

        def run(source: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
            firsts, places = shared.value
            for batch in source:
                for key, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    mark = _mark(key, page)
                    for k in range(max(0, bisect.bisect_left(firsts, mark) - 1), bisect.bisect_right(firsts, mark)):
                        yield (key, page, *places[k])

        return wanted.select("key", "page_id").mapInArrow(lean(lambda source: batches(run(source), schema)), _PLACED)
    # a directory too large for one worker is merged with the wanted keys by range, each range after the last block that begins before it
    from pyspark.sql import Window

    place = F.struct("file", "offset", "length")
    nothing = F.lit(None).cast("struct<file:string,offset:bigint,length:bigint>")
    both = wanted.select("key", "page_id", F.lit(1).alias("side"), nothing.alias("place")).union(directory.select("first_key", "first_page", F.lit(0), place))
    parts = partitions(wanted.sparkSession)
    both = written(both.repartitionByRange(parts, "key", "page_id").withColumn("part", F.spark_partition_id()), "located")
    order = F.struct("key", F.col("page_id").isNotNull().alias("known"), "page_id", "place")
    ends = both.where("side = 0").groupBy("part").agg(F.max_by("place", order).alias("end"))
    begins = ends.select("part", F.lead("part", 1).over(Window.orderBy("part")).alias("next"), "end")  # a row a partition
    spans = begins.select(F.explode(F.sequence(F.col("part") + 1, F.coalesce("next", F.lit(parts)))).alias("part"), F.col("end").alias("carried"))
    rows = both.join(F.broadcast(spans), "part", "left").select("part", "key", "page_id", "side", *(F.coalesce(f"place.{c}", f"carried.{c}").alias(c) for c in ("file", "offset", "length")))
    dealt = rows.repartition(parts, "part").sortWithinPartitions("part", "key", F.col("page_id").asc_nulls_first(), "side", "file", "offset")

    def merged(source: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        part, lower, equal, at = None, None, [], None
        for batch in source:
            for own, key, page, side, *found in zip(*(batch.column(k).to_pylist() for k in range(7)), strict=True):
                if own != part:
                    part, lower, equal, at = own, None, [], None
                if side == 0:
                    mark = (key, page)
                    if mark != at:
                        lower, equal, at = (equal or [lower])[-1], [], mark
                    equal.append(found)
                    continue
                before = lower if (key, page) == at else (equal or [lower])[-1]
                before = before or (found if found[0] is not None else None)  # what was carried
                for x in (*([before] if before else ()), *(equal if (key, page) == at else ())):
                    yield (key, page, *x)

    return dealt.mapInArrow(lean(lambda source: batches(merged(source), schema)), _PLACED)


RECORD = pa.schema([("page_id", pa.int64()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])


def fetch(wanted: DataFrame, directory: DataFrame, index: str, archives: str, payload: bool = True) -> DataFrame:
    """The records of the captures (key, page_id) that are wanted, found through the index: all records of a capture's
    key and page, once however often it is wanted; captures that aren't there give no row.

    Wanted captures are dealt by index block, of bounded size each; a block is read once for all of them.
    """
    spark = wanted.sparkSession
    dealt = _located(wanted.select("key", "page_id").distinct(), directory).repartition(partitions(spark), "block_file", "block_offset").sortWithinPartitions("block_file", "block_offset")

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        blocks, files, last, lines, keys = _Store(index), _Store(archives), None, [], []
        places: list[tuple[str, int, int]] = []

        def records() -> Iterator[tuple]:
            for member in files.read_all(places):
                got = parse(member)
                yield got["page_id"], got["payload"] if payload else None, got["payload_bytes"], got["digest"], got["type"], got["refers_to"]
            places.clear()

        for batch in source:
            for key, page, file, offset, length in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if (file, offset) != last:
                    yield from records()
                    last = (file, offset)
                    lines = [x.split("\t") for x in zlib.decompress(blocks.read(file, offset, length)).decode("utf-8", "surrogatepass").split("\n")]
                    keys = [_mark(x[0], int(x[1]) if x[1] else None) for x in lines]
                mark = _mark(key, page)
                places += [(x[2], int(x[3]), int(x[4])) for x in lines[bisect.bisect_left(keys, mark) : bisect.bisect_right(keys, mark)]]
        yield from records()
        blocks.close()
        files.close()

    return dealt.mapInArrow(lean(lambda source: batches(run(source), RECORD, 500)), "page_id long, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long")


def url_keys(urls: str) -> F.Column:
    @F.pandas_udf("string")
    def run(column):  # noqa: ANN001, ANN202
        return column.map(url_key)

    return run(urls)


def keyed(pages: DataFrame) -> DataFrame:
    """(key, page_id) of pages."""
    return pages.select(url_keys("url").alias("key"), F.col("page_id").cast("long").alias("page_id"))


def round_trip(pages: DataFrame) -> DataFrame:
    """Archive all pages, index the archives, look every page up and read its records back: (page_id, payload_bytes,
    payload_digest, record_type, refers_to) per row of pages (page_id, url, html).

    Null urls and html are empty ones; rows with null or repeated page ids have records of their own. Other columns are
    not looked at; an empty table gives no rows.
    """
    spark = small_batches(pages.sparkSession)
    archives, index = fresh_path(spark, "warc"), fresh_path(spark, "cdx")
    captures = written(write_archives(pages, archives), "captures")
    directory = written(write_index(captures, index), "directory")
    return fetch(keyed(pages), directory, index, archives, payload=False).drop("payload")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS sha FROM pages),
q AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha, max(page_id) OVER (PARTITION BY sha) AS last,
        row_number() OVER (PARTITION BY sha ORDER BY page_id DESC NULLS LAST) AS place FROM p)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(generate_series(0, 7), lambda k: array_to_string(list_transform([15, 10, 5, 0], lambda s:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(sha, (5 * k + 1)::INTEGER, 5))::BIGINT >> s) & 31)::INTEGER + 1, 1)), '')), '') AS payload_digest,
  CASE WHEN place = 1 THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN place > 1 THEN last END AS refers_to
FROM q
"""
