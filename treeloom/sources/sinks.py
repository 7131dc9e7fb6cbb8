"""Documents to files, and to writers of one's own."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from treeloom.session import ship
from treeloom.sources import encoding as E

#: Takes a document's key and its bytes, and says where it put them.
Write = Callable[[int, bytes], str]


def deliver(texts: DataFrame, connect: Callable[[], Write], encoding: str = "utf8", bom: bool = False) -> DataFrame:
    """(doc_id, target, n_bytes) of texts (doc_id, xml), which are handed to a writer when the result is computed.

    connect is called once in each task, on its executor. A task that is repeated hands its documents over again, so a
    writer should put a document in the same place each time.
    """
    ship(texts.sparkSession)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        write = connect()
        for batch in source:
            keys, data = batch.column(0).to_pylist(), [E.encode(x or "", encoding, bom) for x in batch.column(1).to_pylist()]
            targets = [write(k, d) for k, d in zip(keys, data, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(targets, pa.string()), pa.array([len(d) for d in data], pa.int64())], names=["doc_id", "target", "n_bytes"])

    return texts.selectExpr("cast(doc_id as long) as doc_id", "xml").mapInArrow(run, "doc_id long, target string, n_bytes long")


def files(folder: str) -> Callable[[], Write]:
    """Writers of one file a document, doc_id.xml, in a folder of any store that Arrow knows; a file appears when it is complete."""

    def connect() -> Write:
        fs, path = pyarrow.fs.FileSystem.from_uri(folder)
        fs.create_dir(path, recursive=True)

        def write(key: int, data: bytes) -> str:
            partial, target = f"{path}/.{key}-{uuid.uuid4().hex}", f"{path}/{key}.xml"
            with fs.open_output_stream(partial, compression=None) as out:
                out.write(data)
            fs.move(partial, target)
            return f"{folder.rstrip('/')}/{key}.xml"

        return write

    return connect


class Written(WriterCommitMessage):
    def __init__(self, targets: list[str]) -> None:
        self.targets = targets


class _Writer(DataSourceWriter):
    def __init__(self, options: dict) -> None:
        self.options = options

    def write(self, iterator: Iterator) -> Written:
        put = files(self.options["path"])()
        encoding, bom = self.options.get("encoding", "utf8"), self.options.get("bom", "false").lower() == "true"
        return Written([put(row["doc_id"], E.encode(row["xml"] or "", encoding, bom)) for row in iterator])

    def abort(self, messages: list) -> None:
        fs, path = pyarrow.fs.FileSystem.from_uri(self.options["path"])
        for message in messages:
            for target in message.targets if message else ():
                fs.delete_file(f"{path}/{target.rpartition('/')[2]}")


class XmlFiles(DataSource):
    """Format ``treeloom_xml``: rows (doc_id, xml) as one file a document. Options: path (a URI), encoding, bom."""

    @classmethod
    def name(cls) -> str:
        return "treeloom_xml"

    def schema(self) -> str:
        return "doc_id long, xml string"

    def writer(self, schema: object, overwrite: bool) -> _Writer:
        return _Writer(dict(self.options))


def register(spark) -> None:  # noqa: ANN001
    """Make the format known to the session."""
    ship(spark).dataSource.register(XmlFiles)
