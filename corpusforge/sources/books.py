"""EPUB files of a folder as a Python data source: archives are read member by member at their offsets."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from corpusforge.sinks.committed import open_folder
from corpusforge.sources.files import _BOOK_ARROW, BOOK_SCHEMA, book_members

NAME = "corpusforge_books"


class Books(InputPartition):
    """Archives read by one task: (path to show, path in the file system)."""

    def __init__(self, paths: list[str]):
        super().__init__(paths)


class BookReader(DataSourceReader):
    """Partitions of about `partitionBytes` of archives. Each is opened once; no more than a member is in memory."""

    def __init__(self, options: dict):
        self.root, self.most = options["path"].rstrip("/"), int(options.get("partitionbytes", 64 << 20))

    def partitions(self) -> list[InputPartition]:
        system, root = open_folder(self.root)
        info = system.get_file_info(root)
        found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(root, recursive=True))
        out: list[list[str]] = [[]]
        size = 0
        for f in sorted((f for f in found if f.type == fs.FileType.File and f.base_name.lower().endswith(".epub")), key=lambda f: f.path):
            if out[-1] and size + f.size > self.most:
                out.append([])
                size = 0
            out[-1].append(f.path)
            size += f.size
        return [Books(paths) for paths in out if paths]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        system, _ = open_folder(self.root)
        for path in partition.value if partition is not None and partition.value else ():
            try:
                with system.open_input_file(path) as file:
                    for member in book_members(file):
                        yield pa.RecordBatch.from_pylist([{"path": path, **member}], schema=_BOOK_ARROW)
            except Exception as exc:  # a broken archive must not end the task
                yield pa.RecordBatch.from_pylist([{"path": path, "kind": "error", "error": str(exc)}], schema=_BOOK_ARROW)


class BookSource(DataSource):
    """`spark.read.format("corpusforge_books").load(folder)`: the members of all EPUB files, as `read_epub` gives them.

    An archive that cannot be opened gives one row of kind `error`; one that breaks half-way gives the members before and
    that row.
    """

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return BOOK_SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return BookReader(dict(self.options))


def read_books(spark: SparkSession, folder: str, **options) -> "DataFrame":  # noqa: F821
    spark.dataSource.register(BookSource)
    return spark.read.format(NAME).options(**options).load(folder)
