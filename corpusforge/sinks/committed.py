"""A dataset folder whose writes appear whole or not at all: a Python data source with two-phase commit.

Tasks write files under names of their own into `data/`. Nobody reads a file that no commit names: a commit
is one JSON file in `commits/`, put there under the next number after all tasks have reported.
Readers take the files of the last commit, so a failed or half-finished write is never seen. A write
that overwrites starts a new list of files, one that appends goes on from the last.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlparse

import pyarrow as pa
import pyarrow.compute
import pyarrow.csv
import pyarrow.json
import pyarrow.parquet
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

NAME = "corpusforge_committed"
FORMATS = ("jsonl", "csv", "parquet")


def open_folder(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder; any scheme that Arrow knows."""
    if urlparse(path).scheme:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def put_whole(system: fs.FileSystem, path: str, data: bytes) -> None:
    """Write a file so that it appears complete."""
    scratch = f"{path}.{uuid.uuid4().hex}.tmp"
    with system.open_output_stream(scratch) as out:
        out.write(data)
    system.move(scratch, path)


def commits(system: fs.FileSystem, root: str) -> list[str]:
    """Paths of the commits, oldest first."""
    found = system.get_file_info(fs.FileSelector(f"{root}/commits", allow_not_found=True))
    return sorted(f.path for f in found if f.base_name.endswith(".json"))


def committed(system: fs.FileSystem, root: str) -> dict:
    """The last commit: its number, format and files with their rows."""
    done = commits(system, root)
    if not done:
        return {"number": 0, "format": None, "files": []}
    with system.open_input_stream(done[-1]) as source:
        return json.loads(source.read())


@dataclass
class Written(WriterCommitMessage):
    """What a task reports: its files as (name, rows)."""

    files: list[tuple[str, int]]


class CommittedWriter(DataSourceArrowWriter):
    """Tasks write files of at most `rows` rows; the driver makes them visible in one step, or deletes them."""

    def __init__(self, options: dict, schema: StructType, overwrite: bool):
        self.root, self.format = options["path"].rstrip("/"), options.get("format", "jsonl")
        if self.format not in FORMATS:
            raise ValueError(f"unknown format: {self.format}")
        self.rows, self.overwrite, self.run = int(options.get("rowsperfile", 1_000_000)), overwrite, uuid.uuid4().hex
        self.batch = int(options["batch"]) if "batch" in options else None
        self.base = committed(*open_folder(self.root))["number"]

    def _encode(self, table: pa.Table) -> bytes:
        sink = pa.BufferOutputStream()
        if self.format == "parquet":
            pa.parquet.write_table(table, sink, compression="zstd")
        elif self.format == "csv":
            pa.csv.write_csv(table, sink)
        else:
            for batch in table.to_batches(max_chunksize=10_000):
                for row in batch.to_pylist():
                    sink.write(json.dumps({k: v for k, v in row.items() if v is not None}, ensure_ascii=False, default=str).encode() + b"\n")
        return sink.getvalue().to_pybytes()

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, root = open_folder(self.root)
        system.create_dir(f"{root}/data", recursive=True)
        files: list[tuple[str, int]] = []
        held: list[pa.RecordBatch] = []

        def flush() -> None:
            if held:
                table = pa.Table.from_batches(held)
                held.clear()
                # A task that is tried again writes under new names; what it left before is in no commit.
                name = f"{self.run}-{uuid.uuid4().hex}.{self.format}"
                put_whole(system, f"{root}/data/{name}", self._encode(table))
                files.append((name, len(table)))

        for batch in iterator:
            while len(batch):
                part = batch.slice(0, self.rows - sum(map(len, held)))
                held.append(part)
                batch = batch.slice(len(part))
                if sum(map(len, held)) >= self.rows:
                    flush()
        flush()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        system, root = open_folder(self.root)
        before = committed(system, root)
        if before["number"] != self.base:
            self._delete(system, root)
            raise RuntimeError(f"another write of {self.root} was committed meanwhile")
        if self.batch is not None and before.get("batch", -1) >= self.batch:
            # A batch handed again after a failure: it is in already.
            self._delete(system, root)
            return
        files = sorted(f for m in messages if m for f in m.files)
        kept = [] if self.overwrite else before["files"]
        if kept and before["format"] != self.format:
            self._delete(system, root)
            raise ValueError(f"{self.root} holds {before['format']}, not {self.format}")
        system.create_dir(f"{root}/commits", recursive=True)
        number = before["number"] + 1
        put_whole(system, f"{root}/commits/{number:012d}.json", json.dumps({"number": number, "format": self.format, "batch": before.get("batch", -1) if self.batch is None else self.batch, "files": [*kept, *files]}).encode())

    def abort(self, messages: list[Written | None]) -> None:
        self._delete(*open_folder(self.root))

    def _delete(self, system: fs.FileSystem, root: str) -> None:
        """Take away the files of this run, those of failed tasks too."""
        for f in system.get_file_info(fs.FileSelector(f"{root}/data", allow_not_found=True)):
            if f.base_name.startswith(self.run):
                system.delete_file(f.path)


class File(InputPartition):
    def __init__(self, name: str):
        super().__init__(name)


class CommittedReader(DataSourceReader):
    """One partition per file of the last commit (or that of the option `number`)."""

    def __init__(self, options: dict, schema: StructType):
        self.root, self.schema, self.number = options["path"].rstrip("/"), schema, options.get("number")

    def _commit(self) -> dict:
        system, root = open_folder(self.root)
        if self.number is None:
            return committed(system, root)
        with system.open_input_stream(f"{root}/commits/{int(self.number):012d}.json") as source:
            return json.loads(source.read())

    def partitions(self) -> list[InputPartition]:
        return [File(name) for name, _ in self._commit()["files"]]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        if partition is None or partition.value is None:
            return
        system, root = open_folder(self.root)
        wanted, name = to_arrow_schema(self.schema), partition.value
        with system.open_input_file(f"{root}/data/{name}") as source:
            if name.endswith(".parquet"):
                table = pa.parquet.read_table(source)
            elif name.endswith(".csv"):
                table = pa.csv.read_csv(source, parse_options=pa.csv.ParseOptions(newlines_in_values=True), convert_options=pa.csv.ConvertOptions(column_types=wanted, strings_can_be_null=True, quoted_strings_can_be_null=False))
            else:
                table = pa.json.read_json(source, parse_options=pa.json.ParseOptions(explicit_schema=wanted, newlines_in_values=False, unexpected_field_behavior="ignore"), read_options=pa.json.ReadOptions(block_size=64 << 20))
        yield from table.select(wanted.names).cast(wanted).to_batches(max_chunksize=10_000)


class CommittedSource(DataSource):
    """`spark.read` and `df.write` format `corpusforge_committed`; options path, format (jsonl, csv, parquet), rowsPerFile, number, batch.

    With a `batch`, a write whose batch is not above the last committed one changes nothing. Reading needs a schema. Values that JSON or CSV cannot hold by themselves should be turned into strings first.
    """

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> StructType:
        raise ValueError("give the schema to read with")

    def reader(self, schema: StructType) -> DataSourceReader:
        return CommittedReader(dict(self.options), schema)

    def writer(self, schema: StructType, overwrite: bool) -> CommittedWriter:
        return CommittedWriter(dict(self.options), schema, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(CommittedSource)
