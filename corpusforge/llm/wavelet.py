"""Token files: one wavelet matrix per shard, with the documents it holds."""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from corpusforge.llm.arrays import slices, text_bytes
from corpusforge.llm.tokens import TextEncoder

MAGIC = b"WVM1"
BLOCK = 1 << 16
SHARD_TOKENS = 1 << 21


class WaveletMatrix:
    """Ids as succinct bit-planes, highest bit first. Rank counts are kept per 64-bit word.

    Level l holds bit l of every id, ids ordered by their bits above (zeros before ones, stable).
    `access` walks down by rank; `count` narrows a range; `locate` climbs back up by select.
    """

    def __init__(self, planes: list[np.ndarray], zeros: list[int], n: int):
        self.planes, self.zeros, self.n = planes, zeros, n
        self._ranks: list[np.ndarray] | None = None

    @classmethod
    def of(cls, ids: np.ndarray, bits: int | None = None) -> WaveletMatrix:
        bits = max(1, int(ids.max()).bit_length() if len(ids) else 1) if bits is None else bits
        now = ids.astype(np.uint16 if bits <= 16 else np.uint32)
        planes, zeros = [], []
        for shift in range(bits - 1, -1, -1):
            bit = ((now >> shift) & 1).astype(bool)
            planes.append(np.packbits(bit, bitorder="little"))
            low = now[~bit]
            zeros.append(len(low))
            now = np.concatenate([low, now[bit]])
        return cls(planes, zeros, len(ids))

    def _bits(self, level: int) -> np.ndarray:
        return np.unpackbits(self.planes[level], count=self.n, bitorder="little").view(bool)

    def all(self) -> np.ndarray:
        """Every id in order: the planes undone from the lowest up."""
        now = np.zeros(self.n, np.uint16 if len(self.planes) <= 16 else np.uint32)
        for level in range(len(self.planes) - 1, -1, -1):
            bit, up = self._bits(level), np.empty_like(now)
            up[~bit] = now[: self.zeros[level]]
            up[bit] = now[self.zeros[level] :] | now.dtype.type(1 << (len(self.planes) - 1 - level))
            now = up
        return now.astype(np.uint32)

    def _rank1(self, level: int, at: int) -> int:
        """Ones before place `at`."""
        if self._ranks is None:
            self._ranks = []
            for plane in self.planes:
                words = np.frombuffer(plane.tobytes().ljust(-(-len(plane) // 8) * 8, b"\0"), "<u8")
                self._ranks.append(np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)]))
        whole, rest = divmod(at, 64)
        part = int.from_bytes(self.planes[level][whole * 8 : whole * 8 + 8].tobytes(), "little") & ((1 << rest) - 1)
        return int(self._ranks[level][whole]) + part.bit_count()

    def _select(self, level: int, one: bool, nth: int) -> int:
        """Place of the nth (from 0) bit of that kind."""
        low, high = 0, self.n
        while low < high:
            mid = (low + high) // 2
            ones = self._rank1(level, mid + 1)
            if (ones if one else mid + 1 - ones) > nth:
                high = mid
            else:
                low = mid + 1
        return low

    def access(self, at: int) -> int:
        if not 0 <= at < self.n:
            raise IndexError(at)
        value = 0
        for level in range(len(self.planes)):
            ones = self._rank1(level, at)
            if self._rank1(level, at + 1) > ones:
                value, at = value * 2 + 1, self.zeros[level] + ones
            else:
                value, at = value * 2, at - ones
        return value

    def _range(self, token: int, start: int, stop: int) -> tuple[int, int]:
        if token >> len(self.planes):
            return 0, 0
        for level in range(len(self.planes)):
            a, b = self._rank1(level, start), self._rank1(level, stop)
            if token >> (len(self.planes) - 1 - level) & 1:
                start, stop = self.zeros[level] + a, self.zeros[level] + b
            else:
                start, stop = start - a, stop - b
        return start, stop

    def count(self, token: int, start: int = 0, stop: int | None = None) -> int:
        """How often the id stands in places start to stop."""
        a, b = self._range(token, start, self.n if stop is None else stop)
        return b - a

    def locate(self, token: int, nth: int) -> int:
        """Place of the nth (from 0) occurrence of the id, or -1."""
        a, b = self._range(token, 0, self.n)
        if nth < 0 or a + nth >= b:
            return -1
        at = a + nth
        for level in range(len(self.planes) - 1, -1, -1):
            one = bool(token >> (len(self.planes) - 1 - level) & 1)
            at = self._select(level, one, at - self.zeros[level] if one else at)
        return at


def _packed(raw: bytes) -> tuple[list[int], bytes]:
    """Independent blocks; one that does not shrink is stored as it is (positive length)."""
    tool, sizes, out = zstandard.ZstdCompressor(level=1), [], []
    for i in range(0, len(raw), BLOCK):
        block = raw[i : i + BLOCK]
        small = tool.compress(block)
        sizes.append(-len(small) if len(small) < len(block) else len(block))
        out.append(small if len(small) < len(block) else block)
    return sizes, b"".join(out)


def write_shard(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """File: magic, header length, JSON header (sizes of all blocks), then the blocks of doc ids, lengths and planes."""
    matrix = WaveletMatrix.of(ids)
    known = np.array([d is not None for d in doc_ids], bool)
    parts = [np.packbits(known).tobytes(), np.array([d or 0 for d in doc_ids], "<i8").tobytes(), lengths.astype("<i8").tobytes(), *(p.tobytes() for p in matrix.planes)]
    packed = [_packed(p) for p in parts]
    header = json.dumps({"n": matrix.n, "docs": len(doc_ids), "zeros": matrix.zeros, "blocks": [s for s, _ in packed]}, separators=(",", ":")).encode()
    return b"".join([MAGIC, struct.pack("<I", len(header)), header, *(data for _, data in packed)])


def read_shard(content: bytes) -> tuple[list[int | None], np.ndarray, WaveletMatrix]:
    if content[:4] != MAGIC:
        raise ValueError("not a token shard")
    (size,) = struct.unpack_from("<I", content, 4)
    header, at, tool = json.loads(content[8 : 8 + size]), 8 + size, zstandard.ZstdDecompressor()
    parts = []
    for sizes in header["blocks"]:
        out = []
        for s in sizes:
            block = content[at : at + abs(s)]
            out.append(tool.decompress(block) if s < 0 else block)
            at += abs(s)
        parts.append(b"".join(out))
    known = np.unpackbits(np.frombuffer(parts[0], np.uint8), count=header["docs"])
    doc_ids = [int(d) if k else None for d, k in zip(np.frombuffer(parts[1], "<i8"), known)]
    planes = [np.frombuffer(p, np.uint8) for p in parts[3:]]
    return doc_ids, np.frombuffer(parts[2], "<i8"), WaveletMatrix(planes, header["zeros"], header["n"])


def _put(folder: str, name: str, data: bytes) -> None:
    """Write a file whole or not at all, so that a retried task leaves the same file."""
    from pyarrow import fs

    if urlparse(folder).scheme:
        system, path = fs.FileSystem.from_uri(folder)
    else:
        system, path = fs.LocalFileSystem(), folder
    system.create_dir(path, recursive=True)
    context = TaskContext.get()
    scratch = f"{path}/_{name}.{context.taskAttemptId() if context else 0}"
    with system.open_output_stream(scratch) as out:
        out.write(data)
    system.move(scratch, f"{path}/{name}")


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Write the ids of all documents, in ascending doc_id order, as wavelet shards into a shared folder.

    Returns one row per shard once all are written: part, shard, file, docs, tokens. The order of
    (part, shard) is the order of doc ids. Documents are range-partitioned and sorted by Spark;
    a task holds one shard of about `shard_tokens` ids at a time (a longer document is a shard of its
    own). File names come from part and number, and a file appears whole, so retries are harmless.

    Null or empty text is the end id alone. Null doc ids come first. Rows of one doc_id are ordered by
    text. An empty table writes nothing. Other columns are not looked at.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = TextEncoder.of(tokenizer, end_id), TaskContext.get().partitionId()
        held: list[tuple[list, np.ndarray, np.ndarray]] = []
        shard = size = 0

        def flush() -> pa.RecordBatch:
            nonlocal shard, size
            doc_ids = [d for x in held for d in x[0]]
            lengths, ids = (np.concatenate([x[i] for x in held]) for i in (1, 2))
            name = f"part-{part:06d}-{shard:06d}.wvm"
            _put(folder, name, write_shard(doc_ids, lengths, ids))
            row = pa.RecordBatch.from_pydict({"part": [part], "shard": [shard], "file": [name], "docs": [len(doc_ids)], "tokens": [len(ids)]}, pa.schema([("part", pa.int64()), ("shard", pa.int64()), ("file", pa.string()), ("docs", pa.int64()), ("tokens", pa.int64())]))
            held.clear()
            shard, size = shard + 1, 0
            return row

        for batch in slices(batches, most=4 << 20):
            ids, offsets = encoder.encode(*text_bytes(batch.column("text")))
            doc_ids = batch.column("doc_id").to_pylist()
            start = 0
            while start < len(doc_ids):
                stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + shard_tokens - size, "right")) - 1)
                held.append((doc_ids[start:stop], np.diff(offsets[start : stop + 1]), ids[offsets[start] : offsets[stop]]))
                size += len(held[-1][2])
                if size >= shard_tokens or stop < len(doc_ids):
                    yield flush()
                start = stop
        if held:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return ordered.mapInArrow(write, "part long, shard long, file string, docs long, tokens long")


def read_tokens(spark, folder: str, with_ids: bool = False) -> DataFrame:
    """Read shards back: one row per document with its file, its place there, and its ids' count and crc32."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("file").to_pylist(), batch.column("content")):
                doc_ids, lengths, matrix = read_shard(content.as_py())
                ids = matrix.all().astype("<u4")
                ends = np.cumsum(lengths)
                data = memoryview(ids.tobytes())
                crc = [zlib.crc32(data[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist())]
                columns = [pa.array([name] * len(doc_ids)), pa.array(doc_ids, pa.int64()), pa.array(ends - lengths), pa.array(lengths), pa.array(crc, pa.int64())]
                if with_ids:
                    columns.append(pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], ends])), pa.array(ids.astype(np.int64))).cast(pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(columns, names=["file", "doc_id", "place", "n_tokens", "ids_crc32", *["ids"] * with_ids])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wvm").load(folder)
    files = files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    schema = "file string, doc_id long, place long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    return files.mapInArrow(read, schema)


def token_places(shards: DataFrame) -> DataFrame:
    """`token_index` for any number of shards: file and the ids `before` it, of the rows `write_tokens` returned.

    Shards are summed inside their part, parts (as many as tasks wrote) among themselves. `shards` must be a
    written table: reading it twice must not write the files twice.
    """
    earlier = (Window.unboundedPreceding, -1)
    parts = shards.groupBy("part").agg(F.sum("tokens").alias("_all"))
    parts = parts.select("part", F.coalesce(F.sum("_all").over(Window.orderBy("part").rowsBetween(*earlier)), F.lit(0)).alias("_parts"))
    inside = F.coalesce(F.sum("tokens").over(Window.partitionBy("part").orderBy("shard").rowsBetween(*earlier)), F.lit(0))
    return shards.select("part", "file", inside.alias("_inside")).join(parts, "part").select("file", (F.col("_parts") + F.col("_inside")).alias("before"))


def token_index(shards: list[tuple[str, int]]) -> dict[str, int]:
    """Ids before each file, for files in order. One entry per shard of millions of ids."""
    before, out = 0, {}
    for name, tokens in shards:
        out[name] = before
        before += tokens
    return out
