"""Packing of whole documents into as few sequences as possible, planned over the histogram of lengths."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from corpusforge.llm.arrays import ragged, slices, text_bytes
from corpusforge.llm.configurations import Plan, plan
from corpusforge.llm.tokens import TextEncoder
from corpusforge.session import materialize

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task long, nth long"
_RANK_BITS = 44


def cut_pieces(docs: DataFrame, tokenizer: str, end_id: int, limit: int, with_ids: bool = False) -> DataFrame:
    """Tokens of each document with `end_id` behind, cut only where one is longer than `limit`; one row per piece.

    `nth` counts the pieces of equal length within a task, so together with `task` it numbers them
    without moving any. Columns: doc_id, piece, start, length, ids_crc32, task, nth (and ids).
    """
    fields = [pa.field(n, pa.int32() if n == "piece" else pa.int64()) for n in "doc_id piece start length ids_crc32 task nth".split()]
    if with_ids:
        fields.append(pa.field("ids", pa.list_(pa.int32())))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task = TextEncoder.of(tokenizer, end_id), TaskContext.get().partitionId()
        seen = np.zeros(limit + 1, np.int64)
        for batch in slices(batches):
            ids, offsets = encoder.encode(*text_bytes(batch.column("text")))
            sizes = np.diff(offsets)
            pieces = -(-sizes // limit)
            owner = np.repeat(np.arange(len(sizes)), pieces)
            number = ragged(np.zeros(len(sizes), np.int64), pieces)
            start = number * limit
            length = np.minimum(limit, sizes[owner] - start)
            order = np.argsort(length, kind="stable")
            kinds, first, times = np.unique(length[order], return_index=True, return_counts=True)
            nth = np.empty(len(length), np.int64)
            nth[order] = np.arange(len(order)) - np.repeat(first, times) + seen[length[order]]
            seen[kinds] += times
            at = offsets[owner] + start
            data = memoryview(np.ascontiguousarray(ids, "<u4").tobytes())
            crc = [zlib.crc32(data[4 * a : 4 * (a + n)]) for a, n in zip(at.tolist(), length.tolist())]
            columns = [batch.column("doc_id").take(pa.array(owner)), pa.array(number.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(np.full(len(length), task)), pa.array(nth)]
            if with_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(np.append(at, len(ids)).astype(np.int32)), pa.array(ids.astype(np.int32))))
            yield pa.RecordBatch.from_arrays(columns, schema=pa.schema(fields))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(cut, PIECES + ", ids array<int>" * with_ids)


class Slots:
    """Where the pieces of each length go: the first of them into the first configuration that holds the length, and so on."""

    def __init__(self, made: Plan):
        rows, base, filled = [], 0, {}
        for c in made.configurations:
            offset = 0
            for length, times in zip(c.lengths, c.counts):
                first = filled.get(length, 0)
                rows.append(((length << _RANK_BITS) + first, times, base, offset))
                filled[length] = first + times * c.copies
                offset += length * times
            base += c.copies
        self.first, self.times, self.base, self.offset = np.array(sorted(rows), np.int64).reshape(-1, 4).T

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset there of the piece that is number `rank` (from 0) of its length."""
        key = (length << _RANK_BITS) + rank
        slot = np.searchsorted(self.first, key, "right") - 1
        copy, within = np.divmod(key - self.first[slot], self.times[slot])
        return self.base[slot] + copy, self.offset[slot] + within * length


def histogram(pieces: DataFrame) -> dict[int, int]:
    """How many pieces each length has: at most one row per possible length comes to the driver."""
    return {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}


def pack_whole(docs: DataFrame, tokenizer: str, end_id: int, limit: int = 2048, with_ids: bool = False) -> DataFrame:
    """Pack documents into sequences of at most `limit` tokens, as few as the configuration program finds; one row per piece.

    `docs` needs doc_id and text. A document is its ids and then `end_id`; only one longer than
    `limit` is cut, into pieces of `limit`. Columns: doc_id, piece, start (ids of its document
    before it), length, ids_crc32, sequence_id, offset (and ids).

    Texts are read once. The driver sees the histogram of lengths and makes the plan, whose size
    depends on `limit` alone. A piece finds its place by its number among the pieces of its length:
    its number within its task plus the counts of the tasks before, one row per task and length.
    No piece is gathered with others, so one length may hold any share of all rows.

    Null or empty text is a document of the end id alone. Repeated rows are packed as often as they
    come; a null doc_id stays null. Other columns are not looked at. An empty table gives no rows.
    """
    if not 1 <= limit < 1 << 18:
        raise ValueError("limit must lie in 1..262143")
    pieces = materialize(cut_pieces(docs, tokenizer, end_id, limit, with_ids), "pieces")
    slots = Slots(plan(histogram(pieces), limit))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    earlier = pieces.groupBy("length", "task").agg(F.count("*").alias("n")).select("length", "task", before.alias("before"))
    ranked = pieces.join(earlier, ["length", "task"]).withColumn("rank", F.col("before") + F.col("nth"))
    kept = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            sequence, offset = slots.place(length, rank)
            columns = [batch.column(c) for c in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence), pa.array(offset)], names=[*kept, "sequence_id", "offset"])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids + ", sequence_id long, offset long"
    return ranked.select(*kept, "rank").mapInArrow(place, schema)
