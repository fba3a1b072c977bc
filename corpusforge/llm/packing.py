"""Packing of tokenised documents into fixed-length training sequences by vector bin packing."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from corpusforge.llm.arrays import slices, text_bytes
from corpusforge.llm.tokens import TextEncoder

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, segment long, loss_tokens long, ids array<int>"
_TASK_BITS = 36


@dataclass(frozen=True)
class Limits:
    """What one sequence may hold: tokens, pieces of documents, and tokens that bear loss."""

    tokens: int = 4096
    segments: int = 256
    loss: int = 4096

    def vector(self) -> np.ndarray:
        return np.array([self.tokens, self.segments, self.loss], float)


@dataclass
class Item:
    """What is left of a document: ids from `start` on; the first `free` of them bear no loss."""

    doc_id: int | None
    ids: np.ndarray
    start: int
    total: int
    free: int

    def loss(self, length: int | None = None) -> int:
        return max(0, (len(self.ids) if length is None else length) - self.free)

    def cut(self, tokens: int, loss: int) -> int:
        """The longest beginning within these limits."""
        return min(tokens, len(self.ids), self.free + loss)

    def split(self, length: int) -> tuple[Item, Item]:
        head = Item(self.doc_id, self.ids[:length], self.start, self.total, min(self.free, length))
        return head, Item(self.doc_id, self.ids[length:], self.start + length, self.total, max(0, self.free - length))


class Packer:
    """Streams items into sequences; holds at most `pool` waiting items.

    The sequence being filled takes, again and again, the waiting item that fits and has the largest
    dot product of its demand with the room left, each dimension weighted by the mean demand of the
    pool. When none fits, the largest waiting item is cut to fill the room.
    """

    def __init__(self, limits: Limits, pool: int = 2048):
        self.limits, self.pool = limits, pool
        self.items: list[Item | None] = []
        self.sequence = 0

    def add(self, item: Item) -> Iterator[tuple[int, int, int, Item]]:
        """Take one item; yields (sequence, segment, offset, piece) of what has been placed meanwhile."""
        while (length := item.cut(self.limits.tokens, self.limits.loss)) < len(item.ids) or length == self.limits.tokens:
            head, item = item.split(length)
            yield self.sequence, 0, 0, head
            self.sequence += 1
            if not len(item.ids):
                return
        self.items.append(item)
        if len(self.items) >= self.pool:
            yield from self.drain(self.pool // 4)

    def drain(self, keep: int = 0) -> Iterator[tuple[int, int, int, Item]]:
        """Fill sequences until at most `keep` items wait."""
        size = self.limits.vector()
        items = self.items
        demand = np.array([(len(x.ids), 1, x.loss()) for x in items], float).reshape(-1, 3) / size
        waiting = np.ones(len(items), bool)
        weight = demand.mean(0) if len(items) else np.ones(3)
        left = len(items)
        while left > keep:
            room, segment, offset = np.ones(3), 0, 0
            while left and offset < self.limits.tokens and segment < self.limits.segments:
                fits = waiting & (demand <= room + 1e-12).all(1)
                score = np.where(fits, demand @ (weight * room), -1.0)
                best = int(score.argmax())
                if score[best] >= 0:
                    piece = items[best]
                    waiting[best] = False
                    left -= 1
                else:
                    best = int(np.where(waiting, demand[:, 0], -1).argmax())
                    used = np.round((1 - room) * size)
                    length = items[best].cut(int(self.limits.tokens - offset), int(self.limits.loss - used[2]))
                    if length <= 0:
                        break
                    piece, items[best] = items[best].split(length)
                    demand[best] = np.array([len(items[best].ids), 1, items[best].loss()]) / size
                yield self.sequence, segment, offset, piece
                room = room - np.array([len(piece.ids), 1, piece.loss()]) / size
                offset += len(piece.ids)
                segment += 1
            self.sequence += 1
        self.items = [x for x, w in zip(items, waiting) if w]


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, limits: Limits = Limits(), with_ids: bool = False, prompt: str | None = None) -> DataFrame:
    """Pack whole documents into sequences; one row per piece of a document.

    `docs` needs doc_id and text; `prompt` names a column of text put before it whose tokens bear no
    loss. Each document is its ids and then `end_id`; every id lies in exactly one piece. Work stays
    within the scan's own splits: nothing is shuffled, each task packs what it reads through a pool
    of bounded size, and at most its last sequence is not full unless a limit other than the
    tokens ends it. `sequence_id` is the task's number and a running number.

    Null or empty text (and prompt) is a document of the end id alone. Repeated rows are packed
    as often as they come; a null doc_id stays null. Other columns of `docs` are not looked at.
    An empty table gives no rows.
    """
    if limits.tokens < 1 or limits.segments < 1 or limits.loss < 1:
        raise ValueError("limits must be at least 1")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer = TextEncoder.of(tokenizer, end_id), Packer(limits)
        task = TaskContext.get().partitionId() << _TASK_BITS
        rows: list[tuple] = []

        def note(placed) -> None:
            for sequence, segment, offset, piece in placed:
                data = np.ascontiguousarray(piece.ids, "<u4")
                ids = data.astype(np.int32).tolist() if with_ids else None
                rows.append((piece.doc_id, piece.start, len(data), zlib.crc32(data.tobytes()), piece.total, task + sequence, offset, segment, piece.loss(), ids))

        for batch in slices(batches, most=4 << 20):
            ids, offsets = encoder.encode(*text_bytes(batch.column("text")))
            if prompt is not None:
                head, bounds = encoder.encode(*text_bytes(batch.column("prompt")))
            for i, doc_id in enumerate(batch.column("doc_id").to_pylist()):
                own, free = ids[offsets[i] : offsets[i + 1]], 0
                if prompt is not None:
                    before = head[bounds[i] : bounds[i + 1] - 1]
                    own, free = np.concatenate([before, own]), len(before)
                note(packer.add(Item(doc_id, own.copy(), 0, len(own), free)))
            if len(rows) >= 10_000 or with_ids:
                yield _batch(rows)
                rows.clear()
        note(packer.drain())
        yield _batch(rows)

    columns = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")]
    if prompt is not None:
        columns.append(F.col(prompt).cast("string").alias("prompt"))
    packed = docs.select(*columns).mapInArrow(pack, SCHEMA)
    return packed if with_ids else packed.drop("ids")


_ARROW = pa.schema([(n, pa.int64()) for n in "doc_id start length ids_crc32 doc_tokens sequence_id offset segment loss_tokens".split()] + [("ids", pa.list_(pa.int32()))])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[]] * len(_ARROW)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW)], schema=_ARROW)
