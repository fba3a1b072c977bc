"""Numpy helpers that work on the UTF-8 bytes of many texts at once, inside Spark tasks."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 4 << 20
_RNG = np.random.default_rng(20240517)
_BYTE_CODES = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each holds about `most` bytes of text; one longer text stays alone."""
    for batch in batches:
        texts = batch.column(column)
        if not len(texts):
            continue
        ends = np.cumsum(byte_lengths(texts))
        start = 0
        while start < len(ends):
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + most, "right")))
            yield batch.slice(start, stop - start)
            start = stop
        del batch, texts, ends
        give_back()


def give_back() -> None:
    """Return freed memory to the system: workers outlive their tasks, and the next ones may be of another kind."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def byte_lengths(texts: pa.Array) -> np.ndarray:
    return pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column and the offsets of its texts; null counts as empty."""
    texts = pa.compute.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8, offsets[-1] - offsets[0], offsets[0]) if data is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def mix(x: np.ndarray) -> np.ndarray:
    """Finish a 64-bit hash so that all its bits depend on all bits of the input."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse, modulo 2**64."""
    if 0 not in _POWERS or len(_POWERS[0][0]) < n:
        size = 1 << max(16, int(n).bit_length())
        bases = (_BASE, pow(_BASE, -1, 1 << 64))
        up, down = (np.multiply.accumulate(np.array([1] + [b] * (size - 1), np.uint64)) for b in bases)
        _POWERS[0] = (up, down)
    return _POWERS[0]


def prefix_hash(raw: np.ndarray, codes: np.ndarray = _BYTE_CODES) -> np.ndarray:
    """H with H[j] = sum of code(raw[i]) * base**i over i < j; `span_hash` reads strings off it."""
    out = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(codes[raw] * powers(len(raw))[0][: len(raw)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte string raw[start:end], the same wherever the string stands."""
    return mix((prefix[ends] - prefix[starts]) * powers(len(prefix))[1][starts] + (ends - starts).astype(np.uint64))


def fold_table(separators: str = " \t\n\v\f\r", alphanumeric: bool = False) -> np.ndarray:
    """Byte to byte: A-Z become a-z, separators 0. With `alphanumeric`, all ASCII but letters and digits separate."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    table[[ord(c) for c in separators]] = 0
    if alphanumeric:
        keep = np.zeros(256, bool)
        keep[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
        table[~keep] = 0
    return table


class Words:
    """Words of many texts: `start` and `end` are byte places, text i owns words first[i]:first[i + 1]."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, table: np.ndarray):
        folded = table[raw]
        inside = folded != 0
        edge = np.zeros(len(raw) + 1, bool)
        edge[offsets] = True
        before, after = np.zeros(len(raw), bool), np.zeros(len(raw), bool)
        before[1:] = inside[:-1]
        after[:-1] = inside[1:]
        self.start = np.flatnonzero(inside & (~before | edge[:-1]))
        self.end = np.flatnonzero(inside & (~after | edge[1:])) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.folded = folded

    def hashes(self) -> np.ndarray:
        return span_hash(prefix_hash(self.folded), self.start, self.end)


def shingles(words: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of `size` words that stay inside one text, and the place of their first word."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = np.zeros(n, np.uint64)
    for i in range(size):
        out = (out + words[i : i + n]) * np.uint64(_BASE)
    crosses = np.zeros(len(words) + 1, bool)
    for i in range(1, size):
        at = first[1:-1] - i
        crosses[at[at >= 0]] = True
    place = np.flatnonzero(~crosses[:n])
    return mix(out[place]), place


def owners(first: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Which text each word place belongs to."""
    return np.searchsorted(first, places, "right") - 1


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All indices start, start + 1, ... of each range, one range after the other."""
    total = int(lengths.sum())
    shift = np.repeat(starts - np.concatenate([[0], np.cumsum(lengths)[:-1]]) if len(lengths) else starts, lengths)
    return shift + np.arange(total)
