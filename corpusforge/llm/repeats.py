"""Places in texts that the texts' own bytes choose, the same wherever a passage stands."""

from __future__ import annotations

import numpy as np

from corpusforge.llm.arrays import powers, prefix_hash

GRAM = 16


def sliding_minimum(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of x[i : i + width] for every i that has a full window."""
    n = len(x)
    if n < width:
        return x[:0]
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(x.dtype).max, x.dtype)
    padded[:n] = x
    table = padded.reshape(blocks, width)
    forward = np.minimum.accumulate(table, axis=1).ravel()
    backward = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(backward[: n - width + 1], forward[width - 1 : n])


def anchors(raw: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors with the strings they stand for: arrays text, place, first start, last start (in the whole buffer).

    A string of `length` bytes is anchored at that of its first length // 2 places whose 16-byte gram
    has the least hash (the first such place). Equal strings have equal anchors, at the same distance,
    and the strings of one anchor start at neighbouring places.
    """
    width = length // 2
    sizes = np.diff(offsets)
    out = []
    if len(raw) >= length:
        prefix = prefix_hash(raw)
        at = np.arange(len(raw) - GRAM + 1)
        # A weak hash will do here: it only has to be the same for equal grams.
        grams = (prefix[GRAM:] - prefix[:-GRAM]) * powers(len(prefix))[1][: len(at)]
        # The place in the low bits makes values unique, and of equal grams the first the least.
        ranks = (grams & ~np.uint64((1 << 32) - 1)) | (at.astype(np.uint64) & np.uint64((1 << 32) - 1))
        for text in np.flatnonzero(sizes >= length):
            a, b = int(offsets[text]), int(offsets[text + 1])
            own = ranks[a : b - length + width]
            least = sliding_minimum(own, width)
            least = least[: b - a - length + 1]
            change = np.flatnonzero(np.append(True, least[1:] != least[:-1]))
            place = (least[change] & np.uint64((1 << 32) - 1)).astype(np.int64)
            last = np.append(change[1:], len(least)) - 1
            out.append((np.full(len(change), text), place, change + a, last + a))
    if not out:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    return tuple(np.concatenate(c) for c in zip(*out))
