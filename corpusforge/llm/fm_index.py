"""A bidirectional FM-index over the word ids of one shard of text."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import zstandard

from corpusforge.llm.arrays import ragged

#: Words up to which rotations are told apart, and so the longest phrase whose interval is kept.
DEPTH = 4


def _rotations(text: np.ndarray) -> np.ndarray:
    """Start places of the rotations of `text`, ordered by their first DEPTH symbols (by doubling)."""
    rank, have = text.astype(np.int64), 1
    order = np.arange(len(text))
    while have < DEPTH:
        pair = rank * (int(rank.max()) + 1) + np.roll(rank, -have)
        order = np.argsort(pair)
        change = np.diff(pair[order], prepend=pair[order[:1]]) != 0
        rank[order] = np.cumsum(change)
        have *= 2
    return order


@dataclass
class Intervals:
    """Phrases of one length: rows `lo` to `lo + n` of the index, and `back` to `back + n` of the index of the reversed text."""

    lo: np.ndarray
    back: np.ndarray
    n: np.ndarray

    def take(self, which: np.ndarray) -> Intervals:
        return Intervals(self.lo[which], self.back[which], self.n[which])


class WordIndex:
    """BWT of a text of ids and of its reverse; id 0 is a break that no phrase holds.

    `left[i]` is the word before the i-th rotation in order, `right[i]` the word behind the i-th
    rotation of the reversed text. Following a word from `left` by rank gives the rows of the
    phrase with that word in front, so one pass over a phrase's rows lists all its left
    extensions with their counts and intervals; likewise to the right. Both intervals are kept in
    step, so phrases can be extended at either end.
    """

    def __init__(self, left: np.ndarray, right: np.ndarray, size: int):
        self.left, self.right, self.size = left, right, size
        self.counts = np.bincount(left, minlength=size)
        self.first = np.cumsum(self.counts) - self.counts
        self._steps: dict[bool, tuple[np.ndarray, np.ndarray]] = {}

    @classmethod
    def of(cls, ids: np.ndarray, size: int) -> WordIndex:
        """Index of ids below `size`; runs of breaks count as one."""
        text = np.concatenate([[0], ids, [0]]).astype(np.int32)
        text = text[np.append(True, (text[1:] != 0) | (text[:-1] != 0))]
        back = text[::-1]
        return cls(np.roll(text, 1)[_rotations(text)], np.roll(back, 1)[_rotations(back)], size)

    def to_bytes(self) -> tuple[bytes, bytes]:
        tool = zstandard.ZstdCompressor(level=1)
        return tool.compress(self.left.astype("<i4").tobytes()), tool.compress(self.right.astype("<i4").tobytes())

    @classmethod
    def from_bytes(cls, left: bytes, right: bytes, size: int) -> WordIndex:
        tool = zstandard.ZstdDecompressor()
        return cls(*(np.frombuffer(tool.decompress(x), "<i4") for x in (left, right)), size)

    def _step(self, to_left: bool) -> tuple[np.ndarray, np.ndarray]:
        """For each row, the row of the rotation that starts one word earlier: first row of its word plus the word's rank.

        And all (word, row) in order, as word * rows + row: a place there is that same sum, for any row.
        """
        if to_left not in self._steps:
            symbols = self.left if to_left else self.right
            pairs = symbols.astype(np.int64) * len(symbols) + np.arange(len(symbols))
            order, step = np.argsort(pairs), np.empty(len(symbols), np.int64)
            step[order] = np.arange(len(symbols))
            self._steps[to_left] = step, pairs[order]
        return self._steps[to_left]

    def words(self) -> tuple[np.ndarray, Intervals]:
        """All words that occur, and their intervals."""
        ids = np.flatnonzero(self.counts[1:]) + 1
        return ids, Intervals(self.first[ids], self.first[ids], self.counts[ids])

    def extend(self, phrases: Intervals, to_left: bool) -> tuple[np.ndarray, np.ndarray, Intervals]:
        """All extensions by one word: (number of the phrase, the word, intervals of the longer phrases)."""
        symbols, (step, _) = self.left if to_left else self.right, self._step(to_left)
        near, far = (phrases.lo, phrases.back) if to_left else (phrases.back, phrases.lo)
        rows = ragged(near, phrases.n)
        owner = np.repeat(np.arange(len(near)), phrases.n)
        to = step[rows]
        # Rows of one phrase and word step to rows that follow each other.
        order = np.argsort(owner * len(symbols) + to)
        owner, to, word = owner[order], to[order], symbols[rows[order]]
        start = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (word[1:] != word[:-1]))) if len(to) else np.zeros(0, np.int64)
        n = np.diff(start, append=len(to))
        owner, word, to = owner[start], word[start], to[start]
        # The other interval is parted by the added word, breaks first.
        aside = far[owner] + start - (np.cumsum(phrases.n) - phrases.n)[owner]
        real = word != 0
        lo, back = (to, aside) if to_left else (aside, to)
        return owner[real], word[real], Intervals(lo, back, n).take(real)

    def longer(self, phrases: Intervals) -> tuple[np.ndarray, np.ndarray, Intervals]:
        """Extensions to the left whose own beginning is among `phrases` as well: (phrase behind the first word, first word, intervals).

        Those are the phrases listed from both sides: by a word in front of one of `phrases` and by a
        word behind another.
        """
        owner, word, left = self.extend(phrases, True)
        _, _, right = self.extend(phrases, False)
        both = np.flatnonzero(np.isin(left.lo, right.lo, assume_unique=True))
        return owner[both], word[both], left.take(both)

    def _search(self, phrases: np.ndarray, to_left: bool) -> tuple[np.ndarray, np.ndarray]:
        """First rows and counts of many phrases, the word searched last in column 0."""
        pairs, rows = self._step(to_left)[1], len(self.left)
        at, n = self.first[phrases[:, -1]], self.counts[phrases[:, -1]]
        for i in range(phrases.shape[1] - 2, -1, -1):
            base = phrases[:, i].astype(np.int64) * rows + at
            at = np.searchsorted(pairs, base)
            n = np.searchsorted(pairs, base + n) - at
        return at, n

    def find(self, phrases: np.ndarray) -> Intervals:
        """Intervals of phrases of equal length (rows of ids), of up to DEPTH + 1 words, by backward search in both directions."""
        lo, n = self._search(phrases, True)
        back, _ = self._search(phrases[:, ::-1], False)
        return Intervals(lo, back, n)
