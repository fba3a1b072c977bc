"""Token ids of whole texts, computed once per distinct piece of text."""

from __future__ import annotations

import gc
import os
import sys
import types

import numpy as np

from corpusforge.llm.arrays import fold_table, give_back, prefix_hash, ragged, span_hash

KEEP = 1_500_000
_SPACES = np.zeros(256, bool)
_SPACES[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
_LETTERS = np.zeros(256, bool)
_LETTERS[[*range(65, 91), *range(97, 123)]] = True
_STOPS = np.zeros(256, bool)
_STOPS[[44, 46]] = True
# White space beyond ASCII starts with one of these bytes.
_WIDE = np.zeros(256, bool)
_WIDE[[0xC2, 0xE1, 0xE2, 0xE3]] = True


def worker_state() -> dict:
    """A dictionary that lives as long as the Python worker, so later tasks find what earlier ones loaded."""
    return vars(sys.modules.setdefault("_corpusforge_worker", types.ModuleType("_corpusforge_worker"))).setdefault("state", {})


def forget() -> None:
    """Drop what earlier tasks have loaded into this worker: a worker may serve operators that have no use for it."""
    if worker_state():
        worker_state().clear()
        gc.collect()
    give_back()


class TextEncoder:
    """Ids of texts by a tokenizers file, equal to encoding each whole text with it.

    No token of the two public vocabularies reaches across a space between two characters that are
    no white space, nor across the border of an ASCII letter and a comma or full stop. So texts are
    cut there, and the tokenizer sees every distinct piece once per Python worker; pieces are known
    by a 64-bit hash with their length. A space belongs to the piece behind it. Where white space
    matters (no normalizer drops it), texts with runs of it, or with any beyond ASCII, are encoded
    whole. Strings of special tokens are plain text.
    """

    def __init__(self, path: str, end_id: int):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.end_id = end_id
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.drops_spaces = self.tokenizer.normalizer is not None
        self.table = fold_table() if self.drops_spaces else np.arange(256, dtype=np.uint8)
        self.reset()

    def reset(self) -> None:
        self.known, self.number = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.start = self.length = np.zeros(0, np.int64)

    @classmethod
    def of(cls, path: str, end_id: int) -> TextEncoder:
        state = worker_state()
        if ("encoder", path, end_id) not in state:
            state["encoder", path, end_id] = cls(path, end_id)
        return state["encoder", path, end_id]

    def whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, hashes: np.ndarray, pieces: list[str]) -> None:
        ids = self.whole(pieces)
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter((i for x in ids for i in x), np.uint32, int(lengths.sum()))
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + len(flat)] = flat
        known = np.concatenate([self.known, hashes])
        number = np.concatenate([self.number, len(self.start) + np.arange(len(hashes))])
        order = np.argsort(known, kind="stable")
        self.known, self.number = known[order], number[order]
        self.start = np.concatenate([self.start, self.used + np.cumsum(lengths) - lengths])
        self.length = np.concatenate([self.length, lengths])
        self.used += len(flat)

    def _cuts(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of pieces, and which texts must be encoded whole."""
        edge = np.zeros(len(raw) + 1, bool)
        edge[offsets] = True
        stop = _STOPS[raw]
        stop[1:] &= _LETTERS[raw[:-1]]
        stop[:1] = False
        if self.drops_spaces:
            inside = self.table[raw] != 0
            opens = inside.copy()
            opens[1:] &= ~inside[:-1] | edge[1:-1] | stop[1:]
            starts = np.flatnonzero(opens)
            shuts = inside.copy()
            shuts[:-1] &= ~inside[1:] | edge[1:-1] | stop[1:]
            return starts, np.flatnonzero(shuts) + 1, np.zeros(0, np.int64)
        space = _SPACES[raw]
        bad = space.copy()
        bad[1:] &= space[:-1] & ~edge[1:-1]
        bad[:1] = False
        at = np.flatnonzero(_WIDE[raw])
        if len(at):
            a, b, c = raw[at], raw[np.minimum(at + 1, len(raw) - 1)], raw[np.minimum(at + 2, len(raw) - 1)]
            wide = (a == 0xC2) & ((b == 0x85) | (b == 0xA0)) | (a == 0xE1) & (b == 0x9A) & (c == 0x80) | (a == 0xE3) & (b == 0x80) & (c == 0x80)
            wide |= (a == 0xE2) & ((b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF)) | (b == 0x81) & (c == 0x9F))
            bad[at[wide]] = True
        # A line end between two other characters is a piece of its own.
        line = raw == 10
        after = np.zeros(len(raw), bool)
        after[1:] = line[:-1]
        cut = edge[:-1] | stop | line | after | (raw == 32)
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], len(raw)) if len(starts) else starts
        return starts, ends, np.unique(np.searchsorted(offsets, np.flatnonzero(bad), "right") - 1)

    def encode(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of all texts (UTF-8 bytes and offsets), each with the end id behind, and their offsets."""
        if len(self.known) > KEEP:
            self.reset()
        n = len(offsets) - 1
        starts, ends, strange = self._cuts(raw, offsets)
        folded = self.table[raw]
        hashes = span_hash(prefix_hash(folded), starts, ends)
        unique, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        spot = np.searchsorted(self.known, unique)
        new = np.ones(len(unique), bool)
        within = spot < len(self.known)
        new[within] = self.known[spot[within]] != unique[within]
        if new.any():
            data, at = folded.tobytes(), first[new]
            self._learn(unique[new], [data[a:b].decode("utf-8", "replace") for a, b in zip(starts[at].tolist(), ends[at].tolist())])
            spot = np.searchsorted(self.known, unique)
        numbers = self.number[spot][which] if len(unique) else np.zeros(0, np.int64)
        lengths = self.length[numbers]
        edges = np.searchsorted(starts, offsets)
        redone = {i: np.array(ids, np.uint32) for i, ids in zip(strange.tolist(), self.whole([bytes(raw[offsets[i] : offsets[i + 1]]).decode("utf-8", "replace") for i in strange]) if len(strange) else [])}
        for i in redone:
            lengths[edges[i] : edges[i + 1]] = 0
        run = np.concatenate([[0], np.cumsum(lengths)])
        sizes = run[edges[1:]] - run[edges[:-1]]
        extra = np.zeros(n, np.int64)
        for i, ids in redone.items():
            extra[i] = len(ids)
        out_offsets = np.concatenate([[0], np.cumsum(sizes + extra + 1)])
        out = np.full(int(out_offsets[-1]), self.end_id, np.uint32)
        # Every text's own run moves by the end ids and whole texts before it.
        place = ragged(out_offsets[:-1], sizes)
        out[place] = self.flat[ragged(self.start[numbers], lengths)]
        for i, ids in redone.items():
            out[out_offsets[i] : out_offsets[i] + len(ids)] = ids
        return out, out_offsets
