"""Front-coded sorted runs of equal-length strings, and their merge by a loser tree that knows common prefixes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np


def common_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix of two strings that are known to agree in their first `known` bytes."""
    n = min(len(a), len(b))
    x = int.from_bytes(a[known:n], "big") ^ int.from_bytes(b[known:n], "big")
    return n - (x.bit_length() + 7) // 8 if x else n


def encode_run(strings: list[bytes]) -> tuple[np.ndarray, bytes]:
    """Front coding of sorted strings: each one's common prefix with the one before, and the rest of it."""
    prefixes, tails, before = np.zeros(len(strings), np.uint16), [], b""
    for i, s in enumerate(strings):
        p = common_prefix(before, s)
        prefixes[i] = p
        tails.append(s[p:])
        before = s
    return prefixes, b"".join(tails)


def decode_run(prefixes: np.ndarray, tails: bytes, length: int) -> Iterator[tuple[bytes, int]]:
    """The strings of a run and their common prefixes with the one before."""
    at, before = 0, b""
    for p in prefixes.tolist():
        end = at + length - p
        before = before[:p] + tails[at:end]
        at = end
        yield before, p


def merge_runs(runs: list[Iterator[tuple[bytes, int]]]) -> Iterator[tuple[int, bytes, int]]:
    """Merge sorted runs; yields (run, string, common prefix with the string yielded before).

    Every waiting string knows its common prefix with the last one yielded. Of two of them the one
    with the longer prefix is smaller, without a look at the bytes; with equal prefixes the
    comparison starts behind them, and the loser keeps what was found. So no byte known to be common is
    ever compared again.
    """
    k = 1
    while k < max(1, len(runs)):
        k *= 2
    heads: list[bytes | None] = [None] * k
    prefix = [0] * k
    for i, run in enumerate(runs):
        first = next(run, None)
        if first is not None:
            heads[i] = first[0]
    losers = [-1] * k

    def play(a: int, b: int) -> tuple[int, int]:
        """Winner and loser of two runs."""
        x, y = heads[a], heads[b]
        if x is None or y is None:
            return (b, a) if x is None else (a, b)
        p, q = prefix[a], prefix[b]
        if p != q:
            return (a, b) if p > q else (b, a)
        shared = common_prefix(x, y, p)
        if x[shared:] <= y[shared:]:
            prefix[b] = shared
            return a, b
        prefix[a] = shared
        return b, a

    winners = [*([0] * k), *range(k)]
    for node in range(k - 1, 0, -1):
        winners[node], losers[node] = play(winners[2 * node], winners[2 * node + 1])
    winner = winners[1]
    while heads[winner] is not None:
        yield winner, heads[winner], prefix[winner]
        following = next(runs[winner], None)
        heads[winner], prefix[winner] = following if following is not None else (None, 0)
        node = (winner + k) // 2
        while node:
            winner, losers[node] = play(winner, losers[node])
            node //= 2
