"""Patterns of lengths that fill sequences: a configuration linear program over a length histogram.

The program: choose how often each configuration (a multiset of lengths that fits one sequence) is
used, so that every length is covered as often as it occurs and as few sequences as possible are
used. Everything here works on the histogram alone, whose size is the sequence length, whatever the
number of documents.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass(frozen=True)
class Configuration:
    """`copies` sequences, each with `counts[i]` pieces of `lengths[i]`, longest first."""

    lengths: tuple[int, ...]
    counts: tuple[int, ...]
    copies: int


@dataclass
class Plan:
    """Configurations that hold every length exactly as often as the histogram does."""

    limit: int
    configurations: list[Configuration] = field(default_factory=list)
    #: No packing of the histogram has fewer sequences than this.
    lower_bound: int = 0

    @property
    def sequences(self) -> int:
        return sum(c.copies for c in self.configurations)


def best_fills(limit: int, lengths: np.ndarray, most: np.ndarray, prices: np.ndarray, batch: int = 8) -> tuple[float, list[list[tuple[int, int]]]]:
    """Worth of the sequence worth most, and up to `batch` fills (index of length, times; longest first), by knapsack dynamic programming.

    A length may be taken up to `most` times; multiples are split into powers of two, so that
    each step is one vector operation over all capacities. Lengths enter in ascending order, so the same table
    also holds the best fill without the longest ones: the fills after the first leave out the
    longest piece of the one before, and end where that would waste more room.
    """
    items: list[tuple[int, int, int]] = []
    for i, (length, count) in enumerate(zip(lengths.tolist(), np.minimum(most, limit // lengths).tolist())):
        times = 1
        while count > 0:
            times = min(times, count)
            items.append((i, times, times * length))
            count, times = count - times, times * 2
    worth, taken = np.zeros(limit + 1), np.zeros((len(items), limit + 1), bool)
    for k, (i, times, size) in enumerate(items):
        with_it = worth[: limit + 1 - size] + prices[i] * times
        np.greater(with_it, worth[size:], out=taken[k, size:])
        np.maximum(worth[size:], with_it, out=worth[size:])
    fills: list[list[tuple[int, int]]] = []
    top, least = len(items), 0
    while top and len(fills) < batch:
        room, found = limit, {}
        for k in range(top - 1, -1, -1):
            if taken[k, room]:
                i, times, size = items[k]
                found[i] = found.get(i, 0) + times
                room -= size
        if not found or limit - room < least:
            break
        least = limit - room
        fills.append(sorted(found.items(), reverse=True))
        while top and items[top - 1][0] >= fills[-1][0][0]:
            top -= 1
    return float(worth[limit]), fills


def start_prices(limit: int, lengths: np.ndarray, steep: float) -> np.ndarray:
    """Worth of a piece before anything is covered: its share of a sequence, and by `steep` more for long ones, which are the hardest to place."""
    part = lengths / limit
    return part * (1 + steep * part)


def fractional(limit: int, lengths: np.ndarray, counts: np.ndarray, steep: float = 0.2, rate: float = 0.2, step: float = 0.5) -> tuple[dict[tuple, float], float]:
    """Solve the program about by multiplicative weights: (configuration -> uses, lower bound).

    Each round prices a piece by its start price times a weight, exp(-rate * cover), that falls with the part of
    its length's demand covered so far; finds the best fills at these prices; and uses each so often
    that its scarcest length gains `step` of its demand, or what is left of it. Every length ends covered
    exactly once. Any prices bound the program from below by the worth of all demand over the
    worth of the best fill. A configuration is indices of lengths with times, the longest first.
    """
    uses: dict[tuple, float] = {}
    cover = np.zeros(len(lengths))
    worth, _ = best_fills(limit, lengths, counts, lengths / limit, 1)
    bound = float(lengths @ counts) / limit / worth
    waiting = np.arange(len(lengths))
    while len(waiting):
        prices = start_prices(limit, lengths[waiting], steep) * np.exp(-rate * cover[waiting])
        worth, fills = best_fills(limit, lengths[waiting], counts[waiting], prices)
        if len(waiting) == len(lengths):
            bound = max(bound, float(prices @ counts) / worth)
        for fill in fills:
            index, times = waiting[[i for i, _ in fill]], np.array([t for _, t in fill])
            amount = float((np.minimum(step, 1 - cover[index]) * counts[index] / times).min())
            if amount <= 1e-9:
                continue
            key = tuple(zip(index.tolist(), times.tolist()))
            uses[key] = uses.get(key, 0.0) + amount
            cover[index] += amount * times / counts[index]
        waiting = waiting[cover[waiting] < 1 - 1e-9]
    return uses, bound


def rounded(uses: dict[tuple, float], counts: np.ndarray) -> tuple[dict[tuple, int], np.ndarray]:
    """Whole uses and the demand they leave: all are rounded down, then, from the largest lost part on, up while demand lasts."""
    left, whole = counts.copy(), {}
    for key, amount in uses.items():
        if copies := int(amount + 1e-9):
            whole[key] = copies
            for i, times in key:
                left[i] -= copies * times
    for key in sorted(uses, key=lambda k: (int(uses[k]) - uses[k], k)):
        if uses[key] > int(uses[key] + 1e-9) and all(left[i] >= times for i, times in key):
            whole[key] = whole.get(key, 0) + 1
            for i, times in key:
                left[i] -= times
    return whole, left


def fill_up(limit: int, lengths: np.ndarray, counts: np.ndarray, steep: float = 0.2) -> dict[tuple, int]:
    """Place all that rounding left by the same fills at start prices, each as often as it can be."""
    out: dict[tuple, int] = {}
    left = counts.copy()
    while len(index := np.flatnonzero(left)):
        _, fills = best_fills(limit, lengths[index], left[index], start_prices(limit, lengths[index], steep))
        for fill in fills:
            copies = min(int(left[index[i]]) // t for i, t in fill)
            if copies:
                key = tuple((int(index[i]), t) for i, t in fill)
                out[key] = out.get(key, 0) + copies
                for i, t in key:
                    left[i] -= copies * t
    return out


# Extra worth of long pieces, rate at which covered lengths lose worth, and step of each solution tried. The first
# wins where pieces must be matched in threes and more, the second where long pieces need the right short ones.
SOLUTIONS = ((0.2, 0.2, 0.5), (1.0, 0.02, 1.0))


def plan(histogram: dict[int, int], limit: int) -> Plan:
    """Configurations that hold each length of the histogram exactly, in about as few sequences as the program allows.

    The program is solved and rounded, and what that leaves (less than one use of each configuration) is filled
    up fill by fill; of `SOLUTIONS` the one with the fewest sequences is taken. Lengths of exactly `limit` are
    sequences of their own. Equal histograms give equal plans; an empty one gives no
    configuration. `lower_bound` holds for every packing, so the distance from the best is known.
    """
    if any(not 1 <= length <= limit for length in histogram):
        raise ValueError(f"lengths must lie in 1..{limit}")
    lengths = np.array(sorted(n for n in histogram if histogram[n] and n < limit), np.int64)
    counts = np.array([histogram[n] for n in lengths.tolist()], np.int64)
    whole = histogram.get(limit, 0)
    out = Plan(limit, [Configuration((limit,), (1,), whole)] if whole else [], whole)
    if not len(lengths):
        return out
    best: dict[tuple, int] | None = None
    for steep, rate, step in SOLUTIONS:
        uses, bound = fractional(limit, lengths, counts, steep, rate, step)
        total, left = rounded(uses, counts)
        for key, copies in fill_up(limit, lengths, left, steep).items():
            total[key] = total.get(key, 0) + copies
        if best is None or sum(total.values()) < sum(best.values()):
            best = total
        out.lower_bound = max(out.lower_bound, whole + int(np.ceil(bound - 1e-6)))
    for key in sorted(best, reverse=True):
        out.configurations.append(Configuration(tuple(int(lengths[i]) for i, _ in key), tuple(t for _, t in key), best[key]))
    return out
