"""Cutting stock by column generation over a histogram of lengths.

The linear program has one row per length and one column per pattern (how many pieces of each length fill a
sequence). It begins with the basis of a greedy filling. Prices of the lengths come from the basis; a knapsack by
dynamic programming finds the pattern that is worth most at these prices; it enters the basis; this goes on until
the bound of the prices or of the lengths themselves is within `gap`. The columns are rounded to whole sequences,
and what is left is filled greedily. All sizes are bounded by the capacity, not by the number of pieces.
"""

from __future__ import annotations

import math

import numpy as np

Pattern = dict[int, int]  # length -> pieces


def greedy_pattern(rest: np.ndarray, capacity: int) -> Pattern:
    """The longest length left, then the one that fills the gap, or else the longest that fits.

    `rest[l]` is what is left of length l; a pattern never takes more whole pieces than that (one at least).
    """
    pattern: Pattern = {}
    there = np.flatnonzero(rest > 0)
    gap = capacity
    while gap and len(there):
        there = there[there <= gap]
        if not len(there):
            break
        length = int(there[-1])
        # with two more pieces that fill the gap, if there are such
        if length < gap:
            other = gap - there
            pairs = there[(other > 0) & np.isin(other, there)]
            if len(pairs):
                length = int(pairs[-1])
        take = int(min(gap // length, max(1, math.floor(rest[length]) - pattern.get(length, 0))))
        pattern[length] = pattern.get(length, 0) + take
        gap -= take * length
        if pattern[length] >= rest[length]:
            there = there[there != length]
    return pattern


def _times(pattern: Pattern, rest: np.ndarray) -> float:
    return min(rest[l] / n for l, n in pattern.items())


def knapsack(prices: np.ndarray, capacity: int) -> tuple[float, Pattern]:
    """The pattern of the highest price; prices[l] is that of a piece of length l (0: not wanted)."""
    worth = np.where(prices > 1e-12, prices, -1.0)
    best = np.zeros(capacity + 1)
    taken = np.zeros(capacity + 1, np.int64)
    for c in range(1, capacity + 1):
        value = best[:c][::-1] + worth[1:c + 1]  # a last piece of length 1, 2 .. c
        i = int(value.argmax())
        if value[i] > best[c - 1] + 1e-13:
            best[c], taken[c] = value[i], i + 1
        else:
            best[c] = best[c - 1]
    pattern: Pattern = {}
    c = capacity
    while c > 0:
        if taken[c]:
            pattern[int(taken[c])] = pattern.get(int(taken[c]), 0) + 1
            c -= int(taken[c])
        else:
            c -= 1
    return float(best[capacity]), pattern


def column_generation(demand: np.ndarray, capacity: int, gap: float = 0.0005, most: int = 250) -> list[tuple[Pattern, float]]:
    """Patterns with how often each is used (a fraction), within `gap` of the least number of sequences."""
    lengths = np.flatnonzero(demand > 0)
    m = len(lengths)
    if not m:
        return []
    row = {int(l): i for i, l in enumerate(lengths)}
    # equal demands make the simplex stand still; a little more of each length, different for all, prevents that
    demand = np.where(demand > 0, demand + 0.01 * ((np.arange(len(demand)) * 0.6180339887) % 1), 0.0)
    rest = demand.copy()
    basis: list[Pattern | None] = [None] * m
    x = np.zeros(m)
    order = []  # rows in the order in which the greedy columns used them up
    while (rest > 0).any():
        pattern = greedy_pattern(rest, capacity)
        times = _times(pattern, rest)
        for l, n in pattern.items():
            rest[l] -= n * times
        used_up = [l for l in pattern if rest[l] <= 1e-9 * max(1.0, demand[l])]
        for l in used_up:
            rest[l] = 0
        basis[row[used_up[0]]], x[row[used_up[0]]] = pattern, times
        order.append(row[used_up[0]])
        for l in used_up[1:]:  # a column of the length alone, at zero
            basis[row[l]] = {l: capacity // l}
            order.append(row[l])

    def column(pattern: Pattern) -> np.ndarray:
        out = np.zeros(m)
        for l, n in pattern.items():
            out[row[l]] = n
        return out

    def inverse() -> np.ndarray:
        return np.linalg.inv(np.column_stack([column(p) for p in basis]))

    inv = inverse()
    material = float((demand * np.arange(len(demand))).sum()) / capacity
    prices = np.zeros(capacity + 1)
    for step in range(most):
        prices[lengths] = inv.sum(axis=0)
        value, pattern = knapsack(prices, capacity)
        total = x.sum()
        if value <= 1 + 1e-7 or total <= (1 + gap) * max(material, total / value):
            break
        move = inv[:, [row[l] for l in pattern]] @ np.array(list(pattern.values()), float)
        can = move > 1e-7
        if not can.any():
            break
        ratio = np.where(can, x / np.where(can, move, 1), np.inf)
        step_size = ratio.min()
        out = int(np.where(ratio <= step_size + 1e-9, move, 0).argmax())  # the safest pivot of those that tie
        x = np.maximum(x - step_size * move, 0)
        x[out] = step_size
        basis[out] = pattern
        if step % 200 == 199:
            inv = inverse()
        else:
            pivot = inv[out] / move[out]
            inv -= np.outer(move, pivot)
            inv[out] = pivot
    return [(p, float(t)) for p, t in zip(basis, x) if t > 1e-9]


def cut(demand: np.ndarray, capacity: int, gap: float = 0.0005) -> list[tuple[Pattern, int]]:
    """Patterns with whole numbers of sequences, that take each of demand[l] pieces of every length l exactly once."""
    rest = demand.astype(np.int64).copy()
    out: list[tuple[Pattern, int]] = []
    if rest[capacity]:
        out.append(({capacity: 1}, int(rest[capacity])))
        rest[capacity] = 0
    fractions = column_generation(rest[: capacity + 1], capacity, gap)
    for up in (False, True):
        for pattern, times in sorted(fractions, key=lambda p: -(p[1] % 1)):
            wanted = math.floor(times + 1e-6) if not up else int(times % 1 > 0.3)
            fits = min(int(rest[l]) // n for l, n in pattern.items())
            if (t := min(wanted, fits)) > 0:
                out.append((pattern, t))
                for l, n in pattern.items():
                    rest[l] -= n * t
    while rest.any():
        pattern = greedy_pattern(rest, capacity)
        t = max(1, min(int(rest[l]) // n for l, n in pattern.items()))
        out.append((pattern, t))
        for l, n in pattern.items():
            rest[l] -= n * t
    return out
