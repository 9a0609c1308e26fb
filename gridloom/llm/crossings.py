"""Divide and conquer over sequences of units that lead from one of four states to another.

A unit is a row, or a segment of rows as a whole. It has two matrices of 4 by 4: the least cost of
going from a state to another, and the order of the cheapest edits' letters among those that
start in the same state. All sequences are worked on together, in flat numpy arrays. A sequence
is split in its middle; the costs from its start forward and from its end backward meet
there, and of the cheapest crossings the one whose letters come first is chosen. Its halves are split in turn, so
only vectors of four costs are held, never a table of all rows.

What lies before a crossing ends with the letter of a unit, so of two different crossings neither's
letters begin the other's: the four ranks of a vector suffice to compare them.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

#: More than any sequence costs.
FAR = np.int64(1) << 50

Matrices = Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]


def advance(cost: np.ndarray, rank: np.ndarray, unit_cost: np.ndarray, unit_order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Costs and ranks of the four states after one more unit of each sequence. Orders must be under 16."""
    key = (cost[:, :, None] + unit_cost) * 4 + rank[:, :, None]
    came = key.argmin(axis=1)[:, None, :]
    least = np.take_along_axis(key, came, 1)[:, 0]
    order = (least & 3) * 16 + np.take_along_axis(unit_order, came, 1)[:, 0]
    return np.minimum(least >> 2, FAR), order.argsort(axis=1, kind="stable").argsort(axis=1, kind="stable")


def forward(matrices: Matrices, low: np.ndarray, high: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Costs and ranks of the four states after the units low to high - 1, by sequence."""
    cost = np.where(np.arange(4) == start[:, None], np.int64(0), FAR)
    rank = np.tile(np.arange(4), (len(low), 1))
    order, ends = _by_length(low, high)
    for step, m in enumerate(ends):
        some = order[:m]
        cost[some], rank[some] = advance(cost[some], rank[some], *matrices(low[some] + step))
    return cost, rank


def backward(matrices: Matrices, low: np.ndarray, high: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Costs from each of the four states before the unit `low` to the state `end` after the unit high - 1."""
    cost = np.where(np.arange(4) == end[:, None], np.int64(0), FAR)
    order, ends = _by_length(low, high)
    for step, m in enumerate(ends):
        some = order[:m]
        cost[some] = np.minimum((matrices(high[some] - 1 - step)[0] + cost[some][:, None, :]).min(axis=2), FAR)
    return cost


def _by_length(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """The sequences, longest first, and how many of them have a unit left at each step."""
    length = high - low
    order = np.argsort(-length, kind="stable")
    steps = int(length.max()) if len(length) else 0
    return order, np.searchsorted(-length[order], -np.arange(steps), "left").tolist()


def states(matrices: Matrices, low: np.ndarray, high: np.ndarray, start: np.ndarray, end: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The state before and after each of the n units, on the cheapest way of each sequence from its start to its end whose letters come first."""
    before, after = np.zeros(n, np.int64), np.zeros(n, np.int64)
    some = high > low
    low, high, start, end = low[some], high[some], start[some], end[some]
    while len(low):
        one = high - low == 1
        before[low[one]], after[low[one]] = start[one], end[one]
        low, high, start, end = low[~one], high[~one], start[~one], end[~one]
        if not len(low):
            break
        middle = (low + high) // 2
        cost, rank = forward(matrices, low, middle, start)
        crossing = ((cost + backward(matrices, middle, high, end)) * 4 + rank).argmin(axis=1)
        low, high, start, end = np.r_[low, middle], np.r_[middle, high], np.r_[start, crossing], np.r_[crossing, end]
    return before, after
