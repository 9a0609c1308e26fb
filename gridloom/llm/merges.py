"""Rounds of byte-pair merges over many sequences that lie one after another in a flat numpy array.

Each round finds the lowest-rank pair of every sequence and applies it in all of
them at once. Where a sequence holds that pair several times, all its occurrences
are merged together, unless a merge would create a pair that should have come
before the remaining ones; then only the leftmost is merged in this round. The
result therefore equals one-at-a-time merging, lowest rank first and leftmost
among equals.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

NONE = np.int64(1) << 60


@dataclass
class MergeTable:
    """Pairs of symbols by sorted key, with the rank and the symbol that replaces them."""

    keys: np.ndarray
    ranks: np.ndarray
    merged: np.ndarray
    base: int

    @classmethod
    def build(cls, left, right, ranks, merged, base: int) -> MergeTable:
        keys = np.asarray(left, np.int64) * base + np.asarray(right, np.int64)
        order = np.argsort(keys, kind="stable")
        return cls(keys[order], np.asarray(ranks, np.int64)[order], np.asarray(merged, np.int64)[order], base)

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (NONE if there is no such pair) and replacement of each pair, by binary search."""
        key = left * self.base + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = (self.keys[at] == key) & (left < self.base) & (right < self.base)
        return np.where(hit, self.ranks[at], NONE), self.merged[at]


def merge_rounds(symbols: np.ndarray, lengths: np.ndarray, table: MergeTable) -> tuple[np.ndarray, np.ndarray]:
    """Merges until no sequence has a known pair. Returns the surviving symbols, flat, and each sequence's number of them."""
    out_lengths = np.asarray(lengths, np.int64).copy()
    done: list[tuple[np.ndarray, np.ndarray]] = []
    owner = np.repeat(np.arange(len(lengths)), lengths)
    sym = np.asarray(symbols, np.int64)
    rank, new = _pairs(sym, owner, table)
    while len(sym):
        starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        count = np.diff(np.r_[starts, len(sym)])
        least = np.minimum.reduceat(rank, starts)
        if (least == NONE).any():
            over = np.repeat(least == NONE, count)
            done.append((owner[over], sym[over]))
            owner, sym, rank, new = owner[~over], sym[~over], rank[~over], new[~over]
            if not len(sym):
                break
            live = least != NONE
            count, least = count[live], least[live]
            starts = np.r_[0, np.cumsum(count)[:-1]]
        at = np.flatnonzero(rank == np.repeat(least, count))
        run = np.r_[True, np.diff(at) != 1]
        offset = np.arange(len(at)) - np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
        at = at[offset % 2 == 0]
        at = _safe(at, sym, owner, new, rank, table)
        sym[at] = new[at]
        keep = np.ones(len(sym), bool)
        keep[at + 1] = False
        place = np.cumsum(keep) - 1
        owner, sym, rank, new = owner[keep], sym[keep], rank[keep], new[keep]
        at = place[at]
        stale = np.unique(np.r_[at, np.maximum(at - 1, 0)])
        rank[stale], new[stale] = _pairs_at(stale, sym, owner, table)
    owner = np.concatenate([o for o, _ in done]) if done else np.zeros(0, np.int64)
    sym = np.concatenate([s for _, s in done]) if done else np.zeros(0, np.int64)
    order = np.argsort(owner, kind="stable")
    out_lengths[:] = np.bincount(owner, minlength=len(out_lengths))
    return sym[order], out_lengths


def _pairs(sym, owner, table):
    return _pairs_at(np.arange(len(sym)), sym, owner, table)


def _pairs_at(at, sym, owner, table):
    """Rank and replacement of the pairs that begin at these places; a sequence's last symbol begins none."""
    after = np.minimum(at + 1, len(sym) - 1)
    rank, new = table.find(sym[at], sym[after])
    return np.where((after > at) & (owner[at] == owner[after]), rank, NONE), new


def _safe(at, sym, owner, new, rank, table):
    """Of sequences with several merges, keeps all of them or only the first one (see the module's text)."""
    of = owner[at]
    first = np.r_[True, of[1:] != of[:-1]]
    if first.all():
        return at
    several = ~first | np.r_[~first[1:], False]
    some = at[several]
    chosen = np.zeros(len(sym) + 2, bool)
    chosen[at] = True
    before, after = some - 1, some + 2
    has_before = (before >= 0) & (owner[np.maximum(before, 0)] == owner[some])
    has_after = (after < len(sym)) & (owner[np.minimum(after, len(sym) - 1)] == owner[some])
    two = np.maximum(some - 2, 0)
    left = np.where((some >= 2) & chosen[two], new[two], sym[np.maximum(before, 0)])
    right = sym[np.minimum(after, len(sym) - 1)]
    low = np.minimum(np.where(has_before, table.find(left, new[some])[0], NONE), np.where(has_after, table.find(new[some], right)[0], NONE))
    bad = np.unique(owner[some][low <= rank[some]])
    if not len(bad):
        return at
    return at[first | ~np.isin(of, bad)]
