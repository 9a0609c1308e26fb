"""A minimal perfect hash of integer keys, built in parts that do not know of each other.

Every part places its keys by levels: a level has twice as many places as keys that
are left, a key that is alone on its place stays there, the others try the next level. The rank
of a key's place among all places taken is its index: n keys have the indices 0 to n - 1. Keys that were never
placed get an index too, so a table of the keys by index tells whether one was.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Places for each key that a level still has to place, and the most levels. Each leaves about four keys in ten.
PLACES, LEVELS = 2, 100


def mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    """The finalizer of splitmix64, a bijection of 64-bit integers."""
    x = keys.astype(np.uint64) + np.uint64(((seed + 1) * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _place(keys: np.ndarray, level: int, places) -> np.ndarray:
    return (mixed(keys, level) % np.asarray(places, np.uint64)).astype(np.int64)


def build(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of each level (multiples of 64) and the words of bits that say which are taken. Keys must be distinct."""
    places, words = [], []
    while len(keys):
        if len(places) == LEVELS:
            raise ValueError("keys are not distinct")
        size = -(-PLACES * len(keys) // 64) * 64
        at = _place(keys, len(places), size)
        taken = np.bincount(at, minlength=size) == 1
        places.append(size)
        words.append(np.packbits(taken, bitorder="little").view(np.uint64))
        keys = keys[~taken[at]]
    return np.array(places, np.int64), np.concatenate(words) if words else np.zeros(0, np.uint64)


@dataclass
class PairHash:
    """The parts of a hash together. `part_of` must be the function that dealt the keys out."""

    places: np.ndarray  # by level and part
    begins: np.ndarray  # first place of each level and part
    words: np.ndarray
    before: np.ndarray  # places taken before each word

    @classmethod
    def of_parts(cls, parts: list[tuple[np.ndarray, np.ndarray]]) -> PairHash:
        levels = max([1, *(len(p) for p, _ in parts)])
        places = np.zeros((levels, len(parts)), np.int64)
        begins = np.zeros_like(places)
        start = 0
        for k, (sizes, _) in enumerate(parts):
            places[: len(sizes), k] = sizes
            begins[: len(sizes), k] = start + np.cumsum(sizes) - sizes
            start += int(sizes.sum())
        words = np.concatenate([w for _, w in parts] or [np.zeros(0, np.uint64)])
        taken = np.bitwise_count(words).astype(np.int64)
        return cls(places, begins, words, np.cumsum(taken) - taken)

    def index(self, keys: np.ndarray, part: np.ndarray) -> np.ndarray:
        """Index of each key, -1 for some that were never placed."""
        found = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for level, (sizes, begins) in enumerate(zip(self.places, self.begins)):
            left = left[sizes[part[left]] > 0]
            if not len(left):
                break
            of = part[left]
            at = begins[of] + _place(keys[left], level, sizes[of])
            word, bit = at >> 6, (at & 63).astype(np.uint64)
            hit = (self.words[word] >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(self.words[word] & ((np.uint64(1) << bit) - np.uint64(1)))
            found[left[hit]] = (self.before[word] + below)[hit]
            left = left[~hit]
        return found
