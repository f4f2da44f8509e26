"""Approximate sets of names: a Bloom filter that grows by layers, over arrays of hashes.

It serves where a set must stay in memory: lint.possible_duplicates() has one in each
task, and only names it has met before go to the exact check.
"""

from __future__ import annotations

import math

import numpy as np

# How much larger and how much stricter each further layer is; the rate and size of the first one for read names.
GROWTH, TIGHTENING = 2, 0.85
NAME_RATE, NAME_CAPACITY = 0.0001, 10_000_000


def optimal_bits(rate: float, capacity: int) -> int:
    """Bits at which a full filter answers wrongly at this rate."""
    return math.ceil(-capacity * math.log(rate) / math.log(2) ** 2)


def optimal_hashes(bits: int, capacity: int) -> int:
    """Bits to set for each key."""
    return max(1, math.ceil(bits / capacity * math.log(2)))


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class BloomFilter:
    """A set of 64-bit hashes; may say yes wrongly, never no."""

    def __init__(self, rate: float = NAME_RATE, capacity: int = NAME_CAPACITY):
        if not 0 < rate < 1 or capacity < 1:
            raise ValueError(f"invalid filter: rate {rate}, capacity {capacity}")
        self.rate, self.capacity, self.count = rate, capacity, 0
        self.bits = optimal_bits(rate, capacity)
        self.hashes = optimal_hashes(self.bits, capacity)
        self.words = np.zeros((self.bits + 7) // 8, dtype=np.uint8)

    def _places(self, keys: np.ndarray) -> np.ndarray:
        first, second = _scramble(keys), _scramble(keys ^ np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
        steps = np.arange(self.hashes, dtype=np.uint64)
        return (first[:, None] + steps * second[:, None]) % np.uint64(self.bits)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        """Whether each key may be in the set."""
        at = self._places(keys)
        return ((self.words[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=1)

    def insert(self, keys: np.ndarray) -> None:
        at = self._places(keys).ravel()
        np.bitwise_or.at(self.words, at >> np.uint64(3), np.left_shift(np.uint8(1), (at & np.uint64(7)).astype(np.uint8)))
        self.count += len(keys)


class ScalableBloomFilter:
    """Layers of filters: when all are full a stricter one follows, GROWTH times as large as they are together, so the rate stays bounded."""

    def __init__(self, rate: float = NAME_RATE, capacity: int = NAME_CAPACITY):
        self.layers = [BloomFilter(rate, capacity)]

    def contains(self, keys: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys), dtype=bool)
        for layer in self.layers:
            out |= layer.contains(keys)
        return out

    def insert(self, keys: np.ndarray) -> np.ndarray:
        """Adds keys in order; whether each may have been there before, repeats within ``keys`` included."""
        seen = self.contains(keys)
        first = np.zeros(len(keys), dtype=bool)
        first[np.unique(keys, return_index=True)[1]] = True
        new = keys[first & ~seen]
        while len(new):
            last = self.layers[-1]
            room = last.capacity - last.count
            if room <= 0:
                self.layers.append(BloomFilter(last.rate * TIGHTENING, sum(x.capacity for x in self.layers) * GROWTH))
                continue
            last.insert(new[:room])
            new = new[room:]
        return seen | ~first
