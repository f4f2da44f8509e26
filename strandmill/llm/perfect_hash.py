"""Minimal perfect hashing with fingerprints, over arrays of 64-bit hashes."""

from __future__ import annotations

import struct

import numpy as np

#: Slots tried for each key left at a level, and levels before the rest is kept as a sorted list.
GAMMA, LEVELS = 2.0, 24

_MIX1, _MIX2, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), 0x9E3779B97F4A7C15
_BYTE_BITS = np.array([bin(i).count("1") for i in range(256)], dtype=np.uint8)


def mix(keys: np.ndarray, salt: int) -> np.ndarray:
    """A 64-bit hash of each 64-bit key."""
    x = keys + np.uint64((salt * _STEP) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


class SealedPartition:
    """An immutable set of keys: no key is kept, only about 3.5 bits to find its slot and a fingerprint there.

    Level by level, keys that alone claim a bit of the level's array get it; the rest
    go on.  A key's slot is the number of set bits before its own.  Asking for a key
    that was never put in answers wrongly with chance 2**-32 at most.
    """

    def __init__(self, levels: list[tuple[int, np.ndarray]], rest: np.ndarray, prints: np.ndarray):
        self.levels, self.rest, self.prints = levels, rest, prints
        self.ranks, before = [], 0
        for _, bits in levels:
            ones = np.cumsum(_BYTE_BITS[bits], dtype=np.int64)
            self.ranks.append(before + np.concatenate([[0], ones]))
            before += int(ones[-1]) if len(ones) else 0
        self.placed = before

    @classmethod
    def seal(cls, keys: np.ndarray, prints: np.ndarray) -> SealedPartition:
        """``keys``: distinct 64-bit hashes; ``prints``: a 32-bit fingerprint of each by an independent hash."""
        levels, left = [], keys
        for level in range(LEVELS):
            if not len(left):
                break
            size = (max(64, int(GAMMA * len(left))) + 7) // 8 * 8
            at = (mix(left, level) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            levels.append((size, np.packbits(alone, bitorder="little")))
            left = left[~alone[at]]
        made = cls(levels, np.sort(left), np.empty(0, dtype=np.uint32))
        slots = made.slots(keys)
        made.prints = np.zeros(len(keys), dtype=np.uint32)
        made.prints[slots] = prints
        return made

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, or -1 where it was surely not put in."""
        out = np.full(len(keys), -1, dtype=np.int64)
        open_, left = np.arange(len(keys)), keys
        for level, ((size, bits), ranks) in enumerate(zip(self.levels, self.ranks)):
            if not len(left):
                return out
            at = (mix(left, level) % np.uint64(size)).astype(np.int64)
            byte, bit = at >> 3, (at & 7).astype(np.uint8)
            here = bits[byte]
            hit = (here >> bit) & 1 == 1
            below = here[hit] & ((np.uint8(1) << bit[hit]) - np.uint8(1))
            out[open_[hit]] = ranks[byte[hit]] + _BYTE_BITS[below]
            open_, left = open_[~hit], left[~hit]
        if len(left) and len(self.rest):
            where = np.minimum(np.searchsorted(self.rest, left), len(self.rest) - 1)
            same = self.rest[where] == left
            out[open_[same]] = self.placed + where[same]
        return out

    def holds(self, keys: np.ndarray, prints: np.ndarray) -> np.ndarray:
        """Whether each key seems to have been put in."""
        slots = self.slots(keys)
        found = slots >= 0
        found[found] = self.prints[slots[found]] == prints[found]
        return found

    def to_bytes(self) -> bytes:
        """About 8 bytes a key at most, to be stored."""
        head = [struct.pack("<3q", len(self.levels), len(self.rest), len(self.prints))]
        head += [struct.pack("<q", size) for size, _ in self.levels]
        return b"".join([*head, *[bits.tobytes() for _, bits in self.levels], self.rest.tobytes(), self.prints.tobytes()])

    @classmethod
    def from_bytes(cls, data: bytes) -> SealedPartition:
        n_levels, n_rest, n_prints = struct.unpack_from("<3q", data)
        at = 24
        sizes = struct.unpack_from(f"<{n_levels}q", data, at)
        at += 8 * n_levels
        levels = []
        for size in sizes:
            levels.append((size, np.frombuffer(data, np.uint8, size // 8, at)))
            at += size // 8
        rest = np.frombuffer(data, np.uint64, n_rest, at)
        return cls(levels, rest, np.frombuffer(data, np.uint32, n_prints, at + 8 * n_rest))
