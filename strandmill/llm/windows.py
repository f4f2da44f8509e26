"""Hashes of windows of texts, and the choice of those that an index holds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Characters hashed at once.
CHUNK_CHARS = 1 << 19

#: Stretches on either side of a chosen window whose digests go with it.
LEVELS = 4

_BASE = 0x9E3779B97F4A7C15
_M1, _M2 = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xBF58476D1CE4E5B9)
_powers: tuple[np.ndarray, np.ndarray] | None = None


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64."""
    global _powers
    if _powers is None or len(_powers[0]) < n:
        n = max(n, CHUNK_CHARS + 1)
        inverse = pow(_BASE, -1, 1 << 64)
        first = np.array([1], dtype=np.uint64)
        _powers = (
            np.cumprod(np.concatenate([first, np.full(n, _BASE, dtype=np.uint64)])),
            np.cumprod(np.concatenate([first, np.full(n, inverse, dtype=np.uint64)])),
        )
    return _powers


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)


def _prefix_sums(codes: np.ndarray) -> np.ndarray:
    """Of n code points n + 1 sums, from which the hash of any stretch follows."""
    powers, _ = _power_tables(len(codes))
    x = np.empty(len(codes) + 1, dtype=np.uint64)
    x[0] = 0
    y = (codes.astype(np.uint64) + np.uint64(1)) * _M1
    y ^= y >> np.uint64(32)
    y *= _M2
    y *= powers[: len(codes)]
    np.cumsum(y, out=x[1:])
    return x


def _finished(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(29)
    h *= _M2
    h ^= h >> np.uint64(32)
    h *= _M1
    return h


def _hashes_of(sums: np.ndarray, length: int) -> np.ndarray:
    n = len(sums) - 1
    if n < length:
        return np.empty(0, dtype=np.uint64)
    return _finished((sums[length:] - sums[: n - length + 1]) * _power_tables(n)[1][: n - length + 1])


def window_hashes(codes: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit hash of each window of ``length`` code points; equal windows have equal hashes."""
    return _hashes_of(_prefix_sums(codes), length)


def _digests(sums: np.ndarray, at: np.ndarray, length: int, there: np.ndarray) -> np.ndarray:
    """A byte from 1 to 255 of each stretch of ``length`` from ``at`` on, 0 where it isn't ``there``."""
    first = np.where(there, at, 0)
    h = _finished((sums[first + length] - sums[first]) * _power_tables(len(sums))[1][first])
    return np.where(there, (h >> np.uint64(40)) % np.uint64(255) + np.uint64(1), np.uint64(0))


def level_step(span: int, gram: int) -> int:
    """Characters from one level to the next."""
    return max(1, (span - gram) // LEVELS)


def levels_needed(span: int, gram: int) -> int:
    """How many levels, left and right together, must agree around a window inside a common span.

    The span goes span - gram characters beyond the window, left and right together, of
    which less than a level's step is lost to rounding on each side.
    """
    return max(0, (span - gram) // level_step(span, gram) - 1)


def contexts(sums: np.ndarray, at: np.ndarray, first: np.ndarray, last: np.ndarray, span: int, gram: int) -> np.ndarray:
    """Eight digests, a byte each, of what lies 1 to LEVELS steps left and right of the windows ``at`` of texts from ``first`` to ``last``."""
    step, out = level_step(span, gram), np.zeros(len(at), dtype=np.uint64)
    for level in range(LEVELS):
        n = step * (level + 1)
        out |= _digests(sums, at - n, n, at - n >= first) << np.uint64(8 * level)
        out |= _digests(sums, at + gram, n, at + gram + n <= last) << np.uint64(8 * (LEVELS + level))
    return out


def levels_in_common(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of contexts of equal windows: levels left and right, counted outwards, up to which both agree."""
    differ, total = x ^ y, np.zeros(len(x), dtype=np.int64)
    for side in (0, LEVELS):
        so_far = np.ones(len(x), dtype=bool)
        for level in range(side, side + LEVELS):
            byte = np.uint64(255) << np.uint64(8 * level)
            so_far &= ((differ & byte) == 0) & ((x & byte) != 0)
            total += so_far
    return total


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours."""
    step = 1
    while 2 * step <= width:
        x = np.minimum(x[:-step], x[step:])
        step *= 2
    return np.minimum(x[: len(x) - (width - step)], x[width - step :]) if width > step else x


def chosen_windows(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, span: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of chosen windows of texts laid end to end, their contexts, and the text each is of.

    Of all windows of ``gram`` inside each stretch of ``span`` the least hash is
    chosen, so two texts that share a stretch share a chosen hash, at least
    levels_needed() levels around which agree.
    """
    width = span - gram + 1
    fit = ends - starts >= span
    if not fit.any():
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    sums = _prefix_sums(codes)
    h = _hashes_of(sums, gram)
    # The place's low bits make neighbours differ, so that a new least hash shows as a change.
    place = np.arange(len(h), dtype=np.uint64) & np.uint64(127)
    least = _least((h & ~np.uint64(127)) | place, width)
    new = np.empty(len(least), dtype=bool)
    new[0] = True
    np.not_equal(least[1:], least[:-1], out=new[1:])
    owner = np.flatnonzero(fit)
    first, last = starts[owner], ends[owner] - span + 1
    new[first] = True
    at = np.flatnonzero(new)
    which = np.searchsorted(first, at, side="right") - 1
    inside = (which >= 0) & (at < last[which])
    at, which = at[inside], which[inside]
    # The window lies less than 128 places on, where the low bits say.
    window = at + ((least[at].astype(np.int64) - at) & 127)
    context = contexts(sums, window, starts[owner][which], ends[owner][which], span, gram)
    return (least[at] >> np.uint64(7)).astype(np.int64), context.view(np.int64), owner[which]


def pieces(texts: list[str], span: int) -> Iterator[tuple[list[int], list[str]]]:
    """Groups of texts (their numbers and parts) of about CHUNK_CHARS; a longer text comes in parts that overlap by a span."""
    numbers: list[int] = []
    parts: list[str] = []
    size = 0
    for i, text in enumerate(texts):
        if len(text) < span:
            continue
        for at in range(0, len(text), CHUNK_CHARS - span):
            part = text[at : at + CHUNK_CHARS]
            if at and len(part) < span:
                continue
            if size + len(part) > CHUNK_CHARS and parts:
                yield numbers, parts
                numbers, parts, size = [], [], 0
            numbers.append(i)
            parts.append(part)
            size += len(part)
    if parts:
        yield numbers, parts
