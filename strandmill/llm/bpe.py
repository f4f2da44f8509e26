"""Byte-level BPE over whole columns: speculate, verify in bulk, repair.

A word's greedy longest-match split is its BPE encoding exactly when each token
encodes to itself and each two neighbours stay apart when encoded together.  So
the encoder guesses greedily, tests every neighbouring pair of a batch through a
vectorised lookup (each distinct pair is decided once, by merging its few bytes),
and merges exactly only the words with a failing pair.

Words are cut by array operations on character classes, not by a regular
expression, and each distinct word is encoded once per Python worker.
"""

from __future__ import annotations

import base64
import heapq
import os
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np

#: Where the public vocabulary lies; every operator takes another path.
DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

#: Distinct words a worker remembers before it starts afresh, and the length from which words aren't remembered.
MEMO_WORDS, MEMO_LENGTH = 600_000, 400

#: Numbers from here on are of words that aren't remembered.
LONG = 1 << 30

#: Characters handled at once, to bound the working arrays.
CHUNK_CHARS = 1 << 20

LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3

# The Unicode White_Space property.
WHITE_SPACE = [0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, 0x2000, 0x2001, 0x2002, 0x2003, 0x2004, 0x2005,
               0x2006, 0x2007, 0x2008, 0x2009, 0x200A, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

# The endings that are words of their own after an apostrophe.
CONTRACTIONS = ["s", "t", "re", "ve", "m", "ll", "d"]

_classes: np.ndarray | None = None


def character_classes() -> np.ndarray:
    """The class of every code point, as one byte each."""
    global _classes
    if _classes is None:
        table = np.full(0x110000, OTHER, dtype=np.uint8)
        for code in range(0x110000):
            first = unicodedata.category(chr(code))[0]
            if first == "L":
                table[code] = LETTER
            elif first == "N":
                table[code] = NUMBER
        table[WHITE_SPACE] = SPACE
        _classes = table
    return _classes


def word_starts(codes: np.ndarray, text_ends: np.ndarray) -> np.ndarray:
    """Positions in ``codes`` where words start; texts are laid end to end, ``text_ends`` are exclusive.

    Words are runs of one class, with at most one plain space before a run that isn't
    white space.  Of white space before such a run the last character stands apart.
    An apostrophe at a word's start takes one of CONTRACTIONS with it.
    """
    n = len(codes)
    if not n:
        return np.empty(0, dtype=np.int64)
    kind = character_classes()[codes]
    space = kind == SPACE
    text_first = np.zeros(n + 1, dtype=bool)
    text_first[0] = True
    text_first[text_ends] = True
    text_first = text_first[:n]
    plain = codes == 32
    start = text_first.copy()
    # A run begins, unless a plain space before it belongs to it.
    start[1:] |= (kind[1:] != kind[:-1]) & ~(plain[:-1] & ~space[1:])
    # The last white-space character before other characters of the same text.
    start[:-1] |= space[:-1] & ~space[1:] & ~text_first[1:]
    quote = np.flatnonzero((codes == 39) & start)
    if len(quote):
        ends = text_ends[np.searchsorted(text_ends, quote, side="right")]
        padded = np.concatenate([codes, np.zeros(2, dtype=codes.dtype)])
        one, two, left = padded[quote + 1], padded[quote + 2], ends - quote - 1
        length = np.zeros(len(quote), dtype=np.int64)
        for ending in reversed(CONTRACTIONS):
            fits = (left >= len(ending)) & (one == ord(ending[0]))
            if len(ending) == 2:
                fits &= two == ord(ending[1])
            length[fits] = len(ending)
        quote, length, ends = quote[length > 0], length[length > 0], ends[length > 0]
        start[quote + 1] = False
        after = quote + 1 + length
        start[after[after < ends]] = True
    return np.flatnonzero(start)


class ByteBpe:
    """An encoder over the ranks of a rank file (``base64-token rank`` per line)."""

    def __init__(self, rank_file: bytes):
        self.ranks: dict[bytes, int] = {}
        for line in rank_file.splitlines():
            if line.strip():
                token, rank = line.split()
                self.ranks[base64.b64decode(token)] = int(rank)
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.longest = [1] * 256
        for token in self.ranks:
            self.longest[token[0]] = max(self.longest[token[0]], len(token))
        self.apart: dict[int, bool] = {}
        self.alone: dict[int, bool] = {}
        self.repaired = self.speculated = 0
        self._forget()

    def _forget(self) -> None:
        self.memo = _Memo()
        self.memo_start = np.zeros(1024, dtype=np.int64)
        self.memo_length = np.zeros(1024, dtype=np.int32)
        self.memo_tokens = np.zeros(4096, dtype=np.int32)
        self.memo_used = 0

    def merge(self, word: bytes) -> list[int]:
        """The exact encoding: the lowest-ranked neighbours merge first, leftmost of equals."""
        ranks, n = self.ranks, len(word)
        if n > 64:
            return self._merge_long(word)
        parts = [word[i : i + 1] for i in range(n)]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                rank = ranks.get(parts[i] + parts[i + 1])
                if rank is not None and (best is None or rank < best):
                    best, at = rank, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def _merge_long(self, word: bytes) -> list[int]:
        """As merge(), with a heap over linked parts: n log n for long words."""
        ranks, n = self.ranks, len(word)
        end, following, before = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
        alive = [True] * n
        heap: list[tuple[int, int, int, int]] = []

        def offer(i: int) -> None:
            j = following[i]
            if j < n:
                rank = ranks.get(word[i : end[j]])
                if rank is not None:
                    heapq.heappush(heap, (rank, i, end[i], end[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, middle, stop = heapq.heappop(heap)
            if not alive[i] or end[i] != middle or following[i] >= n or end[following[i]] != stop:
                continue
            j = following[i]
            alive[j] = False
            end[i], following[i] = stop, following[j]
            if following[j] < n:
                before[following[j]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [ranks[word[i : end[i]]] for i in range(n) if alive[i]]

    def speculate(self, word: bytes) -> list[int]:
        """The greedy longest-match split."""
        ranks, longest, n, at, out = self.ranks, self.longest, len(word), 0, []
        while at < n:
            stop = min(n, at + longest[word[at]])
            rank = ranks.get(word[at:stop])
            while rank is None:
                stop -= 1
                rank = ranks.get(word[at:stop])
            out.append(rank)
            at = stop
        return out

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of the words end to end, and how many each has."""
        guesses = [self.speculate(w) for w in words]
        lengths = np.fromiter(map(len, guesses), dtype=np.int64, count=len(guesses))
        flat = np.fromiter((t for g in guesses for t in g), dtype=np.int64, count=int(lengths.sum()))
        owner = np.repeat(np.arange(len(words)), lengths)
        wrong = np.zeros(len(words), dtype=bool)
        if len(flat):
            distinct, where = np.unique(flat, return_inverse=True)
            unfit = np.fromiter((not self._alone(int(t)) for t in distinct), dtype=bool, count=len(distinct))
            wrong[owner[unfit[where]]] = True
            inner = np.flatnonzero(owner[1:] == owner[:-1])
            if len(inner):
                distinct, where = np.unique((flat[inner] << 32) | flat[inner + 1], return_inverse=True)
                clash = np.fromiter((not self._apart(int(k)) for k in distinct), dtype=bool, count=len(distinct))
                wrong[owner[inner[clash[where]]]] = True
        self.speculated += len(words)
        bad = np.flatnonzero(wrong)
        if not len(bad):
            return flat.astype(np.int32), lengths
        self.repaired += len(bad)
        for i in bad.tolist():
            guesses[i] = self.merge(words[i])
        lengths = np.fromiter(map(len, guesses), dtype=np.int64, count=len(guesses))
        return np.fromiter((t for g in guesses for t in g), dtype=np.int32, count=int(lengths.sum())), lengths

    def _alone(self, token: int) -> bool:
        known = self.alone.get(token)
        if known is None:
            known = self.alone[token] = self.merge(self.tokens[token]) == [token]
        return known

    def _apart(self, key: int) -> bool:
        known = self.apart.get(key)
        if known is None:
            if len(self.apart) > 4_000_000:
                self.apart.clear()
            left, right = key >> 32, key & 0xFFFFFFFF
            known = self.apart[key] = self.merge(self.tokens[left] + self.tokens[right]) == [left, right]
        return known

    def _learn(self, first: int) -> None:
        """Encodes the words the memo has numbered from ``first`` on."""
        words = self.memo.added
        if not words:
            return
        flat, lengths = self.encode_words([w.encode() for w in words])
        stop = first + len(words)
        if stop > len(self.memo_start):
            size = max(stop, 2 * len(self.memo_start))
            self.memo_start, self.memo_length = np.resize(self.memo_start, size), np.resize(self.memo_length, size)
        self._room(len(flat))
        self.memo_start[first:stop] = self.memo_used + np.cumsum(lengths) - lengths
        self.memo_length[first:stop] = lengths
        self.memo_tokens[self.memo_used : self.memo_used + len(flat)] = flat
        self.memo_used += len(flat)
        self.memo.added = []

    def _words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where each word's tokens lie in memo_tokens, how many they are, and the first word of each text (and the end)."""
        joined = "".join(texts)
        codes = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32)
        lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        ends = np.cumsum(lengths)
        starts = word_starts(codes, ends[lengths > 0])
        cuts = starts.tolist()
        cuts.append(len(joined))
        if len(self.memo) > MEMO_WORDS:
            self._forget()
        first = len(self.memo)
        numbers = np.fromiter(
            map(self.memo.__getitem__, (joined[a:b] for a, b in zip(cuts, cuts[1:]))), dtype=np.int32, count=len(starts)
        )
        self._learn(first)
        long = numbers >= LONG
        known = np.where(long, 0, numbers)
        at, count = self.memo_start[known], self.memo_length[known].astype(np.int64)
        if self.memo.long:
            # Encoded once a group; their tokens lie behind those of the memo until the next group.
            flat, n = self.encode_words([w.encode() for w in self.memo.long])
            self._room(len(flat))
            self.memo_tokens[self.memo_used : self.memo_used + len(flat)] = flat
            mine = numbers[long] - LONG
            at[long], count[long] = (self.memo_used + np.cumsum(n) - n)[mine], n[mine]
            self.memo.long = {}
        return at, count, np.concatenate([[0], np.searchsorted(starts, ends, side="left")])

    def _room(self, tokens: int) -> None:
        if self.memo_used + tokens > len(self.memo_tokens):
            self.memo_tokens = np.resize(self.memo_tokens, max(self.memo_used + tokens, 2 * len(self.memo_tokens)))

    def encode_texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all texts end to end, and the offsets where each begins (one more than texts)."""
        values, counts = [], []
        for group in _groups(texts):
            at, lengths, bounds = self._words(group)
            before = np.concatenate([[0], np.cumsum(lengths)])
            shift = np.repeat(at - before[:-1], lengths)
            values.append(self.memo_tokens[np.arange(before[-1]) + shift])
            counts.append(np.diff(before[bounds]))
        offsets = np.concatenate([[0], *[np.asarray(c) for c in counts]]).cumsum()
        return np.concatenate(values) if values else np.empty(0, dtype=np.int32), offsets.astype(np.int64)

    def count_texts(self, texts: list[str]) -> np.ndarray:
        """How many tokens each text has."""
        counts = []
        for group in _groups(texts):
            _, lengths, bounds = self._words(group)
            counts.append(np.diff(np.concatenate([[0], np.cumsum(lengths)])[bounds]))
        return np.concatenate(counts) if counts else np.empty(0, dtype=np.int64)

    def decode(self, ids: Iterable[int]) -> bytes:
        """The bytes that the tokens stand for."""
        return b"".join(map(self.tokens.__getitem__, ids))


class _Memo(dict):
    """Numbers words as they come; ``added`` are those not encoded yet, ``long`` those of this group that it doesn't keep."""

    def __init__(self):
        super().__init__()
        self.added: list[str] = []
        self.long: dict[str, int] = {}

    def __missing__(self, word: str) -> int:
        if len(word) > MEMO_LENGTH:
            return LONG + self.long.setdefault(word, len(self.long))
        number = self[word] = len(self)
        self.added.append(word)
        return number


def _groups(texts: list[str]) -> Iterator[list[str]]:
    """The texts in order, in groups of about CHUNK_CHARS characters."""
    group: list[str] = []
    size = 0
    for text in texts:
        if group and size + len(text) > CHUNK_CHARS:
            yield group
            group, size = [], 0
        group.append(text)
        size += len(text)
    if group:
        yield group


_encoders: dict[str, ByteBpe] = {}


def encoder(rank_file: bytes, key: str) -> ByteBpe:
    """This worker's encoder for a vocabulary; it and what it has learnt stay for later tasks."""
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = ByteBpe(rank_file)
    return _encoders[key]


def read_vocabulary(path: str | None = None) -> tuple[bytes, str]:
    """The rank file's bytes and a key for it."""
    path = path or DEFAULT_VOCABULARY
    with open(path, "rb") as f:
        data = f.read()
    return data, f"{os.path.abspath(path)}:{len(data)}"


def encode_all(texts: Iterable[str], path: str | None = None) -> list[list[int]]:
    """For small uses in one process."""
    model = encoder(*read_vocabulary(path))
    values, offsets = model.encode_texts(list(texts))
    return [values[a:b].tolist() for a, b in zip(offsets, offsets[1:])]
