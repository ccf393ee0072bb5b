"""Words of many texts at once: byte tables, boundaries and 64-bit hashes in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Multiplier of the polynomial hash, odd so that it has an inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        x = np.full(max(n, 1 << 16), base, np.uint64)
        x[0] = 1
        have = _powers[base] = np.multiply.accumulate(x)
    return have[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (splitmix64's finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts' UTF-8 bytes end to end, and len + 1 offsets. Nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.fill_null("" if not pa.types.is_binary(texts.type) else b"")
    texts = texts.cast(pa.large_binary())
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def byte_table(outside: str) -> np.ndarray:
    """Which bytes belong to words: all but those of ``outside``."""
    t = np.ones(256, bool)
    t[np.frombuffer(outside.encode("latin-1"), np.uint8)] = False
    return t


#: `[^\x20\x09-\x0D]+`
SPACED = byte_table(" \t\n\x0b\x0c\r")
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`, for lower-cased text
LETTERED = byte_table("".join(map(chr, [*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


class Words:
    """start, end (bytes), hash and doc of each word, in order; first: index of each text's first word, with the total last."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, inside: np.ndarray):
        n = len(data)
        mask = np.zeros(n + 2, bool)
        mask[1:-1] = inside[data]
        begin, end = mask[1:-1] & ~mask[:-2], mask[1:-1] & ~mask[2:]
        cut = offsets[(offsets > 0) & (offsets < n)]
        begin[cut] |= mask[1:-1][cut]
        end[cut - 1] |= mask[1:-1][cut - 1]
        self.start, self.end = np.flatnonzero(begin), np.flatnonzero(end) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(offsets) - 1), self.count)
        self.hash = hashes(data, self.start, self.end)

    def __len__(self) -> int:
        return len(self.start)


def prefix(data: np.ndarray) -> np.ndarray:
    """Sums of (byte + 1) * BASE**position, from 0."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(data)), out=out[1:])
    return out


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, sums: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit hash of each data[start:end], that depends on these bytes alone."""
    sums = prefix(data) if sums is None else sums
    return mixed((sums[end] - sums[start]) * powers(INVERSE, len(data) + 1)[start])


def hash_word(word: str) -> int:
    data = np.frombuffer(word.encode(), np.uint8)
    return int(hashes(data, np.array([0]), np.array([len(data)]))[0])


def windows(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first word of every run of ``k`` words in one text; a text of 1 to k - 1 words gives one for all of them."""
    h = words.hash
    n = len(h)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(h * powers(BASE, n), out=sums[1:])
    last = words.first[1:][words.doc]
    at = np.arange(n)
    whole = at + k <= last
    short = (at == words.first[:-1][words.doc]) & (words.count[words.doc] < k)
    start = np.flatnonzero(whole | short)
    end = np.minimum(start + k, last[start])
    return mixed((sums[end] - sums[start]) * powers(INVERSE, n + 1)[start] + (end - start).astype(np.uint64)), start
