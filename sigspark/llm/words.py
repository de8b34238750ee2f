"""Lower-cased words and word shingles of whole texts as 64-bit hashes, computed for many texts at once.

A word is a run of bytes other than space and \\x09-\\x0D, A-Z lower-cased. Two different words (or shingles) get one
hash with a probability of about 2^-64 a pair; the operators treat equal hashes as equal words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
# letters, digits and all bytes of other characters
_PLAIN = _SPACE.copy()
_PLAIN[[c for c in range(128) if not chr(c).isalnum()]] = True
_LOWER = np.arange(1, 257, dtype=np.uint64)
_LOWER[0x41:0x5B] += np.uint64(32)
_BASE = 0x9E3779B97F4A7C15 | 1
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_BASE^i and its inverse modulo 2^64 for i < n."""
    if not _powers or len(_powers[0]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        _powers[:] = [
            np.concatenate([[np.uint64(1)], np.cumprod(np.full(size - 1, b, np.uint64))])
            for b in (_BASE, pow(_BASE, -1, 1 << 64))
        ]
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts and where each begins; null counts as empty."""
    texts = pa.compute.fill_null(texts, "").cast(pa.large_string())
    _, at, data = texts.buffers()
    at = np.frombuffer(at, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and len(data) else np.zeros(0, np.uint8)
    return raw, at - at[0]


def word_spans(texts: pa.Array, plain: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all texts, first and past-the-end byte of each word, and the first word of each text."""
    raw, at = text_bytes(texts)
    n = len(raw)
    if not n:
        return raw, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    solid = ~(_PLAIN if plain else _SPACE)[raw]
    left = np.empty(n, bool)
    left[0], left[1:] = True, ~solid[:-1]
    left[at[:-1][at[:-1] < n]] = True
    right = np.empty(n, bool)
    right[-1], right[:-1] = True, ~solid[1:]
    right[at[1:][at[1:] > 0] - 1] = True
    first = np.flatnonzero(solid & left)
    return raw, first, np.flatnonzero(solid & right) + 1, np.searchsorted(first, at)


def words(texts: pa.Array, plain: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of every text, and the first word of each text (one entry more than texts).

    ``plain``: ASCII signs part words as white space does.
    """
    raw, first, end, at = word_spans(texts, plain)
    if not len(first):
        return np.zeros(0, np.uint64), at
    up, down = _power_tables(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_LOWER[raw] * up[:-1], out=total[1:])
    return mix((total[end] - total[first]) * down[first]), at


def hash_of(word: str) -> int:
    """Hash of one word, as ``words`` gives it."""
    return int(words(pa.array([word]))[0][0])


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the runs of ``size`` words of one text; of all its words if it has fewer; none if it has none."""
    n = len(hashes)
    size = min(size, n)
    if not n:
        return hashes
    out = hashes[: n - size + 1]
    for j in range(1, size):
        out = mix(out * np.uint64(_BASE) + hashes[j : n - size + 1 + j])
    return out + np.uint64(size)


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


class Lookup:
    """Numbers of known hashes: a table by their low bits, with the next free place for those that collide."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(10, (4 * max(1, len(keys)) - 1).bit_length())
        self.mask = np.uint64((1 << self.bits) - 1)
        self.keys = np.zeros(1 << self.bits, np.uint64)
        self.at = np.full(1 << self.bits, -1, np.int32)
        place, left = keys & self.mask, np.arange(len(keys))
        while len(left):
            free = self.at[place.astype(np.int64)] < 0
            spots, first = np.unique(place[free], return_index=True)
            won = np.flatnonzero(free)[first]
            self.keys[spots.astype(np.int64)] = keys[left[won]]
            self.at[spots.astype(np.int64)] = left[won]
            stay = np.ones(len(left), bool)
            stay[won] = False
            left, place = left[stay], (place[stay] + np.uint64(1)) & self.mask

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        """Number of each hash, -1 for unknown ones."""
        place = (hashes & self.mask).astype(np.int64)
        found = self.at[place]
        wrong = np.flatnonzero((found >= 0) & (self.keys[place] != hashes))
        while len(wrong):
            place[wrong] = (place[wrong] + 1) & int(self.mask)
            now = self.at[place[wrong]]
            found[wrong] = now
            wrong = wrong[(now >= 0) & (self.keys[place[wrong]] != hashes[wrong])]
        return found
