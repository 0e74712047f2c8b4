"""Words and word windows of whole texts as numpy hashes, one Arrow batch at a time.

Texts stay UTF-8 bytes. Both word definitions used here are byte classes, so the split needs
no decoding: ``SPACED`` words are runs of bytes other than ASCII white space, ``PLAIN`` words
are runs of ASCII letters, digits and non-ASCII bytes, with A-Z lower-cased.

A word's hash mixes its bytes eight at a time. A window of L words is hashed from its two
halves of ceil(L/2) words, which overlap by one word when L is odd. Hashes are 64 bits;
``seed`` gives independent families, and two families together identify a window.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa

SPACED, PLAIN = "spaced", "plain"

_byte = np.arange(256)
_IS_WORD = {
    SPACED: ~((_byte == 0x20) | ((_byte >= 0x09) & (_byte <= 0x0D))),
    PLAIN: ((_byte >= 0x30) & (_byte <= 0x39)) | ((_byte >= 0x41) & (_byte <= 0x5A)) | ((_byte >= 0x61) & (_byte <= 0x7A)) | (_byte >= 0x80),
}
_LOWER = np.where((_byte >= 0x41) & (_byte <= 0x5A), _byte + 32, _byte).astype(np.uint8)
_SEEDS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)
_LONG = 64  # bytes; longer words are hashed one by one

BATCH_BYTES = 2 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (in place on a fresh array)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its offsets; nulls count as empty."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    off = np.frombuffer(off, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def slices(batch: pa.RecordBatch, name: str, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of a batch with about ``most`` text bytes each (a longer text stands alone)."""
    _, off = text_bytes(batch.column(batch.schema.get_field_index(name)))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(off, off[at] + most, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


class Words:
    """The words of a column of texts: ``first[i]:first[i + 1]`` are those of text i."""

    def __init__(self, column: pa.Array, kind: str):
        raw, off = text_bytes(column)
        self.raw = _LOWER[raw] if kind == PLAIN else raw
        inside = _IS_WORD[kind][raw]
        before = np.zeros(len(raw), bool)
        before[1:] = inside[:-1]
        before[off[:-1][off[:-1] < len(raw)]] = False
        self.start = np.flatnonzero(inside & ~before)
        after = np.ones(len(raw), bool)
        after[:-1] = ~inside[1:]
        after[off[1:][off[1:] > 0] - 1] = True
        self.end = np.flatnonzero(inside & after) + 1
        self.first = np.searchsorted(self.start, off)
        self.count = np.diff(self.first)
        self._hashes: dict[int, np.ndarray] = {}

    def hashes(self, seed: int = 0) -> np.ndarray:
        if seed not in self._hashes:
            self._hashes[seed] = self._hash(seed)
        return self._hashes[seed]

    def _hash(self, seed: int) -> np.ndarray:
        size = self.end - self.start
        h = mix(size.astype(np.uint64) * _SEEDS[seed] + _SEEDS[(seed + 1) % 4])
        raw = np.concatenate([self.raw, np.zeros(8, np.uint8)])
        eights = np.lib.stride_tricks.sliding_window_view(raw, 8)
        alive = np.flatnonzero(size <= _LONG)
        for k in range(0, _LONG, 8):
            if k:
                alive = alive[size[alive] > k]
            if not len(alive):
                break
            left = np.minimum(size[alive] - k, 8).astype(np.uint64)
            block = eights[self.start[alive] + k].view(np.uint64).ravel()
            block &= np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - left * np.uint64(8))
            h[alive] = mix((h[alive] ^ block) * _SEEDS[(seed + 2) % 4] + _SEEDS[seed])
        for i in np.flatnonzero(size > _LONG):
            word = self.raw[self.start[i] : self.end[i]].tobytes()
            h[i] = np.frombuffer(blake2b(word, digest_size=8, salt=bytes([seed])).digest(), np.uint64)[0]
        return h

    def windows(self, length: int, seed: int = 0) -> np.ndarray:
        """The hash of the window that starts at each word; meaningful where ``fits`` holds."""
        return window_hash(self.hashes(seed), length, seed)

    def fits(self, length: int) -> np.ndarray:
        """Where a window of so many words of the same text starts."""
        last = np.repeat(self.first[1:], self.count)
        return np.arange(len(self.start)) + length <= last

    def text_of(self) -> np.ndarray:
        """The text number of each word."""
        return np.repeat(np.arange(len(self.count)), self.count)


def window_hash(h: np.ndarray, length: int, seed: int = 0) -> np.ndarray:
    if length == 1:
        return h
    half = (length + 1) // 2
    w = window_hash(h, half, seed)
    shift = length - half
    other = np.zeros_like(w)
    other[: max(len(w) - shift, 0)] = w[shift:]
    return paired_hash(w, other, length, seed)


def paired_hash(w: np.ndarray, other: np.ndarray, length: int, seed: int = 0) -> np.ndarray:
    """The hash of windows of ``length`` words from those of their two halves."""
    return mix(w * _SEEDS[(seed + 1) % 4] + other + _SEEDS[(seed + 3) % 4 : (seed + 3) % 4 + 1] * np.uint64(length))


def covered(hit: np.ndarray, length: int) -> np.ndarray:
    """Which positions lie in a window that starts at a hit; windows never leave their text."""
    step = np.zeros(len(hit) + length + 1, np.int32)
    at = np.flatnonzero(hit)
    np.add.at(step, at, 1)
    np.add.at(step, at + length, -1)
    return np.cumsum(step)[: len(hit)] > 0


def first_minimum(h: np.ndarray, width: int) -> np.ndarray:
    """For each start, the position of the leftmost smallest value among ``width`` values from it on (fewer at the end)."""
    n = len(h)
    at = np.arange(n)
    best, span = h.copy(), 1
    while span < width:
        step = min(span, width - span)
        other = np.full(n, np.uint64(0xFFFFFFFFFFFFFFFF))
        other_at = np.full(n, n)
        if n > step:
            other[: n - step] = best[step:]
            other_at[: n - step] = at[step:]
        better = other < best
        best = np.where(better, other, best)
        at = np.where(better, other_at, at)
        span += step
    return at
