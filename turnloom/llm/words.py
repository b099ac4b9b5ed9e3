"""Words and fingerprints over whole Arrow text columns, without a Python object per word.

A word is a maximal run of bytes other than space and \\t..\\r.  Its fingerprint takes in eight
bytes a step and mixes after each, so that no step is linear in the bytes; spans longer than
``LONG`` bytes are hashed one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15
LONG = 512
#: The lowest n bytes of eight.
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def word_count(text: Column) -> Column:
    """Number of words of a text column, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, however often ``body`` names it."""
    return F.transform(F.array(value), body)[0]


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> U64(33))) * U64(0xFF51AFD7ED558CCD)
        h = (h ^ (h >> U64(33))) * U64(0xC4CEB9FE1A85EC53)
        return h ^ (h >> U64(33))


class Block:
    """Some consecutive texts: ``data`` bytes and ``bounds`` with one more entry than texts."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray):
        self.data, self.bounds, self.n = data, bounds, len(bounds) - 1

    @staticmethod
    def fingerprints(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A 64-bit fingerprint of each span of ``data``."""
        padded = np.concatenate((data, np.zeros(8, np.uint8)))
        eight = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))  # the eight bytes from each position on
        size = ends - starts
        with np.errstate(over="ignore"):
            out = mix(size.astype(U64) + U64(_BASE))
            live = np.flatnonzero((size > 0) & (size <= LONG))
            step = 0
            while len(live):
                left = size[live] - step
                part = eight[starts[live] + step] & _MASKS[np.minimum(left, 8)]
                out[live] = mix(out[live] * U64(5) ^ part)
                live, step = live[left > 8], step + 8
        for i in np.flatnonzero(size > LONG):
            out[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]].tobytes())
        return out

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of all words, and how many words lie before each text's bound."""
        inside = ~SPACE[self.data]
        edge = np.zeros(len(self.data) + 1, bool)
        edge[self.bounds] = True
        before = np.empty_like(inside)
        if len(inside):
            before[0], before[1:] = False, inside[:-1]
        starts = np.flatnonzero(inside & (~before | edge[:-1]))
        after = np.empty_like(inside)
        if len(inside):
            after[-1], after[:-1] = False, inside[1:]
        ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
        return starts, ends, np.searchsorted(starts, self.bounds)

    def word_hashes(self, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """A fingerprint for each word (A-Z lower-cased on request) and the texts' word bounds."""
        starts, ends, bounds = self.words()
        return self.fingerprints(LOWER[self.data] if lower else self.data, starts, ends), bounds


def blocks(column: pa.Array, size: int = 1 << 22) -> Iterator[tuple[int, int, Block]]:
    """Cut a string column into blocks of about ``size`` bytes; a longer text is a block alone."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(at, at[i] + size, "right")) - 1)
        yield i, j, Block(raw[at[i] : at[j]], at[i : j + 1] - at[i])
        i = j


def text_block(text: bytes) -> Block:
    return Block(np.frombuffer(text, np.uint8), np.array([0, len(text)]))


def windows(hashes: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of all runs of ``n`` words within a text, and the texts' bounds among them."""
    per = np.maximum(np.diff(bounds) - n + 1, 0)
    out = np.concatenate(([0], np.cumsum(per)))
    if not out[-1]:
        return np.zeros(0, U64), out
    first = np.repeat(bounds[:-1] - out[:-1], per) + np.arange(out[-1])
    total = np.zeros(out[-1], U64)
    with np.errstate(over="ignore"):
        for k in range(n):
            total = (total + hashes[first + k]) * U64(_BASE + 2 * k)
    return mix(total), out
