"""Word shingles of many texts at once, as 64-bit hashes in numpy.

Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z. A word's hash is a polynomial over its
UTF-8 bytes (from one running sum per chunk of texts), then mixed; a shingle's hash mixes those
of its words in order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
#: Bytes of text hashed at once: bounds a worker's memory whatever the batch size.
CHUNK_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that high and low bits depend on all input bits."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _is_space() -> np.ndarray:
    table = np.zeros(256, bool)
    table[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
    return table


SPACE = _is_space()
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def chunks(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(index of the first text, bytes, offsets of the texts) for runs of about CHUNK_BYTES; null reads as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + CHUNK_BYTES, "right")) - 1)
        yield first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and for each text the index of its first word (one more at the end)."""
    n = len(data)
    if not n:
        return np.empty(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = ~SPACE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = offsets[(offsets > 0) & (offsets < n)]
    begins[edges] |= inside[edges]  # a text's end ends a word
    starts = np.flatnonzero(begins)
    stops = np.zeros(n + 1, bool)
    stops[1:n] = inside[:-1] & ~inside[1:]
    stops[n] = inside[-1]
    stops[edges] |= inside[edges - 1]
    ends = np.flatnonzero(stops)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((LOWER[data].astype(np.uint64) + np.uint64(1)) * powers(BASE, n), out=sums[1:])
    hashes = (sums[ends] - sums[starts]) * powers(INVERSE, n)[starts]
    return mix(hashes + (ends - starts).astype(np.uint64)), np.searchsorted(starts, offsets, "left")


def shingle_sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """For each text its sorted distinct shingle hashes; fewer words than ``width`` give one, none gives none."""
    w = [np.uint64(pow(0xD6E8FEB86659FD93, k + 1, 1 << 64)) for k in range(width)]
    for _, data, offsets in chunks(column):
        words, firsts = word_hashes(data, offsets)
        n = max(0, len(words) - width + 1)
        rolled = np.zeros(n, np.uint64)
        for k in range(width):
            rolled += words[k : k + n] * w[k]
        rolled = mix(rolled)
        for a, b in zip(firsts[:-1].tolist(), firsts[1:].tolist()):
            if b - a >= width:
                yield np.unique(rolled[a : b - width + 1])
            elif b > a:
                short = np.array([b - a], np.uint64)
                for k in range(b - a):
                    short += words[a + k : a + k + 1] * w[k]
                yield mix(short)
            else:
                yield np.empty(0, np.uint64)
