"""Vectorised word and shingle hashing over Arrow text columns.

Works on the UTF-8 bytes of many texts at once. A word is a maximal run of bytes other than space and 0x09-0x0D, with
A-Z lower-cased where asked. A word's hash is taken from running sums of a keyed polynomial modulo 2^64, so the cost is
a few array operations per byte and no Python object per word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 4 << 20  # texts are hashed in runs of about this many bytes; a longer text forms a run of its own

_R = np.uint64(0x9E3779B97F4A7C15)
_R_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE_KEYS = np.random.Generator(np.random.PCG64(8128)).integers(1, 1 << 63, 256, dtype=np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER_KEYS = _BYTE_KEYS[_LOWER]
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads every input bit over the whole 64-bit word."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


@dataclass
class Words:
    """Words of consecutive rows: row of each word, byte span inside its own text, hash; ``first`` has a word offset per row."""

    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray


def words_of(data: np.ndarray, bounds: np.ndarray, lower: bool) -> Words:
    """``data``: bytes of texts laid end to end; ``bounds``: their n + 1 offsets."""
    space = _IS_SPACE[data]
    edge = np.empty(len(data) + 1, bool)
    edge[0] = edge[-1] = True
    edge[1:-1] = space[1:] != space[:-1]
    edge[bounds] = True
    edge = np.flatnonzero(edge)
    start, end = edge[:-1], edge[1:]
    keep = ~space[start] if len(data) else np.zeros(0, bool)
    start, end = start[: len(keep)][keep], end[: len(keep)][keep]
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum((_LOWER_KEYS if lower else _BYTE_KEYS)[data] * _powers(_R, len(data)), out=sums[1:])
    back = _powers(_R_INVERSE, len(data) + 1)
    h = mix((sums[end] - sums[start]) * back[start] + (end - start).astype(np.uint64))
    row = np.searchsorted(bounds, start, side="right") - 1
    first = np.searchsorted(row, np.arange(len(bounds)))
    return Words(row, start - bounds[row], end - bounds[row], h, first)


def text_chunks(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None and column.buffers()[2].size else np.empty(0, np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK_BYTES, side="right")) - 1)
        to = min(to, len(column))
        yield at, data[offsets[at]:offsets[to]], offsets[at:to + 1] - offsets[at]
        at = to


def gram_hashes(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, valid) of the n words from each word on; not valid where the text ends before."""
    count = len(words.hash)
    if count < n:
        return np.empty(0, np.uint64), np.empty(0, bool)
    sums = np.zeros(count + 1, np.uint64)
    np.cumsum(words.hash * _powers(_R, count), out=sums[1:])
    h = (sums[n:] - sums[:-n]) * _powers(_R_INVERSE, count - n + 1)
    return mix(h), words.row[: count - n + 1] == words.row[n - 1:]
