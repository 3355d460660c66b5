"""Distinct terms of Arrow text columns, counted by text.

A term is a maximal run of letters A-Z, a-z and code points beyond ASCII, A-Z lower-cased; nothing else is changed. Runs of
texts are cut into terms on their UTF-8 bytes at once, and equal terms are found by Arrow's dictionary, byte by byte.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_IN_TERM = np.zeros(256, bool)
_IN_TERM[0x41:0x5B] = _IN_TERM[0x61:0x7B] = _IN_TERM[0x80:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


@dataclass
class TermCounts:
    """``terms``: distinct terms; row, term and count of every (text, term) that occurs, in order of row, then term."""

    terms: pa.Array
    row: np.ndarray
    term: np.ndarray
    count: np.ndarray


def term_counts(data: np.ndarray, bounds: np.ndarray) -> TermCounts:
    """``data``: bytes of texts laid end to end; ``bounds``: their n + 1 offsets."""
    inside = _IN_TERM[data]
    edge = np.ones(len(data) + 1, bool)
    edge[1:-1] = inside[1:] != inside[:-1]
    edge[bounds] = True
    edge = np.flatnonzero(edge)
    start, end = edge[:-1], edge[1:]
    keep = inside[start] if len(data) else np.zeros(0, bool)
    start, end = start[: len(keep)][keep], end[: len(keep)][keep]
    offsets = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int64)
    packed = np.ascontiguousarray(_LOWER[data[inside]])
    column = pa.Array.from_buffers(pa.large_string(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(packed)]).dictionary_encode()
    size = max(len(column.dictionary), 1)
    row = np.searchsorted(bounds, start, side="right") - 1
    key, count = np.unique(row * size + column.indices.to_numpy(zero_copy_only=False), return_counts=True)
    return TermCounts(column.dictionary, key // size, key % size, count)
