"""A tokenizer file's encoder with a cache of pre-tokens, for use inside tasks.

Texts over a plain alphabet, whose pre-tokens a simple pattern finds for certain, are encoded by looking their
pre-tokens up; only pre-tokens not seen before go through the library. Every other text goes through it whole.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CACHE_ENTRIES = 150_000  # pre-tokens a worker remembers, and as many older ones

_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_PLAIN = re.compile(rf"[\t\n\r\x20-\x7e{_LETTERS}]*\Z")
_PRETOKENS = {
    # byte-level files: a word keeps the space before it
    "byte": re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[0-9]+| ?[^\s0-9{_LETTERS}]+|\s+(?!\S)|\s+"),
    # word files: lower case, white space dropped, digits one by one
    "word": re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^\s0-9{_LETTERS}]+"),
}


_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that byte-level files write as themselves
_SHOWN = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in set(_PRINTED))}


class Encoder:
    def __init__(self, path: str, kind: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.kind, self.pattern, self.cache, self.old, self.model = kind, _PRETOKENS[kind], {}, {}, self.library.model

    def raw(self, text: str) -> bytes:
        """Ids as the library gives them with add_special_tokens=False, as little-endian unsigned 32-bit integers."""
        if "<|" in text or not _PLAIN.match(text):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        found = self.pattern.findall(text.lower() if self.kind == "word" else text)
        cache = self.cache
        try:
            return b"".join([cache[x] for x in found])
        except KeyError:
            self.learn(found)
            return b"".join([self.cache[x] for x in found])

    def learn(self, found: list[str]) -> None:
        """Ids of pre-tokens go into the cache; a full one becomes the old one, out of which what is asked for again is taken."""
        if len(self.cache) > CACHE_ENTRIES:
            self.cache, self.old = {}, self.cache
        cache, old = self.cache, self.old
        fresh = []
        for x in {x for x in found if x not in cache}:
            if x in old:
                cache[x] = old[x]
            else:
                fresh.append(x)
        if self.kind == "word":  # nothing but the merges is left to do for a pre-token
            for x in fresh:
                cache[x] = np.array([t.id for t in self.model.tokenize(x if x.isascii() else x.encode("utf-8").decode("latin-1").translate(_SHOWN))], "<u4").tobytes()
        else:
            for x, e in zip(fresh, self.library.encode_batch_fast(fresh, add_special_tokens=False)):
                cache[x] = np.array(e.ids, "<u4").tobytes()

    def ids(self, text: str) -> list[int]:
        return np.frombuffer(self.raw(text), "<u4").tolist()

    def spans(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, character ends and word starts of a text's tokens."""
        e = self.library.encode(text, add_special_tokens=False)
        ids = np.array(e.ids, np.uint32)
        spans = np.array(e.offsets, np.int64).reshape(-1, 2)
        words = np.array([-1 if w is None else w for w in e.word_ids], np.int64)
        begins = np.ones(len(ids), bool)
        begins[1:] = words[1:] != words[:-1]
        return ids, spans, begins


def small_batches(batches, rows: int = 512, limit: int = 1 << 20):
    """Arrow batches cut into runs of few rows and few bytes, so that a worker holds few texts as Python strings.

    A run is at most ``rows`` rows, and one row or at most ``limit`` bytes of text and binary columns.
    """
    for batch in batches:
        sizes = np.zeros(batch.num_rows, np.int64)
        for column in batch.columns:
            if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
                sizes += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
        ends, at = np.cumsum(sizes, dtype=np.int64), 0
        while at < batch.num_rows:
            before = ends[at] - sizes[at]
            to = min(at + rows, max(at + 1, int(np.searchsorted(ends, before + limit, side="right"))))
            yield batch.slice(at, to - at)
            at = to


# classes of the bytes of plain text
_SPACE, _LETTER, _DIGIT, _OTHER, _ODD = range(5)
_CLASS = np.full(256, _ODD, np.uint8)
_CLASS[0x20:0x7F] = _OTHER
_CLASS[[0x09, 0x0A, 0x0D, 0x20]] = _SPACE
_CLASS[0x30:0x3A] = _DIGIT
_CLASS[0x41:0x5B] = _CLASS[0x61:0x7B] = _LETTER
_CLASS[0x80:0xC0] = _CLASS[0xC3] = _LETTER  # the two bytes of letters of Latin-1; every other first byte is odd
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def word_pretokens(data: np.ndarray, bounds: np.ndarray) -> tuple[pa.DictionaryArray, np.ndarray, np.ndarray]:
    """Pre-tokens of a "word" file in texts laid end to end, the text each lies in, and which texts aren't plain.

    The same pre-tokens as the pattern above finds in a plain text's lower case; texts that aren't plain have none.
    """
    lead = np.flatnonzero(data == 0xC3)
    second = data[np.minimum(lead + 1, len(data) - 1)]
    low = _LOWER[data]
    low[lead[(second >= 0x80) & (second <= 0x9E)] + 1] += 0x20
    kind = _CLASS[data]
    kind[lead[(second == 0x97) | (second == 0xB7)]] = _ODD  # signs, not letters
    kind[np.flatnonzero((data[:-1] == ord("<")) & (data[1:] == ord("|")))] = _ODD
    odd = np.zeros(len(bounds) - 1, bool)
    odd[np.searchsorted(bounds, np.flatnonzero(kind == _ODD), side="right") - 1] = True
    kind[np.repeat(odd, np.diff(bounds))] = _SPACE
    edge = np.ones(len(data) + 1, bool)
    edge[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
    edge[bounds] = True
    # a quote that begins a run of signs takes the letters of a contraction
    quote = np.flatnonzero((data == 0x27) & (kind == _OTHER) & edge[:-1])
    if len(quote):
        end = bounds[np.searchsorted(bounds, quote, side="right")]
        one, two = (np.where(quote + k < end, low[np.minimum(quote + k, len(low) - 1)], 0) for k in (1, 2))
        size = np.where(np.isin(one, np.frombuffer(b"stmd", np.uint8)), 2, 0)
        pair = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        size = np.where(pair, 3, size)
        taken = size > 0
        edge[quote[taken] + 1] = False
        edge[quote[taken] + size[taken]] = True
    edge = np.flatnonzero(edge)
    start, end = edge[:-1], edge[1:]
    keep = kind[start] != _SPACE if len(data) else np.zeros(0, bool)
    start, end = start[: len(keep)][keep], end[: len(keep)][keep]
    offsets = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int64)
    column = pa.Array.from_buffers(pa.large_string(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(low[kind != _SPACE]))])
    return column.dictionary_encode(), np.searchsorted(bounds, start, side="right") - 1, odd


def word_ids(enc: Encoder, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of texts laid end to end, as ``Encoder.raw`` gives them for a "word" file, and the n + 1 offsets of the texts."""
    tokens, row, odd = word_pretokens(data, bounds)
    known = tokens.dictionary.to_numpy(zero_copy_only=False).tolist()
    enc.learn(known)
    parts = [enc.cache[x] for x in known]
    flat, size = np.frombuffer(b"".join(parts), "<u4"), np.array([len(x) // 4 for x in parts], np.int64)
    first = np.cumsum(size) - size
    code = tokens.indices.to_numpy(zero_copy_only=False)
    each = size[code] if len(size) else np.zeros(0, np.int64)
    ends = np.cumsum(each)
    ids = flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(first[code] - ends + each, each)] if len(ends) else np.zeros(0, "<u4")
    offsets = np.concatenate([[0], ends])[np.searchsorted(row, np.arange(len(bounds)))]
    if odd.any():
        texts = [ids[a:b] for a, b in zip(offsets[:-1], offsets[1:])]
        for k in np.flatnonzero(odd).tolist():
            texts[k] = np.frombuffer(enc.raw(data[bounds[k]:bounds[k + 1]].tobytes().decode("utf-8")), "<u4")
        ids, offsets = np.concatenate(texts), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    return ids, offsets


@lru_cache(maxsize=4)
def encoder(path: str, kind: str) -> Encoder:
    """One encoder for each file and worker process."""
    return Encoder(path, kind)


class Decoder:
    """Bytes of a byte-level file's ids; ids outside the file and invalid UTF-8 are left to the library.

    The library is loaded again at the first text that needs it, so that a worker doesn't hold it for nothing.
    """

    def __init__(self, path: str):
        self.path, self.library = path, None
        byte = {chr(b): b for b in _PRINTED} | {c: b for b, c in _SHOWN.items()}
        vocabulary = self._load().get_vocab(with_added_tokens=True)
        self.pieces = {i: bytes(byte[c] for c in t) for t, i in vocabulary.items() if all(c in byte for c in t)}

    def _load(self):
        from tokenizers import Tokenizer
        return Tokenizer.from_file(self.path)

    def text(self, raw: bytes) -> str:
        ids = np.frombuffer(raw, "<u4").tolist()
        try:
            return b"".join([self.pieces[i] for i in ids]).decode("utf-8")
        except (KeyError, UnicodeDecodeError):
            self.library = self.library or self._load()
            return self.library.decode(ids, skip_special_tokens=False)


@lru_cache(maxsize=4)
def decoder(path: str) -> Decoder:
    return Decoder(path)
