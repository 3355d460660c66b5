"""Detection of periodic runs of words, by tiles of period octaves.

A run of period q and n words has n - q consecutive words that equal the word q places on: a stretch. Periods are split
into octaves; octave B holds the periods B to 2B - 1. A run has at least three periods, so its stretch has at least 2B
places and holds the whole block of B places from some multiple of B on. At each such boundary the block's hash is compared
with the hashes 1 to 2 octaves on, and every hit is extended both ways word by word (the boundary's Z values).

Texts are exploded into overlapping tiles, one grid per band of octaves; each tile is solved by itself and knows only what
lies inside it. Its stretches are fragments (document, period, from, to), which are shuffled by document and period and
stitched where they touch. A text no longer than a tile is one tile for all octaves and is solved where it is read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from .common import bitmap, likely, store
from .wordstream import _powers, mix, text_chunks, words_of

MIN_WORDS = 24  # words of a run, at least
MIN_PERIODS = 3  # periods of a run, at least
TILE_WORDS = 8_192  # words between the starts of neighbouring tiles of the first band
TILE_BYTES = 65_536  # longer texts are cut into tiles
FIRST = 8  # block of the first octave, which holds the periods 1 to 15
BAND = 8  # a band's tiles are so many times as long as those of the band before

_RATIO = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def least_stretch(period):
    """Places of a run's stretch, at least."""
    return np.maximum(MIN_WORDS - period, (MIN_PERIODS - 1) * period)


def word_ids(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(id, row) of all words of texts laid end to end; ids are equal where the words' bytes are. One id that no other word
    has stands behind each text."""
    words = words_of(data, bounds, lower=False)
    count, texts = len(words.hash), len(bounds) - 1
    starts, lengths = bounds[words.row] + words.start, words.end - words.start
    inside = np.zeros(len(data) + 1, np.int8)
    inside[starts] += 1
    inside[starts + lengths] -= 1
    packed = data[np.cumsum(inside[:-1], dtype=np.int8) > 0]
    column = pa.Array.from_buffers(pa.large_binary(), count, [None, pa.py_buffer(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(packed))])
    ids = column.dictionary_encode().indices.to_numpy(zero_copy_only=False)
    out = np.empty(count + texts, np.int64)
    row = np.empty(count + texts, np.int64)
    place = np.arange(count) + words.row
    out[place], row[place] = ids, words.row
    ends = words.first[1:] + np.arange(texts)
    out[ends], row[ends] = -1 - np.arange(texts), np.arange(texts)
    return out, row


def _true_runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8)))
    return edge[::2], edge[1::2]


class _Found:
    """Stretches found so far: one inside which a hit's window lies, and whose period divides the hit's, makes the hit void."""

    def __init__(self):
        self.rows: list[tuple[int, int, int]] = []

    def freeze(self) -> None:
        self.start, self.end, self.period = (np.array(c, np.int64) for c in zip(*sorted(self.rows))) if self.rows else (np.empty(0, np.int64),) * 3

    def void(self, at: np.ndarray, period: np.ndarray, block: int) -> np.ndarray:
        out = np.zeros(len(at), bool)
        if len(self.start):
            last = np.searchsorted(self.start, at, side="right") - 1
            for back in range(3):
                i = np.maximum(last - back, 0)
                out |= (last >= back) & (self.end[i] + self.period[i] >= at + period + block) & (period % self.period[i] == 0)
        return out


def stretches(ids: np.ndarray, low: int, high: int, open_left: bool = False, open_right: bool = False) -> list[tuple[int, int, int]]:
    """(period, from, to): maximal stretches of octaves ``low`` to ``high`` that are long enough, or that meet an open end.

    A multiple of a stretch's period may come out as well where it covers the same words.
    """
    n = len(ids)
    out: list[tuple[int, int, int]] = []
    if n < MIN_WORDS:
        return out
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(ids.astype(np.uint64) + np.uint64(1)) * _powers(_RATIO, n))])
        back = _powers(_INVERSE, n)
    found = _Found()
    block = low
    while block <= high and MIN_PERIODS * (1 if block == FIRST else block) <= n:
        with np.errstate(over="ignore"):
            h = (sums[block:] - sums[:-block]) * back[:n - block + 1]
        found.freeze()
        if block == FIRST:
            grid, hits = h[::block], []
            for q in range(1, 2 * block):
                same = np.flatnonzero(grid[:max(0, -(-(len(h) - q) // block))] == h[q::block])
                hits.append((np.full(len(same), q), same * block))
            period, at = (np.concatenate(c) for c in zip(*hits))
        else:
            places = np.arange(block, len(h))
            first = (places // block - 1) * block
            hit = np.flatnonzero(h[block:] == h[first])
            at, period = first[hit], places[hit] - first[hit]
        keep = ~found.void(at, period, block)
        at, period = at[keep], period[keep]
        order = np.lexsort((at, period))
        at, period = at[order], period[order]
        split = np.flatnonzero((np.diff(at) != block) | (np.diff(period) != 0)) + 1
        heads, tails = np.concatenate([[0], split]), np.concatenate([split, [len(at)]])
        if len(at):
            # the block before the first and the one after the last hit differ somewhere, so a stretch ends within them
            a, b, q = at[heads], at[tails - 1] + block, period[heads]
            near = (a < block) | (b + block + q > n)
            for a, b, q in zip(*(x[near | (b - a + 2 * (block - 1) >= least_stretch(q))].tolist() for x in (a, b, q))):
                lo, hi = max(0, a - block), min(n - q, b + block)
                for s, e in zip(*_true_runs(ids[lo:hi] == ids[lo + q:hi + q])):
                    s, e = lo + int(s), lo + int(e)
                    whole = e - s >= least_stretch(q)
                    if whole or (open_left and s == 0) or (open_right and e == n - q):
                        out.append((q, s, e))
                    if whole:
                        found.rows.append((s, e, q))
        block *= 2
    return sorted(set(out))


def _fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stretches of texts that are one tile each."""
    for batch in batches:
        ids = batch.column("_id"), batch.column("_digest")
        for at, data, bounds in text_chunks(batch.column("text")):
            with np.errstate(over="ignore"):
                words, row = word_ids(data, bounds)
            longest = int(np.bincount(row, minlength=1).max()) if len(row) else 0
            found = np.array(stretches(words, FIRST, max(FIRST, longest // MIN_PERIODS)), np.int64).reshape(-1, 3)
            own = row[found[:, 1]]
            base = np.searchsorted(row, own)
            take = pa.array(at + own)
            yield pa.RecordBatch.from_arrays([*(c.take(take) for c in ids), *(pa.array(c) for c in (found[:, 0], found[:, 1] - base, found[:, 2] - base))], _FRAGMENT)


_FRAGMENT = ["_id", "_digest", "period", "lo", "hi"]
_FRAGMENT_TYPE = "_id long, _digest long, period long, lo long, hi long"


def _tiles(batches: Iterator[pa.RecordBatch], tile: int) -> Iterator[pa.RecordBatch]:
    """Overlapping tiles of every text's word ids, a grid for each band of octaves."""
    for batch in batches:
        keys = batch.column("_id"), batch.column("_digest")
        for at, data, bounds in text_chunks(batch.column("text")):
            with np.errstate(over="ignore"):
                words, row = word_ids(data, bounds)
            ends = np.searchsorted(row, np.arange(len(bounds)))
            for k in range(len(bounds) - 1):
                ids = words[ends[k]:ends[k + 1] - 1].astype(np.int32)
                n, step, low = len(ids), tile, FIRST
                while low == FIRST or MIN_PERIODS * low <= n:
                    high = step // 8
                    for start in range(0, max(n, 1), step):
                        a, b = max(0, start - high), min(n, start + step + 3 * high)
                        one = pa.array([at + k])
                        yield pa.RecordBatch.from_arrays(
                            [*(c.take(one) for c in keys), pa.array([low]), pa.array([high]), pa.array([a]), pa.array([b < n]), pa.array([ids[a:b].tobytes()])],
                            ["_id", "_digest", "low", "high", "first", "more", "ids"])
                        if b == n:
                            break
                    low, step = 2 * high, step * BAND


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fragments of tiles, at places of their texts."""
    for batch in batches:
        for k in range(batch.num_rows):
            low, high, first, more = (batch.column(c)[k].as_py() for c in ("low", "high", "first", "more"))
            ids = np.frombuffer(batch.column("ids")[k].as_buffer(), np.int32).astype(np.int64)
            found = np.array(stretches(ids, low, high, first > 0, more), np.int64).reshape(-1, 3)
            take = pa.array(np.full(len(found), k))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).take(take) for c in ("_id", "_digest")), pa.array(found[:, 0]), pa.array(found[:, 1] + first), pa.array(found[:, 2] + first)], _FRAGMENT)


def _stitched(fragments: DataFrame) -> DataFrame:
    """(_id, _digest, start, length, period): fragments of one text and period that touch are one; runs that are long enough stay."""
    own = Window.partitionBy("_id", "_digest", "period").orderBy("lo", "hi")
    reach = F.max("hi").over(own.rowsBetween(Window.unboundedPreceding, -1))
    part = F.sum(F.when(F.col("lo") <= reach, 0).otherwise(1)).over(own.rowsBetween(Window.unboundedPreceding, 0))
    whole = (fragments.distinct().withColumn("_part", part).groupBy("_id", "_digest", "period", "_part").agg(F.min("lo").alias("start"), F.max("hi").alias("hi")))
    size = F.col("hi") - F.col("start")
    whole = whole.where(size >= F.greatest(MIN_WORDS - F.col("period"), (MIN_PERIODS - 1) * F.col("period")))
    # the same words with a multiple of the period are the same run
    return whole.withColumn("length", size + F.col("period")).groupBy("_id", "_digest", "start", "length").agg(F.min("period").alias("period"))


def _collapsed(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        runs = batch.column("_runs")
        for at, data, bounds in text_chunks(batch.column("text")):
            with np.errstate(over="ignore"):
                words = words_of(data, bounds, lower=False)
            size, keep = np.diff(words.first), np.ones(len(words.hash), bool)
            for k in np.flatnonzero(runs.slice(at, len(size)).is_valid().to_numpy(zero_copy_only=False)).tolist():
                own = runs[at + k].values
                start, length, period = (own.field(c).to_numpy(zero_copy_only=False) for c in ("start", "length", "period"))
                change = np.zeros(int(size[k]) + 1, np.int64)
                np.add.at(change, start + period, 1)
                np.add.at(change, start + length, -1)
                keep[words.first[k]:words.first[k + 1]] = np.cumsum(change[:-1]) == 0
            row = words.row[keep]
            begin, end = bounds[row] + words.start[keep], bounds[row] + words.end[keep]
            # each kept word is copied with the byte behind it, made a space; a text's last word without
            last = np.ones(len(row), bool)
            last[:-1] = row[1:] != row[:-1]
            inside = np.zeros(len(data) + 2, np.int8)
            inside[begin] += 1
            inside[end + ~last] -= 1
            blank = data.copy()
            blank[end[~last]] = 0x20
            packed = np.ascontiguousarray(blank[np.cumsum(inside[:-2], dtype=np.int8) > 0])
            total = np.concatenate([[0], np.cumsum(end - begin + ~last)])
            offsets = total[np.searchsorted(row, np.arange(len(size) + 1))]
            text = pa.Array.from_buffers(pa.large_string(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(packed)]).cast(pa.string())
            part = batch.slice(at, len(size))
            yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), part.column("_runs"), text, pa.array(size.astype(np.int64))], [*names, "runs", "collapsed", "n_words"])


def periodic_runs(documents: DataFrame, tile_words: int = TILE_WORDS, tile_bytes: int = TILE_BYTES) -> DataFrame:
    """``documents`` with ``runs``, ``collapsed`` and ``n_words``.

    Words are maximal pieces without white space (space, 0x09-0x0D), compared byte by byte. ``runs`` lists every run of a
    text, as (start, length, period) in words, ordered by start, then period: a stretch of consecutive words whose smallest
    period is ``period``, of at least 24 words and three periods, which no word next to it continues. It's empty, not null,
    without runs. ``collapsed`` has the words, joined by one space, that no run holds behind its first period.

    Null and empty texts have no words, no runs and an empty ``collapsed``. Repeated rows are treated alike, rows of one id
    with unlike texts by themselves; null ids are allowed. Other columns stay; those named like an added one are replaced.
    An empty table gives no rows. Every octave up to a third of the text is searched, whatever its length; the result does
    not depend on the size of tiles. Work in one task is bounded by a text, or by a tile for texts over ``tile_bytes``
    up to periods of an eighth of the tile's step, and for longer periods by a tile that grows with the period.
    """
    names = [c for c in documents.columns if c not in ("runs", "collapsed", "n_words", "_id", "_digest", "_runs")]
    rows = documents.select(*names).withColumn("_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long"))).withColumn("_digest", F.xxhash64("doc_id", "text"))
    texts = rows.select("_id", "_digest", "text").where("text is not null")
    short = texts.where(F.octet_length("text") <= tile_bytes).mapInArrow(_fragments, _FRAGMENT_TYPE)
    tiles = texts.where(F.octet_length("text") > tile_bytes).mapInArrow(
        lambda batches: _tiles(batches, tile_words), "_id long, _digest long, low long, high long, first long, more boolean, ids binary")
    tiles = tiles.repartition("_id", "_digest", "low", "first")
    runs = _stitched(store(short.unionByName(tiles.mapInArrow(_solved, _FRAGMENT_TYPE))))
    runs = store(runs.groupBy("_id", "_digest").agg(F.array_sort(F.collect_list(F.struct("start", "length", "period"))).alias("_all")))  # bounded by a text
    runs = runs.select("_id", "_digest", F.expr("array_sort(_all, (x, y) -> case when x.start < y.start then -1 when x.start > y.start then 1 when x.period < y.period then -1 when x.period > y.period then 1 else 0 end)").alias("_runs"))
    bits = store(bitmap(runs.select("_digest")))
    found = likely(rows, bits, True, "_digest").join(runs, ["_id", "_digest"], "left").select(*rows.columns, "_runs")
    rest = likely(rows, bits, False, "_digest").withColumn("_runs", F.lit(None).cast(dict(runs.dtypes)["_runs"]))
    fields = ", ".join(f"`{n}` {t}" for n, t in documents.select(*names).dtypes)
    out = found.unionByName(rest).mapInArrow(
        lambda batches: _collapsed(batches, names), f"{fields}, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string, n_words long")
    empty = F.expr("cast(array() as array<struct<start:bigint,length:bigint,period:bigint>>)")
    return out.withColumn("runs", F.coalesce("runs", empty))
