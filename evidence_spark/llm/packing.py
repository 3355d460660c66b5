"""Packing documents into fixed windows from a non-negative least-squares plan.

Documents longer than a window give full windows and a remainder. The histogram of remainder lengths (one counter per
length, whatever the corpus) is matched by repeat counts of shallow length combinations that fill a window exactly:
the counts are a non-negative least-squares solution, rounded down. What is left of the histogram is packed greedily,
best fit first. Pieces find their place by their rank among the pieces of their length, so no row passes the driver.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from .common import store
from .fast_bpe import encoder, word_ids
from .wordstream import text_chunks

WINDOW = 2048
END_ID = 1
THREES = 24  # combinations of three tried for each length
FOURS = 12  # combinations of four tried for each length
ROUNDS = 1500  # steps of the least-squares solver


def combinations(present: np.ndarray, window: int) -> np.ndarray:
    """Rows of up to four lengths (0: unused), each summing to the window, over lengths that occur."""
    here = np.zeros(window + 1, bool)
    here[present] = True
    here[0] = False
    rows = [np.array([[window, 0, 0, 0]])] if here[window] else []
    low = present[(present > 0) & (present < window)]
    a = low[(low <= window - low) & here[window - low]]
    rows.append(np.stack([a, window - a, a * 0, a * 0], axis=1))
    if len(low):
        for share in range(1, THREES + 1):
            b = low[np.searchsorted(low, (window - low) * share // (2 * THREES + 1)).clip(0, len(low) - 1)]
            c = window - low - b
            ok = (c > 0) & here[c.clip(0)]
            rows.append(np.stack([low, b, c, low * 0], axis=1)[ok])
        for share in range(1, FOURS + 1):
            b = low[np.searchsorted(low, (window - low) * share // (3 * FOURS + 1)).clip(0, len(low) - 1)]
            c = low[np.searchsorted(low, (window - low - b) * share // (2 * FOURS + 1)).clip(0, len(low) - 1)]
            d = window - low - b - c
            ok = (d > 0) & here[d.clip(0)]
            rows.append(np.stack([low, b, c, d], axis=1)[ok])
    return np.unique(np.sort(np.concatenate(rows), axis=1)[:, ::-1], axis=0)


def least_squares(combos: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Non-negative x with the least |A x - counts|: accelerated projected gradients on the sparse columns of A."""
    if not len(combos):
        return np.zeros(0)
    n = len(counts)
    used = (combos > 0).astype(float)
    forward = lambda x: np.bincount(combos.ravel(), weights=(used * x[:, None]).ravel(), minlength=n)
    back = lambda r: (r[combos] * used).sum(axis=1)
    v = np.ones(len(combos))
    for _ in range(30):
        v = back(forward(v))
        top = np.linalg.norm(v)
        v /= top
    x = y = np.zeros(len(combos))
    t = 1.0
    goal = counts.astype(float).copy()
    goal[0] = 0
    for _ in range(ROUNDS):
        fresh = np.maximum(y - back(forward(y) - goal) / (1.05 * top), 0)
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = fresh + (t - 1) / after * (fresh - x)
        x, t = fresh, after
    return x


def plan(counts: np.ndarray, window: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, how many such sequences) using every counted piece exactly once."""
    left = counts.astype(np.int64).copy()
    left[0] = 0
    combos = combinations(np.flatnonzero(left), window) if left.any() else np.zeros((0, 4), np.int64)
    x = least_squares(combos, left)
    out: Counter = Counter()

    def take(row, most: int) -> int:
        need = Counter(int(v) for v in row if v)
        got = min([most, *(left[v] // k for v, k in need.items())])
        if got > 0:
            for v, k in need.items():
                left[v] -= got * k
            out[tuple(sorted(need.elements(), reverse=True))] += int(got)
        return got

    order = np.argsort(-x, kind="stable")
    for i in order:
        if x[i] >= 1:
            take(combos[i], int(x[i]))
    bins: dict[int, list[list]] = {}  # room left -> runs [lengths, how many]
    for v in range(window, 0, -1):
        c = int(left[v])
        while c:
            room = min((r for r in bins if r >= v), default=None)
            if room is None:
                per = window // v
                for k, many in ((per, c // per), (c % per, 1)):
                    if k and many:
                        bins.setdefault(window - k * v, []).append([(v,) * k, many])
                break
            run = bins[room][-1]
            t = min(c, run[1])
            run[1] -= t
            if not run[1]:
                bins[room].pop()
                if not bins[room]:
                    del bins[room]
            bins.setdefault(room - v, []).append([run[0] + (v,), t])
            c -= t
    for runs in bins.values():
        for lengths, many in runs:
            out[tuple(sorted(lengths, reverse=True))] += many
    return sorted(out.items())


def seats(planned: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, end rank, first sequence, offset): rank r of a length sits in sequence first + r - first rank."""
    used: Counter = Counter()
    out, sequence = [], 0
    for lengths, many in planned:
        offset = 0
        for v in lengths:
            out.append((v, used[v], used[v] + many, sequence, offset))
            used[v] += many
            offset += v
        sequence += many
    return out


def token_pieces(documents: DataFrame, path: str, window: int, end_id: int) -> DataFrame:
    """Pieces of every document's ids with a mark of the task that made them and their rank there among equal lengths."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, block, ranks = encoder(path, "word"), TaskContext.get().partitionId(), np.zeros(window + 1, np.int64)
        for batch in batches:
            docs = batch.column("doc_id")
            for at, data, bounds in text_chunks(batch.column("text")):
                ids, offsets = word_ids(enc, data, bounds)
                raw = memoryview(np.insert(ids, offsets[1:], end_id).astype("<u4").tobytes())
                count = np.diff(offsets) + 1  # with the end of each text
                first = np.cumsum(count) - count
                many = -(-count // window)
                row = np.repeat(np.arange(len(count)), many)
                start = (np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)) * window
                size = np.minimum(window, count[row] - start)
                sums = [zlib.crc32(raw[4 * i:4 * (i + n)]) for i, n in zip((first[row] + start).tolist(), size.tolist())]
                order = np.argsort(size, kind="stable")
                heads = np.searchsorted(size[order], size[order])
                nth = np.empty(len(size), np.int64)
                nth[order] = np.arange(len(size)) - heads
                nth += ranks[size]
                ranks += np.bincount(size, minlength=window + 1)
                columns = [start, size, np.array(sums, np.int64), count[row], nth, np.full(len(size), block, np.int64)]
                yield pa.RecordBatch.from_arrays([docs.take(pa.array(at + row)), *(pa.array(c, pa.int64()) for c in columns)], NAMES)

    NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "nth", "block"]
    rows = documents.select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(run, ", ".join(f"{n} long" for n in NAMES))


def pack_documents(documents: DataFrame, path: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """One row per piece: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset).

    A document's ids are the tokenizer's, without special tokens, followed by ``end_id``. Documents over a window are
    cut at its multiples and nowhere else; the remainder shares a sequence. Null and empty texts are one piece of one
    id. Repeated ids are packed as separate documents with the same id; null ids stay null. An empty table gives no
    rows. Sequences hold at most ``window`` ids without gaps; sequence ids are consecutive from 0.

    The driver sees the histogram (one counter per length up to the window) and the plan made from it, both bounded by
    the window alone. A length's ranks are offsets by task plus ranks in the task, so equal lengths crowd nowhere.
    """
    spark = documents.sparkSession
    pieces = store(token_pieces(documents, path, window, end_id))
    by_block = store(pieces.groupBy("length", "block").agg(F.count("*").alias("n")))
    counts = np.zeros(window + 1, np.int64)
    for length, n in by_block.groupBy("length").agg(F.sum("n")).collect():  # at most a row for each length
        counts[length] = n
    rules = seats(plan(counts, window))
    before = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = store(by_block.select("length", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")))
    ranked = pieces.join(offsets, ["length", "block"]).withColumn("rank", F.col("base") + F.col("nth"))
    table = spark.createDataFrame(rules or [(0, 0, 0, 0, 0)], "seat_length long, lo long, hi long, first long, offset long")
    # bounded by the window and the number of combinations, not by the data
    placed = ranked.join(F.broadcast(table), (F.col("length") == F.col("seat_length")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("first") + F.col("rank") - F.col("lo")).alias("sequence_id"), "offset")
