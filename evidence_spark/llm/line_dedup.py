"""Removal of passages repeated across documents, by winnowing.

Texts keep their passages inside long paragraphs, so the line that is hashed is a typeset one: ``LINE`` consecutive words,
starting at any word; physical line breaks count as white space. Of every ``min_words - LINE + 1`` consecutive line hashes
the smallest is selected, so any run of ``min_words`` words that two documents share has a selected hash at the same place
in both. Selected hashes meet by a shuffle; each later place is matched with the first one, the match is extended word by
word both ways, and runs of at least ``min_words`` words are deleted from the later document. The first place of a hash
need not be the one that shares most: windows of ``min_words`` words that stand at a shared hash and are left over meet a
second time, by the hash of the whole window, and go from every document but the first that has them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import bitmap, folded, likely, store
from .fast_bpe import small_batches
from .wordstream import Words, gram_hashes, text_chunks, words_of

LINE = 26  # words of a hashed line
MIN_WORDS = 50  # words of a run that is deleted
STRIDE = 64  # bounds of the passages fetched for comparison are multiples of this many words

_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def sliding(x: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """Least or greatest of every ``width`` consecutive values, from windows that double."""
    out, have = x, 1
    while have < width:
        step = min(have, width - have)
        out, have = pick(out[:-step], out[step:]), have + step
    return out


def selected(words: Words, line: int, min_words: int) -> np.ndarray:
    """Word positions whose line hash is the smallest of a window."""
    h, valid = gram_hashes(words, line)
    width = min_words - line + 1
    if len(h) < width:
        return np.empty(0, np.int64)
    h = np.where(valid, h, _NONE)
    whole = words.row[: len(words.row) - min_words + 1] == words.row[min_words - 1:]  # windows inside one text
    least = np.where(whole, sliding(h, width, np.minimum), np.uint64(0))
    # a hash is the smallest of some window around it if the greatest of those windows' least hashes is no smaller
    edge = np.zeros(width - 1, np.uint64)
    spots = np.flatnonzero((sliding(np.concatenate([edge, least, edge]), width, np.maximum) >= h) & valid)
    # periodic text repeats its smallest hash: of such a chain each window keeps one, the last that it reaches
    chain = (h[spots[1:]] == h[spots[:-1]]) & (spots[1:] - spots[:-1] <= width) & (words.row[spots[1:]] == words.row[spots[:-1]])
    if not chain.any():
        return spots
    keep = np.ones(len(spots), bool)
    edge = np.flatnonzero(np.diff(np.concatenate([[False], chain, [False]]).astype(np.int8)))
    for first, last in zip(edge[::2], edge[1::2]):
        at = first
        while at < last:
            reach = min(last, int(np.searchsorted(spots, spots[at] + width, side="right")) - 1)
            keep[at + 1:reach] = False
            at = reach
    return spots[keep]


def fingerprints(documents: DataFrame, line: int, min_words: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for at, data, bounds in text_chunks(batch.column("text")):
                with np.errstate(over="ignore"):
                    words = words_of(data, bounds, lower=False)
                    spots = selected(words, line, min_words)
                    h, _ = gram_hashes(words, line)
                row = words.row[spots]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h[spots].view(np.int64)) if len(spots) else pa.array([], pa.int64()), pa.array(ids[at + row].astype(np.int64)),
                     pa.array((spots - words.first[row]).astype(np.int32))], ["gram", "doc_id", "pos"])

    return documents.where(F.col("doc_id").isNotNull()).select("doc_id", "text").mapInArrow(run, "gram long, doc_id long, pos int")


def _passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words lo to hi of every text, as text, for each of its spans."""
    for batch in batches:
        for at, data, bounds in text_chunks(batch.column("text")):
            with np.errstate(over="ignore"):
                words = words_of(data, bounds, lower=False)
            spans = batch.column("spans").slice(at, len(bounds) - 1)
            lo, hi = (spans.flatten().field(c).to_numpy(zero_copy_only=False) for c in ("lo", "hi"))
            row = np.repeat(np.arange(len(spans)), spans.value_lengths().to_numpy(zero_copy_only=False))
            a = np.minimum(words.first[row] + lo, words.first[row + 1])
            b = np.maximum(a, np.minimum(words.first[row] + hi, words.first[row + 1]))
            out = [data[bounds[k] + words.start[i]:bounds[k] + words.end[j - 1]].tobytes() if i < j else b"" for k, i, j in zip(row.tolist(), a.tolist(), b.tolist())]
            yield pa.RecordBatch.from_arrays([batch.column("f_doc").take(pa.array(at + row)), pa.array(lo), pa.array(hi), pa.array(out, pa.binary()).cast(pa.string())], ["f_doc", "lo", "hi", "passage"])


def _digest(raw: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "little", signed=True)


def _own(raw: bytes) -> Words:
    data = np.frombuffer(raw, np.uint8)
    return words_of(data, np.array([0, len(data)]), lower=False)


def _runs(mask: np.ndarray) -> np.ndarray:
    """Starts and ends, in turn, of the runs of true values."""
    return np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8)))


def _settle(batches: Iterator[pa.RecordBatch], line: int, min_words: int) -> Iterator[pa.RecordBatch]:
    """Runs that the matches delete from a text, and the windows at its shared hashes that they leave over."""
    for batch in small_batches(batches):
        digests, runs, windows, none = [], [], [], np.empty(0, np.int64)
        for text, found, grams in zip(*(batch.column(c) for c in ("text", "found", "grams"))):
            raw = (text.as_py() or "").encode("utf-8")
            with np.errstate(over="ignore"):
                own = _own(raw)
                gone = _matched(own, found.as_py() or [], min_words)
                h, _ = gram_hashes(own, line)
                whole, _ = gram_hashes(own, min_words)
            left = none, none, none.astype(bool)
            if len(whole):
                known, later = (grams.values.field(c).to_numpy(zero_copy_only=False) for c in ("gram", "later"))
                least = sliding(h, min_words - line + 1, np.minimum).view(np.int64)
                sums = np.concatenate([[0], np.cumsum(gone)])
                open_ = sums[min_words:] - sums[:-min_words] < min_words
                at = np.flatnonzero(open_ & np.isin(least, known))
                at = at[np.unique(whole[at], return_index=True)[1]]
                left = least[at], whole[at].view(np.int64), np.isin(least[at], known[later])
            digests.append(_digest(raw))
            runs.append(_runs(gone).tolist())
            windows.append(left)
        ends = np.cumsum([0, *(len(w[0]) for w in windows)]).astype(np.int32)
        flat = [pa.array(np.concatenate(c)) for c in zip(*windows)] if windows else [pa.array(none), pa.array(none), pa.array(none.astype(bool))]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(digests, pa.int64()), pa.array(runs, pa.list_(pa.int32())),
             pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(flat, ["gram", "win", "later"]))], ["doc_id", "digest", "runs", "windows"])


def _delete(batches: Iterator[pa.RecordBatch], min_words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found, wins = batch.column("found"), batch.column("wins")
        names = [n for n in batch.schema.names if n not in ("found", "wins")]
        hit = np.flatnonzero(found.is_valid().to_numpy(zero_copy_only=False) | wins.is_valid().to_numpy(zero_copy_only=False))
        texts: dict[int, tuple[str, int]] = {}
        for row in hit.tolist():
            result = _without_runs(batch.column("text")[row].as_py() or "", found[row].as_py() or [], wins[row].as_py() or [], min_words)
            if result is not None:
                texts[row] = result
        removed = np.zeros(batch.num_rows, np.int64)
        column = batch.column("text")
        if texts:
            for row, (_, n) in texts.items():
                removed[row] = n
            where = np.array(sorted(texts))
            mask = np.zeros(batch.num_rows, bool)
            mask[where] = True
            column = column.cast(pa.large_string()) if column.nbytes > (1 << 30) else column
            import pyarrow.compute as pc
            column = pc.replace_with_mask(column, pa.array(mask), pa.array([texts[r][0] for r in where.tolist()], column.type)).cast(pa.string())
        arrays = [column if n == "text" else batch.column(n) for n in names]
        yield pa.RecordBatch.from_arrays([*arrays, pa.array(removed)], [*names, "n_removed"])


def _matched(own: Words, found: list[dict], min_words: int) -> np.ndarray:
    gone = np.zeros(len(own.hash), bool)
    passages = [match["passage"].encode("utf-8") for match in found]
    others = words_of(np.frombuffer(b"".join(passages), np.uint8), np.cumsum([0, *map(len, passages)]), lower=False)
    for k, match in enumerate(found):
        other = others.hash[others.first[k]:others.first[k + 1]]
        at = match["lo"] + match["shift"]
        skip = max(0, -at)
        a = own.hash[at + skip:at + len(other)]
        edge = _runs(a == other[skip:skip + len(a)])
        for i, j in zip(edge[::2], edge[1::2]):
            if j - i >= min_words:
                gone[at + skip + i:at + skip + j] = True
    return gone


def _without_runs(text: str, found: list[dict], wins: list[int], min_words: int) -> tuple[str, int] | None:
    raw = text.encode("utf-8")
    with np.errstate(over="ignore"):
        own = _own(raw)
        gone = np.zeros(len(own.hash), bool)
        digest = _digest(raw)
        for runs in (f["runs"] for f in found if f["digest"] == digest):
            for i, j in zip(runs[::2], runs[1::2]):
                gone[i:j] = True
        if wins:
            for i in np.flatnonzero(np.isin(gram_hashes(own, min_words)[0].view(np.int64), np.array(wins, np.int64))).tolist():
                gone[i:i + min_words] = True
    if not gone.any():
        return None
    edge = _runs(gone)
    parts, at = [], 0
    for i, j in zip(edge[::2], edge[1::2]):
        if j < len(gone):
            start, end = int(own.start[i]), int(own.start[j])
        else:
            start, end = (int(own.end[i - 1]) if i else 0), len(raw)
        parts.append(raw[at:start])
        at = end
    parts.append(raw[at:])
    return b"".join(parts).decode("utf-8"), int(gone.sum())


def remove_repeats(documents: DataFrame, min_words: int = MIN_WORDS, line: int = LINE) -> DataFrame:
    """``documents`` with repeated runs deleted from ``text``, and ``n_removed``, the number of words deleted.

    A run is at least ``min_words`` consecutive words that also stand in a document of smaller id; words are compared one
    by one, windows left over by two 64-bit hashes. It stays in the first document that has it. Repeats inside one document are left alone. Null and empty texts, texts
    without a repeated run and rows with a null id stay as they are; columns of ``documents`` are kept whatever their names,
    except that one named ``n_removed`` is replaced. Rows of a repeated id count as one document towards each other. An empty table gives
    no rows. A text all of whose words are deleted is left empty.
    """
    rows, unfold = folded(documents.withColumn("doc_id", F.col("doc_id").cast("long")).drop("n_removed"), "doc_id", "text")
    prints = store(fingerprints(rows, line, min_words))
    first = prints.groupBy("gram").agg(F.min(F.struct("doc_id", "pos")).alias("f"), F.max("doc_id").alias("last"))
    first = store(first.where("f.doc_id < last").select("gram", F.col("f.doc_id").alias("f_doc"), F.col("f.pos").alias("f_pos")))
    shared = store(prints.join(first, "gram"))
    places = shared.where("doc_id > f_doc")
    near = F.col("f_pos")
    matches = places.groupBy("doc_id", "f_doc", (F.col("pos") - near).alias("shift")).agg(F.min(near).alias("a"), F.max(near).alias("b"))
    lo = F.greatest(F.lit(0), F.floor((F.col("a") - min_words) / STRIDE) * STRIDE).cast("int")
    hi = (F.ceil((F.col("b") + line + min_words) / STRIDE) * STRIDE).cast("int")
    matches = store(matches.select("doc_id", "f_doc", "shift", lo.alias("lo"), hi.alias("hi")))
    # a text is sent once, with its spans; their bounds are multiples of the stride, so a text's length bounds them
    wanted = matches.groupBy("f_doc").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))
    sources = likely(rows.select("doc_id", "text"), store(bitmap(matches.select("f_doc"))), True).select(F.col("doc_id").alias("f_doc"), "text").join(wanted, "f_doc")
    passages = store(sources.select("f_doc", "spans", "text").mapInArrow(_passages, "f_doc long, lo int, hi int, passage string"))
    found = matches.join(passages, ["f_doc", "lo", "hi"]).groupBy("doc_id").agg(
        F.collect_list(F.struct("shift", "lo", "passage")).alias("found"))  # a document's own length bounds what it can match
    grams = shared.groupBy("doc_id").agg(F.collect_set(F.struct("gram", (F.col("doc_id") > F.col("f_doc")).alias("later"))).alias("grams"))
    texts = likely(rows.select("doc_id", "text"), store(bitmap(shared.select("doc_id"))), True).join(grams.join(found, "doc_id", "left"), "doc_id")
    settled = store(texts.select("doc_id", "text", "found", "grams").mapInArrow(
        lambda batches: _settle(batches, line, min_words), "doc_id long, digest long, runs array<int>, windows array<struct<gram:long,win:long,later:boolean>>"))
    left = settled.select("doc_id", F.inline("windows"))
    needed = likely(left, store(bitmap(left.where("later").select("gram"))), True, "gram")  # the others have no window to delete
    lead = store(needed.groupBy("gram", "win").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("last")).where("lo < last").select("gram", "win", "lo"))
    again = likely(left, store(bitmap(lead.select("win"))), True, "win").join(lead, ["gram", "win"]).where("doc_id > lo")
    again = store(again.groupBy("doc_id").agg(F.collect_set("win").alias("wins")))  # no more than the document's words
    runs = settled.where(F.size("runs") > 0).groupBy("doc_id").agg(F.collect_set(F.struct("digest", "runs")).alias("found"))
    bits = store(bitmap(settled.where(F.size("runs") > 0).select("doc_id").unionByName(again.select("doc_id"))))
    out = likely(rows, bits, True).join(runs.join(again, "doc_id", "full"), "doc_id", "left").select(*rows.columns, "found", "wins")
    out = out.mapInArrow(lambda batches: _delete(batches, min_words), StructType([*rows.schema.fields, StructField("n_removed", LongType())]))
    out = out.unionByName(likely(rows, bits, False).withColumn("n_removed", F.lit(0).cast("long")))
    return out.select(*unfold(out), "n_removed")
