"""Exact n-gram Jaccard join by rare-first prefix filtering.

Two sets with Jaccard similarity of at least t share an element among the first n - ceil(t * n) + 1 elements of each, in
any common order. The order is rare first: by how often an element's slot was counted over the whole corpus, then by
hash. Documents meet on those prefix elements only; length, positional and suffix filters discard pairs that can't
reach t, and each remaining pair is verified once on its texts.

Large groups of near copies aren't expanded into all pairs. Documents with equal sets are one class from the start.
First every document is verified against the earliest member of a list it shares most elements with; then only pairs
that still lie in different components are looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from .common import bitmap, components, likely, store
from .fast_bpe import small_batches
from .wordstream import Words, gram_hashes, mix, text_chunks, words_of

SLOTS = 1 << 19  # counters of the rarity table: a fixed 4 MB whatever the corpus
CELLS = 128  # cells of the suffix filter's histogram
HEAVY = 200_000  # members of one prefix list that a task handles; longer lists are split by document


def set_sizes(words: Words, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct hashes) of every row of a chunk."""
    grams, valid = gram_hashes(words, n)
    for row in range(len(words.first) - 1):
        a, b = words.first[row], words.first[row + 1]
        if b - a >= n:
            own = grams[a:b - n + 1]
            yield row, np.unique(own)
        elif b > a:
            h = np.uint64(b - a)
            for x in words.hash[a:b]:
                h = mix(np.array([h * np.uint64(31) + x], np.uint64))[0]
            yield row, np.array([h], np.uint64)
        else:
            yield row, np.empty(0, np.uint64)


def shingle_sets(texts: pa.Array, n: int) -> Iterator[tuple[int, np.ndarray]]:
    with np.errstate(over="ignore"):
        for at, data, bounds in text_chunks(texts):
            for row, own in set_sizes(words_of(data, bounds, lower=True), n):
                yield at + row, own


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1 if n else 0


def required(na, nb, percent: int):
    """Smallest intersection i with 100 * i >= percent * (na + nb - i)."""
    return -(-(percent * (na + nb)) // (100 + percent))


def histogram(own: np.ndarray) -> bytes:
    """Elements by cell; a set too large for 16-bit cells gets full ones, which never rule a pair out."""
    cells = np.bincount((own & np.uint64(CELLS - 1)).astype(np.int64), minlength=CELLS) if len(own) < 65535 else np.full(CELLS, 65535)
    return cells.astype("<u2").tobytes()


def _signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64) if h.dtype == np.uint64 else h


def profiles(documents: DataFrame, n: int) -> DataFrame:
    """Rows kind 'd': id, set size, set digest, histogram; rows kind 'c': counts of the rarity table's slots."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SLOTS, np.int64)
        for batch in small_batches(batches, 2048):
            ids, sizes, k1, k2, cells, slots = batch.column("doc_id"), [], [], [], [], [np.empty(0, np.uint64)]
            with np.errstate(over="ignore"):
                for _, own in shingle_sets(batch.column("text"), n):
                    sizes.append(len(own))
                    k1.append(own.sum(dtype=np.uint64))
                    k2.append(mix(own ^ np.uint64(0x5DEECE66D)).sum(dtype=np.uint64))
                    cells.append(histogram(own))
                    slots.append(own >> np.uint64(45))
            counts += np.bincount(np.concatenate(slots).astype(np.int64), minlength=SLOTS)
            yield pa.RecordBatch.from_arrays(
                [pa.array(["d"] * len(sizes)), ids.cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(_signed(np.array(k1, np.uint64)), pa.int64()),
                 pa.array(_signed(np.array(k2, np.uint64)), pa.int64()), pa.array(cells, pa.binary())], SCHEMA.names)
        slots = np.flatnonzero(counts)
        for at in range(0, len(slots), 50_000):
            part = slots[at:at + 50_000]
            none = pa.nulls(len(part), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(["c"] * len(part)), pa.array(part, pa.int64()), pa.array(counts[part], pa.int64()), none, none, pa.nulls(len(part), pa.binary())], SCHEMA.names)

    SCHEMA = pa.schema([("kind", pa.string()), ("doc_id", pa.int64()), ("n", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("cells", pa.binary())])
    return documents.select("doc_id", "text").mapInArrow(run, "kind string, doc_id long, n long, k1 long, k2 long, cells binary")


def prefixes(documents: DataFrame, n: int, percent: int, table: np.ndarray) -> DataFrame:
    """(gram, part, size, k1, doc_id, pos, rare): the rarest elements of every set; lists of heavy elements are dealt into parts.

    ``rare`` is the same for all rows of a set: the less its prefix is shared, the larger.
    """
    usual = int(np.median(table))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 2048):
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            cols = [[] for _ in range(7)]
            with np.errstate(over="ignore"):
                for row, own in shingle_sets(batch.column("text"), n):
                    if not len(own) or pd.isna(ids[row]):
                        continue
                    p = prefix_length(len(own), percent)
                    counts = table[(own >> np.uint64(45)).astype(np.int64)]
                    if p < len(own):
                        edge = np.partition(counts, p - 1)[p - 1]
                        few = np.flatnonzero(counts <= edge)
                    else:
                        few = np.arange(len(own))
                    few = few[np.argsort(counts[few], kind="stable")][:p]  # equal counts stay in the order of hashes
                    parts = np.maximum(counts[few] - usual, 0) // HEAVY  # part 0: a list that isn't split
                    digest = own.sum(dtype=np.uint64)  # copies of a set stay in one part
                    spot, size = mix(np.array([digest]))[0], len(few)
                    for col, x in zip(cols, (own[few], np.where(parts > 0, 1 + spot % np.maximum(parts, 1).astype(np.uint64), 0).astype(np.int32), np.full(size, len(own), np.int32),
                                             np.full(size, digest), np.full(size, int(ids[row]), np.int64), np.arange(size, dtype=np.int32),
                                             np.full(size, -int(counts[few].mean()), np.int32))):
                        col.append(x)
            if cols[0]:
                out = [np.concatenate(c) for c in cols]
                yield pa.RecordBatch.from_arrays([pa.array(_signed(c)) for c in out], ["gram", "part", "size", "k1", "doc_id", "pos", "rare"])

    return documents.select("doc_id", "text").mapInArrow(run, "gram long, part int, size int, k1 long, doc_id long, pos int, rare int")


def stars(postings: DataFrame) -> DataFrame:
    """(gram, doc_id, size, pos, p_doc, p_size, p_pos) of lists with at least two classes; of a class only its smallest id.

    The pivot p of a list (or of a part of a split list) is the member whose prefix is shared most: the text that near
    copies were made from, rather than a copy with words of its own. A task reads its lists in sorted order and keeps one
    row, so the length of a list costs no memory. Split lists are given out whole, since company may be in another part.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the first row of the list that was going on at the end of a batch
        pivot = None  # (gram, part, doc, size, pos) of that list
        last = None  # (gram, part, size, k1) of the last row, to skip copies
        for batch in batches:
            g, part, size, k1, doc, pos = (batch.column(c).to_numpy() for c in ("gram", "part", "size", "k1", "doc_id", "pos"))
            if not len(g):
                continue
            fresh = np.ones(len(g), bool)
            fresh[1:] = (g[1:] != g[:-1]) | (part[1:] != part[:-1]) | (size[1:] != size[:-1]) | (k1[1:] != k1[:-1])
            fresh[0] = last is None or (g[0], part[0], size[0], k1[0]) != last
            last = (g[-1], part[-1], size[-1], k1[-1])
            rows = [x[fresh] for x in (g, part, doc, size, pos)]
            if held is not None:
                rows = [np.concatenate([[h], x]) for h, x in zip(held, rows)]
            g, part, doc, size, pos = rows
            if not len(g):
                continue
            head = np.ones(len(g), bool)
            head[1:] = (g[1:] != g[:-1]) | (part[1:] != part[:-1])
            head[0] = held is not None or pivot is None or (g[0], part[0]) != pivot[:2]
            at = np.maximum.accumulate(np.where(head, np.arange(len(g)), -1))  # place of each row's pivot, -1: of the batch before
            mine = [np.where(at < 0, 0 if pivot is None else old, x[np.maximum(at, 0)]) for x, old in zip((doc, size, pos), pivot[2:] if pivot else (0, 0, 0))]
            keep = ~(head & np.append(head[1:], True)) | (part > 0)
            pivot = (g[-1], part[-1], mine[0][-1], mine[1][-1], mine[2][-1])
            held = (g[-1], part[-1], doc[-1], size[-1], pos[-1]) if head[-1] and not part[-1] else None  # its company shows in the next batch
            columns = (g, doc, size, pos, *mine)
            yield pa.RecordBatch.from_arrays([pa.array(x[keep].astype(t)) for x, t in zip(columns, ("i8", "i8", "i4", "i4", "i8", "i4", "i4"))], NAMES)

    NAMES = ["gram", "doc_id", "size", "pos", "p_doc", "p_size", "p_pos"]
    dealt = postings.repartition("gram", "part").sortWithinPartitions("gram", "part", "rare", "size", "k1", "doc_id")
    return dealt.mapInArrow(run, "gram long, doc_id long, size int, pos int, p_doc long, p_size int, p_pos int")


def rest(size, percent: int):
    """Elements of a set after its prefix."""
    return F.ceil(percent * size / 100) - 1


def missing(size_a, size_b, percent: int):
    """Least number of prefix elements that two sets of these sizes share if they link."""
    return F.ceil(percent * (size_a + size_b) / (100 + percent)) - F.greatest(rest(size_a, percent), rest(size_b, percent))


def reachable(a: tuple, b: tuple, percent: int):
    """Length and positional filter on columns (size, position) of two sets."""
    (na, ia), (nb, ib) = a, b
    need = F.ceil(percent * (na + nb) / (100 + percent))
    bound = F.least(ia, ib) + F.least(na - ia, nb - ib)
    return (100 * F.least(na, nb) >= percent * F.greatest(na, nb)) & (bound >= need)


def crossing(placed: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b), a > b, of different components that share a list and may link.

    Two sets that link share at least ``missing`` of their listed elements. With the m elements of a set in the order of
    their lists' lengths, rarest first, one of the shared ones is among its first m - missing + 1, and the same holds for
    the other set, so a pair is made from lists early in the order of both.
    """
    lengths = placed.groupBy("gram").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("length"))
    mixed = store(lengths.where("lo <> hi").select("gram", "length"))
    own = Window.partitionBy("doc_id")
    open_ = placed.join(mixed, "gram").withColumn("m", F.count("*").over(own)).withColumn("rank", F.row_number().over(own.orderBy("length", "gram")))
    open_ = store(open_.select("gram", "doc_id", "size", "pos", "m", "rank", "component"))
    names = ["doc_id", "size", "pos", "m", "rank", "component"]
    left, right = (open_.select("gram", *[F.col(n).alias(f"{n}_{side}") for n in names]) for side in "ab")
    a, b = ({n: F.col(f"{n}_{side}") for n in names} for side in "ab")
    least = F.greatest(missing(a["size"], b["size"], percent), F.lit(1))
    early = (a["rank"] <= a["m"] - least + 1) & (b["rank"] <= b["m"] - least + 1)
    both = left.join(right, "gram").where((a["doc_id"] > b["doc_id"]) & (a["component"] != b["component"]) & early)
    both = both.where(reachable((a["size"], a["pos"]), (b["size"], b["pos"]), percent))
    return both.select(a["doc_id"].alias("a"), b["doc_id"].alias("b")).distinct()


def ends_of(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct()


def suffix_filter(pairs: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """Drops pairs whose histograms leave less in common than the threshold needs."""
    side = likely(docs.select("doc_id", "n", "cells"), store(bitmap(ends_of(pairs))), True)
    both = pairs.join(side.toDF("a", "na", "ca"), "a").join(side.toDF("b", "nb", "cb"), "b")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                x = np.frombuffer(b"".join(pdf["ca"]), "<u2").reshape(len(pdf), CELLS)
                y = np.frombuffer(b"".join(pdf["cb"]), "<u2").reshape(len(pdf), CELLS)
                most = np.minimum(x, y).sum(axis=1, dtype=np.int64)
                pdf = pdf[most >= required(pdf["na"].to_numpy(), pdf["nb"].to_numpy(), percent)]
            yield pdf[["a", "b"]]

    return both.mapInPandas(run, "a long, b long")


def verify(pairs: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """Pairs whose sets reach the threshold."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            sides = zip(shingle_sets(batch.column("ta"), n), shingle_sets(batch.column("tb"), n))
            for (row, x), (_, y) in sides:
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep[row] = 100 * common >= percent * (len(x) + len(y) - common)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    ids = store(ends_of(pairs))
    texts = store(likely(texts, store(bitmap(ids)), True).join(ids, "doc_id", "left_semi"))
    both = pairs.join(texts.toDF("a", "ta"), "a").join(texts.toDF("b", "tb"), "b")
    return both.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def jaccard_components(documents: DataFrame, n: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: (doc_id, n_shingles, component_id).

    A document's set has its distinct ``n``-word shingles (A-Z lower-cased, words as in ``wordstream``); a text with
    fewer words has one element, the whole sequence. Null and empty texts have the empty set and link with nothing.
    Two documents link when 100 * intersection >= ``percent`` * union. The component is the smallest id reachable by
    links. Repeated ids give one row each; rows with a null id get the component of documents with an equal set, or
    null. An empty table gives no rows. Other columns are ignored.

    Sets are compared by 64-bit hashes of shingles. All pairs of different sets that link are either verified or end
    up in one component through verified ones; none is capped or sampled.
    """
    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    profile = store(profiles(rows, n))
    docs = profile.where("kind = 'd'").select("doc_id", "n", "k1", "k2", "cells")
    table = np.zeros(SLOTS, np.int64)  # a fixed number of counters, whatever the corpus
    counted = profile.where("kind = 'c'").groupBy("doc_id").agg(F.sum("n").alias("n")).toPandas()
    table[counted["doc_id"].to_numpy(np.int64)] = counted["n"].to_numpy(np.int64)

    classes = store(docs.where("n > 0").groupBy("n", "k1", "k2").agg(F.min("doc_id").alias("rep")))
    lists = store(stars(prefixes(rows, n, percent, table)))
    sets = docs.where("n > 0")

    # first each document against the pivot that it shares most lists with
    shared = lists.where("doc_id <> p_doc").where(reachable((F.col("p_size"), F.col("p_pos")), (F.col("size"), F.col("pos")), percent))
    tried = shared.groupBy("doc_id", "p_doc").agg(F.count("*").alias("c"))
    tried = tried.groupBy("doc_id").agg(F.max_by("p_doc", F.struct("c", -F.col("p_doc"))).alias("p_doc"))
    tried = store(tried.select(F.col("doc_id").alias("a"), F.col("p_doc").alias("b")))
    links = store(verify(store(suffix_filter(tried, sets, percent)), rows, n, percent))
    first = store(components(links))

    # then all pairs that share a list, may link and lie in different components
    label = first.select(F.col("node").alias("doc_id"), "component")
    placed = lists.select("gram", "doc_id", "size", "pos").join(label, "doc_id", "left")
    placed = store(placed.withColumn("component", F.coalesce("component", "doc_id")))
    done = tried.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    pairs = store(crossing(placed, percent).join(done, ["a", "b"], "left_anti"))
    more = verify(store(suffix_filter(pairs, sets, percent)), rows, n, percent)
    merged = first.select(F.col("node").alias("a"), F.col("component").alias("b"))
    ends = more.join(first.toDF("a", "x"), "a", "left").join(first.toDF("b", "y"), "b", "left")
    ends = ends.select(F.coalesce("x", "a").alias("a"), F.coalesce("y", "b").alias("b"))
    final = store(components(merged.unionByName(ends)))

    groups = classes.join(final.withColumnRenamed("node", "rep"), "rep", "left").select(
        "n", "k1", "k2", F.coalesce("component", "rep").alias("component_id"))
    groups = store(groups)
    out = docs.join(groups, ["n", "k1", "k2"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
