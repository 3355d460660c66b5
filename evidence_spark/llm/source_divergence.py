"""Divergence of sources within a language, by merging pairs of term counts.

Every (lang, source) group is a vector of counts over the terms its language keeps. Terms are dealt by hash into blocks and
numbered there, so a group is a set of blocks, each a sorted array of term ids with their counts. A task gets one block of
two groups: a galloping search intersects the shorter array with the longer, and prices the shared terms, those on one side
and, by the difference of sizes, those on neither, in both directions. No block grows with the corpus, a group of any size
is spread over blocks, and each pair of groups meets once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from .common import store
from .terms import term_counts
from .wordstream import text_chunks

MIN_DOCUMENTS = 3  # documents of a language that a kept term occurs in
SCALE = 1_000_000_000  # parts of a smoothed probability
TOP_TERMS = 200  # ranks of part ``term``
BLOCK_TERMS = 16_384  # terms of a block, about


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of terms by (lang, source) of a run of texts, and the texts that have them."""
    for batch in batches:
        lang, source = (batch.column(c).dictionary_encode() for c in ("lang", "source"))
        group = lang.indices.to_numpy(zero_copy_only=False).astype(np.int64) * max(len(source.dictionary), 1) + source.indices.to_numpy(zero_copy_only=False)
        for at, data, bounds in text_chunks(batch.column("text")):
            found = term_counts(data, bounds)
            size = max(len(found.terms), 1)
            key, place = np.unique(group[at + found.row] * size + found.term, return_inverse=True)
            g, term = key // size, key % size
            yield pa.RecordBatch.from_arrays(
                [lang.dictionary.take(pa.array(g // max(len(source.dictionary), 1))), source.dictionary.take(pa.array(g % max(len(source.dictionary), 1))),
                 found.terms.take(pa.array(term)).cast(pa.string()), pa.array(np.bincount(place, weights=found.count, minlength=len(key)).astype(np.int64)),
                 pa.array(np.bincount(place, minlength=len(key)))], ["lang", "source", "term", "n", "docs"])


def smoothed(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE * (count + 1) / (total + kept)) by long division in base 1000, exact for sums below 9e15."""
    by = F.greatest(total + kept, F.lit(1))
    whole, rest = F.lit(0).cast("long"), count + 1
    for step in range(4):
        top = rest if step == 0 else rest * 1000
        whole, rest = whole * 1000 + F.call_function("div", top, by), top % by
    return whole + 1


def _smoothed(count: np.ndarray, by: int) -> np.ndarray:
    whole, rest = np.zeros(len(count), np.int64), count + 1
    for step in range(4):
        top = rest if step == 0 else rest * 1000
        whole, rest = whole * 1000 + top // by, top % by
    return whole + 1


def _price(p: np.ndarray, q: np.ndarray) -> int:
    return int(((p - q) * (p - q) // q).sum())


def gallop(short: np.ndarray, long: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in both of the values that two sorted arrays share.

    From the place of every 64th value of ``short``, found by bisection, the others double their step until they have passed
    their value, then bisect the last step.
    """
    if not len(short) or not len(long):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    low = np.repeat(np.searchsorted(long, short[::64]), 64)[: len(short)]
    step = np.ones(len(short), np.int64)
    ahead = np.flatnonzero(long[np.minimum(low, len(long) - 1)] < short)
    while len(ahead):
        to = low[ahead] + step[ahead]
        on = (to < len(long)) & (long[np.minimum(to, len(long) - 1)] < short[ahead])
        ahead, to = ahead[on], to[on]
        low[ahead] = to
        step[ahead] *= 2
    high = np.minimum(low + step, len(long))  # the first value not below lies in (low, high], or at low
    while True:
        open_ = np.flatnonzero(low < high)
        if not len(open_):
            break
        middle = (low[open_] + high[open_]) // 2
        below = long[middle] < short[open_]
        low[open_[below]] = middle[below] + 1
        high[open_[~below]] = middle[~below]
    hit = np.flatnonzero(long[np.minimum(low, len(long) - 1)] == short)
    return hit, low[hit]


def merge_pair(left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray], left_by: int, right_by: int) -> tuple[int, int, int]:
    """(left priced against right, right against left, terms on either side) of two sorted (ids, counts)."""
    swap = len(left[0]) > len(right[0])
    a, b = (right, left) if swap else (left, right)
    in_a, in_b = gallop(a[0], b[0])
    if swap:
        in_a, in_b = in_b, in_a
    p, q = _smoothed(left[1], left_by), _smoothed(right[1], right_by)
    none_p, none_q = (_smoothed(np.zeros(1, np.int64), by) for by in (left_by, right_by))
    only_p, only_q = np.delete(p, in_a), np.delete(q, in_b)
    one = _price(p[in_a], q[in_b]) + _price(only_p, none_q) + _price(none_p, only_q)
    two = _price(q[in_b], p[in_a]) + _price(none_q, only_p) + _price(only_q, none_p)
    return one, two, len(p) + len(q) - len(in_a)


def _pair_block(left: pa.Table, right: pa.Table) -> pa.Table:
    """Prices of one block of one pair; a group without terms in the block has no row."""
    some = left if left.num_rows else right
    sides = []
    for side in (left, right):
        if side.num_rows:
            sides.append(tuple(side.column(c).combine_chunks().values.to_numpy(zero_copy_only=False) for c in ("ids", "counts")))
        else:
            sides.append((np.empty(0, np.int32), np.empty(0, np.int64)))
    one, two, either = merge_pair(*sides, some.column("a_by")[0].as_py(), some.column("b_by")[0].as_py())
    return pa.table({"lang": some.column("lang"), "a": some.column("a"), "b": some.column("b"), "ab": pa.array([one], pa.int64()), "ba": pa.array([two], pa.int64()),
                     "either": pa.array([either], pa.int64())})


def _divergence(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def source_divergence(documents: DataFrame, top_terms: int = TOP_TERMS, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """Rows (lang, source, part, item, value, rank) for every (lang, source) group of ``documents``.

    Null lang, source and text count as ''. Each row is a document, also one that repeats. A language keeps the terms of at
    least 3 of its documents; a group's probability of a kept term is smoothed by one and scaled to integers, and the
    divergence of p from q at a term is floor((p - q)^2 / q). Part ``pair``: for each other source of the language the sum
    over all kept terms of the group against that source, 0 if the language keeps none; all ranks. Part ``term``: kept terms
    that the group has more often than its language, against the language; the first ``top_terms`` ranks. Ranks go by value
    descending, then item ascending by UTF-8 bytes. A language with one source has no pairs; an empty table gives no rows.
    Other columns are not read. All arithmetic is in integers and exact for sums of counts below 9e15.

    The driver gets one number, the size of the largest vocabulary.
    """
    texts = documents.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    counts = texts.mapInArrow(_counts, "lang string, source string, term string, n long, docs long")
    counts = store(counts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
    kept = store(counts.groupBy("lang", "term").agg(F.sum("n").alias("all_n"), F.sum("docs").alias("docs")).where(F.col("docs") >= MIN_DOCUMENTS).drop("docs"))
    sizes = kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("all_n").alias("all_total"))
    most = sizes.agg(F.max("kept")).first()[0] or 0
    blocks = max(1, -(-most // block_terms))
    block = F.pmod(F.xxhash64("term"), F.lit(blocks)).cast("int")
    numbered = kept.withColumn("block", block).withColumn("id", F.row_number().over(Window.partitionBy("lang", "block").orderBy("term")))
    own = store(counts.drop("docs").join(numbered, ["lang", "term"]))
    totals = own.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = texts.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(sizes, "lang", "left")
    groups = store(groups.na.fill(0, ["total", "kept", "all_total"]))

    a, b = (groups.select("lang", F.col("source").alias(x), F.col("total").alias(f"{x}_total"), *(["kept"] if x == "a" else [])) for x in "ab")
    pairs = a.join(b, "lang").where("a < b")  # as many as the result has
    pairs = store(pairs.select("lang", "a", "b", "kept", (F.col("a_total") + F.col("kept")).alias("a_by"), (F.col("b_total") + F.col("kept")).alias("b_by")))
    arrays = own.groupBy("lang", "source", "block").agg(F.sort_array(F.collect_list(F.struct("id", "n"))).alias("terms"))  # bounded by a block
    arrays = store(arrays.select("lang", "source", "block", F.col("terms.id").alias("ids"), F.col("terms.n").alias("counts")))

    def side(x: str) -> DataFrame:
        joined = pairs.where("kept > 0").drop("kept").join(arrays.withColumnRenamed("source", x), ["lang", x])
        return joined.select(*[F.col(c).alias(c) for c in joined.columns])  # columns of its own, for the co-group

    keys = ["lang", "a", "b", "block"]
    priced = side("a").groupBy(*keys).cogroup(side("b").groupBy(*keys)).applyInArrow(
        _pair_block, "lang string, a string, b string, ab long, ba long, either long")
    priced = priced.groupBy("lang", "a", "b").agg(*[F.sum(c).alias(c) for c in ("ab", "ba", "either")])
    p, q = (smoothed(F.lit(0).cast("long"), F.col(x), F.lit(0)) for x in ("a_by", "b_by"))
    absent = F.col("kept") - F.coalesce("either", F.lit(0))
    both = pairs.join(priced, ["lang", "a", "b"], "left").select(
        "lang", "a", "b", *[F.when(F.col("kept") > 0, F.coalesce(c, F.lit(0)) + absent * _divergence(x, y)).otherwise(0).cast("long").alias(c)
                            for c, x, y in (("ab", p, q), ("ba", q, p))])
    both = store(both)
    value = both.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), F.col("ab").alias("value")).unionByName(
        both.select("lang", F.col("b").alias("source"), F.col("a").alias("item"), F.col("ba").alias("value")))
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    pair_rows = value.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))

    priced_terms = own.join(groups.select("lang", "source", "total", "kept", "all_total"), ["lang", "source"]).select(
        "lang", "source", F.col("term").alias("item"), smoothed(F.col("n"), F.col("total"), F.col("kept")).alias("p"),
        smoothed(F.col("all_n"), F.col("all_total"), F.col("kept")).alias("q"))
    terms = priced_terms.where("p > q").select("lang", "source", "item", _divergence(F.col("p"), F.col("q")).alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_terms)
    return pair_rows.unionByName(terms.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank"))
