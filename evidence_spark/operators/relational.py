"""Joins, nesting, keep-first/last and numbering that stay balanced under hot keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.text import col, nonblank, pipe_list, sval
from ..session import materialise, small_side


def keep_last(df: DataFrame, key: str, order) -> DataFrame:
    """One row per non-blank key, the last by ``order``; combines before the shuffle."""
    return _keep(df, key, order, F.max_by)


def keep_first(df: DataFrame, key: str, order) -> DataFrame:
    return _keep(df, key, order, F.min_by)


def _keep(df, key, order, pick):
    row = F.struct(*[F.col(c) for c in df.columns])
    return (df.where(nonblank(key).isNotNull())
              .groupBy(sval(key).alias("_k")).agg(pick(row, col(order)).alias("_r"))
              .select("_r.*"))


def lookup_join(fact: DataFrame, dim: DataFrame, fact_key: str, dim_key: str,
                fields: dict[str, str], order="_ord", unique: bool = False) -> DataFrame:
    """Left-join dimension fields; duplicates keep the last row, misses give blanks.

    ``unique=True`` skips the de-duplication for a key already checked. Catalyst
    broadcasts the dimension when its size allows and shuffles it otherwise.
    """
    picked = dim if unique else keep_last(dim, dim_key, order)
    picked = picked.where(nonblank(dim_key).isNotNull()).select(
        sval(dim_key).alias("_dk"), *[sval(src).alias(f"_d_{out}") for out, src in fields.items()])
    joined = fact.join(picked, sval(fact_key) == F.col("_dk"), "left")
    for out in fields:
        joined = joined.withColumn(out, F.coalesce(F.col(f"_d_{out}"), F.lit("")))
    return joined.drop("_dk", *[f"_d_{out}" for out in fields])


def nest_children(child: DataFrame, key: str, value: Column, order="_ord",
                  out: str = "items", block: int = 65536) -> DataFrame:
    """Ordered child values per parent key as one array.

    Children are first collected per (key, range of the ordinal), so no task sorts a
    hot parent's children as one group; the second step only concatenates blocks.
    """
    rows = (child.where(nonblank(key).isNotNull())
                 .select(sval(key).alias(key), col(order).cast("long").alias("_o"), value.alias("_v")))
    parts = (rows.groupBy(key, F.floor(F.col("_o") / block).alias("_b"))
                 .agg(F.array_sort(F.collect_list(F.struct("_o", "_v"))).alias("_xs"))
                 .select(key, "_b", F.transform("_xs", lambda x: x["_v"]).alias("_xs")))
    return (parts.groupBy(key)
                 .agg(F.array_sort(F.collect_list(F.struct("_b", "_xs"))).alias("_bs"))
                 .select(key, F.flatten(F.transform("_bs", lambda b: b["_xs"])).alias(out)))


def nest_text(child: DataFrame, key: str, value: Column, order="_ord", out: str = "items",
              sep: str = ", ") -> DataFrame:
    nested = nest_children(child, key, value, order, out="_n")
    clean = F.filter(F.col("_n"), lambda x: x != "")
    return nested.select(key, F.array_join(clean, sep).alias(out))


def array_link_join(df: DataFrame, id_col: str, list_col: Column, dim: DataFrame, dim_key: str,
                    value: Column, out: str = "linked", order="_ord", unique=False) -> DataFrame:
    """Resolve an id list against a dimension, keeping list order and dropping misses."""
    picked = dim if unique else keep_last(dim, dim_key, order)
    picked = picked.select(sval(dim_key).alias("_lk"), value.alias("_v"))
    exploded = df.select(F.col(id_col), F.posexplode(list_col).alias("_p", "_lk"))
    return (exploded.join(picked, "_lk")
            .groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("_p", "_v"))).alias("_xs"))
            .select(id_col, F.transform("_xs", lambda x: x["_v"]).alias(out)))


def explode_ids(df: DataFrame, keep: list, list_col: str, out: str) -> DataFrame:
    return df.select(*keep, F.explode(pipe_list(list_col)).alias(out))


def top_k(df: DataFrame, keys: list[str], order: list, k: int, out: str = "rank") -> DataFrame:
    """First k rows per key; the rank limit is applied before and after the shuffle."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w)).where(F.col(out) <= k)


def ordinal(df: DataFrame, keys: list[str], block: list, order: list, out: str) -> DataFrame:
    """Gap-free position per key for groups of any size.

    ``block`` must be a coarsening of ``order`` (its leading part). Rows are numbered
    inside (key, block) and shifted by the sizes of the blocks before, so a hot key is
    spread over as many tasks as it has blocks.
    """
    names = [f"_b{i}" for i in range(len(block))]
    tagged = df
    for n, b in zip(names, block):
        tagged = tagged.withColumn(n, col(b))
    sizes = tagged.groupBy(*keys, *names).agg(F.count("*").alias("_n"))
    before = W.partitionBy(*keys).orderBy(*names).rowsBetween(W.unboundedPreceding, -1)
    shift = sizes.withColumn("_s", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inner = W.partitionBy(*keys, *names).orderBy(*order)
    numbered = tagged.withColumn("_r", F.row_number().over(inner))
    return (numbered.join(shift, [*keys, *names])
            .withColumn(out, (F.col("_s") + F.col("_r")).cast("long"))
            .drop("_s", "_r", *names))


def running_last(df: DataFrame, keys: list[str], order: str, value: Column, out: str,
                 block: int = 4096) -> DataFrame:
    """Last non-NULL ``value`` strictly before each row, for sessions of any length.

    The order column is cut into ranges: the window runs inside (key, range) and the
    carry-over from earlier ranges is a per-range summary.
    """
    tagged = df.withColumn("_v", value).withColumn("_b", F.floor(F.col(order) / block))
    inner = W.partitionBy(*keys, "_b").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    per_block = tagged.where(F.col("_v").isNotNull()).groupBy(*keys, "_b").agg(
        F.max_by("_v", order).alias("_e"))
    all_blocks = tagged.select(*keys, "_b").distinct().join(per_block, [*keys, "_b"], "left")
    outer = W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    carry = all_blocks.withColumn("_c", F.last("_e", ignorenulls=True).over(outer)).drop("_e")
    return (tagged.withColumn("_w", F.last("_v", ignorenulls=True).over(inner))
            .join(carry, [*keys, "_b"])
            .withColumn(out, F.coalesce("_w", "_c")).drop("_v", "_b", "_w", "_c"))


def _grams(c: str, size) -> Column:
    """Distinct substrings of ``size`` characters."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - size + 1), lambda p: F.substr(F.col(c), p, size)))


def _within(needles: DataFrame, texts: DataFrame, n: int) -> DataFrame:
    """The distinct needles that some text may contain, without those that none does.

    A needle of m to 2m characters (m is n, 2n, 4n, ...) consists of its first and its last m characters, so one that has an
    m-gram no text has is passed over where it is read, and only the others are compared with each other.
    """
    longest = texts.agg(F.max(F.length("_text"))).first()[0] or 0
    sizes = [n]
    while 2 * sizes[-1] <= longest:
        sizes.append(2 * sizes[-1])
    hashes = reduce(DataFrame.unionByName, [
        texts.where(F.length("_text") >= m).select(F.explode(_grams("_text", F.lit(m))).alias("_g")).select(F.xxhash64("_g").alias("_h"))
        for m in sizes], texts.select(F.xxhash64(F.lit("")).alias("_h")))
    held = small_side(hashes.distinct())
    # a needle below n characters is held by its empty gram, so that all are read in one scan
    size = reduce(lambda smaller, m: F.when(F.length("_needle") >= m, m).otherwise(smaller), sizes, F.lit(0))
    left = needles.where(F.length("_needle") <= longest).withColumn("_m", size)
    for start in (F.lit(1), F.length("_needle") - F.col("_m") + 1):
        left = left.withColumn("_h", F.xxhash64(F.substr(F.col("_needle"), start, F.col("_m")))).join(held, "_h", "left_semi").drop("_h")
    return left.drop("_m").distinct()


def substring_pairs(hay: DataFrame, hay_id: str, text: str, needles: DataFrame, needle: str, n: int = 4) -> DataFrame:
    """(hay_id, needle) for every distinct needle that occurs inside a text; ``needles`` may repeat.

    Texts are expanded into their n-grams only, so the rows of a text grow with its length. A needle can occur only where
    all its n-grams do: it is anchored at the one that the fewest texts have, and verified there. Needles shorter than n
    are their own anchors, in texts expanded by the lengths such needles have.
    """
    found = needles.select(F.col(needle).alias("_needle")).where(F.length("_needle") > 0)
    if found.isEmpty():
        return hay.select(hay_id, F.col(text).cast("string").alias(needle)).where(F.lit(False))
    texts = materialise(hay.select(hay_id, F.col(text).alias("_text")).where(F.col("_text") != ""))
    found = materialise(_within(found, texts, n))
    places = materialise(texts.where(F.length("_text") >= n).select(hay_id, F.explode(_grams("_text", F.lit(n))).alias("_g")))
    counts = small_side(places.groupBy("_g").agg(F.count("*").alias("_c")))
    # most needles go at their first n-gram
    likely = found.where(F.length("_needle") >= n).withColumn("_g", F.substring("_needle", 1, n)).join(counts, "_g", "left_semi").drop("_g")
    grams = likely.select("_needle", F.explode(_grams("_needle", F.lit(n))).alias("_g")).join(counts, "_g", "left")
    anchors = (grams.groupBy("_needle").agg(F.min(F.struct(F.coalesce("_c", F.lit(0)).alias("c"), F.col("_g").alias("g"))).alias("_a"))
               .where("_a.c > 0").select("_needle", F.col("_a.g").alias("_g")))
    short = found.where(F.length("_needle") < n)
    sizes = short.agg(F.collect_set(F.length("_needle"))).first()[0]  # fewer than n numbers
    if sizes:
        small = reduce(DataFrame.unionByName, [texts.where(F.length("_text") >= size).select(hay_id, F.explode(_grams("_text", F.lit(size))).alias("_g"))
                                               for size in sorted(sizes)])
        places, anchors = places.unionByName(small), anchors.unionByName(short.select("_needle", F.col("_needle").alias("_g")))
    pairs = places.join(anchors, "_g").select(hay_id, "_needle")
    return (pairs.join(texts, hay_id).where(F.col("_text").contains(F.col("_needle")))
            .select(hay_id, F.col("_needle").alias(needle)).distinct())


def contains_join(queries: DataFrame, query_id: str, text: str, docs: DataFrame, doc_id: str,
                  values: Column) -> DataFrame:
    """Pairs where a lower-cased document value occurs inside the lower-cased query.

    ``values`` is an array column; a value held twice by a document counts twice.
    """
    held = docs.select(doc_id, F.explode(values).alias("_v")).where(F.col("_v") != "")
    q = queries.select(query_id, F.lower(F.col(text)).alias("_q"))
    return substring_pairs(q, query_id, "_q", held, "_v").join(held, "_v")
