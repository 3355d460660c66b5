"""Exact top-k by integer inner product with a pivot table.

Distances to a fixed set of pivots are computed once per vector. For a query q and a candidate c the triangle
inequality gives |q - c| >= max over pivots |d(q, p) - d(c, p)|, hence an upper bound of the inner product
(|q|^2 + |c|^2 - |q - c|^2) / 2. Candidates are evaluated in the order of that bound until the k-th best score
exceeds every bound that is left.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.window import Window

SCALE = 256
PIVOTS = 32
PIVOT_SAMPLE = 1024  # vectors (smallest hashes of their ids) among which the pivots are chosen
BLOCK = 8192  # candidates of one task's block
QUERY_BLOCK = 1024  # queries of one task's block
STEP = 256  # candidates evaluated between two tests of the stopping rule


def usable(vector: Column) -> Column:
    """Not null and free of null and non-finite components."""
    inf = F.lit(float("inf")).cast("double")
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) != inf))
    return F.coalesce(vector.isNotNull() & fine, F.lit(False))


def quantised(column: pd.Series) -> np.ndarray:
    return np.floor(np.stack(column.to_numpy()).astype(np.float64) * SCALE).astype(np.int64)


def spread_pivots(points: np.ndarray, count: int) -> np.ndarray:
    """Farthest-first choice among the sample, beginning at its longest vector."""
    chosen = [int(np.argmax((points ** 2).sum(1)))]
    gap = ((points - points[chosen[0]]) ** 2).sum(1)
    while len(chosen) < min(count, len(points)) and gap.max() > 0:
        chosen.append(int(np.argmax(gap)))
        gap = np.minimum(gap, ((points - points[chosen[-1]]) ** 2).sum(1))
    return points[chosen]


def distances(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    square = (points ** 2).sum(1)[:, None] + (pivots ** 2).sum(1)[None, :] - 2.0 * points @ pivots.T
    return np.sqrt(np.maximum(square, 0.0))


def block_topk(query_ids, queries, ids, vectors, pivots, k: int) -> list[tuple[int, int, int]]:
    """(query, candidate, score) of each query's k best in one block of candidates; ties go to the smaller id."""
    order = np.argsort(ids, kind="stable")
    ids, vectors = ids[order], vectors[order]
    fq, fc = queries.astype(np.float64), vectors.astype(np.float64)
    dq, dc = distances(fq, pivots), distances(fc, pivots)
    q2, c2 = (fq ** 2).sum(1), (fc ** 2).sum(1)
    out = []
    for i in range(len(queries)):
        gap = np.abs(dc - dq[i]).max(axis=1)
        size = q2[i] + c2
        bound = (size - gap ** 2) / 2 + 1e-6 * (size + 1)  # the slack covers rounding
        bound[ids == query_ids[i]] = -np.inf
        ranked = np.argsort(-bound, kind="stable")
        ranked = ranked[: np.count_nonzero(bound > -np.inf)]
        best_s, best_c = np.empty(0, np.int64), np.empty(0, np.int64)
        for at in range(0, len(ranked), STEP):
            if len(best_s) >= k and bound[ranked[at]] < best_s[k - 1]:
                break
            part = ranked[at:at + STEP]
            best_s = np.concatenate([best_s, vectors[part] @ queries[i]])
            best_c = np.concatenate([best_c, part])
            keep = np.lexsort((best_c, -best_s))[:k]  # positions are in the order of ids
            best_s, best_c = best_s[keep], best_c[keep]
        out += zip([query_ids[i]] * len(best_s), ids[best_c], best_s)
    return out


def exact_topk(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding",
               pivots: int = PIVOTS) -> DataFrame:
    """Each query's ``k`` highest integer inner products: (query_id, rank, vec_id, score).

    A component x becomes floor(256 * x). Candidates of a query are all rows with another id; fewer than k give all.
    Vectors that are null or hold null or non-finite components, and rows with a null id, take no part; vectors are
    compared with those of their own length only. Repeated rows of an id are candidates each;
    as a query an id is asked once, with its smallest vector. An empty table, or one
    without queries, gives no rows. Scores are 64-bit.

    Queries and candidates meet in blocks of fixed size spread by hash, so equal vectors can't crowd one task; a block
    returns k rows for a query, and Spark's rank limit prunes them before and after the last shuffle.
    """
    spark = vectors.sparkSession
    base = vectors.where(usable(F.col(vector_col)) & F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("vid"), F.col(vector_col).alias("vec"), F.size(vector_col).alias("dim"), is_query.alias("isq"))
    sizes = base.groupBy("dim").agg(F.count("*").alias("n"), F.count_if("isq").alias("q")).collect()  # a row for each length of vectors
    found = None
    for dim, n, q in ((r["dim"], r["n"], r["q"]) for r in sizes if r["q"]):
        own = base.where(F.col("dim") == dim)
        sample = own.orderBy(F.xxhash64("vid"), "vid").limit(PIVOT_SAMPLE).select("vec").toPandas()
        table = spread_pivots(quantised(sample["vec"]).astype(np.float64), pivots) if dim else np.zeros((1, 0))
        blocks, qblocks = -(-n // BLOCK), -(-q // QUERY_BLOCK)
        spots = lambda m: F.sequence(F.lit(0), F.lit(m - 1))
        cand = own.withColumn("cb", F.pmod(F.xxhash64("vid", "vec"), F.lit(blocks)).cast("int")).select(
            "vid", "vec", "cb", F.explode(spots(qblocks)).alias("qb"))
        ask = own.where("isq").groupBy("vid").agg(F.min("vec").alias("vec")).withColumn("qb", F.pmod(F.xxhash64("vid"), F.lit(qblocks)).cast("int")).select(
            "vid", "vec", F.explode(spots(blocks)).alias("cb"), "qb")

        def search(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            hits = []
            if len(left) and len(right):
                hits = block_topk(right["vid"].to_numpy(), quantised(right["vec"]), left["vid"].to_numpy(), quantised(left["vec"]), table, k)
            return pd.DataFrame(hits, columns=["query_id", "vec_id", "score"]).astype("int64")

        hits = cand.groupBy("cb", "qb").cogroup(ask.groupBy("cb", "qb")).applyInPandas(search, "query_id long, vec_id long, score long")
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast(T.IntegerType()).alias("rank"), "vec_id", "score")
