"""Helpers shared by the training-data operators: stored tables, column hygiene and connected components."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


ARROW_BATCH, ARROW_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"
BATCH_BYTES = "8m"
BITMAP = 1 << 22  # bits of the fixed bitmaps that keep unmatched texts out of shuffles


def bound_batches(spark: SparkSession) -> None:
    """Batches sent to Python workers are bounded by bytes, too, unless the session's setting was changed."""
    if spark.conf.get(ARROW_BATCH) == ARROW_DEFAULT:
        spark.conf.set(ARROW_BATCH, BATCH_BYTES)


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``, or a folder in the session's warehouse where it is unset."""
    bound_batches(spark)
    folder = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/_stored"
    return folder.rstrip("/")


def store(df: DataFrame) -> DataFrame:
    """Write a result to the shared folder and read it back, so that a lost executor costs no recomputation."""
    path = f"{shared_folder(df.sparkSession)}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def folded(df: DataFrame, *keep: str) -> tuple[DataFrame, Callable[[DataFrame], list[Column]]]:
    """``df`` with all columns but those in ``keep`` in one struct ``rest``, and what brings the columns of ``df`` back in order.

    So no column of a user's table meets the name of a helper column.
    """
    others = {c: f"c{i}" for i, c in enumerate(df.columns) if c not in keep}
    rest = [F.struct(*[F.col(f"`{c}`").alias(field) for c, field in others.items()]).alias("rest")] if others else []
    return df.select(*keep, *rest), lambda out: [out[c] if c in keep else out["rest"][others[c]].alias(c) for c in df.columns]


def bitmap(ids: DataFrame) -> DataFrame:
    """(_word, _bits): a bitmap of ``BITMAP`` bits with those set that the ids hash to; at most BITMAP / 64 rows."""
    slots = ids.toDF("id").select(F.pmod(F.xxhash64("id"), F.lit(BITMAP)).alias("slot"))
    return slots.groupBy((F.col("slot") / 64).cast("int").alias("_word")).agg(F.expr("bit_or(shiftleft(1L, cast(slot % 64 as int)))").alias("_bits"))


def likely(documents: DataFrame, bits: DataFrame, wanted: bool, key: str = "doc_id") -> DataFrame:
    """Documents (or other rows with a ``key``) whose id's bit is set, or those whose bit isn't.

    It spares most texts a shuffle; the join that follows decides. A bitmap that is full lets every document through.
    """
    marked = documents.withColumn("_slot", F.pmod(F.xxhash64(key), F.lit(BITMAP))).withColumn("_word", (F.col("_slot") / 64).cast("int"))
    marked = marked.join(F.broadcast(bits), "_word", "left")  # a fixed number of rows
    hit = F.coalesce(F.expr("shiftright(_bits, cast(_slot % 64 as int)) & 1 = 1"), F.lit(False))
    return marked.where(hit if wanted else ~hit).select(*documents.columns)


def components(links: DataFrame, max_rounds: int = 100) -> DataFrame:
    """Smallest node reachable from every linked node: rows (node, component), nodes without links absent.

    ``links`` has two long columns ``a`` and ``b``; direction and repetition don't matter. Alternates the large-star
    and small-star rewiring. A node's minimum is an aggregate that combines before the shuffle, and is stored before
    it is joined back, so the join can split a hub over several tasks. Nothing reaches the driver but a row count.
    """
    a, b = F.col("a"), F.col("b")
    edges = store(links.where(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct())
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(b.alias("a"), a.alias("b")))
        least = store(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        # large star: every larger neighbour points at the smallest node around
        large = both.where(b > a).join(least, "a").select(b.alias("a"), F.col("m").alias("b")).where(a != b).distinct()
        large = store(large)
        # small star: a node and its smaller neighbours point at the smallest of them
        floor = store(large.groupBy("a").agg(F.min("b").alias("m")))
        moved = large.join(floor, "a").select(b.alias("a"), F.col("m").alias("b")).where(a != b)
        fresh = store(moved.unionByName(floor.withColumnRenamed("m", "b")).distinct())
        changed = fresh.exceptAll(edges).limit(1).count()
        edges = fresh
        if not changed:
            break
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    return edges.select(a.alias("node"), b.alias("component")).unionByName(
        edges.select(b.alias("node"), b.alias("component")).distinct()
    )
