"""Cleans a document corpus and packs it for training: toxicity, line dedup, near duplicates, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from evidence_spark.llm.common import folded, store, table
from evidence_spark.llm.jaccard_join import jaccard_components
from evidence_spark.llm.line_dedup import remove_repeats
from evidence_spark.llm.packing import pack_documents
from evidence_spark.llm.toxicity import score_toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the chain predicts as toxic go.

    Null and empty texts are scored like others, repeated rows alike; other columns, whatever their names, stay. An empty
    table gives no rows.
    """
    rows, unfold = folded(docs, "doc_id", "text")
    kept = score_toxicity(rows, table(spark, sf_dir, "labels")).where("predicted = 0")
    return kept.select(*unfold(kept))


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has are deleted; a document goes where nothing but blanks is left of its words.

    Null texts, texts without a repeated passage and rows without an id stay as they are; rows of a repeated id keep what
    they share with each other. ``n_chars`` follows a changed text, other columns stay. An empty table gives no rows.
    """
    rows, unfold = folded(docs, "doc_id", "text", "n_chars")
    cut = remove_repeats(rows).where("n_removed = 0 or text rlike '[^\\\\x20\\\\x09-\\\\x0D]'")
    length = F.when(F.col("n_removed") > 0, F.length("text").cast(dict(docs.dtypes)["n_chars"])).otherwise(F.col("n_chars"))
    cut = cut.withColumn("n_chars", length)
    return cut.select(*unfold(cut))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one with the smallest id. Rows without an id stay.

    Rows of one id with unlike texts are different documents; of rows equal in id and text one stays. Null texts and texts
    without words are in no group. An empty table gives no rows.
    """
    rows, unfold = folded(docs, "doc_id", "text")
    keyed = rows.where("doc_id is not null").withColumn("_key", F.xxhash64("doc_id", "text"))
    groups = jaccard_components(keyed.select(F.col("_key").alias("doc_id"), "text")).select(F.col("doc_id").alias("_key"), "component_id")
    ids = keyed.select("_key", "doc_id").distinct()
    first = groups.join(ids, "_key").groupBy("component_id").agg(F.min(F.struct("doc_id", "_key")).alias("first"))
    kept = keyed.join(first.select("first._key"), "_key", "left_semi").dropDuplicates(["_key"]).select(*rows.columns)
    kept = kept.unionByName(rows.where("doc_id is null"))
    return kept.select(*unfold(kept))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2,048 ids; a null text is an empty one, an empty table gives no rows."""
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_passages),
    ("near_duplicates", drop_near_duplicates),
    ("packing", pack),
]
ORACLE_SQL = None  # the chain and the tokenizer can't be written in SQL; tests/llm compares the other stages with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
