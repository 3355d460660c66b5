"""Evaluation cases in one schema from JSON rows or plain text lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import slug, squeeze, strip, sval
from ..operators.relational import ordinal

LIST_FIELDS = {"expected_sources": "expected_source", "expected_documents": "expected_document",
               "expected_categories": "expected_category", "expected_answer_intents": "expected_answer_intent"}


def _as_list(df: DataFrame, *names: str) -> Column:
    """First given alias, scalars lifted, blanks and case-insensitive repeats dropped."""
    options = []
    for n in names:
        if n in df.columns:
            is_list = dict(df.dtypes)[n].startswith("array")
            value = F.col(n).cast("array<string>") if is_list else F.array(F.col(n).cast("string"))
            clean = F.filter(F.transform(value, lambda x: sval(x)), lambda x: x != "")
            options.append(F.when(F.size(clean) > 0, clean))
    items = F.coalesce(*options, F.array().cast("array<string>"))
    return F.aggregate(items, F.array().cast("array<string>"), lambda acc, x: F.when(
        F.exists(acc, lambda a: squeeze(a) == squeeze(x)), acc).otherwise(F.concat(acc, F.array(x))))


def load_eval_cases(df: DataFrame, legacy: bool = False, order: str = "_ord") -> DataFrame:
    """Cases with list fields and a generated id where none is given.

    The running number follows ``order``, counted range by range.
    """
    df = df.withColumn("query", strip(F.coalesce("query", F.lit(""))))
    if legacy:
        df = df.where((F.col("query") != "") & ~F.col("query").startswith("#"))
    df = ordinal(df.withColumn("_all", F.lit(1)), ["_all"], [F.floor(F.col(order) / 65536)], [order], "_n").drop("_all")
    text = F.when(slug("query") == "", "query").otherwise(slug("query"))
    padded = F.lpad(F.col("_n").cast("string"), 3, "0")
    padded = F.when(F.length(F.col("_n").cast("string")) > 3, F.col("_n").cast("string")).otherwise(padded)
    made = F.concat_ws("-", F.lit("legacy" if legacy else "case"), padded, text)
    given = [F.nullif(sval(c), F.lit("")) for c in ("id", "case_id", "query_id") if c in df.columns]
    out = df.withColumn("case_id", F.coalesce(*given, made))
    for name, alias in LIST_FIELDS.items():
        out = out.withColumn(name, _as_list(df, name, alias))
    return out.drop("_n")
