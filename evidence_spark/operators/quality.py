"""Validation jobs: columns, unique keys, foreign keys, corpus and the combined report."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..functions.text import nonblank, pipe_list, sval

ISSUE_COLUMNS = ["table_name", "line", "rule", "message"]


def _issue(df: DataFrame, table: str, line, rule: str, message) -> DataFrame:
    return df.select(F.lit(table).alias("table_name"), F.col(line).cast("long").alias("line"),
                     F.lit(rule).alias("rule"), message.alias("message"))


def _at(table: str, line: str):
    return F.concat(F.lit(table + ":"), F.col(line).cast("string"), F.lit(": "))


def missing_columns(df: DataFrame, required) -> list[str]:
    """Required names the table does not have; a metadata check, no job runs."""
    return sorted(set(required) - set(df.columns))


def check_columns(spark, table: str, df: DataFrame, required, line: str = "_ord",
                  surplus: str | None = None) -> DataFrame:
    """One issue for missing columns, one per row with surplus cells."""
    missing = missing_columns(df, required)
    rows = [(table, 0, "columns", f"{table}: missing required columns: {', '.join(missing)}")]
    issues = spark.createDataFrame(rows if missing else [],
                                   "table_name string, line long, rule string, message string")
    if surplus and surplus in df.columns:
        bad = df.where(F.col(surplus).isNotNull())
        issues = issues.unionByName(_issue(
            bad, table, line, "surplus", F.concat(_at(table, line), F.lit("row has extra unparsed columns"))))
    return issues


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    parts = [df.agg(F.count("*").alias("row_count")).select(F.lit(n).alias("table_name"), "row_count")
             for n, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def check_unique(df: DataFrame, table: str, key: str, line: str = "_ord") -> DataFrame:
    """Blank keys, and every repeat of a key after its first line.

    First lines come from an aggregate that combines map-side, so a key held by a third
    of the rows never has to be sorted in one task.
    """
    keyed = df.select(sval(key).alias("_v"), F.col(line).alias("_line"))
    blank = _issue(keyed.where(F.col("_v") == ""), table, "_line", "blank_key",
                   F.concat(_at(table, "_line"), F.lit(f"missing {key}")))
    firsts = (keyed.where(F.col("_v") != "").groupBy("_v")
              .agg(F.min("_line").alias("_first"), F.count("*").alias("_n")).where("_n > 1"))
    repeats = keyed.join(firsts, "_v").where(F.col("_line") > F.col("_first"))
    text = F.concat(_at(table, "_line"), F.lit(f"duplicate {key} '"), F.col("_v"),
                    F.lit("' (first seen on line "), F.col("_first").cast("string"), F.lit(")"))
    return blank.unionByName(_issue(repeats, table, "_line", "duplicate_key", text))


def check_fk(src: DataFrame, src_name: str, col_name: str, dst: DataFrame, dst_name: str,
             key: str, line: str = "_ord", report_blank: bool = True) -> DataFrame:
    """Blank and dangling references. ``report_blank=False`` treats a blank as dangling."""
    keyed = src.select(sval(col_name).alias("_v"), F.col(line).alias("_line"))
    known = dst.select(nonblank(key).alias("_v")).where(F.col("_v").isNotNull()).distinct()
    probe = keyed.where(F.col("_v") != "") if report_blank else keyed
    text = F.concat(_at(src_name, "_line"), F.lit(f"invalid foreign key {col_name}='"), F.col("_v"),
                    F.lit(f"' -> {dst_name}.{key}"))
    issues = _issue(probe.join(known, "_v", "left_anti"), src_name, "_line", "dangling_fk", text)
    if report_blank:
        issues = issues.unionByName(_issue(
            keyed.where(F.col("_v") == ""), src_name, "_line", "blank_fk",
            F.concat(_at(src_name, "_line"), F.lit(f"missing foreign key {col_name}"))))
    return issues


def check_array_fk(src: DataFrame, src_name: str, list_col: str, dst: DataFrame, key: str,
                   line: str = "_ord") -> DataFrame:
    exploded = src.select(F.col(line).alias("_line"), F.explode(pipe_list(list_col)).alias("_v"))
    known = dst.select(sval(key).alias("_v")).where("_v <> ''").distinct()
    text = F.concat(_at(src_name, "_line"), F.lit(f"invalid {list_col} value '"), F.col("_v"), F.lit("'"))
    return _issue(exploded.join(known, "_v", "left_anti"), src_name, "_line", "dangling_list_id", text)


def check_corpus(docs: DataFrame, name: str, id_col: str, text_col: str,
                 expected: DataFrame | None = None, line: str = "_ord") -> DataFrame:
    """Empty documents and expected ids without a document."""
    empty = _issue(docs.where(sval(text_col) == ""), name, line, "empty_document",
                   F.concat(F.lit(name + ":"), sval(id_col), F.lit(": empty content")))
    if expected is None:
        return empty
    have = docs.select(sval(id_col).alias("_v")).where("_v <> ''").distinct()
    gone = expected.select(F.col(expected.columns[0]).cast("string").alias("_v")).join(
        have, "_v", "left_anti").withColumn("_line", F.lit(0))
    return empty.unionByName(_issue(gone, name, "_line", "missing_document",
                                    F.concat(F.lit(name + ": missing id "), F.col("_v"))))


def duplicate_ids(docs: DataFrame, id_col: str = "id") -> DataFrame:
    return (docs.groupBy(sval(id_col).alias("id")).agg(F.count("*").alias("copies"))
            .where("copies > 1"))


def validation_report(tables: dict[str, DataFrame], spec, line: str = "_ord") -> DataFrame:
    """All issues of a domain in one table; the dataset is valid when it is empty."""
    spark = next(iter(tables.values())).sparkSession
    parts = []
    for t in spec.tables:
        if t.name not in tables:
            parts.append(spark.createDataFrame(
                [(t.name, 0, "missing_table", f"{t.name}: missing required file")],
                "table_name string, line long, rule string, message string"))
            continue
        df = tables[t.name]
        parts.append(check_columns(spark, t.name, df, t.required, line))
        if t.key in df.columns:
            parts.append(check_unique(df, t.name, t.key, line))
        for column, other, key in t.foreign_keys:
            if other in tables and column in df.columns:
                parts.append(check_fk(df, t.name, column, tables[other], other, key, line,
                                      report_blank=spec.report_blank_fk))
        for column, other, key in t.list_keys:
            if other in tables and column in df.columns:
                parts.append(check_array_fk(df, t.name, column, tables[other], key, line))
        if t.text and t.text in df.columns:
            parts.append(check_corpus(df, t.name, t.key, t.text, line=line))
    return reduce(DataFrame.unionByName, parts)
