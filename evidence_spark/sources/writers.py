"""Run files: per-case JSON lines, one-row summaries and readable reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def write_run(records: DataFrame, path: str, partitions: int | None = None) -> str:
    """Per-case records as JSON lines; as many files as there are partitions."""
    df = records if partitions is None else records.coalesce(partitions)
    df.write.mode("overwrite").json(path)
    return path


def write_summary(summary: DataFrame, path: str) -> str:
    """A one-row summary as a single JSON object."""
    summary.coalesce(1).write.mode("overwrite").json(path)
    return path


def write_report(summary: DataFrame, path: str, title: str = "Evaluation summary") -> str:
    """The one-row summary as a short Markdown text."""
    rows = [F.concat(F.lit(f"- {c}: `"), F.coalesce(F.col(c).cast("string"), F.lit("n/a")), F.lit("`")) for c in summary.columns]
    summary.select(F.concat_ws("\n", F.lit(f"# {title}\n"), *rows).alias("value")).coalesce(1).write.mode("overwrite").text(path)
    return path


def write_nodes(nodes: DataFrame, path: str) -> str:
    """Parent or leaf nodes as JSON lines, readable by ``load_hierarchy``."""
    nodes.write.mode("overwrite").json(path)
    return path
