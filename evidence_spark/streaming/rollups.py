"""Counter and histogram roll-ups, request statistics and sliding risk counts.

All functions take a static or a streaming DataFrame. On a stream pass ``watermark``; rows
later than it are dropped, which is the late-data rule of this package.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import constants as K


def _timed(df: DataFrame, ts: str, watermark: str | None) -> DataFrame:
    return df.withWatermark(ts, watermark) if watermark else df


def attribute_key(attributes: Column) -> Column:
    """Sorted ``key=value`` text of a map without blank values."""
    entries = F.filter(F.map_entries(attributes), lambda e: e["value"].isNotNull() & (e["value"] != ""))
    return F.array_join(F.array_sort(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ",")


def metric_rollup(samples: DataFrame, window: str | None = None, watermark: str | None = None,
                  order: str = "_ord") -> DataFrame:
    """Count, sum, min, max and last value by kind, name and attributes, optionally windowed."""
    df = _timed(samples, "ts", watermark).withColumn("attrs", attribute_key(F.col("attributes")))
    keys = ["kind", "name", "attrs"] + ([F.window("ts", window).alias("window")] if window else [])
    return df.groupBy(*keys).agg(
        F.count("*").alias("count"), F.sum("value").alias("sum"), F.min("value").alias("min"), F.max("value").alias("max"),
        F.max_by("value", order).alias("last"))


def request_stats(requests: DataFrame, window: str = "1 hour", watermark: str | None = None) -> DataFrame:
    """Requests, errors, low-confidence answers and latency by path per tumbling window."""
    df = _timed(requests, "ts", watermark)
    return df.groupBy(F.window("ts", window).alias("window"), "path").agg(
        F.count("*").alias("requests"), F.sum(F.when(F.col("status_code") >= 500, 1).otherwise(0)).alias("errors"),
        F.sum(F.when(F.col("confidence") == "low", 1).otherwise(0)).alias("low_confidence"),
        F.avg("duration_ms").alias("avg_ms"), F.max("duration_ms").alias("max_ms"))


def risk_sliding(signals: DataFrame, days: int = 7, step: str = "1 day", watermark: str | None = None, panes: bool | None = None) -> DataFrame:
    """Trailing signal counts per customer over sliding windows.

    signals come from ``operators.risk.signals`` or any stream with the same columns. With ``panes`` the rows of a customer
    are first summed per step, and only the sums are put into the windows they belong to, so a busy customer's rows are not
    multiplied. That is how tables are counted. A stream sums in one stage unless ``panes`` is set: two chained stages
    need a watermark and the append mode. ``days`` must be a whole number of steps.
    """
    df = _timed(signals, "at", watermark)
    flags = ["critical", "escalation", "login", "api", "refund", "negative"]
    ones = {"tickets": F.col("source_type") == "ticket", **{c: F.col(c) for c in flags}}
    sums = [F.sum(F.when(c, 1).otherwise(0)).alias(name) for name, c in ones.items()]
    wide = f"{days} days"
    if not (not signals.isStreaming if panes is None else panes):
        return df.groupBy(F.window("at", wide, step).alias("window"), "customer_id").agg(*sums)
    pane = df.groupBy(F.window("at", step).alias("pane"), "customer_id").agg(*sums)
    return pane.groupBy(F.window(F.window_time("pane"), wide, step).alias("window"), "customer_id").agg(*[F.sum(c).alias(c) for c in ones])
