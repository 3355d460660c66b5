"""Action ledger: the first record of an idempotency key claims it, later saves win."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.text import sval

CLAIM = ["action_id", "action_name", "reason", "created_at"]
STATE = ["status", "updated_at", "last_error"]


def action_ledger(events: DataFrame, order: str = "_ord") -> DataFrame:
    """One row per idempotency key from an event log.

    events: idempotency_key, action_id, action_name, reason, status, created_at, updated_at,
    last_error and an order column. Records that lost the claim are ignored unless they save
    the claimed action id.
    """
    df = events.where(sval("idempotency_key") != "")
    claims = df.groupBy("idempotency_key").agg(F.min_by(F.struct(*CLAIM), order).alias("_c")).select("idempotency_key", "_c.*")
    latest = df.groupBy(F.col("action_id")).agg(
        F.max_by(F.struct(*STATE), order).alias("_s"), F.count("*").alias("attempt_count")).select("action_id", "_s.*", "attempt_count")
    return claims.join(latest, "action_id")


def merge_ledger(ledger: DataFrame | None, batch: DataFrame) -> DataFrame:
    """Ledger after a batch: earlier claims stand, newer states replace older ones."""
    new = action_ledger(batch)
    if ledger is None:
        return new
    saved = batch.where(sval("idempotency_key") != "").groupBy("action_id").agg(
        F.max_by(F.struct(*STATE), "_ord").alias("_s"), F.count("*").alias("_n"))
    kept = ledger.join(saved, "action_id", "left")
    for c in STATE:
        kept = kept.withColumn(c, F.when(F.col("_s").isNotNull(), F.col(f"_s.{c}")).otherwise(F.col(c)))
    kept = kept.withColumn("attempt_count", F.col("attempt_count") + F.coalesce("_n", F.lit(0))).drop("_s", "_n")
    fresh = new.join(ledger.select("idempotency_key"), "idempotency_key", "left_anti")
    return kept.unionByName(fresh)


def ledger_sink(path: str, ttl_days: int | None = None, keep: int = 2):
    """A foreachBatch function that keeps the ledger as versioned tables under ``path``.

    A batch starts from the newest complete version, whatever its own id, so a stream that
    starts over with a new checkpoint goes on with the ledger it finds. Records at or before
    the newest ``_ord`` that an action has applied are replays and change nothing. The
    last ``keep`` versions stay.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        done = _versions(spark, path)
        stored = spark.read.parquet(f"{path}/v={done[-1]}") if done else None
        if stored is not None:
            seen = stored.select("action_id", F.col("last_ord").alias("_seen"))
            batch = batch.join(seen, "action_id", "left").where("_seen IS NULL OR _ord > _seen").drop("_seen")
        out = merge_ledger(None if stored is None else stored.drop("last_ord"), batch)
        newest = batch.groupBy("action_id").agg(F.max("_ord").alias("last_ord"))
        if stored is not None:
            newest = newest.unionByName(stored.select("action_id", "last_ord")).groupBy("action_id").agg(F.max("last_ord").alias("last_ord"))
        out = out.join(newest, "action_id", "left")
        if ttl_days is not None:
            newest_save = out.agg(F.max(F.try_to_timestamp("updated_at")).alias("t")).scalar()
            out = out.where(F.try_to_timestamp("updated_at") >= newest_save - F.expr(f"INTERVAL {int(ttl_days)} DAYS"))
        out.write.mode("overwrite").parquet(f"{path}/v={done[-1] + 1 if done else 0}")
        for version in done[:max(0, len(done) + 1 - keep)]:
            _path(spark, path).delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/v={version}"), True)

    return write


def read_ledger(spark: SparkSession, path: str) -> DataFrame | None:
    """The newest complete version of a stored ledger."""
    done = _versions(spark, path)
    return spark.read.parquet(f"{path}/v={done[-1]}").drop("last_ord") if done else None


def _path(spark, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())


def _versions(spark, path: str) -> list[int]:
    """Numbers of the versions whose write was completed, oldest first."""
    pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/v=*/_SUCCESS")
    found = _path(spark, path).globStatus(pattern) or []
    return sorted(int(s.getPath().getParent().getName()[2:]) for s in found)
