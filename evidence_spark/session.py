"""Session construction with the settings every job in this package relies on."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession, functions as F

# Settings that are safe on any cluster: nothing here pins a machine-local path.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
}


def get_spark(app: str = "evidence_spark", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**BASE_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_scratch: list[tempfile.TemporaryDirectory] = []  # of a local session; a cluster names its own folder


def local_spark(cpus: int | None = None) -> SparkSession:
    """Single-machine session for tests and bench.py."""
    cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    if not _scratch:
        _scratch.append(tempfile.TemporaryDirectory(prefix="evidence-store-"))
    spark = get_spark(
        master=f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": str(cpus),
            "spark.ui.enabled": "false",
            "spark.checkpoint.dir": _scratch[0].name,
            "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
            "spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "8g"),
            "spark.sql.streaming.stateStore.providerClass":
                "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def prepare(spark: SparkSession) -> SparkSession:
    """Pin the time zone on a session somebody else created."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def _store_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or the session's warehouse folder where it is unset.

    Both are shared by the driver and all executors.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/_stored"
    return folder.rstrip("/")


def new_folder(spark: SparkSession, kind: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{_store_folder(spark)}/{kind}-{uuid.uuid4().hex}"


DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession):
    """What runs inside removes its shuffle files when it ends; else they stay until the driver collects garbage."""
    before = spark.conf.get(DROP_SHUFFLES, None)
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.unset(DROP_SHUFFLES) if before is None else spark.conf.set(DROP_SHUFFLES, before)


def materialise(df):
    """Store a result as a table in the shared folder and return the table, cutting the lineage.

    Later stages read only the columns they need and see real sizes, and a lost executor
    costs no recomputation. It works alike on every master. Shuffle files it took are gone once the table is stored.
    """
    spark = df.sparkSession
    path = f"{_store_folder(spark)}/stored-{uuid.uuid4().hex}"
    with shuffles_dropped(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


BROADCAST_BYTES = 64 << 20  # of the stored files, columns compressed


def stored_bytes(df) -> int:
    """Bytes of the files behind a stored table."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    paths = [jvm.org.apache.hadoop.fs.Path(f) for f in df.inputFiles()]
    return sum(p.getFileSystem(conf).getFileStatus(p).getLen() for p in paths)


def small_side(df, max_bytes: int = BROADCAST_BYTES):
    """A stored copy that is broadcast only when the size of its files allows it.

    Beyond ``max_bytes`` the plain table is returned and the join shuffles both sides.
    """
    stored = materialise(df)
    return F.broadcast(stored) if stored_bytes(stored) <= max_bytes else stored
