"""Conversation history per session: batch window and keyed streaming state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..functions.text import strip
from ..operators.relational import top_k

HISTORY = 6
TURN = StructType([StructField("turn", LongType()), StructField("role", StringType()), StructField("content", StringType())])


def clean_turns(turns: DataFrame) -> DataFrame:
    """Turns with a session, a role and a text; the rest is dropped."""
    df = turns.withColumn("role", strip(F.coalesce("role", F.lit("")))).withColumn("content", strip(F.coalesce("content", F.lit(""))))
    return df.where("session_id IS NOT NULL AND role <> '' AND content <> ''")


def session_history(turns: DataFrame, n: int = HISTORY) -> DataFrame:
    """The last n turns of every session; the rank limit works before the shuffle."""
    return top_k(clean_turns(turns), ["session_id"], [F.col("turn").desc()], n, "_r").drop("_r")


class KeepLast(StatefulProcessor):
    """Holds the last n turns of one session and emits the history after each batch."""

    def __init__(self, n: int, ttl_ms: int | None):
        self.n, self.ttl_ms = n, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        # a write renews the expiry, as a refreshed key would
        self.turns = handle.getListState("turns", TURN, ttlDurationMs=self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = [tuple(t) for t in self.turns.get()]
        for pdf in rows:
            held += list(pdf[["turn", "role", "content"]].itertuples(index=False, name=None))
            held = sorted(held, key=lambda t: t[0])[-self.n:]
        held = [(int(t), r, c) for t, r, c in held]
        self.turns.put(held)
        yield pd.DataFrame([(key[0], *t) for t in held], columns=["session_id", "turn", "role", "content"])

    def close(self) -> None:
        pass


def stream_session_history(turns: DataFrame, n: int = HISTORY, ttl_ms: int | None = None) -> DataFrame:
    """Streaming twin of ``session_history``; needs the RocksDB state store provider.

    Every touched session emits its current history; the last emission per session equals
    the batch result. Sessions keep the type of their id.
    """
    shape = StructType([StructField("session_id", turns.schema["session_id"].dataType), *TURN.fields])
    return (clean_turns(turns).select("session_id", "turn", "role", "content").groupBy("session_id")
            .transformWithStateInPandas(KeepLast(n, ttl_ms), shape, "Update", "None" if ttl_ms is None else "ProcessingTime"))
