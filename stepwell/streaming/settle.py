"""Files that have gone quiet: one output per burst of changes.

A change stream has (path, event_ts) and, for moves, dest_path.  A path settles when it
has not changed for the debounce time.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

DEBOUNCE_SECONDS = 10
SUFFIX = ".jsonl"


def watched(changes: DataFrame, suffix: str | None = SUFFIX) -> DataFrame:
    """Changes of session files; a move counts at its destination."""
    if "dest_path" in changes.columns:
        changes = changes.withColumn("path", F.coalesce("dest_path", "path")).drop("dest_path")
    return changes if suffix is None else changes.filter(F.col("path").endswith(suffix))


def settled_stream(
    changes: DataFrame,
    debounce: int = DEBOUNCE_SECONDS,
    delay: int = 0,
    suffix: str | None = SUFFIX,
) -> DataFrame:
    """Streaming form in event time: (path, first_write, last_write, writes) per burst.

    A burst is emitted once the watermark has passed its end.  A write that arrives later
    than ``delay`` opens a new burst, and ingesting a file twice is harmless.  Session
    windows that touch are merged, so the gap is a microsecond short of the debounce: a
    write after exactly the debounce time opens a new burst.
    """
    return _sessions(watched(changes, suffix), debounce, delay)


def _sessions(changes: DataFrame, debounce: int, delay: int, writes: str = "*") -> DataFrame:
    gap = f"{debounce * 1_000_000 - 1} microseconds"
    return (
        changes.withWatermark("event_ts", f"{delay} seconds")
        .groupBy(F.session_window("event_ts", gap), "path")
        .agg(
            F.min("event_ts").alias("first_write"),
            F.max("event_ts").alias("last_write"),
            F.count(writes).alias("writes"),
        )
        .drop("session_window")
    )


def settled_batch(
    changes: DataFrame, debounce: int = DEBOUNCE_SECONDS, suffix: str | None = SUFFIX
) -> DataFrame:
    """Batch form of :func:`settled_stream` over a table of changes.

    Changes are first reduced to one row per path and time bucket as wide as the debounce
    (two changes in a bucket always belong together), before the shuffle; only buckets
    are then put in order.
    """
    gap = debounce * 1_000_000
    micros = F.unix_micros(F.col("event_ts").cast("timestamp"))
    buckets = (
        watched(changes, suffix)
        .select("path", micros.alias("_at"))
        .groupBy("path", F.floor(F.col("_at") / gap).alias("_bucket"))
        .agg(F.min("_at").alias("_from"), F.max("_at").alias("_to"), F.count("*").alias("_n"))
    )
    w = Window.partitionBy("path").orderBy("_bucket")
    opens = F.coalesce(F.col("_from") - F.lag("_to").over(w) >= gap, F.lit(True))
    bursts = buckets.withColumn("_opens", opens.cast("int")).withColumn(
        "_burst", F.sum("_opens").over(w.rowsBetween(Window.unboundedPreceding, 0))
    )
    return bursts.groupBy("path", "_burst").agg(
        F.timestamp_micros(F.min("_from")).alias("first_write"),
        F.timestamp_micros(F.max("_to")).alias("last_write"),
        F.sum("_n").alias("writes"),
    ).drop("_burst")


class _Quiet(StatefulProcessor):
    """One processing-time timer per path, restarted by every change."""

    def __init__(self, debounce_ms: int):
        self.debounce_ms = debounce_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "timer bigint, writes bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        fresh = sum(len(batch) for batch in rows)
        timer, writes = (self.seen.get() if self.seen.exists() else (None, 0))
        if timer is not None:
            self.handle.deleteTimer(timer)
        due = timerValues.getCurrentProcessingTimeInMs() + self.debounce_ms
        self.handle.registerTimer(due)
        self.seen.update((due, writes + fresh))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        writes = self.seen.get()[1]
        self.seen.clear()
        yield pd.DataFrame({"path": [key[0]], "writes": [writes]})

    def close(self) -> None:
        pass


def settled_by_timer(
    changes: DataFrame, debounce: int = DEBOUNCE_SECONDS, suffix: str | None = SUFFIX
) -> DataFrame:
    """Streaming form with exact processing-time timers (needs the RocksDB state store)."""
    return (
        watched(changes, suffix)
        .groupBy("path")
        .transformWithStateInPandas(
            statefulProcessor=_Quiet(debounce * 1000),
            outputStructType="path string, writes bigint",
            outputMode="Append",
            timeMode="ProcessingTime",
        )
    )


# --- every burst, the last ones included -----------------------------------------------------

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB, off the heap; timers need it."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def settled_bursts(
    changes: DataFrame, debounce: int = DEBOUNCE_SECONDS, delay: int = 0, suffix: str | None = SUFFIX
) -> DataFrame:
    """:func:`settled_stream` that lets every burst out: (path, first_write, last_write, writes).

    Rows without a path are ticks of a clock: they open no burst, but move the time on, so
    the last burst of a path leaves although nothing is written after it.  The state is one
    row per open burst, carried from batch to batch and over restarts; start it inside
    ``rocksdb_state``.  A write more than ``delay`` seconds older than the newest write or tick
    of the batches before is lost.
    """
    named = watched(changes, None)
    if suffix is not None:
        named = named.filter(F.col("path").isNull() | F.col("path").endswith(suffix))
    # a filter on the path would move below the watermark, and no tick would get there
    bursts = _sessions(named, debounce, delay, writes="path").filter("writes > 0")
    return bursts.select("path", "first_write", "last_write", "writes")
