"""Ingest of sessions whose lines arrive bit by bit.

Two streams share a table of lines.  The first stores lines as they come, in buckets of their
path.  The second follows that table, waits until a path has been quiet for the debounce time
(event-time sessions with carried state, ``settle.settled_bursts``) and then builds the whole session from
all lines stored so far and ingests it.  A session that goes on after it was ingested is built again with
its new lines; the newest batch of a trace counts, so turns that are split over any number of
deliveries end up in one trace.

Only names of settled paths meet the table of lines, in a join that reads the buckets of
these paths alone.  A line that was delivered twice counts once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from stepwell.session import cut_lineage
from stepwell.streaming.continuous import Passes, ingest_batch, signals_only
from stepwell.streaming.settle import DEBOUNCE_SECONDS, SUFFIX, rocksdb_state, settled_bursts

LINE_SCHEMA = "path string, line_no bigint, line string, event_ts timestamp"
BUCKETS = 64


def _bucket(path: str = "path"):
    return F.pmod(F.xxhash64(path), F.lit(BUCKETS)).cast("int")


def store_lines(lines: DataFrame, out: str, once: bool = True) -> StreamingQuery:
    """Append a stream of (path, line_no, line, event_ts) to the table of lines.

    A row without a path is a tick of a clock.
    """
    writer = (
        lines.select("path", "line_no", "line", "event_ts", _bucket().alias("bucket"))
        .writeStream.format("parquet")
        .partitionBy("bucket")
        .option("path", f"{out}/lines")
        .option("checkpointLocation", f"{out}/progress/lines")
    )
    return (writer.trigger(availableNow=True) if once else writer).start()


def stored_lines(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(f"{LINE_SCHEMA}, bucket int").parquet(f"{out}/lines")


def whole_sessions(lines: DataFrame, settled: DataFrame) -> DataFrame:
    """Raw files (path, file_name, raw_blob, mtime) of the settled paths, from all their lines.

    ``settled`` has path and last_write.  The join prunes the buckets of ``lines``.
    """
    wanted = settled.groupBy("path").agg(F.max("last_write").alias("mtime")).withColumn("bucket", _bucket())
    joined = lines.join(wanted, ["bucket", "path"])
    text = F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("line_no", "line"))), lambda s: F.concat(s["line"], F.lit("\n"))), "")
    return joined.groupBy("path").agg(text.alias("raw_blob"), F.max("mtime").alias("mtime")).select(
        "path", F.element_at(F.split("path", "/"), -1).alias("file_name"), "raw_blob", "mtime"
    )


def ingest_appended(
    spark: SparkSession,
    out: str,
    debounce: int = DEBOUNCE_SECONDS,
    delay: int = 0,
    suffix: str | None = SUFFIX,
    passes: Passes = signals_only,
    once: bool = True,
) -> StreamingQuery:
    """Ingest the sessions of the table of lines as they settle, into tables below ``out``."""
    changes = spark.readStream.schema(f"{LINE_SCHEMA}, bucket int").parquet(f"{out}/lines").select("path", "event_ts")

    def run(batch: DataFrame, batch_id: int) -> None:
        # every use of the batch would run its state once more
        settled = cut_lineage(batch.select("path", "last_write"))
        if not settled.isEmpty():
            ingest_batch(whole_sessions(stored_lines(spark, out), settled), out, batch_id, passes=passes)

    writer = (
        settled_bursts(changes, debounce, delay, suffix)
        .writeStream.outputMode("append")
        .option("checkpointLocation", f"{out}/progress/settled")
        .foreachBatch(run)
    )
    with rocksdb_state(spark):
        return (writer.trigger(availableNow=True) if once else writer).start()
