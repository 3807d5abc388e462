"""Continuous ingest of session files."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from stepwell.plans.enrich import signal_pass
from stepwell.plans.ingest import Ingested, ingest
from stepwell.plans.tables import write_batch
from stepwell.sources.files import raw_columns, read_sessions, small_files, staged_path

PATHS_PER_READ = 10_000


Passes = Callable[[Ingested], DataFrame]


def signals_only(done: Ingested) -> DataFrame:
    return signal_pass(done.traces, done.trajectories, done.steps)


def ingest_batch(
    raw: DataFrame,
    out: str,
    batch_id: int,
    roots: dict[str, str] | None = None,
    passes: Passes = signals_only,
) -> None:
    """Ingest one batch of raw files, enrich it and write its tables.

    ``passes`` turns the ingested tables into the traces to write; a caller with labels,
    events or vectors chains ``plans.enrich.enrich`` there.  Files that cannot be
    normalised become raw-only trace rows; none of them can fail the batch.  Writing the
    same batch again replaces it.
    """
    done = ingest(raw, bronze=f"{out}/raw/batch_id={batch_id}")
    traces = passes(done)
    if roots:
        traces = traces.withColumn("staged_path", staged_path(F.col("path"), roots))
    write_batch(done.trajectories, f"{out}/trajectories", batch_id)
    write_batch(done.steps, f"{out}/steps", batch_id)
    write_batch(traces, f"{out}/traces", batch_id)


def sync_folder(
    spark: SparkSession,
    folder: str,
    out: str,
    checkpoint: str,
    pattern: str = "*.jsonl",
    roots: dict[str, str] | None = None,
    files_per_batch: int = 10_000,
    once: bool = True,
    passes: Passes = signals_only,
) -> StreamingQuery:
    """Ingest all files of a folder that were not ingested before.

    With ``once`` the query stops when it has caught up; otherwise it keeps running.
    """
    files = (
        spark.readStream.format("text")
        .option("wholetext", True)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", pattern)
        .option("maxFilesPerTrigger", files_per_batch)
        .load(folder)
        .select(*raw_columns())
    )
    writer = files.writeStream.option("checkpointLocation", checkpoint).foreachBatch(
        lambda batch, batch_id: ingest_batch(batch, out, batch_id, roots, passes)
    )
    return (writer.trigger(availableNow=True) if once else writer).start()


def _groups(paths: Iterator[str]) -> Iterator[list[str]]:
    while group := list(islice(paths, PATHS_PER_READ)):
        yield group


def ingest_settled(
    spark: SparkSession,
    settled: DataFrame,
    out: str,
    checkpoint: str,
    passes: Passes = signals_only,
) -> StreamingQuery:
    """Ingest files as they settle (``settled``: a stream with a path column).

    Paths reach the driver in groups of bounded size; file contents never do.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        paths = (row["path"] for row in batch.select("path").distinct().toLocalIterator())
        with small_files(spark):
            for part, group in enumerate(_groups(paths)):
                ingest_batch(
                    read_sessions(spark, group), out, batch_id * 1_000_000 + part, passes=passes
                )

    return settled.writeStream.option("checkpointLocation", checkpoint).foreachBatch(run).start()
