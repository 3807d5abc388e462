"""Catch-up sync of a folder: new and changed files are ingested, unchanged ones skipped.

The listing of a folder is a table of (path, size, mtime) that Spark builds without opening a
file.  The manifest holds the same columns for every file as it was when it was taken in; a
file is due when no manifest row has its path, size and modification second.  Due files are
ingested in groups; a group's tables are written first and its manifest rows last under
the same batch number, so a sync that breaks off repeats the group and nothing else.  A file
that grows while it is read keeps the size it was listed with and is due again next time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepwell.plans.tables import read_or_none, write_batch
from stepwell.sources.files import read_sessions, small_files
from stepwell.streaming.continuous import Passes, ingest_batch, signals_only

FILES_PER_BATCH = 10_000
# names are fetched a partition at a time, by one job each
NAME_PARTITIONS = 32
MANIFEST_SCHEMA = "path string, size bigint, mtime_s bigint, batch_id bigint"
MANIFEST_COLUMNS = ("path", "size", "mtime_s", "bigint(batch_id) AS batch_id")


@dataclass(frozen=True)
class Synced:
    """Counts of one sync."""

    scanned: int
    ingested: int
    skipped: int
    batches: tuple[int, ...]


def listing(spark: SparkSession, folder: str, pattern: str | None = "*.jsonl") -> DataFrame:
    """(path, size, mtime_s) of every file below the folder; contents are not read.

    Empty files hold no session, and Spark lists none.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if pattern is not None:
        reader = reader.option("pathGlobFilter", pattern)
    seconds = F.unix_seconds("modificationTime").alias("mtime_s")
    return reader.load(folder).select("path", F.col("length").alias("size"), seconds)


def manifest(spark: SparkSession, out: str) -> DataFrame:
    """(path, size, mtime_s, batch_id) of all files taken in so far; empty before the first."""
    found = read_or_none(spark, f"{out}/manifest")
    return spark.createDataFrame([], MANIFEST_SCHEMA) if found is None else found.selectExpr(*MANIFEST_COLUMNS)


def due(files: DataFrame, known: DataFrame) -> DataFrame:
    """Files of a listing that the manifest does not have as they are now.

    Only a file's newest manifest row counts: one that went back to an earlier size is due.
    """
    newest = known.groupBy("path").agg(F.max_by(F.struct("size", "mtime_s"), "batch_id").alias("_seen"))
    same = (files["path"] == newest["path"]) & (files["size"] == F.col("_seen.size")) & (files["mtime_s"] == F.col("_seen.mtime_s"))
    return files.join(newest, same, "left_anti")


def by_name(path: str) -> str:
    """A path that stands for itself where Spark expects a pattern."""
    return re.sub(r"([\\*?\[\]{}])", r"\\\1", path)


def _groups(rows: Iterator, size: int) -> Iterator[list]:
    while group := list(islice(rows, size)):
        yield group


def sync_changed(
    spark: SparkSession,
    folder: str,
    out: str,
    pattern: str | None = "*.jsonl",
    roots: dict[str, str] | None = None,
    files_per_batch: int = FILES_PER_BATCH,
    passes: Passes = signals_only,
) -> Synced:
    """Ingest the files below ``folder`` that are new or changed since the last sync.

    Tables and manifest lie below ``out`` as batches; a trace whose file grew is in several,
    and the newest counts (``plans.tables.current``).  Names of due files pass the driver in
    groups of ``files_per_batch``, as Spark opens files by name; contents never do.
    """
    with small_files(spark):
        files = listing(spark, folder, pattern)
        known = manifest(spark, out)
        last = known.agg(F.max("batch_id")).first()[0]
        batch_id = 0 if last is None else last + 1
        scanned, ingested, batches = files.count(), 0, []
        names = due(files, known).coalesce(NAME_PARTITIONS)
        for group in _groups(names.toLocalIterator(), files_per_batch):
            raw = read_sessions(spark, [by_name(r["path"]) for r in group])
            ingest_batch(raw, out, batch_id, roots, passes)
            taken = spark.createDataFrame(group, "path string, size bigint, mtime_s bigint")
            write_batch(taken.coalesce(1), f"{out}/manifest", batch_id)
            ingested += len(group)
            batches.append(batch_id)
            batch_id += 1
    return Synced(scanned, ingested, scanned - ingested, tuple(batches))
