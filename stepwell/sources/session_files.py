"""One file per row: a batch data source that writes session files under their own names.

Tasks write into a folder of the job, one sub-folder per attempt, so a task that fails or runs
twice leaves nothing in place.  The commit moves the files of the attempts that count to their
names and then drops the job's folder; a job that fails drops it as well.  Readers that look
for whole names never see half a file.  A name that exists already is replaced.

The folder must be one that all executors mount.  The commit costs one rename per file.
"""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from stepwell.operators.sequencing import first_per_key
from stepwell.sources.files import safe_filename

FORMAT = "session_files"
RENAMES_AT_ONCE = 16
PENDING = ".pending-"


@dataclass
class Written(WriterCommitMessage):
    """Folder of one attempt; the files in it are its result."""

    folder: str


class _Writer(DataSourceArrowWriter):
    def __init__(self, folder: str):
        self.folder = folder
        self.job = f"{folder}/{PENDING}{uuid.uuid4().hex}"

    def write(self, iterator: Iterator) -> Written:
        own = f"{self.job}/{uuid.uuid4().hex}"
        os.makedirs(own)
        for batch in iterator:
            names, texts = (batch.column(batch.schema.get_field_index(c)) for c in ("file_name", "text"))
            for name, text in zip(names, texts):
                with open(f"{own}/{name.as_py()}", "wb") as file:
                    file.write((text.as_py() or "").encode())
        return Written(own)

    def commit(self, messages: list[Written | None]) -> None:
        def place(folder: str) -> None:
            for entry in os.scandir(folder):
                os.replace(entry.path, f"{self.folder}/{entry.name}")

        with ThreadPoolExecutor(RENAMES_AT_ONCE) as pool:
            list(pool.map(place, [m.folder for m in messages if m is not None]))
        shutil.rmtree(self.job, ignore_errors=True)

    def abort(self, messages: list[Written | None]) -> None:
        shutil.rmtree(self.job, ignore_errors=True)


class SessionFiles(DataSource):
    """``df.write.format("session_files").mode("append").save(folder)`` for (file_name, text)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema, overwrite: bool) -> _Writer:
        if overwrite:
            raise ValueError("session files are added or replaced one by one: use mode('append')")
        folder = mounted(self.options["path"])
        os.makedirs(folder, exist_ok=True)
        return _Writer(folder)


def mounted(folder: str) -> str:
    """The local name of a folder; only mounted folders take single files."""
    if folder.startswith("file:"):
        return "/" + folder.removeprefix("file:").lstrip("/")
    if "://" in folder:
        raise ValueError(f"{folder}: single files need a folder that all executors mount")
    return folder


def write_session_files(files: DataFrame, folder: str) -> None:
    """Write (file_name, text) rows, one file each; a NULL text is an empty file.

    Rows without a name are left out.  Of rows that share a name the one with the greatest
    text is written.  A name with a slash is refused.
    """
    mounted(folder)
    named = files.filter("file_name IS NOT NULL").select("file_name", F.col("text").cast("string").alias("text"))
    single = first_per_key(named, ["file_name"], [F.col("text").desc_nulls_last()])
    plain = F.when(F.contains("file_name", F.lit("/")), F.raise_error(F.concat(F.lit("not a file name: "), "file_name"))).otherwise(F.col("file_name"))
    files.sparkSession.dataSource.register(SessionFiles)
    single.select(plain.cast("string").alias("file_name"), "text").write.format(FORMAT).mode("append").save(folder)


def extract_files(rows: DataFrame, key: str, folder: str) -> None:
    """Write every row as a JSON document named after its key."""
    document = F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"})
    write_session_files(rows.select(safe_filename(F.col(key)).alias("file_name"), document.alias("text")), folder)
