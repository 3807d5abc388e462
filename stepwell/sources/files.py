"""Scans: session files, manifests and evaluation sets."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stepwell.functions import variants as V

# File name patterns per collection.
PATTERNS = {
    "claude_code": "*.jsonl",
    "codex": "*.jsonl",
    # exports and plain chats; the content decides
    "cursor": "*.json",
    "swe_agent": "*.json",
    "atif": "trajectory.json",
}

# Line ends of Python's str.splitlines().
LINE_BREAK_SQL = r"\\R|\u001c|\u001d|\u001e"

# Reads of many small files: given names are looked up by this many tasks at most, not one task a
# name, and a file counts as this many bytes beside its size when the tasks of a scan are cut.
SMALL_FILES = {
    "spark.sql.sources.parallelPartitionDiscovery.parallelism": "64",
    "spark.sql.files.openCostInBytes": "262144",
}

RAW_SCHEMA = "path string, file_name string, raw_blob string, size bigint, mtime timestamp"


def raw_columns() -> list[Column]:
    return [
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_name").alias("file_name"),
        # broken byte sequences become replacement characters
        F.make_valid_utf8(F.col("value")).alias("raw_blob"),
        F.col("_metadata.file_size").alias("size"),
        F.col("_metadata.file_modification_time").alias("mtime"),
    ]


@contextmanager
def small_files(spark: SparkSession) -> Iterator[None]:
    """Reads that are set up and run inside take many small files to a task."""
    before = {name: spark.conf.get(name) for name in SMALL_FILES}
    for name, value in SMALL_FILES.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def read_sessions(
    spark: SparkSession,
    paths: str | list[str],
    pattern: str | None = None,
    recursive: bool = False,
) -> DataFrame:
    """One row per file, undecoded beyond UTF-8."""
    files = spark.read.text(
        paths, wholetext=True, pathGlobFilter=pattern, recursiveFileLookup=recursive
    )
    return files.select(*raw_columns())


def read_collection(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    """All session files of one collection below ``folder``."""
    return read_sessions(spark, folder, PATTERNS[kind], recursive=True)


def parsed_lines(raw: str) -> str:
    """SQL: ordered JSON objects of a JSONL text; other lines are left out."""
    lines = f"transform(split({raw}, '{LINE_BREAK_SQL}'), s -> {V.parse(V.strip('s'))})"
    return f"filter({lines}, e -> {V.is_object('e')})"


def scan_jsonl(raw: DataFrame) -> DataFrame:
    """(path, line_no, event, event_type): one row per object line, numbered from 1."""
    lines = raw.selectExpr("path", f"posexplode(split(raw_blob, '{LINE_BREAK_SQL}')) AS (_pos, _line)")
    events = lines.selectExpr("path", "_pos + 1 AS line_no", f"{V.parse(V.strip('_line'))} AS event")
    return events.filter(V.is_object("event")).selectExpr(
        "*", f"{V.string('event', '$.type')} AS event_type"
    )


def scan_json(raw: DataFrame) -> DataFrame:
    """(path, doc): the parsed document, NULL when the text is not JSON."""
    return raw.selectExpr("path", f"{V.parse('raw_blob')} AS doc")


def read_benchmark_rows(spark: SparkSession, path: str) -> DataFrame:
    """Benchmark rows from Parquet as session documents, nested fields untouched."""
    rows = spark.read.parquet(path)
    document = F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"})
    return rows.select(
        F.col("instance_id").alias("path"),
        safe_filename(F.col("instance_id")).alias("file_name"),
        document.alias("raw_blob"),
    )


def safe_filename(key: Column) -> Column:
    """File name of a benchmark row."""
    flat = F.replace(F.replace(key, F.lit("/"), F.lit("__")), F.lit(" "), F.lit("_"))
    return F.concat(flat, F.lit(".json"))


MANIFEST_SCHEMA = """
    summary map<string,string>,
    results array<struct<
        spec: struct<output_format:string, primary_failure:string,
                     secondary_failures:array<string>, task:string,
                     target_step_count:int, is_failure:boolean>,
        ok:boolean, attempts:int, error:string, notes:string,
        cost: struct<input_tokens:bigint, cache_write_tokens:bigint,
                     cache_read_tokens:bigint, output_tokens:bigint>,
        cost_usd:double, output_path:string,
        atif_summary: struct<n_steps:int, n_tool_calls:int>,
        budget_skipped:boolean>>
"""


def read_manifest(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One row per generation result, numbered within its manifest."""
    runs = spark.read.schema(MANIFEST_SCHEMA).option("multiLine", True).json(path)
    return runs.select(
        F.col("_metadata.file_path").alias("manifest"), F.posexplode("results").alias("row", "r")
    ).select(
        "manifest",
        "row",
        "r.*",
        F.col("r.spec.primary_failure").alias("label"),
        F.col("r.atif_summary.n_steps").alias("n_steps"),
        F.col("r.atif_summary.n_tool_calls").alias("n_tool_calls"),
    )


def read_eval_queries(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Evaluation queries (query, expected) and the entries that have another shape."""
    entries = (
        spark.read.text(path, wholetext=True)
        .selectExpr(f"posexplode({V.array(V.parse('value'))}) AS (query_id, entry)")
        .selectExpr(
            "query_id",
            f"{V.string('entry', '$.query')} AS query",
            "try_variant_get(entry, '$.expected', 'array<string>') AS expected",
            "to_json(entry) AS entry_json",
        )
    )
    sound = F.col("query").isNotNull() & F.col("expected").isNotNull()
    return entries.filter(sound).drop("entry_json"), entries.filter(~sound).select("query_id", "entry_json")


def staged_path(path: Column, roots: dict[str, str]) -> Column:
    """Destination of a watched file: the path below its root, under the root's target.

    NULL for a file below none of the roots.
    """
    result = F.lit(None).cast("string")
    for root, target in roots.items():
        prefix = root.rstrip("/") + "/"
        inside = F.concat(F.lit(target.rstrip("/") + "/"), F.substring(path, len(prefix) + 1, 2**30))
        result = F.coalesce(result, F.when(path.startswith(prefix), inside))
    return result
