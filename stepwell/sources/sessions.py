"""The canonical session: one row per file with its facts and its ordered steps.

A normaliser turns raw rows (path, file_name, raw_blob) into sessions.  Files without a
usable trajectory have no session row; their raw row stays where it is.  A session is
one file, so everything collected into a session is bounded by the size of that file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CALL = "struct<tool_call_id:string,function_name:string,arguments:string,extra:string>"
RESULT = "struct<source_call_id:string,content:string,text:string,extra:string>"
METRICS = "struct<prompt_tokens:bigint,completion_tokens:bigint,cached_tokens:bigint,extra:string>"
CALLS, RESULTS = f"array<{CALL}>", f"array<{RESULT}>"

# arguments, extra: canonical JSON text
STEP_FIELDS = (
    ("ts", "string"),
    ("source", "string"),
    ("message", "string"),
    ("model_name", "string"),
    ("reasoning_content", "string"),
    ("tool_calls", CALLS),
    ("results", RESULTS),
    ("metrics", METRICS),
    ("extra", "string"),
)
HEADER_FIELDS = (
    ("schema_version", "string"),
    ("trajectory_id", "string"),
    ("session_id", "string"),
    ("agent_name", "string"),
    ("agent_version", "string"),
    ("model", "string"),
    ("agent_extra", "string"),
    ("total_prompt_tokens", "bigint"),
    ("total_completion_tokens", "bigint"),
    ("total_cached_tokens", "bigint"),
    ("metrics_extra", "string"),
    ("resolved", "boolean"),
    ("exit_status", "string"),
    ("synthetic_failure_mode", "string"),
    ("counters", "map<string,bigint>"),
    ("extra", "string"),
)
SCHEMA_VERSION = "ATIF-v1.7"


def struct_type(fields: tuple[tuple[str, str], ...]) -> str:
    return "struct<" + ",".join(f"{name}:{kind}" for name, kind in fields) + ">"


STEP = struct_type(STEP_FIELDS)
HEADER = struct_type(HEADER_FIELDS)


def struct_of(fields: tuple[tuple[str, str], ...], values: dict[str, str]) -> str:
    """SQL struct with every field of a layout; fields not given are NULL."""
    unknown = set(values) - {name for name, _ in fields}
    if unknown:
        raise ValueError(f"unknown fields: {sorted(unknown)}")
    parts = [f"'{name}', cast({values.get(name, 'NULL')} as {kind})" for name, kind in fields]
    return f"named_struct({', '.join(parts)})"


def step(**values: str) -> str:
    return struct_of(STEP_FIELDS, values)


def header(**values: str) -> str:
    return struct_of(HEADER_FIELDS, values)


def call(tool_call_id: str, function_name: str, arguments: str, extra: str = "NULL") -> str:
    return (
        f"named_struct('tool_call_id', {tool_call_id}, 'function_name', {function_name}, "
        f"'arguments', {arguments}, 'extra', cast({extra} as string))"
    )


def result(source_call_id: str, content: str, extra: str = "NULL", text: str | None = None) -> str:
    return (
        f"named_struct('source_call_id', {source_call_id}, 'content', {content}, "
        f"'text', {text or content}, 'extra', cast({extra} as string))"
    )


def add(df: DataFrame, **columns: str) -> DataFrame:
    """Add columns given as SQL; later stages can then use them by name."""
    return df.withColumns({name: F.expr(sql) for name, sql in columns.items()})


def explode_events(docs: DataFrame, header_sql: str, events: str) -> DataFrame:
    """(path, line, e, header): one row per event and one row, line -1, with the header."""
    head = f"named_struct('line', bigint(-1), 'e', cast(NULL as variant), 'header', {header_sql})"
    rest = (
        f"transform({events}, (e, i) -> named_struct('line', bigint(i), 'e', e, "
        f"'header', cast(NULL as {HEADER})))"
    )
    return docs.selectExpr("path", f"inline(concat(array({head}), {rest}))")


def gather(placed: DataFrame, order: list[str], **aggregates: str) -> DataFrame:
    """Sessions from rows (path, header on one row, step or NULL, order columns)."""
    kept = f"if(step IS NOT NULL, struct({', '.join(order)}, step), NULL)"
    gathered = placed.groupBy("path").agg(
        F.expr("first(header, true)").alias("header"),
        F.expr(f"array_sort(collect_list({kept}))").alias("_placed"),
        *[F.expr(sql).alias(name) for name, sql in aggregates.items()],
    )
    return add(gathered, steps="transform(_placed, p -> p.step)").drop("_placed")


def finish(sessions: DataFrame) -> DataFrame:
    """Keep sessions that have steps."""
    return sessions.filter("header IS NOT NULL AND size(steps) > 0").select("path", "header", "steps")


def with_counter(counters: str, name: str, value: str) -> str:
    """Counter map with one more entry, if that is positive."""
    none = "cast(map() as map<string,bigint>)"
    return (
        f"if({value} > 0, map_concat(coalesce({counters}, {none}), map('{name}', bigint({value}))), "
        f"{counters})"
    )


def counts_of(values: str, prefix: str = "") -> str:
    """Counter entries of an array of strings."""
    return (
        f"transform(array_distinct({values}), v -> struct(concat('{prefix}', v) AS key, "
        f"bigint(size(filter({values}, x -> x = v))) AS value))"
    )


def counter_map(*entries: str) -> str:
    """Map of the positive counters; NULL when there is none."""
    positive = f"filter(concat({', '.join(entries)}), c -> c.value > 0)"
    return f"if(size({positive}) > 0, map_from_entries({positive}), NULL)"


def steps_of(sessions: DataFrame, key: str = "path") -> DataFrame:
    """Steps table: one row per step, numbered 1..N."""
    return sessions.selectExpr(f"{key} AS trace_id", "posexplode(steps) AS (_pos, _step)").selectExpr(
        "trace_id", "_pos + 1 AS step_id", "_step.*"
    )


def trajectories_of(sessions: DataFrame, key: str = "path") -> DataFrame:
    return sessions.selectExpr(f"{key} AS trace_id", "header.*")
