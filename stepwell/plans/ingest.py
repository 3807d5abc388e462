"""Batch ingest: detect, normalise, key, derive, upsert."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepwell.functions import variants as V
from stepwell.functions.outcomes import EVENT_SCHEMA
from stepwell.session import cut_lineage
from stepwell.sources import sessions as S
from stepwell.sources.detect import detect_format, known_id, raw_identity
from stepwell.sources.registry import normalize_all

SIGNALS_SCHEMA = (
    "struct<hit_max_turns:boolean,repeated_tool_call_loop:boolean,ended_on_error:boolean,"
    "abandonment:boolean,incomplete_session:boolean>"
)
# enrichment columns start out empty and are filled by later passes
EMPTY_COLUMNS = (
    ("signals", SIGNALS_SCHEMA),
    ("failure_label", "string"),
    ("failure_label_reasoning", "string"),
    ("failure_label_source", "string"),
    ("failure_events", EVENT_SCHEMA),
    ("ultimately_succeeded", "int"),
)

# Bounds of the quality gate.
MIN_STEPS, MAX_STEPS = 5, 200

# narrow rows of a run (ids, counts, hashes: a few hundred bytes each) that are broadcast to
# where the texts lie; more are joined by a shuffle of both sides
NARROW_ROWS = 500_000

TOOL_CALLS = "aggregate(steps, 0, (n, s) -> n + coalesce(size(s.tool_calls), 0))"


@dataclass(frozen=True)
class Ingested:
    """Tables of one ingest run, all keyed by trace id."""

    traces: DataFrame
    trajectories: DataFrame
    steps: DataFrame


def redact_steps(sessions: DataFrame, redact: Callable[[Column], Column]) -> DataFrame:
    """Apply a text rule to messages and call arguments."""
    return sessions.withColumn(
        "steps",
        F.transform(
            "steps",
            lambda s: s.withField("message", redact(s["message"])).withField(
                "tool_calls",
                F.transform(
                    s["tool_calls"], lambda c: c.withField("arguments", redact(c["arguments"]))
                ),
            ),
        ),
    )


def ingest(
    raw: DataFrame,
    bronze: str | None = None,
    redact: Callable[[Column], Column] | None = None,
    ingested_at: Column | None = None,
) -> Ingested:
    """Raw files (path, file_name, raw_blob[, mtime]) to the trace tables.

    Every file becomes a trace row that keeps its raw text; files that no normaliser can
    use have no steps.  Of files with the same trace id the newest wins.

    The raw texts are written once, with all that is read off them (format, id in the text,
    hash), partitioned by format, so that each normaliser reads its own files only; the
    sessions are written once because three tables read them.  Ids, winners and counts are
    settled on narrow columns.  Only then every text is read again, where it was written, and
    gets the columns of its trace by path and hash: no text is shuffled for up to
    ``NARROW_ROWS`` files a run.  Without a ``bronze`` folder the texts go to the checkpoint folder.
    """
    read_off = {"source_format": detect_format(), "raw_id": raw_identity(), "raw_hash": F.sha2("raw_blob", 256)}
    detected = raw.withColumns(read_off)
    if bronze is None:
        detected = cut_lineage(detected)
    else:
        detected.write.mode("overwrite").partitionBy("source_format").parquet(bronze)
        detected = raw.sparkSession.read.schema(detected.schema).parquet(bronze)
    # a handful of names: the formats that occur in this run
    present = {r["source_format"] for r in detected.select("source_format").distinct().collect()}
    sessions = normalize_all(detected, only=present)
    if redact is not None:
        sessions = redact_steps(sessions, redact)
    sessions = cut_lineage(sessions)
    facts = sessions.select(
        "path",
        "header.trajectory_id",
        "header.session_id",
        "header.agent_name",
        "header.model",
        "header.resolved",
        "header.synthetic_failure_mode",
        F.size("steps").alias("num_steps"),
        F.expr(TOOL_CALLS).alias("num_tool_calls"),
        F.lit(True).alias("_normalised"),
    )
    order = F.col("mtime") if "mtime" in raw.columns else F.lit(None).cast("timestamp")
    narrow = detected.select("path", "file_name", "source_format", "raw_id", "raw_hash", order.alias("_mtime"))
    keyed = narrow.join(facts, "path", "left").withColumn("id", known_id())
    # the newest file per id
    winners = keyed.groupBy("id").agg(F.max(F.struct("_mtime", "path")).alias("_newest")).select("_newest.path")
    newest = cut_lineage(keyed.join(winners, "path", "left_semi").drop("_mtime", "file_name", "raw_id"))
    small = newest.count() <= NARROW_ROWS
    beside = F.broadcast if small else (lambda rows: rows)
    # the format is known to the narrow side only, so that the scan of the texts stays one scan
    texts = detected.select("path", "raw_hash", "raw_blob")
    traces = texts.join(beside(newest), ["path", "raw_hash"]).select(
        "id",
        "path",
        "source_format",
        "raw_blob",
        "raw_hash",
        F.coalesce("_normalised", F.lit(False)).alias("has_atif"),
        (F.current_timestamp() if ingested_at is None else ingested_at).alias("ingested_at"),
        "agent_name",
        "model",
        "num_steps",
        "num_tool_calls",
        F.when(F.col("resolved").isNotNull(), (~F.col("resolved")).cast("int")).alias("has_error"),
        "synthetic_failure_mode",
        *[F.lit(None).cast(kind).alias(name) for name, kind in EMPTY_COLUMNS],
    )
    keys = newest.filter("_normalised").select("path", F.col("id").alias("_id"))
    kept = sessions.join(beside(keys), "path")
    return Ingested(traces, S.trajectories_of(kept, "_id"), S.steps_of(kept, "_id"))


def quality_gate(
    raw: DataFrame, sessions: DataFrame, low: int = MIN_STEPS, high: int = MAX_STEPS
) -> DataFrame:
    """(path, ok, error): is a generated session fit to keep, and if not, why."""
    counts = sessions.selectExpr("path", "size(steps) AS _n", f"{TOOL_CALLS} AS _calls")
    error = f"""CASE
        WHEN {V.is_blank('raw_blob')} THEN 'empty raw_text from model'
        WHEN _n IS NULL THEN 'adapter returned None'
        WHEN _n < {low} THEN concat('too few steps (', _n, ' < {low})')
        WHEN _n > {high} THEN concat('too many steps (', _n, ' > {high})')
        WHEN _calls < 1 THEN 'no tool calls in trajectory (degenerate)'
        ELSE '' END"""
    return (
        raw.join(counts, "path", "left")
        .selectExpr("path", f"{error} AS error")
        .select("path", (F.col("error") == "").alias("ok"), "error")
    )
