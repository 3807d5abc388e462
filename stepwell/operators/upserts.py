"""Idempotent writes expressed as joins: last writer wins, known truth is kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepwell.functions import outcomes
from stepwell.operators.sequencing import first_per_key

ENRICHMENT_COLUMNS = (
    "signals",
    "failure_label",
    "failure_label_reasoning",
    "failure_label_source",
    "failure_events",
    "ultimately_succeeded",
)


def last_writer(batch: DataFrame, key: str, order: Column) -> DataFrame:
    """Newest row per key; map tasks keep one row per key, so copies do not pile up."""
    return first_per_key(batch, [key], [order])


def upsert(existing: DataFrame, batch: DataFrame, key: str, order: Column) -> DataFrame:
    """Rows of ``batch`` replace rows of ``existing`` with the same key.

    Of the rows that share a key in the batch the first in ``order`` is written.
    """
    newest = last_writer(batch, key, order)
    kept = existing.join(newest.select(key), key, "left_anti")
    return kept.unionByName(newest, allowMissingColumns=True)


def upsert_traces(
    existing: DataFrame, batch: DataFrame, order: Column, keep_enrichment: bool = False
) -> DataFrame:
    """Insert or replace traces by ``id``.

    A replaced trace loses its enrichment columns.  With ``keep_enrichment`` they stay
    when the raw text did not change (``raw_hash`` in both tables).
    """
    newest = last_writer(batch, "id", order)
    if keep_enrichment:
        old = existing.select(
            "id", F.col("raw_hash").alias("_hash"), *[F.col(c).alias(f"_{c}") for c in ENRICHMENT_COLUMNS]
        )
        newest = newest.join(old, "id", "left")
        same = F.col("_hash") == F.col("raw_hash")
        for column in ENRICHMENT_COLUMNS:
            newest = newest.withColumn(column, F.when(same, F.col(f"_{column}")))
        newest = newest.drop("_hash", *[f"_{c}" for c in ENRICHMENT_COLUMNS])
    return upsert(existing, newest, "id", order)


def drop_replaced(children: DataFrame, batch_ids: DataFrame, key: str = "trace_id") -> DataFrame:
    """Replacing a trace also removes its dependent rows (its embedding)."""
    return children.join(batch_ids.select(F.col("id").alias(key)).distinct(), key, "left_anti")


def upsert_embeddings(existing: DataFrame, batch: DataFrame, dim: int, order: Column) -> DataFrame:
    """Insert or replace vectors by ``trace_id``; a vector of another size fails the job.

    A batch with several vectors for one trace writes the first in ``order``.
    """
    right_size = F.assert_true(
        F.size("embedding") == dim, F.concat(F.lit(f"expected {dim} values, got "), F.size("embedding"))
    )
    checked = batch.filter(right_size.isNull())
    return upsert(existing, checked, "trace_id", order)


def backfill_label_source(traces: DataFrame) -> DataFrame:
    """Provenance of labels written before the column existed."""
    guess = F.when(
        F.col("failure_label").isNotNull(),
        F.when(F.col("source_format") == "swe_agent", outcomes.FROM_BENCHMARK).otherwise(
            outcomes.FROM_JUDGE
        ),
    )
    return traces.withColumn("failure_label_source", F.coalesce("failure_label_source", guess))


def outcome_violations(traces: DataFrame, target: Column) -> DataFrame:
    """Benchmark rows whose target is not a boolean or contradicts ``has_error``."""
    contradiction = (target.cast("int") != 1 - F.col("has_error")) & F.col("has_error").isNotNull()
    return traces.filter(
        (F.col("source_format") == "swe_agent")
        & F.col("ultimately_succeeded").isNull()
        & (target.isNull() | contradiction)
    )


def backfill_outcome(traces: DataFrame, target: Column) -> DataFrame:
    """Outcome of benchmark rows from their target; the job fails on a contradiction."""
    due = (F.col("source_format") == "swe_agent") & F.col("ultimately_succeeded").isNull()
    sound = target.isNotNull() & (
        F.col("has_error").isNull() | (target.cast("int") == 1 - F.col("has_error"))
    )
    value = F.when(F.coalesce(sound, F.lit(False)), target.cast("int")).otherwise(
        F.raise_error(F.concat(F.lit("target contradicts has_error for trace "), F.col("id"))).cast(
            "int"
        )
    )
    return traces.withColumn(
        "ultimately_succeeded", F.when(due, value).otherwise(F.col("ultimately_succeeded"))
    )


def stale_only(texts: DataFrame, embeddings: DataFrame, model: str) -> DataFrame:
    """Texts (trace_id, text) whose stored vector of this model is missing or out of date."""
    hashed = texts.withColumn("source_text_hash", F.sha2("text", 256))
    fresh = embeddings.filter(F.col("model") == model).select("trace_id", "source_text_hash")
    return hashed.join(fresh, ["trace_id", "source_text_hash"], "left_anti")


def unstaged_only(files: DataFrame, staged: DataFrame) -> DataFrame:
    """Files (path, size, mtime) that are new or changed; times compare by whole seconds."""
    stamp = F.unix_seconds(F.col("mtime").cast("timestamp"))
    seen = staged.select("path", "size", stamp.alias("_seconds"))
    return (
        files.withColumn("_seconds", stamp)
        .join(seen, ["path", "size", "_seconds"], "left_anti")
        .drop("_seconds")
    )
