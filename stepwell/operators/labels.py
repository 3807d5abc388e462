"""Merging label and failure-event responses into the traces table."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepwell.functions import outcomes
from stepwell.functions.text import strip
from stepwell.operators.sequencing import first_per_key


def valid_labels(responses: DataFrame) -> DataFrame:
    """Responses (trace_id, label, reasoning) with a known label and a reasoning text."""
    return responses.filter(
        F.col("label").isin(*outcomes.LABEL_NAMES) & F.col("reasoning").isNotNull()
    ).withColumn("reasoning", strip(F.col("reasoning")))


def apply_labels(
    traces: DataFrame, responses: DataFrame, order: Sequence[Column | str] = ("label", "reasoning")
) -> DataFrame:
    """Write labels with their provenance; traces without a valid response stay as they are.

    Of several valid responses for one trace (a scorer that was run again) the first in
    ``order`` counts.
    """
    answers = first_per_key(valid_labels(responses), ["trace_id"], order).select(
        F.col("trace_id").alias("id"), F.col("label").alias("_l"), F.col("reasoning").alias("_r")
    )
    hit = F.col("_l").isNotNull()
    return (
        traces.join(answers, "id", "left")
        .withColumn(
            "failure_label_source",
            F.when(hit, F.lit(outcomes.FROM_JUDGE)).otherwise(F.col("failure_label_source")),
        )
        .withColumn("failure_label", F.coalesce("_l", "failure_label"))
        .withColumn("failure_label_reasoning", F.coalesce("_r", "failure_label_reasoning"))
        .drop("_l", "_r")
    )


def apply_events(
    traces: DataFrame,
    responses: DataFrame,
    bump_has_error: bool = True,
    order: Sequence[Column | str] | None = None,
) -> DataFrame:
    """Write failure events (trace_id, events) and what follows from them.

    A list with one bad event is dropped as a whole.  ``has_error`` rises to 1 when any
    event exists and never falls; a known outcome is kept.  Of several valid lists for one
    trace the first in ``order`` counts, by default in the order of their JSON texts.
    """
    valid = responses.withColumn("_e", outcomes.validate_events(F.col("events"))).filter(F.col("_e").isNotNull())
    first = first_per_key(valid, ["trace_id"], order or [F.to_json("_e")])
    answers = first.select(F.col("trace_id").alias("id"), "_e")
    hit = F.col("_e").isNotNull()
    raised = F.when(F.size("_e") > 0, F.lit(1)) if bump_has_error else F.lit(None).cast("int")
    return (
        traces.join(answers, "id", "left")
        .withColumn("failure_events", F.coalesce("_e", "failure_events"))
        .withColumn(
            "failure_label",
            F.when(hit, outcomes.summary_label(F.col("_e"))).otherwise(F.col("failure_label")),
        )
        .withColumn(
            "failure_label_source",
            F.when(hit, F.lit(outcomes.FROM_EVENTS)).otherwise(F.col("failure_label_source")),
        )
        .withColumn(
            "ultimately_succeeded",
            F.when(
                hit, outcomes.ultimately_succeeded(F.col("_e"), F.col("ultimately_succeeded"))
            ).otherwise(F.col("ultimately_succeeded")),
        )
        .withColumn("has_error", F.coalesce(F.when(hit, raised), F.col("has_error")))
        .drop("_e")
    )


def rejected_events(responses: DataFrame) -> DataFrame:
    return responses.filter(outcomes.validate_events(F.col("events")).isNull())


def summarise_event_rows(events: DataFrame) -> DataFrame:
    """Summary label and outcome per trace from one row per event.

    The same rules as for event lists, as mergeable aggregates: a trace with very many
    events is reduced on the map side.
    """
    rank = outcomes.severity(F.col("label"))
    worst = F.min(F.when(~F.col("recovered"), rank))
    names = F.array(*[F.lit(name) for name in outcomes.SEVERITY])
    return (
        events.groupBy("trace_id")
        .agg(
            F.count("*").alias("n_events"),
            F.sum(F.col("recovered").cast("long")).alias("n_recovered"),
            worst.alias("_worst"),
        )
        .select(
            "trace_id",
            "n_events",
            "n_recovered",
            F.coalesce(F.get(names, F.col("_worst")), F.lit("success")).alias("summary_label"),
            F.when(F.col("_worst").isNull(), 1).otherwise(0).alias("ultimately_succeeded"),
        )
    )


def score(
    prompts: DataFrame,
    scorer: Callable[[pd.Series], pd.Series],
    out_type: str,
    attempts: int = 2,
) -> DataFrame:
    """Run a caller's scorer over (trace_id, prompt) batches; failed batches are retried once.

    ``scorer`` maps a batch of prompts to a batch of JSON answers, read as ``out_type``.
    Rows of a batch that keeps failing get a NULL answer and an error text.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            answer, error = pd.Series([None] * len(batch), dtype=object), None
            for attempt in range(attempts):
                try:
                    answer, error = scorer(batch["prompt"]), None
                    break
                except Exception as exc:  # noqa: BLE001 - one bad batch must not fail the job
                    error = f"{type(exc).__name__}: {exc}"
            yield pd.DataFrame(
                {
                    "trace_id": batch["trace_id"].to_numpy(),
                    "answer_json": pd.Series(answer).to_numpy(),
                    "attempts": attempt + 1,
                    "error": error,
                }
            )

    raw = prompts.select("trace_id", "prompt").mapInPandas(
        run, "trace_id string, answer_json string, attempts int, error string"
    )
    return raw.withColumn("answer", F.from_json("answer_json", out_type)).drop("answer_json")
