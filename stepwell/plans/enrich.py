"""The enrichment chain: signals, labels, events, recommendations, in that order.

Later passes see what earlier ones wrote: events may raise ``has_error``, and only
failed traces get recommendations.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepwell.operators import labels, signals
from stepwell.operators.render import prompt_facts, render_tail, searchable_text
from stepwell.operators.upserts import stale_only
from stepwell.plans.recommend import DEFAULT_K, recommend


@dataclass(frozen=True)
class Enriched:
    traces: DataFrame
    recommendations: DataFrame | None


def signal_pass(
    traces: DataFrame, trajectories: DataFrame, steps: DataFrame, force: bool = False
) -> DataFrame:
    """Compute the signals of traces that lack them and write them back."""
    due = signals.targets(traces, force).select(F.col("id").alias("trace_id"))
    found = signals.compute_signals(
        steps.join(due, "trace_id", "left_semi"), headers=trajectories
    )
    return signals.apply_signals(traces, found)


def enrich(
    traces: DataFrame,
    trajectories: DataFrame,
    steps: DataFrame,
    label_responses: DataFrame | None = None,
    event_responses: DataFrame | None = None,
    vectors: DataFrame | None = None,
    k: int = DEFAULT_K,
) -> Enriched:
    """Run the passes for which there is input."""
    traces = signal_pass(traces, trajectories, steps)
    if label_responses is not None:
        traces = labels.apply_labels(traces, label_responses)
    if event_responses is not None:
        traces = labels.apply_events(traces, event_responses)
    found = None if vectors is None else recommend(traces, vectors, k)
    return Enriched(traces, found)


def _facts(traces: DataFrame) -> DataFrame:
    return traces.filter("has_atif").select(
        F.col("id").alias("trace_id"),
        "agent_name",
        "model",
        "failure_label",
        "failure_label_reasoning",
    )


def texts_to_embed(
    traces: DataFrame, steps: DataFrame, vectors: DataFrame, model: str, force: bool = False
) -> DataFrame:
    """Search texts whose vector is missing or out of date."""
    texts = searchable_text(_facts(traces), steps)
    if force:
        return texts.withColumn("source_text_hash", F.sha2("text", 256))
    return stale_only(texts, vectors, model)


def prompts(
    traces: DataFrame, steps: DataFrame, with_index: bool = False, with_signals: bool = True
) -> DataFrame:
    """(trace_id, prompt): fact lines and conversation for an external scorer."""
    fired = None
    if with_signals:
        fired = traces.filter("signals IS NOT NULL").select(
            F.col("id").alias("trace_id"), "signals.*"
        )
    facts = prompt_facts(_facts(traces), steps, fired)
    body = render_tail(steps, with_index=with_index)
    return facts.join(body, "trace_id", "left").select(
        "trace_id",
        F.concat("facts", F.lit("\n\n"), F.coalesce("conversation", F.lit("(no steps)"))).alias(
            "prompt"
        ),
    )
