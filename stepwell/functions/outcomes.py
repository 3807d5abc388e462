"""Labels, failure events, outcomes and costs: vocabularies and row-level rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stepwell.functions.text import strip

# The failure labels in declared order, with their descriptions.
LABELS = (
    ("loop", "Same tool call repeated N+ times in a row with no progress."),
    ("tool_spamming", "Many tool calls with low signal-to-noise; agent thrashes."),
    ("gave_up", "Agent explicitly abandoned the task with give-up language."),
    ("incomplete", "Session ended mid-action (pending tool call, truncated output)."),
    ("wrong_approach", "Agent pursued an incorrect plan that would never succeed."),
    ("hallucinated_api", "Agent invented a function / file / library that does not exist."),
    ("misread_error", "Agent misinterpreted an error message and acted on the wrong cause."),
    ("environment_issue", "Tool / network / setup failure outside the agent's control."),
    ("success", "Task completed correctly."),
    ("partial_success", "Some progress made but the task was not fully completed."),
    ("unclear", "The trace does not carry enough signal to classify."),
)
LABEL_NAMES = tuple(name for name, _ in LABELS)

# Labels from most to least severe.
SEVERITY = (
    "hallucinated_api",
    "misread_error",
    "wrong_approach",
    "gave_up",
    "tool_spamming",
    "loop",
    "environment_issue",
    "incomplete",
    "partial_success",
    "unclear",
    "success",
)

# The source formats a structured query may name.
SOURCE_FORMATS = ("atif", "claude_code", "codex", "cursor", "swe_agent")

# Provenance of a label.
FROM_BENCHMARK = "swe_agent_target"
FROM_JUDGE = "sonnet_judge"
FROM_EVENTS = "opus_events_derived"

EVENT_SCHEMA = (
    "array<struct<label:string,step_start:int,step_end:int,recovered:boolean,"
    "recovery_step:int,recovery_summary:string>>"
)

# Prices in USD per million tokens.
GENERATION_PRICES = {"input": 3.00, "cache_write": 3.75, "cache_read": 0.30, "output": 15.00}
JUDGE_PRICES = {"input": 3.00, "output": 15.00}
EVENT_PRICES = {"input": 15.00, "output": 75.00}


def label_table(spark: SparkSession) -> DataFrame:
    """The label dimension: one row per label, with declared position and severity rank."""
    rows = ", ".join(
        f'("{name}", "{text}", {i}, {SEVERITY.index(name)})' for i, (name, text) in enumerate(LABELS)
    )
    return spark.sql(f"SELECT * FROM VALUES {rows} AS labels(label, description, position, severity)")


def severity(label: Column) -> Column:
    """0 for the most severe label; unknown labels rank after all known ones."""
    table = F.create_map(*[F.lit(x) for i, name in enumerate(SEVERITY) for x in (name, i)])
    return F.coalesce(F.try_element_at(table, label), F.lit(len(SEVERITY)))


def outcome(has_error: Column, succeeded: Column) -> Column:
    """Outcome class of a trace from its process flag and its result flag."""
    return (
        F.when((has_error == 0) & (succeeded == 1), "Success")
        .when((has_error == 1) & (succeeded == 1), "Recovered failure")
        .when((has_error == 1) & (succeeded == 0), "Failed")
        .when((has_error == 0) & (succeeded == 0), "Subtle failure")
        .otherwise("Unknown")
    )


def event_is_valid(e: Column) -> Column:
    """The contract of one failure event."""
    recovered_ok = (e["recovery_step"] >= e["step_end"]) & (
        strip(e["recovery_summary"]) != ""
    )
    return F.coalesce(
        e["label"].isin(*LABEL_NAMES)
        & (e["step_start"] >= 1)
        & (e["step_end"] >= e["step_start"])
        & e["recovered"].isNotNull()
        & (~e["recovered"] | recovered_ok),
        F.lit(False),
    )


def validate_events(events: Column) -> Column:
    """Clean event list, or NULL when the list is missing or one event breaks the contract."""
    clean = F.transform(
        events,
        lambda e: F.struct(
            e["label"].alias("label"),
            e["step_start"].alias("step_start"),
            e["step_end"].alias("step_end"),
            e["recovered"].alias("recovered"),
            F.when(e["recovered"], e["recovery_step"]).alias("recovery_step"),
            F.when(e["recovered"], e["recovery_summary"]).alias("recovery_summary"),
        ),
    )
    return F.when(events.isNotNull() & F.forall(events, event_is_valid), clean)


def has_unrecovered(events: Column) -> Column:
    return F.coalesce(F.exists(events, lambda e: ~e["recovered"]), F.lit(False))


def has_recovered(events: Column) -> Column:
    return F.coalesce(F.exists(events, lambda e: e["recovered"]), F.lit(False))


def summary_label(events: Column) -> Column:
    """Most severe unrecovered label; ``success`` when nothing is left open."""
    ranked = F.array_sort(
        F.transform(
            F.filter(events, lambda e: ~e["recovered"]),
            lambda e: F.struct(severity(e["label"]).alias("rank"), e["label"].alias("label")),
        )
    )
    return F.coalesce(F.get(ranked, F.lit(0))["label"], F.lit("success"))


def ultimately_succeeded(events: Column, existing: Column) -> Column:
    """Known outcome first; else 0 when a failure stayed open, 1 otherwise."""
    return F.coalesce(existing, F.when(has_unrecovered(events), F.lit(0)).otherwise(F.lit(1)))


def recoveries(events: Column) -> Column:
    """``{label, summary, recovery_step}`` of the recovered events that say how."""
    usable = F.filter(
        events,
        lambda e: F.coalesce(e["recovered"] & (strip(e["recovery_summary"]) != ""), F.lit(False)),
    )
    return F.coalesce(
        F.transform(
            usable,
            lambda e: F.struct(
                e["label"].alias("label"),
                strip(e["recovery_summary"]).alias("summary"),
                e["recovery_step"].alias("recovery_step"),
            ),
        ),
        F.array().cast("array<struct<label:string,summary:string,recovery_step:int>>"),
    )


def cost_usd(tokens: dict[str, Column], prices: dict[str, float]) -> Column:
    """Dollar cost of token counts at per-million prices; missing counts are free."""
    total = F.lit(0.0)
    for name, price in prices.items():
        if name in tokens:
            total = total + F.coalesce(tokens[name], F.lit(0)) * F.lit(price)
    return total / F.lit(1_000_000)
