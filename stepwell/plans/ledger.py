"""The enrichment chain with a ledger: a pass runs for a trace only when its input changed.

The ledger has one row per trace, pass and run with the hash of what the pass read: the text
of the trace, the answers given for it, its vector and the pool it was compared with.  A
trace is due for a pass when the newest ledger row for both has another hash, or there is
none.  A run writes the traces it touched, their recommendation lists and, last, its ledger rows, all
under its number; what a run left behind that broke off is not read and is written again.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stepwell.operators import labels, signals
from stepwell.operators.catalog import recovered_pool
from stepwell.operators.upserts import last_writer
from stepwell.plans.ingest import EMPTY_COLUMNS
from stepwell.plans.recommend import DEFAULT_K, recommend, recommendation_lists
from stepwell.plans.tables import read_or_none, write_batch
from stepwell.session import cut_lineage

LEDGER_SCHEMA = "trace_id string, pass string, input_hash string"
ENRICHED = [*(name for name, _ in EMPTY_COLUMNS), "has_error"]


@dataclass(frozen=True)
class Run:
    """All traces after the run, its new recommendation lists, and how many traces each pass touched."""

    number: int
    traces: DataFrame
    recommendations: DataFrame | None
    touched: dict[str, int]


def stale(inputs: DataFrame, name: str, ledger: DataFrame | None) -> DataFrame:
    """The (trace_id, input_hash) rows that the ledger does not have as the newest of the pass."""
    if ledger is None:
        return inputs
    newest = ledger.filter(F.col("pass") == name).groupBy("trace_id").agg(F.max_by("input_hash", "batch_id").alias("_seen"))
    return inputs.join(newest, "trace_id", "left").filter(~F.col("_seen").eqNullSafe(F.col("input_hash"))).drop("_seen")


def _hash(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("-")) for p in parts]), 256)


def _answered(traces: DataFrame, responses: DataFrame, *columns: str) -> DataFrame:
    """(trace_id, input_hash): the text of a trace and all answers for it, in any order."""
    each = responses.select("trace_id", F.xxhash64(F.to_json(F.struct(*columns))).cast("decimal(38,0)").alias("_h"))
    answers = each.distinct().groupBy("trace_id").agg(F.sum("_h").alias("_sum"), F.count("*").alias("_n"))
    texts = traces.select(F.col("id").alias("trace_id"), "raw_hash")
    return texts.join(answers, "trace_id").select("trace_id", _hash(F.col("raw_hash"), F.col("_sum"), F.col("_n")).alias("input_hash"))


def _carried(traces: DataFrame, known: DataFrame | None) -> DataFrame:
    """Traces with the enrichment of their last run, unless their text has changed since."""
    if known is None:
        return traces
    before = known.select("id", "raw_hash", F.struct(*ENRICHED).alias("_before"))
    joined = traces.join(before, ["id", "raw_hash"], "left")
    kept = {c: F.when(F.col("_before").isNotNull(), F.col(f"_before.{c}")).otherwise(F.col(c)) for c in ENRICHED}
    return joined.withColumns(kept).select(traces.columns)


def enrich_stale(
    spark: SparkSession,
    out: str,
    traces: DataFrame,
    trajectories: DataFrame | None,
    steps: DataFrame,
    label_responses: DataFrame | None = None,
    event_responses: DataFrame | None = None,
    vectors: DataFrame | None = None,
    k: int = DEFAULT_K,
    order: Sequence[Column | str] = ("label", "reasoning"),
) -> Run:
    """Run the chain below ``out`` for the traces whose inputs changed since the last run.

    ``traces`` are the ingested ones (id, raw_hash, has_atif, ...).  Passes follow each
    other: events may raise ``has_error``, and only failed traces get recommendations.
    A recommendation depends on the whole pool of recovered traces, so a changed pool makes all
    of them due.
    """
    ledger = read_or_none(spark, f"{out}/ledger")
    last = None if ledger is None else ledger.agg(F.max("batch_id")).first()[0]
    number = 0 if last is None else last + 1
    known = None
    if last is not None and (written := read_or_none(spark, f"{out}/enriched")) is not None:
        known = last_writer(written.filter(F.col("batch_id") <= last), "id", F.col("batch_id").desc())
    now = cut_lineage(_carried(traces, known))
    done: dict[str, DataFrame] = {}

    def due(name: str, inputs: DataFrame) -> DataFrame:
        done[name] = cut_lineage(stale(inputs, name, ledger))
        return done[name].select("trace_id")

    found = due("signals", now.filter("has_atif").select(F.col("id").alias("trace_id"), F.col("raw_hash").alias("input_hash")))
    now = signals.apply_signals(now, signals.compute_signals(steps.join(found, "trace_id", "left_semi"), headers=trajectories))
    if label_responses is not None:
        found = due("labels", _answered(now, label_responses, "label", "reasoning"))
        now = labels.apply_labels(now, label_responses.join(found, "trace_id", "left_semi"), order)
    if event_responses is not None:
        found = due("events", _answered(now, event_responses, "events"))
        now = labels.apply_events(now, event_responses.join(found, "trace_id", "left_semi"))
    now = cut_lineage(now)
    lists = None
    if vectors is not None:
        of_vector = vectors.select("trace_id", F.xxhash64("embedding").alias("_v"))
        pool = recovered_pool(now).select(F.col("id").alias("trace_id"), F.to_json("failure_events").alias("_e")).join(of_vector, "trace_id")
        shape = pool.agg(F.sum(F.xxhash64("trace_id", "_e", "_v").cast("decimal(38,0)")).alias("s"), F.count("*").alias("n")).first()
        failed = now.filter("has_error = 1").select(F.col("id").alias("trace_id")).join(of_vector, "trace_id")
        found = due("recommendations", failed.select("trace_id", _hash(F.col("_v"), F.lit(str(shape["s"])), F.lit(shape["n"]), F.lit(k)).alias("input_hash")))
        asked = now.join(found.select(F.col("trace_id").alias("id")), "id", "left_semi")
        lists = cut_lineage(recommendation_lists(asked, recommend(now, vectors, k, targets=found)))
        write_batch(lists, f"{out}/recommendations", number)
    rows = None
    for name, inputs in done.items():
        part = inputs.select("trace_id", F.lit(name).alias("pass"), "input_hash")
        rows = part if rows is None else rows.union(part)
    touched = rows.select(F.col("trace_id").alias("id")).distinct()
    write_batch(now.join(touched, "id", "left_semi"), f"{out}/enriched", number)
    write_batch(rows, f"{out}/ledger", number)
    return Run(number, now, lists, {name: inputs.count() for name, inputs in done.items()})
