"""The enrichment chain runs stale passes only."""

import pytest
from conftest import STEP_SCHEMA, step

from stepwell.functions.outcomes import EVENT_SCHEMA
from stepwell.plans import ledger as L
from stepwell.plans.ingest import EMPTY_COLUMNS
from stepwell.plans.tables import read_batches


def tables(spark, texts, answers=(), labels=()):
    empty = [f"cast(NULL as {kind}) AS {name}" for name, kind in EMPTY_COLUMNS]
    traces = spark.createDataFrame(list(texts.items()), "id string, raw_hash string").selectExpr(
        "id", "raw_hash", "raw_hash <> 'broken' AS has_atif", "'codex' AS source_format", "'a' AS agent_name", "cast(NULL as int) AS has_error", *empty
    )
    rows = [(i, n + 1, *step("agent", m)) for i, t in texts.items() if t != "broken" for n, m in enumerate(t.split())]
    steps = spark.createDataFrame(rows, STEP_SCHEMA)
    events = spark.createDataFrame([(i, [(label, 1, 1, done, 2, "went on")]) for i, label, done in answers], f"trace_id string, events {EVENT_SCHEMA}")
    given = spark.createDataFrame(list(labels), "trace_id string, label string, reasoning string")
    return traces, steps, events, given


def test_only_changed_inputs_run_again(spark, folder):
    vectors = spark.createDataFrame([(i, [float(n), 1.0]) for n, i in enumerate("abcd")], "trace_id string, embedding array<double>")

    def run(texts, answers, labels=()):
        traces, steps, events, given = tables(spark, texts, answers, labels)
        return L.enrich_stale(spark, folder, traces, None, steps, given, events, vectors, k=2)

    texts = {"a": "x y", "b": "x", "c": "z", "x": "broken"}
    answers = [("a", "loop", True), ("b", "gave_up", False)]
    first = run(texts, answers, [("c", "loop", "why")])
    assert first.number == 0 and first.touched == {"signals": 3, "labels": 1, "events": 2, "recommendations": 2}
    got = {r["id"]: (r["failure_label"], r["has_error"]) for r in first.traces.collect()}
    assert got == {"a": ("success", 1), "b": ("gave_up", 1), "c": ("loop", 0), "x": (None, None)}
    assert {r["trace_id"]: [x["hit_id"] for x in r["recommendations"]] for r in first.recommendations.collect()} == {"a": [], "b": ["a"]}
    # nothing new: nothing runs, and what was found stays
    second = run(texts, answers, [("c", "loop", "why"), ("c", "loop", "why")])
    assert set(second.touched.values()) == {0}
    assert {r["id"]: (r["failure_label"], r["has_error"]) for r in second.traces.collect()} == got
    # a changed text, a changed answer (and with it the pool), a new trace
    third = run(texts | {"c": "z z", "d": "new"}, [("a", "loop", False), *answers[1:]], [("c", "loop", "why")])
    assert third.touched == {"signals": 2, "labels": 1, "events": 1, "recommendations": 2}
    assert {r["id"]: r["failure_label"] for r in third.traces.collect()}["a"] == "loop"
    assert {r["trace_id"]: r["recommendations"] for r in third.recommendations.collect()} == {"a": [], "b": []}


def test_a_run_that_breaks_off_is_repeated(spark, folder, monkeypatch):
    texts = {"a": "x y", "b": "x"}

    def run():
        traces, steps, events, _ = tables(spark, texts, [("a", "loop", True)])
        return L.enrich_stale(spark, folder, traces, None, steps, event_responses=events)

    real = L.write_batch

    def breaks(df, path, number):
        if path.endswith("/ledger"):
            raise RuntimeError("lost")
        real(df, path, number)

    monkeypatch.setattr(L, "write_batch", breaks)
    with pytest.raises(RuntimeError, match="lost"):
        run()
    monkeypatch.setattr(L, "write_batch", real)
    again = run()
    assert again.number == 0 and again.touched == {"signals": 2, "events": 1}
    assert read_batches(spark, f"{folder}/enriched").count() == 2
