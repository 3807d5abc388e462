from datetime import datetime

import pytest
from conftest import rows
from pyspark.sql import functions as F

from stepwell.functions.outcomes import EVENT_SCHEMA
from stepwell.operators import upserts as U
from stepwell.plans import tables

T = f"id string, raw_hash string, at int, signals string, failure_label string, failure_label_reasoning string, failure_label_source string, failure_events {EVENT_SCHEMA}, ultimately_succeeded int"


def test_upsert_resets_or_keeps_enrichment(spark):
    old = spark.createDataFrame([("a", "h1", 0, "s", "loop", "r", "x", None, 1), ("b", "h2", 0, "s", None, None, None, None, None)], T)
    new = spark.createDataFrame(
        [("a", "h1", 1, None, None, None, None, None, None), ("a", "h0", 0, None, None, None, None, None, None), ("c", "h3", 1, None, None, None, None, None, None)], T
    )
    got = rows(U.upsert_traces(old, new, F.col("at").desc()), "id")
    assert [(r["id"], r["at"], r["failure_label"]) for r in got] == [("a", 1, None), ("b", 0, None), ("c", 1, None)]
    kept = rows(U.upsert_traces(old, new, F.col("at").desc(), keep_enrichment=True), "id")
    assert kept[0]["failure_label"] == "loop" and kept[0]["ultimately_succeeded"] == 1
    again = U.upsert_traces(U.upsert_traces(old, new, F.col("at").desc()), new, F.col("at").desc())
    assert again.count() == 3


def test_embedding_upsert_checks_the_size(spark):
    v = "trace_id string, embedding array<float>, model string"
    old = spark.createDataFrame([("a", [1.0, 2.0], "m"), ("b", [1.0, 2.0], "m")], v)
    new = spark.createDataFrame([("a", [3.0, 4.0], "m")], v)
    assert [r["embedding"] for r in rows(U.upsert_embeddings(old, new.union(new), 2, F.col("model")), "trace_id")] == [[3.0, 4.0], [1.0, 2.0]]
    with pytest.raises(Exception, match="expected 3 values"):
        U.upsert_embeddings(old, new, 3, F.col("model")).collect()
    gone = spark.createDataFrame([("a",)], "id string")
    assert [r["trace_id"] for r in U.drop_replaced(old, gone).collect()] == ["b"]


def test_backfills(spark):
    traces = spark.createDataFrame(
        [("a", "swe_agent", "loop", None, 1, None, False), ("b", "codex", "loop", None, None, None, None), ("c", "codex", None, None, None, None, None), ("d", "codex", "loop", "kept", None, 0, None)],
        "id string, source_format string, failure_label string, failure_label_source string, has_error int, ultimately_succeeded int, target boolean",
    )
    got = [r["failure_label_source"] for r in rows(U.backfill_label_source(traces), "id")]
    assert got == ["swe_agent_target", "sonnet_judge", None, "kept"]
    filled = U.backfill_outcome(traces, F.col("target"))
    assert [r["ultimately_succeeded"] for r in rows(filled, "id")] == [0, None, None, 0]
    assert rows(U.backfill_outcome(filled, F.col("target")), "id") == rows(filled, "id")
    assert U.outcome_violations(traces, F.col("target")).count() == 0
    for wrong in (F.lit(True), F.lit(None).cast("boolean")):
        assert [r["id"] for r in U.outcome_violations(traces, wrong).collect()] == ["a"]
        with pytest.raises(Exception, match="target contradicts has_error for trace a"):
            U.backfill_outcome(traces, wrong).collect()


def test_stale_and_unstaged(spark):
    texts = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "z")], "trace_id string, text string")
    stored = texts.filter("trace_id <> 'c'").selectExpr(
        "trace_id", "if(trace_id = 'a', sha2(text, 256), 'old') AS source_text_hash", "'m' AS model"
    )
    assert [r["trace_id"] for r in rows(U.stale_only(texts, stored, "m"), "trace_id")] == ["b", "c"]
    assert U.stale_only(texts, stored, "other").count() == 3
    at = lambda ms: datetime(2024, 1, 1, 0, 0, 1, ms * 1000)
    f = "path string, size long, mtime timestamp"
    files = spark.createDataFrame([("p", 1, at(900)), ("q", 1, at(0)), ("r", 1, at(0))], f)
    staged = spark.createDataFrame([("p", 1, at(100)), ("q", 2, at(0))], f)
    assert [r["path"] for r in rows(U.unstaged_only(files, staged), "path")] == ["q", "r"]


def test_batches(spark, folder):
    one = spark.createDataFrame([("a", 1), ("b", 1)], "id string, v int")
    two = spark.createDataFrame([("a", 2, "x")], "id string, v int, extra string")
    tables.write_batch(one, f"{folder}/t", 0)
    for _ in range(2):  # a repeated batch replaces itself
        tables.write_batch(two, f"{folder}/t", 1)
    now = rows(tables.current(spark, f"{folder}/t"), "id")
    assert now == [{"id": "a", "v": 2, "extra": "x"}, {"id": "b", "v": 1, "extra": None}]
    for batch, kept in ((0, ["a", "b"]), (1, ["a"])):
        children = spark.createDataFrame([(t, batch) for t in kept], "trace_id string, w int")
        tables.write_batch(children, f"{folder}/c", batch)
    left = rows(tables.current_children(spark, f"{folder}/c", f"{folder}/t"), "trace_id")
    assert left == [{"trace_id": "a", "w": 1}, {"trace_id": "b", "w": 0}]
    tables.compact(spark, f"{folder}/t", f"{folder}/t2")
    assert rows(tables.current(spark, f"{folder}/t2"), "id") == now
