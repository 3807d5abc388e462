import pytest
from conftest import rows
from pyspark.sql import functions as F

from stepwell.functions import outcomes as O
from stepwell.operators import labels as L


def lists(spark, data):
    return spark.createDataFrame(list(enumerate(data)), f"i int, events {O.EVENT_SCHEMA}")


GOOD = ("loop", 1, 2, True, 2, "did it")
CASES = [
    ([], True), ([GOOD], True), ([("loop", 2, 2, False, None, None)], True),
    (None, False),
    ([("nope", 1, 2, False, None, None)], False),
    ([("loop", 0, 2, False, None, None)], False),
    ([("loop", 3, 2, False, None, None)], False),
    ([("loop", 1, None, False, None, None)], False),
    ([("loop", 1, 2, None, None, None)], False),
    ([("loop", 1, 3, True, 2, "early")], False),
    ([("loop", 1, 2, True, None, "x")], False),
    ([("loop", 1, 2, True, 2, " \n")], False),
    ([GOOD, ("nope", 1, 2, False, None, None)], False),
]


def test_validate_events(spark):
    df = lists(spark, [c[0] for c in CASES] + [[("loop", 1, 2, False, 9, "stray")]])
    got = rows(df.select("i", O.validate_events(F.col("events")).alias("e")), "i")
    assert [r["e"] is not None for r in got[:-1]] == [c[1] for c in CASES]
    assert got[-1]["e"][0]["recovery_step"] is None and got[-1]["e"][0]["recovery_summary"] is None


def event(label, recovered):
    return (label, 1, 1, recovered, 1 if recovered else None, "s" if recovered else None)


def test_summary_and_outcome(spark):
    data = [
        ([], None, "success", 1),
        ([event("loop", True)], None, "success", 1),
        ([event("loop", False), event("hallucinated_api", True)], None, "loop", 0),
        ([event(n, False) for n in reversed(O.SEVERITY)], None, O.SEVERITY[0], 0),
        ([event("loop", False)], 1, "loop", 1),
        ([], 0, "success", 0),
    ]
    df = spark.createDataFrame(
        [(i, e, x) for i, (e, x, _, _) in enumerate(data)], f"i int, events {O.EVENT_SCHEMA}, existing int"
    )
    got = rows(
        df.select("i", O.summary_label(F.col("events")).alias("l"), O.ultimately_succeeded(F.col("events"), F.col("existing")).alias("u")),
        "i",
    )
    assert [(r["l"], r["u"]) for r in got] == [(d[2], d[3]) for d in data]
    pairs = df.filter("existing IS NULL").select(F.col("i").cast("string").alias("trace_id"), F.inline("events"))
    by_row = {r["trace_id"]: (r["summary_label"], r["ultimately_succeeded"]) for r in rows(L.summarise_event_rows(pairs))}
    assert by_row == {"1": ("success", 1), "2": ("loop", 0), "3": (O.SEVERITY[0], 0)}


def test_outcome_classes_and_labels(spark):
    cases = {(0, 1): "Success", (1, 1): "Recovered failure", (1, 0): "Failed", (0, 0): "Subtle failure", (None, 1): "Unknown", (1, None): "Unknown"}
    df = spark.createDataFrame(list(cases), "e int, u int")
    for r in rows(df.select("*", O.outcome(F.col("e"), F.col("u")).alias("o"))):
        assert r["o"] == cases[(r["e"], r["u"])]
    dim = rows(O.label_table(spark), "position")
    assert [r["label"] for r in dim] == list(O.LABEL_NAMES)
    assert [r["label"] for r in sorted(dim, key=lambda r: r["severity"])] == list(O.SEVERITY)


def test_recoveries(spark):
    df = lists(spark, [[("loop", 1, 2, True, 3, "  ok "), ("loop", 1, 2, True, 3, " "), ("loop", 1, 2, False, None, None)], None])
    got = rows(df.select("i", O.recoveries(F.col("events")).alias("r")), "i")
    assert got[0]["r"] == [{"label": "loop", "summary": "ok", "recovery_step": 3}]
    assert got[1]["r"] == []


def test_cost(spark):
    df = spark.createDataFrame([(1_000_000, None, 10, 2_000_000)], "i long, w long, r long, o long")
    cost = O.cost_usd(
        {"input": F.col("i"), "cache_write": F.col("w"), "cache_read": F.col("r"), "output": F.col("o")},
        O.GENERATION_PRICES,
    )
    assert df.select(cost).first()[0] == pytest.approx(3 + 10 * 0.3e-6 + 30)


TRACES = "id string, has_error int, failure_label string, failure_label_reasoning string, failure_label_source string, ultimately_succeeded int, failure_events " + O.EVENT_SCHEMA


def test_apply_labels_and_events(spark):
    traces = spark.createDataFrame(
        [("a", 0, None, None, None, None, None), ("b", 1, "loop", "old", "x", 1, None), ("c", None, None, None, None, None, None)], TRACES
    )
    answers = spark.createDataFrame(
        [("a", "gave_up", " why "), ("b", "not_a_label", "r"), ("c", "loop", None)], "trace_id string, label string, reasoning string"
    )
    got = {r["id"]: r for r in rows(L.apply_labels(traces, answers))}
    assert (got["a"]["failure_label"], got["a"]["failure_label_reasoning"], got["a"]["failure_label_source"]) == ("gave_up", "why", "sonnet_judge")
    assert (got["b"]["failure_label"], got["b"]["failure_label_source"]) == ("loop", "x")
    assert got["c"]["failure_label"] is None

    responses = spark.createDataFrame(
        [("a", [event("loop", True)]), ("b", [event("misread_error", False)]), ("c", [])], f"trace_id string, events {O.EVENT_SCHEMA}"
    )
    got = {r["id"]: r for r in rows(L.apply_events(traces, responses))}
    assert [(got[i]["has_error"], got[i]["failure_label"], got[i]["ultimately_succeeded"]) for i in "abc"] == [
        (1, "success", 1), (1, "misread_error", 1), (None, "success", 1),
    ]
    assert all(r["failure_label_source"] == "opus_events_derived" for r in got.values())
    kept = {r["id"]: r["has_error"] for r in rows(L.apply_events(traces, responses, bump_has_error=False))}
    assert kept == {"a": 0, "b": 1, "c": None}
    bad = spark.createDataFrame([("a", [event("zzz", False)])], f"trace_id string, events {O.EVENT_SCHEMA}")
    assert {r["id"]: r["failure_events"] for r in rows(L.apply_events(traces, bad))}["a"] is None
    assert L.rejected_events(bad).count() == 1


def test_scorer_retries_and_isolates(spark):
    prompts = spark.createDataFrame([("a", "good"), ("b", "bad")], "trace_id string, prompt string").repartition(2, "trace_id")

    def scorer(batch):
        if (batch == "bad").any():
            raise RuntimeError("no")
        return batch.map(lambda p: '{"label": "loop", "reasoning": "r"}')

    got = {r["trace_id"]: r for r in rows(L.score(prompts, scorer, "label string, reasoning string"))}
    assert got["a"]["answer"] == {"label": "loop", "reasoning": "r"} and got["a"]["error"] is None
    assert got["b"]["answer"] is None and got["b"]["error"] == "RuntimeError: no" and got["b"]["attempts"] == 2
