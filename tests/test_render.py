import pytest
from conftest import rows, step, steps_frame
from pyspark.sql import functions as F

from stepwell.functions import text as T
from stepwell.operators import render as R

FACTS = "trace_id string, agent_name string, model string, failure_label string, failure_label_reasoning string"


def facts(spark, *data):
    return spark.createDataFrame(list(data), FACTS)


def one(df, column):
    [r] = df.collect()
    return r[column]


def test_text_helpers(spark):
    data = [("  a b  ", "a b"), ("\x1c\x85x　", "x"), ("", ""), (None, None)]
    df = spark.createDataFrame(data, "s string, want string")
    for r in rows(df.select("want", T.strip(F.col("s")).alias("got"))):
        assert r["got"] == r["want"]
    cut = spark.createDataFrame([("abcdef",), ("ab   def",), (" abcde ",)], "s string")
    assert [r[0] for r in cut.select(T.truncate(F.col("s"), 5)).collect()] == ["abcd…", "ab…", "abcde"]
    keys = spark.createDataFrame([("f", '{"a":1}'), (None, None)], "n string, a string")
    assert [r[0] for r in keys.select(T.call_key(F.col("n"), F.col("a"))).collect()] == ['tc::f::{"a":1}', "tc::::null"]
    marks = spark.createDataFrame([("[encrypted reasoning, 3 bytes]",), ("x [encrypted ",), (None,)], "s string")
    assert [r[0] for r in marks.select(T.is_encrypted(F.col("s"))).collect()] == [True, False, False]


def test_step_error_text(spark):
    frame = steps_frame(spark, {
        "a": [step("agent", "Error: m", None, ["fine", "KeyError", "ValueError"])],
        "b": [step("agent", "Error: m", None, ["fine"])],
        "c": [step("agent", "fine", [("f", '" Error:"')])],
    })
    got = {r["trace_id"]: r["e"] for r in rows(frame.select("trace_id", T.step_error_text(F.col("results"), F.col("message")).alias("e")))}
    assert got == {"a": "KeyError", "b": "Error: m", "c": None}


def test_searchable_text_full(spark):
    frame = steps_frame(spark, {"t": [
        step("system", "  fix it  "),
        step("agent", "look", [("bash", "{}"), ("grep", "{}"), ("", "{}")], ["out " * 50]),
        step("agent", "", [("bash", "{}")], [""]),
    ]})
    text = one(R.searchable_text(facts(spark, ("t", "mcp", None, " loop ", "because")), frame), "text")
    assert text == (
        "Agent: mcp\nModel: unknown\nStep count: 3\nTools used: bash, grep\nFailure label: loop\n"
        "Label reasoning: because\nTask: fix it\n\nConversation:\n"
        "1. [system] fix it\n"
        "2. [agent] look {bash, grep} -> " + ("out " * 50)[:139] + "…\n"
        "3. [agent] (no message) {bash}"
    )


def test_searchable_text_is_bounded(spark):
    frame = steps_frame(spark, {"t": [step("user", f"m{i} " + "x" * 300, [(f"f{i:02}", "{}")]) for i in range(30)]})
    df = R.searchable_text(facts(spark, ("t", "a", "m", None, None)), frame, cap=1500)
    text = one(df, "text")
    assert text.endswith("\n(... truncated ...)") and len(text) <= 1500
    assert "Tools used: " + ", ".join(f"f{i:02}" for i in range(20)) + "\n" in text
    assert "(... 18 earlier steps omitted ...)\n19. [user] m18" in text
    assert one(R.searchable_text(facts(spark, ("t", "a", "m", None, None)), frame, cap=300), "text").endswith("…")
    empty = one(R.searchable_text(facts(spark, ("none", "", None, None, None)), frame), "text")
    assert empty == "Agent: unknown\nModel: unknown\nStep count: 0\n\nConversation: (no steps)"


def test_render_tail(spark):
    frame = steps_frame(spark, {"t": [step("agent", f"m{i}", [("", "{}")], [""]) for i in range(4)]})
    assert one(R.render_tail(frame, tail=2), "conversation") == (
        "(... 2 earlier steps omitted ...)\n[agent] m2 {?} -> \n[agent] m3 {?} -> "
    )
    assert one(R.render_tail(frame, tail=3, with_index=True), "conversation") == (
        "(... 1 earlier steps omitted; visible steps start at step 2 ...)\n"
        "[step 2] [agent] m1 {?} -> \n[step 3] [agent] m2 {?} -> \n[step 4] [agent] m3 {?} -> "
    )
    long = one(R.render_tail(frame, tail=4, cap=60), "conversation")
    assert long == "[agent] m0\n(... truncated ...)"


def test_prompt_facts(spark):
    frame = steps_frame(spark, {"t": [step("agent", "m", [("a", "{}"), ("b", "{}")])]})
    signals = spark.createDataFrame([("t", True, False, True)], "trace_id string, zeta boolean, beta boolean, alpha boolean")
    text = one(R.prompt_facts(facts(spark, ("t", "mcp", None, None, None)), frame, signals), "facts")
    assert text == "- Agent: mcp   Model: unknown\n- Steps: 1    Tool calls: 2\n- Rule-based signals fired: alpha, zeta"


LONG = "We are solving this issue in our repository, and here is what is known about it.\nISSUE:\n\n  Wrong value  \nbody"
TITLES = {
    "user_wins": ([step("system", LONG), step("user", "\n do this \nnow")], "do this"),
    "system": ([step("system", "SETTING: " + "x" * 100), step("system", LONG), step("agent", "hm")], "Wrong value"),
    "short_system": ([step("system", "short"), step("agent", "first words")], "short"),
    "framing_skipped": ([step("system", "  You are a helpful " + "x" * 90), step("agent", "hello")], "hello"),
    "only_framing": ([step("system", "You are an AI " + "x" * 90)], None),
    "cut": ([step("user", "w" * 200)], "w" * 109 + "..."),
    "marker_last": ([step("user", "lead\nTASK:")], "lead"),
    "nothing": ([step("user", "  ")], None),
}


def test_task_title(spark):
    frame = steps_frame(spark, {k: v[0] for k, v in TITLES.items()})
    got = {r["trace_id"]: r["title"] for r in rows(R.task_title(frame))}
    assert got == {k: v[1] for k, v in TITLES.items() if v[1] is not None}


@pytest.mark.parametrize("n, shown, omitted", [(9, range(1, 10), 0), (10, range(1, 11), 0), (11, [1, 2, 8, 9, 10, 11], 5), (40, [1, 2, 37, 38, 39, 40], 34)])
def test_compact_thread(spark, n, shown, omitted):
    frame = steps_frame(spark, {"t": [step("agent", "m") for _ in range(n)]})
    got = rows(R.compact_thread(frame, limit=10, head=2, tail=4), "step_id")
    assert [r["step_id"] for r in got] == list(shown)
    assert {r["omitted"] for r in got} == {omitted}
