import pytest
from conftest import rows, step, steps_frame
from pyspark.sql import functions as F

from stepwell.functions import text as T
from stepwell.operators import signals as S

AGENT, SYSTEM = "agent", "system"
LS = [("bash", '{"cmd":"ls"}')]


def call(args="ls"):
    return step(AGENT, "go", [("bash", f'{{"cmd":"{args}"}}')], ["ok"])


TRACES = {
    "short": [step("user", "hi"), step(AGENT, "done")],
    "49": [step(AGENT, str(i)) for i in range(49)],
    "50": [step(AGENT, str(i)) for i in range(50)],
    "loop5": [call() for _ in range(5)],
    "loop4": [call() for _ in range(4)] + [call("pwd")] + [call() for _ in range(4)],
    "loop_broken_by_silence": [call(), call(), call(), step(AGENT, "  "), call(), call()],
    # the system reply repeats while the agent rephrases
    "loop_system": [s for i in range(5) for s in (step(AGENT, f"try {i}"), step(SYSTEM, "Bad edit"))],
    "loop_user_ignored": [step("user", "same") for _ in range(6)],
    # "agent" and "assistant" count separately
    "loop_two_sources": [step("agent", "x"), step("assistant", "x")] * 3,
    "loop_case": [step(AGENT, "  Same " + "y" * 130 + str(i)) for i in range(5)],
    "error_last": [step("user", "q"), step(AGENT, "run", LS, ["Traceback (most recent call last)\n..."])],
    "error_recovered": [step(AGENT, "run", LS, ["KeyError: 1"]), step(AGENT, "fixed it")],
    "error_too_early": [step(SYSTEM, "Error: x")] + [step("user", "a")] * 3,
    "error_in_tail_user_after": [step(AGENT, "a"), step(SYSTEM, "exit code 3"), step("user", "hm")],
    "error_inside_word": [step(SYSTEM, "MyTypeError raised")],
    "error_zero_exit": [step(SYSTEM, "exit code 0")],
    "error_lower": [step(SYSTEM, "all\ncommand FAILED")],
    "error_in_arguments": [step(AGENT, "a", [("bash", '{"x":" Error: "}')], ["fine"])],
    "gave_up": [step(AGENT, "I cannot do this")],
    "gave_up_curly": [step(AGENT, "Sorry, I can’t")],
    "gave_up_then_went_on": [step(AGENT, "I cannot read it"), step(AGENT, "found another way")],
    "gave_up_by_user": [step(AGENT, "fine"), step("user", "unable to complete")],
    "gave_up_blank_after": [step(AGENT, "unable to complete"), step(AGENT, "  ")],
    "open_call": [step("user", "q"), step(AGENT, "run", LS)],
    "open_call_talk_after": [step(AGENT, "run", LS), step("user", "and?")],
    "closed_later": [step(AGENT, "run", LS), step(SYSTEM, "", None, ["out"])],
    "only_old_result": [call(), step(AGENT, "again", LS)],
    "call_by_user": [step("user", "run", LS)],
}


@pytest.fixture(scope="module")
def found(spark):
    frame = steps_frame(spark, TRACES)
    return {r["trace_id"]: r for r in rows(S.compute_signals(frame))}


@pytest.mark.parametrize(
    "signal, firing",
    [
        ("hit_max_turns", {"50"}),
        ("repeated_tool_call_loop", {"loop5", "loop_system", "loop_case"}),
        ("ended_on_error", {"error_last", "error_in_tail_user_after", "error_lower"}),
        ("abandonment", {"gave_up", "gave_up_curly", "gave_up_blank_after"}),
        ("incomplete_session", {"open_call", "open_call_talk_after", "only_old_result"}),
    ],
)
def test_signal(found, signal, firing):
    assert {t for t, r in found.items() if r[signal]} == firing


def test_any_signal_and_every_trace_present(found):
    assert set(found) == set(TRACES)
    for r in found.values():
        assert r["any_signal"] == any(r[n] for n in S.SIGNAL_NAMES)


@pytest.mark.parametrize("width", [1, 2, 3, 7])
def test_chunks_do_not_change_the_result(spark, found, width):
    frame = steps_frame(spark, TRACES)
    chunk = F.floor((F.col("step_id") - 1) / width)
    again = {r["trace_id"]: r for r in rows(S.compute_signals(frame, chunk=chunk))}
    assert again == found


def test_single_signals_agree_with_the_whole_set(spark, found):
    frame = steps_frame(spark, TRACES)
    for name in S.SIGNAL_NAMES:
        one = {r["trace_id"]: r[name] for r in rows(S.compute_signals(frame, names=[name]))}
        assert one == {t: r[name] for t, r in found.items()}


def test_exit_status_counts_as_error(spark):
    frame = steps_frame(spark, {"a": [step(AGENT, "x")], "b": [step(AGENT, "x")]})
    heads = spark.createDataFrame(
        [("a", "submitted (exit_context)"), ("b", None)], "trace_id string, exit_status string"
    )
    got = {r["trace_id"]: r["ended_on_error"] for r in rows(S.compute_signals(frame, headers=heads))}
    assert got == {"a": True, "b": False}


def test_thresholds_and_extra_signal(spark):
    frame = steps_frame(spark, {"a": [call(), call(), call()]})
    S.register_signal("tiny", lambda p: F.col("n_steps") <= p["tiny"])
    try:
        [r] = rows(S.compute_signals(frame, loop_repeat=3, max_turns=3, tiny=3))
    finally:
        del S.SIGNALS["tiny"]
    assert r["repeated_tool_call_loop"] and r["hit_max_turns"] and r["tiny"]


def traces_frame(spark, data):
    kind = "struct<" + ",".join(f"{n}:boolean" for n in S.SIGNAL_NAMES) + ">"
    return spark.createDataFrame(data, f"id string, has_atif boolean, has_error int, signals {kind}")


def test_known_outcome_is_kept(spark, found):
    frame = steps_frame(spark, {k: TRACES[k] for k in ("short", "open_call", "gave_up")})
    traces = traces_frame(
        spark,
        [("short", True, None, None), ("open_call", True, 0, None), ("gave_up", True, None, None), ("raw", False, None, None)],
    )
    signals = S.compute_signals(frame)
    written = {r["id"]: r for r in rows(S.apply_signals(traces, signals))}
    assert {k: r["has_error"] for k, r in written.items()} == {
        "short": 0, "open_call": 0, "gave_up": 1, "raw": None,
    }
    assert written["open_call"]["signals"]["incomplete_session"]
    [summary] = rows(S.detect_summary(traces, signals))
    assert (summary["processed"], summary["any_fired"], summary["new_flips"]) == (3, 2, 1)


def test_targets(spark):
    done = (True,) * 5
    traces = traces_frame(spark, [("a", True, 1, done), ("b", True, None, None), ("c", False, None, None)])
    assert [r["id"] for r in rows(S.targets(traces), "id")] == ["b"]
    assert [r["id"] for r in rows(S.targets(traces, force=True), "id")] == ["a", "b"]


def test_words_end_where_sql_ends_them(spark):
    import duckdb

    pattern = r"(?i)\b(the|les?|der|los)\b"
    texts = ["le\u00ea on", "quer\u00e9le", "los\u00f1ga", "LE\u017f x", "eles", "x le.", "le_", "le1", "\u00e9the\u00e9"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = [r[0] for r in df.select(F.col("text").rlike(T.sql_pattern(pattern))).collect()]
    assert got == [duckdb.execute("SELECT regexp_matches(?, ?)", [t, pattern]).fetchone()[0] for t in texts]
