"""Normalisers on small hand-written files."""

import json

import pytest
from conftest import rows

from stepwell.sources import claude_code, codex, cursor, native, swe_agent
from stepwell.sources import sessions as S
from stepwell.sources.registry import FORMATS, normalize_all, register_format


def raw(spark, files):
    data = [
        (name, name, text if isinstance(text, str) else json.dumps(text)) for name, text in files.items()
    ]
    return spark.createDataFrame(data, "path string, file_name string, raw_blob string")


def sessions(spark, normalizer, files):
    found = normalizer(raw(spark, files)).collect()
    return {r["path"]: r.asDict(True) for r in found}


def jsonl(*events):
    return "\n".join(e if isinstance(e, str) else json.dumps(e) for e in events)


def said(s):
    return [(x["source"], x["message"]) for x in s["steps"]]


# --- session logs ------------------------------------------------------------------------


def user(content, **more):
    return {"type": "user", "sessionId": "s1", "message": {"role": "user", "content": content}, **more}


def turn(*blocks, **message):
    return {"type": "assistant", "sessionId": "s1", "message": {"role": "assistant", "content": list(blocks), **message}}


def use(call_id, name="Bash", **args):
    return {"type": "tool_use", "id": call_id, "name": name, "input": args}


def answer(call_id, content, **more):
    return {"type": "tool_result", "tool_use_id": call_id, "content": content, **more}


TEXT = {"type": "text", "text": "ok"}

CLAUDE = {
    "basic.jsonl": jsonl(
        {"type": "permission-mode", "sessionId": "s1"},
        "not json",
        "[1, 2]",
        "",
        user("  hello \n", version="1.2", cwd="/w", uuid="u1"),
        turn({"type": "thinking", "thinking": "hm"}, TEXT, {"type": "text", "text": "two"}, use("a", cmd="ls"), model="m1",
             usage={"input_tokens": 10, "output_tokens": 2, "cache_read_input_tokens": 3, "cache_creation_input_tokens": 4}),
        user([answer("a", [{"type": "text", "text": "x"}, {"type": "image"}, {"type": "text", "text": "y"}])],
             toolUseResult={"exitCode": 1}),
        {"type": "attachment", "attachment": {"type": "todo"}},
        {"type": "brand-new"},
        {"type": "system", "content": " kept as is ", "subtype": "warning"},
        {"type": "system", "content": None, "subtype": "compact_boundary"},
        user([{"type": "text", "text": "more"}, {"type": "text", "text": "lines"}]),
        turn(),
        turn(usage={"input_tokens": 5, "output_tokens": 1}),
        {"type": "ai-title", "aiTitle": "My title"},
    ),
    "pairing.jsonl": jsonl(
        user([answer("early", "too soon")]),
        turn(use("dup", n=1)),
        user([answer("dup", "first")]),
        turn(use("dup", n=2), use("other")),
        user([answer("dup", "second"), answer("other", "o", is_error=True), {"type": "text", "text": "ignored"}]),
        user([answer("nobody", "x")]),
    ),
    "odd.jsonl": jsonl(
        turn({"type": "thinking", "thinking": "", "signature": "abcde"}, {"type": "tool_use", "id": 5, "name": "x"},
             {"type": "tool_use", "id": "raw", "name": "R", "input": [1]}, {"type": "tool_use", "id": "none", "name": "N"}),
        user("   "),
        user(7),
    ),
    "empty.jsonl": jsonl({"type": "permission-mode", "sessionId": "s"}),
    "blank.jsonl": "\n\n",
}


@pytest.fixture(scope="module")
def claude(spark):
    return sessions(spark, claude_code.normalize, CLAUDE)


def test_claude_steps_and_facts(claude):
    s = claude["basic.jsonl"]
    assert said(s) == [
        ("user", "hello"),
        ("agent", "ok\ntwo"),
        ("system", " kept as is "),
        ("user", "more\nlines"),
        ("agent", ""),
        ("agent", ""),
    ]
    first, second = s["steps"][0], s["steps"][1]
    assert json.loads(first["extra"]) == {"uuid": "u1"}
    assert second["reasoning_content"] == "hm" and second["model_name"] == "m1"
    assert second["tool_calls"] == [
        {"tool_call_id": "a", "function_name": "Bash", "arguments": '{"cmd":"ls"}', "extra": None}
    ]
    assert second["results"][0]["content"] == "x\ny"
    assert json.loads(second["results"][0]["extra"]) == {"exitCode": 1}
    assert second["metrics"] == {
        "prompt_tokens": 10, "completion_tokens": 2, "cached_tokens": 3,
        "extra": '{"cache_creation_input_tokens":4}',
    }
    assert json.loads(s["steps"][2]["extra"]) == {"subtype": "warning"}
    h = s["header"]
    assert (h["session_id"], h["agent_version"], h["model"]) == ("s1", "1.2", "m1")
    assert (h["total_prompt_tokens"], h["total_completion_tokens"], h["total_cached_tokens"]) == (15, 3, 3)
    assert json.loads(h["metrics_extra"]) == {"cache_creation_input_tokens": 4}
    assert h["counters"] == {
        "permission_mode_changes": 1, "ai_title_count": 1, "attachment:todo": 1, "unknown:brand-new": 1,
    }
    assert json.loads(h["extra"]) == {"cwd": "/w", "ai_title": "My title"}


def test_claude_results_go_to_the_latest_earlier_call(claude):
    s = claude["pairing.jsonl"]
    contents = [[r["content"] for r in x["results"] or []] for x in s["steps"]]
    assert contents == [["first"], ["second", "o"]]
    assert json.loads(s["steps"][1]["results"][1]["extra"]) == {"is_error": True}
    assert s["header"]["counters"] == {"unmatched_tool_results": 2}
    assert s["header"]["total_prompt_tokens"] is None


def test_claude_odd_blocks(claude):
    s = claude["odd.jsonl"]
    assert said(s) == [("agent", "")]
    assert s["steps"][0]["reasoning_content"] == "[encrypted thinking, signature 5 bytes]"
    assert [(c["function_name"], c["arguments"]) for c in s["steps"][0]["tool_calls"]] == [
        ("R", '{"_raw":[1]}'), ("N", "{}"),
    ]
    assert s["header"]["agent_version"] == "unknown"


def test_claude_without_steps_has_no_session(claude):
    assert set(claude) == {"basic.jsonl", "pairing.jsonl", "odd.jsonl"}


# --- rollout logs ------------------------------------------------------------------------


def item(kind, **payload):
    return {"type": "response_item", "timestamp": payload.pop("ts", None), "payload": {"type": kind, **payload}}


def message(role, text):
    return item("message", role=role, content=[{"type": "x", "text": text}])


META = {"type": "session_meta", "payload": {"id": "sess", "cli_version": "0.3", "cwd": "/w", "instructions": "be nice"}}
CONTEXT = {"type": "turn_context", "payload": {"model": "gpt", "user_instructions": "terse"}}


def call(call_id, args='{"a": 1}', name="shell", **more):
    return item("function_call", call_id=call_id, name=name, arguments=args, **more)


def output(call_id, out):
    return item("function_call_output", call_id=call_id, output=out)


def think(*parts):
    return item("reasoning", summary=list(parts))


CODEX = {
    "basic.jsonl": jsonl(
        {**META, "synthetic": True, "synthetic_failure_mode": "loopy"}, CONTEXT,
        message("user", "go"), message("developer", "rules"), message("assistant", ""),
        think("plan", {"text": "more"}),
        call("c1", ts="t1", status="done"),
        message("assistant", "meanwhile"),
        output("c1", json.dumps({"output": "out", "metadata": {"exit": 0}})),
        item("web_search_call", id="w", action={"query": "q", "zzz": 1}, status="ok"),
        item("mystery"), {"type": "strange"},
        {"type": "event_msg", "payload": {"type": "token_count", "info": {"total_token_usage": {"input_tokens": 1}}}},
        {"type": "event_msg", "payload": {"type": "token_count", "info": {"total_token_usage": {
            "input_tokens": 9, "output_tokens": 8, "cached_input_tokens": 7, "total_tokens": 17}, "last_token_usage": {"x": 1}}}},
        {"type": "event_msg", "payload": {"type": "token_count", "info": None}},
    ),
    "pairs.jsonl": jsonl(
        META,
        call("a", "1"), call("b", "not json"), call("a", '{"second": true}'),
        output("a", "plain"), output("a", "late"), output("zzz", {"no": "output"}),
        call("p2"), call("a", '{"third": true}'), output("b", json.dumps({"output": [1]})),
        call("p1"), call("p2", '{"again": 1}'),
        output(None, None), call("", "x"),
    ),
    "carry.jsonl": jsonl(
        META, CONTEXT,
        think("one"), think("two"), message("user", "u"), message("assistant", "A"), message("assistant", "B"),
        think("lost"), item("reasoning", summary=[], encrypted_content="xxxx"), output("none", "o"),
        think("kept"), call("k"), think("over"), output("k", "r"), message("assistant", "C"),
        think(), message("assistant", "D"),
    ),
    "no_steps.jsonl": jsonl(META),
    "by-name.jsonl": jsonl(message("user", "hi")),
}


@pytest.fixture(scope="module")
def rollouts(spark):
    return sessions(spark, codex.normalize, CODEX)


def test_codex_steps_and_facts(rollouts):
    s = rollouts["basic.jsonl"]
    assert said(s) == [
        ("user", "go"), ("system", "rules"), ("agent", "meanwhile"), ("agent", "Tool call: shell"),
        ("agent", "Web search: q"),
    ]
    tool, search = s["steps"][3], s["steps"][4]
    assert tool["ts"] == "t1" and tool["reasoning_content"] == "plan\nmore"
    assert s["steps"][2]["reasoning_content"] is None
    assert tool["tool_calls"][0]["arguments"] == '{"a":1}'
    assert json.loads(tool["tool_calls"][0]["extra"]) == {"raw_arguments": '{"a": 1}', "status": "done"}
    assert tool["results"][0]["content"] == "out"
    assert json.loads(tool["results"][0]["extra"]) == {"tool_metadata": {"exit": 0}}
    assert (search["tool_calls"][0]["tool_call_id"], search["tool_calls"][0]["arguments"]) == ("w", '{"query":"q"}')
    assert [x["model_name"] for x in s["steps"]] == [None, None, "gpt", "gpt", "gpt"]
    h = s["header"]
    assert (h["session_id"], h["agent_version"], h["model"]) == ("sess", "0.3", "gpt")
    assert json.loads(h["agent_extra"]) == {"cwd": "/w", "base_instructions": "be nice", "user_instructions": "terse"}
    assert (h["total_prompt_tokens"], h["total_completion_tokens"], h["total_cached_tokens"]) == (9, 8, 7)
    assert json.loads(h["metrics_extra"]) == {"total_tokens": 17, "last_token_usage": {"x": 1}}
    assert h["synthetic_failure_mode"] == "loopy"
    assert h["counters"] == {"unknown:mystery": 1, "unknown:strange": 1}


def test_codex_pairing_quirks(rollouts):
    s = rollouts["pairs.jsonl"]
    got = [
        (x["message"], x["tool_calls"][0]["tool_call_id"], x["tool_calls"][0]["arguments"],
         None if x["results"] is None else x["results"][0]["content"])
        for x in s["steps"]
    ]
    assert got == [
        # the first call of "a" was overwritten by the second and is lost
        ("Tool call: shell", "a", '{"second":true}', "plain"),
        ("Tool call: <unnamed>", "a", "{}", "late"),
        ("Tool call: <unnamed>", "zzz", "{}", '{"no":"output"}'),
        ("Tool call: shell", "b", '{"input":"not json"}', "[1]"),
        ("Tool call: <unnamed>", "", "{}", ""),
        # open calls come last, in the order their ids were first opened
        ("Tool call (no output): shell", "p2", '{"again":1}', None),
        ("Tool call (no output): shell", "a", '{"third":true}', None),
        ("Tool call (no output): shell", "p1", '{"a":1}', None),
    ]
    assert s["header"]["counters"] == {"unmatched_tool_outputs": 3}
    assert json.loads(s["steps"][-1]["tool_calls"][0]["extra"])["pending"] is True


def test_codex_reasoning_goes_to_the_next_consumer(rollouts):
    s = rollouts["carry.jsonl"]
    assert [(x["message"], x["reasoning_content"]) for x in s["steps"]] == [
        ("u", None), ("A", "two"), ("B", None),
        ("Tool call: <unnamed>", "[encrypted reasoning, 4 bytes]"),
        ("Tool call: shell", "kept"),
        ("C", "over"), ("D", None),
    ]


def test_codex_session_id_falls_back_to_the_file(rollouts):
    assert "no_steps.jsonl" not in rollouts
    assert rollouts["by-name.jsonl"]["header"]["session_id"] == "by-name"


# --- envelopes ---------------------------------------------------------------------------

CURSOR = {
    "a.cursor.json": {
        "session_id": "c1", "cursor_version": "0.4", "workspace_path": "/w", "model": "sonnet", "synthetic_failure_mode": "x",
        "messages": [
            {"role": "user", "content": "hi", "timestamp": "t"},
            {"role": "assistant", "content": [{"type": "thinking", "thinking": "", "signature": "abc"}, {"text": "A"}, {"type": "text", "text": "B"}],
             "tool_calls": [{"id": "1", "name": "f", "arguments": {"z": 1, "a": 2}}, {"tool_call_id": "2", "function_name": "g", "input": "s"}, {"id": "3"}],
             # a result in the message that makes the call is not matched
             "tool_results": [{"tool_call_id": "1", "content": "same message"}],
             "usage": {"input_tokens": 1, "output_tokens": 2}},
            {"role": "user", "tool_results": [{"tool_call_id": "1", "content": [{"text": "r1"}, {"text": "r2"}]}, {"id": "2", "content": {"k": 1}}, {"tool_call_id": 5}]},
            {"role": "narrator", "content": "?"},
            "junk",
            {"role": "user", "content": [{"type": "thinking", "thinking": "not mine"}]},
            {"role": "assistant", "content": [{"type": "thinking", "thinking": "only thoughts"}]},
        ],
    },
    "stem.cursor.json": {"messages": [{"role": "system", "content": "s"}]},
    "none.json": {"session_id": "x", "messages": []},
    "bad.json": "{",
}


def test_cursor(spark):
    got = sessions(spark, cursor.normalize, CURSOR)
    assert set(got) == {"a.cursor.json", "stem.cursor.json"}
    s = got["a.cursor.json"]
    assert said(s) == [("user", "hi"), ("agent", "A\nB"), ("agent", "")]
    agent = s["steps"][1]
    assert [(c["tool_call_id"], c["function_name"], c["arguments"]) for c in agent["tool_calls"]] == [
        ("1", "f", '{"a":2,"z":1}'), ("2", "g", '{"_raw":"s"}'),
    ]
    assert [r["content"] for r in agent["results"]] == ["r1\nr2", '{"k":1}']
    assert agent["reasoning_content"] == "[encrypted thinking, signature 3 bytes]"
    assert s["steps"][2]["reasoning_content"] == "only thoughts"
    assert [x["model_name"] for x in s["steps"]] == [None, "sonnet", "sonnet"]
    assert s["header"]["counters"] == {"unmatched_tool_results": 2, "unknown_role:narrator": 1}
    assert (s["header"]["total_prompt_tokens"], s["header"]["synthetic_failure_mode"]) == (1, "x")
    assert got["stem.cursor.json"]["header"]["session_id"] == "stem.cursor"


# --- benchmark rows and native documents ---------------------------------------------------


def test_swe_agent(spark):
    row = {
        "instance_id": "r__1", "model_name": "llama", "target": False, "exit_status": "exit_context",
        "generated_patch": "  ", "eval_logs": "x" * 10_003,
        "trajectory": [
            {"role": "system", "text": "", "system_prompt": "setting", "mask": False, "cutoff_date": "2023"},
            {"role": "user", "text": "issue"}, {"role": "ai", "text": "fix", "mask": True},
            {"role": "ai", "text": "  "}, {"role": "wat", "text": "?"}, 5,
        ],
    }
    files = {
        "ok.json": row,
        "no_target.json": {k: v for k, v in row.items() if k != "target"},
        "word_target.json": {**row, "target": "yes"},
        "blank.json": {**row, "trajectory": [{"role": "ai", "text": ""}]},
    }
    got = sessions(spark, swe_agent.normalize, files)
    assert set(got) == {"ok.json", "word_target.json"}
    s = got["ok.json"]
    assert said(s) == [("system", "setting"), ("system", "issue"), ("agent", "fix")]
    assert json.loads(s["steps"][0]["extra"]) == {"mask": False, "cutoff_date": "2023"}
    h = s["header"]
    assert (h["resolved"], h["exit_status"], h["counters"]) == (False, "exit_context", {"unknown_role:wat": 1})
    extra = json.loads(h["extra"])
    assert extra["eval_logs"].endswith("\n...[truncated, 3 more bytes]") and extra["eval_logs_full_bytes"] == 10_003
    assert "generated_patch" not in extra
    assert got["word_target.json"]["header"]["resolved"] is None


def native_doc(**more):
    step = {"step_id": 1, "source": "agent", "message": "m", "usage": {"prompt_tokens": 3, "cache_tokens": 2},
            "tool_calls": [{"tool_call_id": "c", "function_name": "f", "arguments": {"b": 1, "a": [2]}}],
            "observation": {"results": [{"content": [{"type": "text", "text": "t"}, {"type": "img"}]}, {"content": None}, {"content": 5}]}}
    return {"schema_version": "ATIF-v1.2", "session_id": "n", "agent": {"name": "mcp", "version": "1"}, "steps": [step], **more}


def test_native(spark):
    two = native_doc()
    two["steps"] = [two["steps"][0], {"step_id": 2, "source": "user", "message": "x", "metrics": {"prompt_tokens": 1}, "usage": {"prompt_tokens": 9}}]
    wrong_ids = native_doc()
    wrong_ids["steps"] = [{**wrong_ids["steps"][0], "step_id": 4}]
    got = sessions(spark, native.normalize, {
        "a.json": two,
        "resolved.json": native_doc(extra={"resolved": True, "exit_status": "x"}),
        "word.json": native_doc(extra={"resolved": "true"}),
        "no_version.json": native_doc(agent={"name": "mcp"}),
        "no_steps.json": native_doc(steps=[]),
        "wrong_ids.json": wrong_ids,
        "list.json": "[1]",
    })
    assert set(got) == {"a.json", "resolved.json", "word.json"}
    first, second = got["a.json"]["steps"]
    assert first["metrics"] == {"prompt_tokens": 3, "completion_tokens": None, "cached_tokens": 2, "extra": None}
    assert second["metrics"]["prompt_tokens"] == 1
    assert first["tool_calls"][0]["arguments"] == '{"a":[2],"b":1}'
    assert [(r["content"], r["text"]) for r in first["results"]] == [
        ('t\n{"type":"img"}', "t"), ("", None), ("5", None),
    ]
    assert got["resolved.json"]["header"]["resolved"] is True
    assert got["word.json"]["header"]["resolved"] is None


def test_steps_table_is_numbered(spark):
    frame = native.normalize(raw(spark, {"a.json": native_doc()}))
    assert [(r["trace_id"], r["step_id"]) for r in rows(S.steps_of(frame))] == [("a.json", 1)]


def test_registry_takes_new_formats(spark):
    files = raw(spark, {"a.json": native_doc(), "b.xyz": native_doc()})
    marked = files.selectExpr("*", "if(path = 'a.json', 'atif', 'mine') AS source_format")
    register_format("mine", native.normalize)
    try:
        assert normalize_all(marked).count() == 2
    finally:
        del FORMATS["mine"]
    assert normalize_all(marked).count() == 1
