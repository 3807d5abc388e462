import json
import os
from datetime import datetime

from conftest import rows
from pyspark.sql import functions as F

from stepwell.operators import reports as R
from stepwell.plans import enrich as E
from stepwell.plans.ingest import ingest, quality_gate
from stepwell.functions.outcomes import EVENT_SCHEMA
from stepwell.sources import codex
from stepwell.sources import files as S
from stepwell.streaming import continuous as C
from stepwell.streaming import settle


def write(folder, name, text, mode="w"):
    path = os.path.join(folder, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, mode) as f:
        f.write(text)
    return path


def item(**payload):
    return json.dumps({"type": "response_item", "payload": payload})


def rollout(session, *texts, calls=1):
    lines = [json.dumps({"type": "session_meta", "payload": {"id": session}})]
    lines += [item(type="message", role="user", content=t) for t in texts]
    for i in range(calls):
        lines.append(item(type="function_call", call_id=f"c{i}", name="sh", arguments="{}"))
        lines.append(item(type="function_call_output", call_id=f"c{i}", output="ok"))
    return "\n".join(lines)


def test_scans(spark, folder):
    write(folder, "a/x.jsonl", '{"type": "t"}\r\n\nbad\n[1]\n{"n": 1}')
    write(folder, "a/b/y.jsonl", '{"type": 5}')
    write(folder, "z.cursor.json", "{}")
    write(folder, "bytes.json", b'{"a": "\xff"}', "wb")
    names = lambda df: sorted(r["file_name"] for r in df.collect())
    assert names(S.read_sessions(spark, f"{folder}/a", "*.jsonl")) == ["x.jsonl"]
    assert names(S.read_collection(spark, folder, "codex")) == ["x.jsonl", "y.jsonl"]
    assert names(S.read_collection(spark, folder, "cursor")) == ["z.cursor.json"]
    assert names(S.read_sessions(spark, [f"{folder}/a/x.jsonl", f"{folder}/z.cursor.json"])) == ["x.jsonl", "z.cursor.json"]
    [r] = S.read_sessions(spark, folder, "bytes.json").collect()
    assert r["raw_blob"] == '{"a": "�"}' and r["size"] == 10
    got = rows(S.scan_jsonl(S.read_collection(spark, folder, "codex")).select("line_no", "event_type"), "line_no", "event_type")
    assert got == [{"line_no": 1, "event_type": None}, {"line_no": 1, "event_type": "t"}, {"line_no": 5, "event_type": None}]
    docs = S.scan_json(S.read_sessions(spark, f"{folder}/z.cursor.json"))
    assert docs.filter("doc IS NOT NULL").count() == 1


def test_benchmark_rows(spark, folder):
    data = [("a/b c", "m", True, [("ai", "hi", "")])]
    spark.createDataFrame(
        data, "instance_id string, model_name string, target boolean, trajectory array<struct<role:string,text:string,system_prompt:string>>"
    ).write.parquet(f"{folder}/p")
    done = ingest(S.read_benchmark_rows(spark, f"{folder}/p"))
    [t] = done.traces.collect()
    assert (t["id"], t["source_format"], t["num_steps"], t["has_error"]) == ("a/b c", "swe_agent", 1, 0)
    assert t["path"] == "a/b c"


def test_manifest_and_reports(spark, folder):
    spec = lambda label: {"output_format": "codex", "primary_failure": label}
    results = [
        {"spec": spec("loop"), "ok": True, "attempts": 1, "cost_usd": 0.5, "atif_summary": {"n_steps": 4, "n_tool_calls": 1}},
        {"spec": spec("loop"), "ok": True, "attempts": 2, "cost_usd": 0.1, "atif_summary": {"n_steps": 9, "n_tool_calls": None}},
        {"spec": spec("success"), "ok": False, "attempts": 2, "error": "bad"},
        {"ok": False, "budget_skipped": True},
    ]
    path = write(folder, "m.json", json.dumps({"summary": {"n": 4}, "results": results}))
    m = S.read_manifest(spark, path)
    assert {r["value"]: r["n"] for r in R.count_by_path(m, "spec.primary_failure").collect()} == {"loop": 2, "success": 1, "<missing>": 1}
    [o] = rows(R.outcome_rates(m))
    assert (o["total"], o["ok"], o["failed"], o["budget_skipped"], o["second_attempt"]) == (4, 2, 1, 1, 2)
    [s] = rows(R.shape_by_label(m))
    assert (s["label"], s["n"], s["mean_steps"], s["median_steps"], s["mean_tool_calls"]) == ("loop", 2, 6.5, 6.5, 1.0)
    assert [r["row"] for r in R.top_n(m, "cost_usd", 2, "row").collect()] == [0, 1]


def test_eval_queries(spark, folder):
    path = write(folder, "q.json", json.dumps([{"query": "q", "expected": ["loop", 5]}, {"query": 1, "expected": []}, {"query": "x"}, 7]))
    good, bad = S.read_eval_queries(spark, path)
    assert rows(good) == [{"query_id": 0, "query": "q", "expected": ["loop", "5"]}]
    assert [r["query_id"] for r in rows(bad, "query_id")] == [1, 2, 3]


def test_confusion_leaves_out_unknown_truth(spark):
    df = spark.createDataFrame([(True, 1), (True, 0), (False, 1), (False, 0), (True, None)], "s boolean, has_error int")
    cells = R.confusion(df, ["s"])
    assert rows(cells) == [{"signal": "s", "tp": 1, "fp": 1, "fn": 1, "tn": 1}]
    [r] = rows(R.precision_recall_f1(R.confusion(df.filter("NOT s"), ["s"])))
    assert (r["precision"], r["recall"], r["f1"]) == (None, 0.0, None)


def test_ingest_end_to_end(spark, folder):
    write(folder, "in/one/s.jsonl", rollout("s1", "hi"))
    write(folder, "in/two/s.jsonl", rollout("s2", "hi", "there"))
    write(folder, "in/same/s.jsonl", rollout("s1", "hi", "newer", "text"))
    write(folder, "in/trajectory.json", json.dumps({"schema_version": "ATIF-v1.7", "session_id": "broken", "steps": []}))
    write(folder, "in/notes.txt", "plain")
    os.utime(f"{folder}/in/one/s.jsonl", (1, 1))
    raw = S.read_sessions(spark, f"{folder}/in", recursive=True)
    done = ingest(raw, bronze=f"{folder}/bronze", redact=lambda c: F.regexp_replace(c, "hi", "**"))
    got = {r["id"]: r.asDict() for r in done.traces.collect()}
    assert {i: (r["source_format"], r["has_atif"], r["num_steps"], r["num_tool_calls"]) for i, r in got.items()} == {
        "s1": ("codex", True, 4, 1), "s2": ("codex", True, 3, 1),
        "broken": ("atif", False, None, None), "notes": ("unknown", False, None, None),
    }
    assert all(r["raw_blob"] for r in got.values())
    steps = rows(done.steps, "trace_id", "step_id")
    assert [(r["trace_id"], r["step_id"], r["message"]) for r in steps][:4] == [
        ("s1", 1, "**"), ("s1", 2, "newer"), ("s1", 3, "text"), ("s1", 4, "Tool call: sh"),
    ]
    assert sorted(r["trace_id"] for r in done.trajectories.collect()) == ["s1", "s2"]
    assert sorted(os.listdir(f"{folder}/bronze"))[-1].startswith("source_format=")


def test_enrichment_order(spark, folder):
    write(folder, "in/a.jsonl", rollout("a", "hi"))
    write(folder, "in/b.jsonl", rollout("b", "hi"))
    done = ingest(S.read_sessions(spark, f"{folder}/in"))
    labels = spark.createDataFrame([("a", "success", "fine")], "trace_id string, label string, reasoning string")
    event = lambda ok: ("loop", 1, 2, ok, 2 if ok else None, "went on" if ok else None)
    events = spark.createDataFrame([("a", [event(False)]), ("b", [event(True)])], f"trace_id string, events {EVENT_SCHEMA}")
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 0.1])], "trace_id string, embedding array<float>")
    out = E.enrich(done.traces, done.trajectories, done.steps, labels, events, vectors)
    got = {r["id"]: r for r in rows(out.traces)}
    # the signals found nothing, the events raised has_error, and that opened the recommendations
    assert (got["a"]["has_error"], got["a"]["failure_label"], got["a"]["failure_label_reasoning"]) == (1, "loop", "fine")
    assert [(r["trace_id"], r["hit_id"]) for r in rows(out.recommendations)] == [("a", "b")]
    prompts = {r["trace_id"]: r["prompt"] for r in rows(E.prompts(out.traces, done.steps))}
    assert prompts["a"].startswith("- Agent: codex") and "[user] hi\n[agent] Tool call: sh {sh} -> ok" in prompts["a"]
    none = spark.createDataFrame([], "trace_id string, source_text_hash string, model string")
    due = E.texts_to_embed(out.traces, done.steps, none, "m")
    stored = due.selectExpr("trace_id", "source_text_hash", "'m' AS model")
    assert due.count() == 2
    assert E.texts_to_embed(out.traces, done.steps, stored, "m").count() == 0
    assert E.texts_to_embed(out.traces, done.steps, stored, "m", force=True).count() == 2


def test_quality_gate(spark):
    texts = {"ok": rollout("s", "1", "2", "3", "4"), "short": rollout("s", "1"), "long": rollout("s", *"123456789"), "talk": rollout("s", *"12345", calls=0), "blank": " \n", "bad": "{}"}
    raw = spark.createDataFrame([(k, k + ".jsonl", v) for k, v in texts.items()], "path string, file_name string, raw_blob string")
    got = {r["path"]: (r["ok"], r["error"]) for r in quality_gate(raw, codex.normalize(raw), 5, 9).collect()}
    assert got == {
        "ok": (True, ""), "short": (False, "too few steps (2 < 5)"), "long": (False, "too many steps (10 > 9)"),
        "talk": (False, "no tool calls in trajectory (degenerate)"), "blank": (False, "empty raw_text from model"),
        "bad": (False, "adapter returned None"),
    }


def test_staged_path(spark):
    df = spark.createDataFrame([("/c/p/a.jsonl",), ("/x/a.jsonl",), ("/cc/a.jsonl",)], "path string")
    got = [r[0] for r in df.select(S.staged_path(F.col("path"), {"/c/": "raw/claude", "/x": "raw/x/"})).collect()]
    assert got == ["raw/claude/p/a.jsonl", "raw/x/a.jsonl", None]


# --- streams -------------------------------------------------------------------------------


def test_sync_takes_each_file_once(spark, folder):
    write(folder, "in/a.jsonl", rollout("a", "hi"))
    write(folder, "in/sub/b.jsonl", "garbage")

    def run():
        q = C.sync_folder(spark, f"{folder}/in", f"{folder}/out", f"{folder}/cp", roots={f"file:{folder}/in": "raw"})
        assert q.awaitTermination(120) and q.exception() is None

    run()
    write(folder, "in/c.jsonl", rollout("c", "hi", "again"))
    run()
    run()
    from stepwell.plans.tables import current, current_children, read_batches

    got = {r["id"]: r for r in rows(current(spark, f"{folder}/out/traces"))}
    assert {i: r["has_atif"] for i, r in got.items()} == {"a": True, "b": False, "c": True}
    assert got["b"]["staged_path"] == "raw/sub/b.jsonl" and got["a"]["signals"] is not None
    assert read_batches(spark, f"{folder}/out/traces").count() == 3
    assert current_children(spark, f"{folder}/out/steps", f"{folder}/out/traces").count() == 5


CHANGES = [("a.jsonl", 0), ("a.jsonl", 4), ("b.jsonl", 5), ("a.jsonl", 13), ("a.jsonl", 23), ("notes.txt", 24), ("b.jsonl", 40), ("c.jsonl", 90)]


def at(seconds):
    return datetime.fromtimestamp(1_700_000_000 + seconds)


def test_settled_batch(spark):
    df = spark.createDataFrame([(p, at(s)) for p, s in CHANGES], "path string, event_ts timestamp")
    got = sorted((r["path"], r["last_write"], r["writes"]) for r in settle.settled_batch(df).collect())
    assert got == [("a.jsonl", at(13), 3), ("a.jsonl", at(23), 1), ("b.jsonl", at(5), 1), ("b.jsonl", at(40), 1), ("c.jsonl", at(90), 1)]
    moved = df.withColumn("dest_path", F.expr("if(path = 'notes.txt', 'd.jsonl', NULL)"))
    assert settle.settled_batch(moved).filter("path = 'd.jsonl'").count() == 1


def test_settled_stream(spark, folder):
    for i, (path, second) in enumerate(CHANGES):
        df = spark.createDataFrame([(path, at(second))], "path string, event_ts timestamp")
        df.coalesce(1).write.parquet(f"{folder}/in/{i}")
    stream = spark.readStream.schema("path string, event_ts timestamp").option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    q = (
        settle.settled_stream(stream, delay=60).writeStream.outputMode("append").format("parquet")
        .option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start()
    )
    assert q.awaitTermination(180) and q.exception() is None
    got = {(r["path"], r["last_write"], r["writes"]) for r in spark.read.parquet(f"{folder}/out").collect()}
    # the watermark has passed the first bursts only
    assert ("a.jsonl", at(13), 3) in got and ("b.jsonl", at(5), 1) in got
    assert not any(p == "c.jsonl" for p, _, _ in got)


def test_settled_files_are_ingested(spark, folder):
    path = write(folder, "watch/a.jsonl", rollout("a", "hi"))
    spark.createDataFrame([(f"file:{path}", 1)], "path string, writes long").write.parquet(f"{folder}/settled")
    stream = spark.readStream.schema("path string, writes long").parquet(f"{folder}/settled")
    q = C.ingest_settled(spark, stream, f"{folder}/out", f"{folder}/cp")
    q.processAllAvailable()
    q.stop()
    assert [r["id"] for r in spark.read.parquet(f"{folder}/out/traces").collect()] == ["a"]


def test_settled_by_timer(spark, folder):
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        spark.createDataFrame([("a.jsonl",), ("a.jsonl",), ("b.txt",)], "path string").write.parquet(f"{folder}/in")
        stream = spark.readStream.schema("path string").parquet(f"{folder}/in")
        q = (
            settle.settled_by_timer(stream, debounce=1).writeStream.outputMode("append").format("memory")
            .queryName("quiet").option("checkpointLocation", f"{folder}/cp").trigger(processingTime="500 milliseconds").start()
        )
        try:
            for _ in range(60):
                if spark.table("quiet").count() or q.exception():
                    break
                q.awaitTermination(1)
            assert q.exception() is None
            assert rows(spark.table("quiet")) == [{"path": "a.jsonl", "writes": 2}]
        finally:
            q.stop()
    finally:
        spark.conf.set(provider, before)
