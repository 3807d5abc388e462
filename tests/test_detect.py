import hashlib
import json

from conftest import rows

from stepwell.sources.detect import detect_format, file_stem, raw_identity, trace_id

SWE = {"instance_id": "i", "model_name": "m", "target": True, "trajectory": []}
CASES = [
    ("a.json", json.dumps({"schema_version": "ATIF-v1.7", "session_id": "s"}), "atif"),
    ("a.json", json.dumps({"schema_version": "v1"}), "unknown"),
    ("a.json", json.dumps({"schema_version": 1}), "unknown"),
    ("a.json", json.dumps(SWE), "swe_agent"),
    ("a.json", json.dumps({k: v for k, v in SWE.items() if k != "target"}), "unknown"),
    ("a.json", json.dumps({"session_id": "s", "messages": [{"role": "user"}]}), "cursor"),
    ("a.json", json.dumps({"session_id": "s", "messages": []}), "unknown"),
    ("a.json", json.dumps({"session_id": None, "messages": [{"role": None}]}), "cursor"),
    ("a.json", json.dumps({"session_id": "s", "messages": ["x"]}), "unknown"),
    ("A.Cursor.JSON", json.dumps({"anything": 1}), "cursor"),
    ("a.cursor.json", "[1]", "unknown"),
    ("a.cursor.json", "{", "unknown"),
    ("a.json", "", "unknown"),
    # an envelope that is also a benchmark row counts as an envelope
    ("a.json", json.dumps({**SWE, "session_id": "s", "messages": [{"role": "u"}]}), "cursor"),
    ("a.jsonl", '\n  \n{"type": "session_meta"}\n{', "codex"),
    ("a.jsonl", '{"type": "compacted", "sessionId": "s"}', "codex"),
    ("a.jsonl", '{"type": "user", "sessionId": null}\r\nrest', "claude_code"),
    ("a.jsonl", '{"type": "summary", "sessionId": "s"}', "claude_code"),
    ("a.jsonl", '{"type": "user"}', "unknown"),
    ("a.jsonl", '{"type": "ai-title", "sessionId": "s"}', "unknown"),
    ("a.jsonl", '{"type": 5, "sessionId": "s"}', "unknown"),
    ("a.jsonl", "[1]\n", "unknown"),
    ("a.jsonl", "  \n", "unknown"),
    ("a.txt", '{"type": "session_meta"}', "unknown"),
    ("a", '{"type": "session_meta"}', "unknown"),
]


def test_detect_format(spark):
    df = spark.createDataFrame(
        [(i, n, t) for i, (n, t, _) in enumerate(CASES)], "i int, file_name string, raw_blob string"
    )
    got = rows(df.select("i", detect_format().alias("f")), "i")
    assert [r["f"] for r in got] == [c[2] for c in CASES]


IDENTITIES = [
    ('{"session_id": "s", "trajectory_id": "t"}', "t"),
    ('{"trajectory_id": "", "session_id": 5, "instance_id": "i"}', "i"),
    ('{"sessionId": "c"}\n{"sessionId": "d"}', "c"),
    ('\n\n {"type": "session_meta", "payload": {"id": "p"}} \nnot json', "p"),
    ('{"type": "other", "payload": {"id": "p"}}', None),
    ("", None),
    ("plain\ntext", None),
]


def test_identity_and_trace_id(spark):
    df = spark.createDataFrame(list(enumerate(t for t, _ in IDENTITIES)), "i int, raw_blob string")
    got = rows(df.select("i", raw_identity().alias("x")), "i")
    assert [r["x"] for r in got] == [x for _, x in IDENTITIES]

    data = [
        ("t", "s", "{}", "f.json", "t"),
        ("", "s", "{}", "f.json", "s"),
        (None, None, '{"session_id": "r"}', "trajectory.json", "r"),
        (None, None, "{}", "a.cursor.json", "a.cursor"),
        (None, None, "{}", ".hidden", ".hidden"),
        (None, None, "é", "", "sha256:" + hashlib.sha256("é".encode()).hexdigest()[:32]),
    ]
    df = spark.createDataFrame(
        data, "trajectory_id string, session_id string, raw_blob string, file_name string, want string"
    )
    for r in rows(df.select("want", trace_id().alias("got"), file_stem().alias("stem"))):
        assert r["got"] == r["want"]


def test_a_text_is_parsed_once_per_reading(spark):
    raw = spark.createDataFrame([("a.json", "{}")], "file_name string, raw_blob string").repartition(1)

    def parsings(column):
        plan = raw.select(column.alias("x"))._jdf.queryExecution().optimizedPlan().toString()
        return plan.lower().count("parsejson") + plan.lower().count("parse_json")

    # the document and the first line; a name for each, however many fields are looked at
    assert 1 <= parsings(detect_format()) <= 2 and 1 <= parsings(raw_identity()) <= 2
