"""Single-file writes and the sync of grown files."""

import json
import os

import pytest
from conftest import rows

from stepwell.plans.tables import current, read_batches
from stepwell.sources.session_files import extract_files, write_session_files
from stepwell.streaming.continuous import signals_only
from stepwell.streaming.sync import due, listing, manifest, sync_changed


def rollout(session, *messages):
    events = [{"type": "session_meta", "payload": {"id": session}}]
    events += [{"type": "response_item", "payload": {"type": "message", "role": "user", "content": m}} for m in messages]
    return "".join(json.dumps(e) + "\n" for e in events)


def put(folder, files):
    for name, text in files.items():
        path = f"{folder}/{name}"
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "w") as file:
            file.write(text)


def test_one_file_per_row(spark, folder):
    data = [("a.jsonl", "one\n"), ("b.jsonl", None), ("a.jsonl", "zwei\n"), (None, "lost"), ("c ü.jsonl", "x" * 200_000), ("d.jsonl", "")]
    files = spark.createDataFrame(data, "file_name string, text string").repartition(4)
    write_session_files(files, folder)
    assert sorted(os.listdir(folder)) == ["a.jsonl", "b.jsonl", "c ü.jsonl", "d.jsonl"]
    assert open(f"{folder}/a.jsonl").read() == "zwei\n" and os.path.getsize(f"{folder}/c ü.jsonl") == 200_000
    # a second write replaces by name and leaves the others
    write_session_files(spark.createDataFrame([("b.jsonl", "new")], "file_name string, text string"), f"file:{folder}")
    assert open(f"{folder}/b.jsonl").read() == "new" and open(f"{folder}/a.jsonl").read() == "zwei\n"
    write_session_files(files.limit(0), folder)
    assert len(os.listdir(folder)) == 4


def test_a_failed_write_leaves_nothing(spark, folder):
    put(folder, {"a.jsonl": "old"})
    bad = spark.createDataFrame([("a.jsonl", "new"), ("../b.jsonl", "out")], "file_name string, text string").repartition(2)
    with pytest.raises(Exception, match="not a file name"):
        write_session_files(bad, folder)
    assert os.listdir(folder) == ["a.jsonl"] and open(f"{folder}/a.jsonl").read() == "old"
    with pytest.raises(ValueError):
        write_session_files(bad.limit(0), "s3://bucket/x")


def test_extract_names_files_by_key(spark, folder):
    df = spark.createDataFrame([("org/repo 1", True, [1, 2]), ("b", None, None)], "instance_id string, target boolean, trajectory array<int>")
    extract_files(df, "instance_id", folder)
    got = {n: json.load(open(f"{folder}/{n}")) for n in os.listdir(folder)}
    assert got == {"org__repo_1.json": {"instance_id": "org/repo 1", "target": True, "trajectory": [1, 2]}, "b.json": {"instance_id": "b", "target": None, "trajectory": None}}


def test_sync_takes_new_and_changed_files(spark, folder):
    watched, out = f"{folder}/in", f"{folder}/out"
    put(watched, {"a.jsonl": rollout("a", "hi"), "sub/b.jsonl": rollout("b", "hi"), "c [1]{x} ü%20?.jsonl": "garbage", "notes.txt": "no"})
    first = sync_changed(spark, watched, out, roots={f"file:{watched}": "raw"}, files_per_batch=2)
    assert (first.scanned, first.ingested, first.skipped, first.batches) == (3, 3, 0, (0, 1))
    again = sync_changed(spark, watched, out)
    assert (again.scanned, again.ingested, again.batches) == (3, 0, ())
    # grown, touched with the same content, and new
    put(watched, {"a.jsonl": rollout("a", "hi", "more"), "d.jsonl": rollout("d", "x")})
    os.utime(f"{watched}/sub/b.jsonl", (1_600_000_000, 1_600_000_000))
    third = sync_changed(spark, watched, out)
    assert (third.scanned, third.ingested, third.batches) == (4, 3, (2,))
    got = {r["id"]: r["num_steps"] for r in current(spark, f"{out}/traces").collect()}
    assert {k: got[k] for k in "abd"} == {"a": 2, "b": 1, "d": 1} and len(got) == 4
    # part of a second does not count
    os.utime(f"{watched}/sub/b.jsonl", (1_600_000_000.5, 1_600_000_000.5))
    assert sync_changed(spark, watched, out).ingested == 0
    # back to an earlier state: the newest manifest row counts
    put(watched, {"a.jsonl": rollout("a", "hi")})
    assert sync_changed(spark, watched, out).ingested == 1
    assert {r["id"]: r["num_steps"] for r in current(spark, f"{out}/traces").collect()}["a"] == 1
    # a removed file keeps its trace
    os.rename(f"{watched}/d.jsonl", f"{folder}/d.gone")
    last = sync_changed(spark, watched, out)
    assert (last.scanned, last.ingested) == (3, 0) and current(spark, f"{out}/traces").count() == 4


def test_a_broken_sync_repeats_its_group_only(spark, folder):
    watched, out = f"{folder}/in", f"{folder}/out"
    put(watched, {f"{n}.jsonl": rollout(n, "hi") for n in "abc"})
    seen = []

    def breaks(done):
        seen.append(1)
        if len(seen) == 2:
            raise RuntimeError("lost")
        return signals_only(done)

    with pytest.raises(RuntimeError, match="lost"):
        sync_changed(spark, watched, out, files_per_batch=1, passes=breaks)
    assert manifest(spark, out).count() == 1
    rest = sync_changed(spark, watched, out, files_per_batch=1)
    assert rest.ingested == 2 and rest.batches == (1, 2)
    assert sorted(r["id"] for r in read_batches(spark, f"{out}/traces").collect()) == ["a", "b", "c"]


def test_due_reads_no_contents(spark, folder):
    put(folder, {"a.jsonl": "x" * 10, "b.jsonl": "", "c.txt": "no"})
    files = listing(spark, folder)
    assert [(r["size"], r["path"].endswith("a.jsonl")) for r in rows(files, "path")] == [(10, True)]
    plan = due(files, manifest(spark, f"{folder}/none"))._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan


def test_names_are_looked_up_many_to_a_task(spark, folder):
    watched, out = f"{folder}/in", f"{folder}/out"
    put(watched, {f"{n}.jsonl": rollout(f"s{n}", "hi") for n in range(150)})
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    context = spark.sparkContext
    context.setJobGroup("many-names", "sync")
    try:
        assert sync_changed(spark, watched, out).ingested == 150
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    tracker = context.statusTracker()
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup("many-names") for s in tracker.getJobInfo(j).stageIds]
    assert stages and max(s.numTasks for s in stages if s is not None) <= 64
    # settings of the session are as they were
    assert spark.conf.get("spark.sql.files.openCostInBytes") == before
