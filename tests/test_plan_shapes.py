"""Plans keep the shape they were designed for: shuffles, limits and pruned columns."""

import re

import pytest
from conftest import STEP_SCHEMA
from pyspark.sql import functions as F

from stepwell.operators import render, signals
from stepwell.operators.sampling import first_n_per_stratum
from stepwell.operators.sequencing import number_in_key
from stepwell.plans.ingest import ingest
from stepwell.sources import claude_code, codex, cursor, native, swe_agent


def shuffles(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    return [re.sub(r"#\d+L?", "", x) for x in re.findall(r" Exchange hashpartitioning\((.*?), \d+\)", plan)], plan


@pytest.fixture(scope="module")
def steps(spark):
    import tempfile

    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.createDataFrame([], STEP_SCHEMA).withColumn("extra", F.lit("x")).write.parquet(f"{folder}/s")
    return spark.read.parquet(f"{folder}/s")


@pytest.mark.parametrize(
    "normalizer, wanted",
    [(claude_code, ["path"]), (codex, ["path"]), (cursor, ["path"]), (swe_agent, []), (native, [])],
)
def test_normalisers_shuffle_at_most_once(spark, normalizer, wanted):
    raw = spark.createDataFrame([], "path string, file_name string, raw_blob string")
    assert shuffles(normalizer.normalize(raw))[0] == wanted


def test_signals_shuffle_rows_by_chunk_and_parts_by_trace(steps):
    # listed from the top of the plan: the small parts last, the rows first
    assert shuffles(signals.compute_signals(steps))[0] == ["_key", "_key, _chunk"]
    # rows that arrive hashed by trace are split again
    assert shuffles(signals.compute_signals(steps.repartition("trace_id")))[0][:2] == ["_key", "_key, _chunk"]


def test_position_signals_combine_before_the_shuffle(steps):
    found, plan = shuffles(signals.compute_signals(steps, names=["ended_on_error", "hit_max_turns"]))
    assert found == ["_key"] and "partial_max" in plan and "Window" not in plan
    assert "extra" not in plan.split("ReadSchema")[1]


def test_renderings_limit_before_the_shuffle(steps):
    for df in (render.render_tail(steps), render.task_title(steps), render.task_text(steps)):
        found, plan = shuffles(df)
        assert found == ["trace_id"]
        assert plan.index("Final") < plan.index("Exchange") < plan.index("Partial")
    assert "tool_calls" not in shuffles(render.task_title(steps))[1].split("ReadSchema")[1]


def test_numbering_shuffles_rows_once(spark):
    df = spark.createDataFrame([("a", 1)], "k string, at long")
    found, _ = shuffles(number_in_key(df, "k", ["at"]))
    assert found.count("k, _slice") == 1


def test_ingest_shuffles_no_text(spark, folder):
    """Texts are written once and read again in place; only narrow columns are exchanged."""
    data = [(f"s{i}.jsonl", f"s{i}.jsonl", '{"type": "session_meta", "payload": {"id": "s%d"}}\n{"type": "response_item", "payload": {"type": "message", "role": "user", "content": "hi"}}' % (i % 7)) for i in range(20)]
    raw = spark.createDataFrame(data, "path string, file_name string, raw_blob string")
    done = ingest(raw, bronze=f"{folder}/bronze")
    for table in (done.traces, done.trajectories, done.steps):
        plan = table._jdf.queryExecution().executedPlan().toString().splitlines()
        moved = [below for line, below in zip(plan, plan[1:]) if " Exchange " in line]
        assert not [x for x in moved if "raw_blob" in x]
    assert "Exchange hashpartitioning" not in done.traces._jdf.queryExecution().executedPlan().toString()
    # ids that several files claim go to one of them, with its own text
    got = {r["id"]: r["path"] for r in done.traces.collect()}
    assert got == {f"s{i}": max(f"s{j}.jsonl" for j in range(20) if j % 7 == i) for i in range(7)}
    assert done.steps.count() == 7


def test_large_strata_are_cut_before_the_shuffle(spark):
    df = spark.range(40_000).selectExpr("id", "id % 2 AS stratum", "string(id) AS key")
    found = first_n_per_stratum(df, "stratum", 5_000, "key", ["id"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    # the first of each key, the first n of each lot, the first n of the stratum: each before its exchange
    assert plan.count("WindowGroupLimit") >= 2 * 3 and "5000, Partial" in plan
    assert found.groupBy("stratum").count().orderBy("stratum").collect() == [(0, 5_000), (1, 5_000)]
    assert found.agg({"id": "max"}).first()[0] == 9_999
