from __future__ import annotations

import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from stepwell.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, app="stepwell-tests")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    yield session
    session.stop()


@pytest.fixture
def folder():
    """A new scratch folder that is left behind."""
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def rows(df, *order):
    """Collected rows as dicts, ordered when column names are given."""
    if order:
        df = df.orderBy(*order)
    return [r.asDict(True) for r in df.collect()]


STEP_SCHEMA = (
    "trace_id string, step_id int, source string, message string, "
    "tool_calls array<struct<tool_call_id:string,function_name:string,arguments:string,extra:string>>, "
    "results array<struct<source_call_id:string,content:string,text:string,extra:string>>"
)


def step(source, message="", calls=None, results=None):
    """One step; calls are (name, arguments) pairs, results are texts."""
    return (
        source,
        message,
        None if calls is None else [(f"c{i}", n, a, None) for i, (n, a) in enumerate(calls)],
        None if results is None else [("c0", t, t, None) for t in results],
    )


def steps_frame(spark, traces):
    data = [
        (trace_id, i + 1, *s) for trace_id, steps in traces.items() for i, s in enumerate(steps)
    ]
    return spark.createDataFrame(data, STEP_SCHEMA)
