"""Sessions whose lines arrive bit by bit."""

import datetime
import json

from stepwell.plans.tables import current
from stepwell.streaming import appended as A


def test_the_state_of_a_batch_runs_once(spark, folder, monkeypatch):
    events = [{"type": "session_meta", "payload": {"id": "s"}}]
    events += [{"type": "response_item", "payload": {"type": "message", "role": "user", "content": m}} for m in ("hi", "more")]
    start = datetime.datetime(2024, 1, 1)
    data = [("s.jsonl", i, json.dumps(e), start) for i, e in enumerate(events)]
    data += [(None, None, None, start + datetime.timedelta(days=1))]
    spark.createDataFrame(data, A.LINE_SCHEMA).coalesce(1).write.parquet(f"{folder}/in")
    A.store_lines(spark.readStream.schema(A.LINE_SCHEMA).parquet(f"{folder}/in"), f"{folder}/out").awaitTermination()
    whole, seen = A.whole_sessions, []

    def watched(lines, settled):
        seen.append(settled._jdf.queryExecution().toRdd().toDebugString())
        return whole(lines, settled)

    monkeypatch.setattr(A, "whole_sessions", watched)
    A.ingest_appended(spark, f"{folder}/out", debounce=600).awaitTermination()
    assert [(r["id"], r["num_steps"]) for r in current(spark, f"{folder}/out/traces").collect()] == [("s", 2)]
    # the settled paths are read back, not worked out from the state once more
    assert seen and not any("StateStore" in lineage for lineage in seen)
