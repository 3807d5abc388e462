"""Headline queries at one scale; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from stepwell import workload  # noqa: E402
from stepwell.session import local_session  # noqa: E402

HEADLINE = (
    "compute_signals",
    "detect_summary",
    "list_traces_page",
    "trace_counts",
    "model_outcomes",
    "confusion_matrix",
    "find_similar",
    "similarity_join",
    "recommendations",
    "searchable_text",
    "searchable_text_calls",
    "render_tail",
    "task_title",
    "stale_only",
    "summary_label",
    "upsert_last_wins",
    "normalize_codex",
    "normalize_claude_code",
    "settled_paths",
    "budget_prefix",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = os.environ.get("BENCH_QUERIES")
    names = wanted.split(",") if wanted else HEADLINE
    workload.load_all()
    spark = local_session(cpus, app="stepwell-bench")
    seconds: dict[str, float] = {}
    first: dict[str, float] = {}
    for name in names:
        # the first run starts Python workers and compiles the generated code
        for times in (first, seconds):
            start = time.perf_counter()
            df = workload.QUERIES[name](spark, sf_dir)
            df.write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - start, 3)
    version = spark.version
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "first_run": first,
                "first_run_total": round(sum(first.values()), 3),
                "timing": "second run of each query in one session; first_run is the cold one",
                "spark": version,
                "master": f"local[{cpus}]",
            }
        )
    )


if __name__ == "__main__":
    main()
