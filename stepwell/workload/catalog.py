"""Catalogue queries over orders, seen as traces."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from stepwell.functions import outcomes
from stepwell.operators import catalog as C
from stepwell.operators import reports as R
from stepwell.operators import labels, sampling, upserts
from stepwell.workload import query
from stepwell.workload import bindings as B

TRACES = f"WITH {B.ORDER_TRACES_SQL}"
# unknown counts and outcomes are shown as -1
COUNTS = ("num_steps", "num_tool_calls", "has_error")
SHOWN = [
    f"coalesce({c}, -1) AS {c}" if c in COUNTS else c for c in C.LIST_COLUMNS if c != "ingested_at"
]


def listed(df):
    return df.selectExpr(*SHOWN, "unix_micros(ingested_at) AS ingested_us")


SELECT = f"SELECT {', '.join(SHOWN)}, epoch_us(ingested_at) AS ingested_us FROM traces"


def _filtered(name: str, where: str, conditions: Callable[[], tuple[Column, ...]]) -> None:
    @query(name, f"{TRACES} {SELECT} WHERE {where}")
    def run(spark, sf_dir):
        return listed(C.matching(B.order_traces(spark, sf_dir), *conditions()))


_filtered("filter_has_error", "has_error = 1", lambda: (C.outcome_is("errors"),))
_filtered("filter_successes", "has_error = 0", lambda: (C.outcome_is("successes"),))
_filtered("filter_unknown", "has_error IS NULL", lambda: (C.outcome_is("unknown"),))
_filtered("filter_has_atif", "NOT has_atif", lambda: (~F.col("has_atif"),))
_filtered(
    "filter_steps", "num_steps BETWEEN 40 AND 90", lambda: (C.steps_between(40, 90),)
)
_filtered(
    "filter_in",
    "source_format IN ('atif', 'codex') AND agent_name IN ('codex') AND model IN ('gpt_5', 'sonnet-4') "
    "AND failure_label IN ('loop', 'gave_up')",
    lambda: (
        C.one_of("source_format", "atif", "codex"),
        C.one_of("agent_name", "codex"),
        C.one_of("model", "gpt_5", "sonnet-4"),
        C.one_of("failure_label", "loop", "gave_up"),
    ),
)
_filtered(
    "filter_search",
    "id ILIKE '%SWE-a_e%' OR agent_name ILIKE '%SWE-a_e%' OR model ILIKE '%SWE-a_e%'",
    lambda: (C.mentions("SWE-a_e"),),
)
_filtered(
    "filter_unrecovered",
    "two_events AND NOT (recovered_1 AND recovered_2)",
    lambda: (C.unrecovered(),),
)
_filtered(
    "filter_recovered_only",
    "has_error = 1 AND ultimately_succeeded = 1",
    lambda: (C.succeeded_after("errors"),),
)
_filtered(
    "filter_clean_only",
    "has_error = 0 AND ultimately_succeeded = 1",
    lambda: (C.succeeded_after("successes"),),
)

def failed_pages():
    return C.outcome_is("errors"), C.steps_between(low=20)


@query(
    "list_traces_page",
    f"""{TRACES} {SELECT} WHERE has_error = 1 AND num_steps >= 20
    ORDER BY ingested_at DESC, id ASC LIMIT 100 OFFSET 200""",
)
def list_traces_page(spark, sf_dir):
    page, _ = C.list_traces(B.order_traces(spark, sf_dir), *failed_pages(), limit=100, offset=200)
    return listed(page)


@query(
    "list_traces_total",
    f"{TRACES} SELECT count(*) AS total FROM traces WHERE has_error = 1 AND num_steps >= 20",
)
def list_traces_total(spark, sf_dir):
    _, total = C.list_traces(B.order_traces(spark, sf_dir), *failed_pages())
    return total


@query(
    "list_traces_after",
    f"""{TRACES} {SELECT} WHERE has_error = 1 AND num_steps >= 20
      AND (ingested_at < TIMESTAMP '1997-06-15' OR (ingested_at = TIMESTAMP '1997-06-15' AND id > '5'))
    ORDER BY ingested_at DESC, id ASC LIMIT 100""",
)
def list_traces_after(spark, sf_dir):
    last = (F.to_timestamp(F.lit("1997-06-15 00:00:00")), "5")
    return listed(C.list_after(B.order_traces(spark, sf_dir), last, *failed_pages()))


@query(
    "list_trace_ids",
    f"{TRACES} SELECT id FROM traces WHERE failure_label IN ('loop') ORDER BY id",
)
def list_trace_ids(spark, sf_dir):
    return C.list_trace_ids(B.order_traces(spark, sf_dir), C.one_of("failure_label", "loop"))


@query("get_trace", f"{TRACES} {SELECT} WHERE id = '77'")
def get_trace(spark, sf_dir):
    return listed(C.get_trace(B.order_traces(spark, sf_dir), "77"))


@query(
    "hydrate",
    f"""WITH {B.ORDER_TRACES_SQL}, hits AS (
        SELECT CAST(vec_id AS VARCHAR) AS trace_id, row_number() OVER (ORDER BY vec_id DESC) AS rank
        FROM embeddings)
    SELECT rank, trace_id, source_format, agent_name, coalesce(num_steps, -1) AS num_steps
    FROM hits JOIN traces ON hits.trace_id = traces.id""",
)
def hydrate(spark, sf_dir):
    # the vectors stand for ranked hits
    last = B.table(spark, sf_dir, "embeddings").agg(F.max("vec_id")).first()[0]
    hits = B.table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("string").alias("trace_id"), (last - F.col("vec_id") + 1).alias("rank")
    )
    return C.hydrate(hits, B.order_traces(spark, sf_dir)).selectExpr(
        "rank", "trace_id", "source_format", "agent_name", "coalesce(num_steps, -1) AS num_steps"
    )


@query(
    "trace_counts",
    f"""{TRACES} SELECT count(*) AS total, count(*) FILTER (WHERE has_atif) AS with_atif,
      count(*) FILTER (WHERE has_error = 1) AS errors, count(*) FILTER (WHERE has_error = 0) AS successes,
      count(*) FILTER (WHERE has_error IS NULL) AS unknown_outcome FROM traces""",
)
def trace_counts(spark, sf_dir):
    return C.trace_counts(B.order_traces(spark, sf_dir))


@query("count_traces", f"{TRACES} SELECT count(*) AS n FROM traces")
def count_traces(spark, sf_dir):
    return C.count_traces(B.order_traces(spark, sf_dir))


@query(
    "bounds",
    f"{TRACES} SELECT min(num_steps) AS min_steps, max(num_steps) AS max_steps FROM traces",
)
def bounds(spark, sf_dir):
    return C.bounds(B.order_traces(spark, sf_dir))


@query(
    "distinct_values",
    f"{TRACES} SELECT DISTINCT model AS value FROM traces WHERE model IS NOT NULL ORDER BY 1",
)
def distinct_values(spark, sf_dir):
    return C.distinct_values(B.order_traces(spark, sf_dir), "model")


@query("by_format", f"{TRACES} SELECT source_format, count(*) AS n FROM traces GROUP BY 1")
def by_format(spark, sf_dir):
    return R.by_format(B.order_traces(spark, sf_dir))


@query(
    "error_crosstab",
    f"""{TRACES} SELECT source_format, count(*) FILTER (WHERE has_error = 0) AS has_error_0,
      count(*) FILTER (WHERE has_error = 1) AS has_error_1,
      count(*) FILTER (WHERE has_error IS NULL) AS has_error_null FROM traces GROUP BY 1""",
)
def error_crosstab(spark, sf_dir):
    return R.error_crosstab(B.order_traces(spark, sf_dir))


@query(
    "model_outcomes",
    f"""{TRACES}, c AS (SELECT source_format, coalesce(model, '<null>') AS model, count(*) AS total,
      count(*) FILTER (WHERE has_error = 0) AS success, count(*) FILTER (WHERE has_error = 1) AS failure,
      count(*) FILTER (WHERE has_error IS NULL) AS unknown FROM traces GROUP BY ALL)
    SELECT *, round(success / nullif(success + failure, 0), 6) AS success_rate FROM c""",
)
def model_outcomes(spark, sf_dir):
    return R.model_outcomes(B.order_traces(spark, sf_dir)).withColumn(
        "success_rate", F.round("success_rate", 6)
    )


@query(
    "failure_modes",
    f"""{TRACES} SELECT source_format, failure_label AS mode, count(*) AS n FROM traces
      WHERE failure_label IS NOT NULL GROUP BY ALL""",
)
def failure_modes(spark, sf_dir):
    return R.failure_modes(B.order_traces(spark, sf_dir), "failure_label")


OUTCOME_SQL = """CASE WHEN has_error = 0 AND ultimately_succeeded = 1 THEN 'Success'
    WHEN has_error = 1 AND ultimately_succeeded = 1 THEN 'Recovered failure'
    WHEN has_error = 1 AND ultimately_succeeded = 0 THEN 'Failed'
    WHEN has_error = 0 AND ultimately_succeeded = 0 THEN 'Subtle failure' ELSE 'Unknown' END"""


@query("outcome_class", f"{TRACES} SELECT id, {OUTCOME_SQL} AS outcome FROM traces")
def outcome_class(spark, sf_dir):
    chip = outcomes.outcome(F.col("has_error"), F.col("ultimately_succeeded"))
    return B.order_traces(spark, sf_dir).select("id", chip.alias("outcome"))


VALID_SQL = """CASE WHEN NOT has_events THEN NULL WHEN NOT two_events THEN true ELSE
    label_1 <> 'no_such_label' AND start_1 >= 1 AND end_1 >= start_1
    AND (NOT recovered_1 OR recovery_1 >= end_1) AND (NOT recovered_2 OR trim(summary_2) <> '') END"""


@query(
    "validate_events",
    f"""WITH {B.ORDER_TRACES_SQL}, v AS (SELECT *, {VALID_SQL} AS valid FROM traces)
    SELECT id, coalesce(valid, false) AS valid, CAST(CASE WHEN valid THEN CASE WHEN two_events THEN 2 ELSE 0 END ELSE -1 END AS INTEGER) AS n_events,
           (CASE WHEN valid AND two_events AND recovered_1 THEN recovery_1 ELSE -1 END)::INTEGER AS recovery_1 FROM v""",
)
def validate_events(spark, sf_dir):
    clean = outcomes.validate_events(F.col("failure_events"))
    return (
        B.order_traces(spark, sf_dir)
        .select("id", clean.alias("clean"))
        .selectExpr(
            "id",
            "clean IS NOT NULL AS valid",
            "if(clean IS NULL, -1, size(clean)) AS n_events",
            "coalesce(get(clean, 0).recovery_step, -1) AS recovery_1",
        )
    )


SEVERITY_SQL = f"list_position({list(outcomes.SEVERITY)}, {{}})"


@query(
    "event_list_summary",
    f"""{TRACES} SELECT id,
      CASE WHEN NOT coalesce(two_events, false) THEN 'success'
           WHEN NOT recovered_1 AND NOT recovered_2 THEN
               CASE WHEN label_1 = 'no_such_label' OR {SEVERITY_SQL.format('label_1')} > {SEVERITY_SQL.format("'loop'")} THEN 'loop' ELSE label_1 END
           WHEN NOT recovered_1 THEN label_1 WHEN NOT recovered_2 THEN 'loop' ELSE 'success' END AS summary_label,
      coalesce(ultimately_succeeded,
               CASE WHEN two_events AND NOT (recovered_1 AND recovered_2) THEN 0 ELSE 1 END) AS ultimately_succeeded
    FROM traces""",
)
def event_list_summary(spark, sf_dir):
    events = F.col("failure_events")
    return B.order_traces(spark, sf_dir).select(
        "id",
        outcomes.summary_label(events).alias("summary_label"),
        outcomes.ultimately_succeeded(events, F.col("ultimately_succeeded")).alias(
            "ultimately_succeeded"
        ),
    )


@query(
    "recoveries",
    f"""{TRACES} SELECT id, label, summary, recovery_step::INTEGER AS recovery_step FROM (
        SELECT id, label_1 AS label, 'changed plan' AS summary, recovery_1 AS recovery_step
        FROM traces WHERE two_events AND recovered_1
        UNION ALL
        SELECT id, 'loop', trim(summary_2), 31 FROM traces
        WHERE two_events AND recovered_2 AND trim(summary_2) <> '')""",
)
def recoveries(spark, sf_dir):
    return (
        B.order_traces(spark, sf_dir)
        .select("id", F.explode(outcomes.recoveries(F.col("failure_events"))).alias("r"))
        .select("id", "r.*")
    )


@query(
    "with_severity",
    f"""WITH {B.FAILURE_EVENT_ROWS_SQL}
    SELECT trace_id, step_id AS step_start, label,
           CAST({SEVERITY_SQL.format('label')} - 1 AS INTEGER) AS severity FROM fe""",
)
def with_severity(spark, sf_dir):
    # eleven rows, one per label of a fixed vocabulary
    dimension = F.broadcast(outcomes.label_table(spark).select("label", "severity"))
    return (
        B.failure_event_rows(spark, sf_dir)
        .join(dimension, "label")
        .select("trace_id", "step_start", "label", "severity")
    )


@query(
    "event_targets",
    f"""{TRACES} SELECT id FROM traces
      WHERE has_atif AND (has_error = 1 OR failure_label IS NOT NULL) AND NOT has_events""",
)
def event_targets(spark, sf_dir):
    return C.event_targets(B.order_traces(spark, sf_dir)).select("id")


@query(
    "recovered_pool_size",
    f"{TRACES} SELECT count(*) AS candidates FROM traces WHERE two_events AND (recovered_1 OR recovered_2)",
)
def recovered_pool_size(spark, sf_dir):
    return C.recovered_pool(B.order_traces(spark, sf_dir)).agg(F.count("*").alias("candidates"))


@query(
    "structured_query",
    """SELECT o_orderkey, o_totalprice <= 300000 AND o_orderstatus <> 'P' AS valid,
      CASE WHEN o_totalprice <= 300000 AND o_orderstatus <> 'P' THEN
        CASE o_orderpriority WHEN '1-URGENT' THEN 'errors' WHEN '2-HIGH' THEN 'successes' ELSE 'any' END END AS has_error
    FROM orders""",
)
def structured_query(spark, sf_dir):
    record = F.expr(
        """named_struct('semantic_intent', if(o_orderstatus = 'P', ' ', 'find loops'),
        'explanation', 'why', 'failure_label', array(if(o_totalprice > 300000, 'nope', 'loop')),
        'agent_name', cast(NULL as array<string>), 'source_format', array('codex'),
        'has_error', CASE o_orderpriority WHEN '1-URGENT' THEN true WHEN '2-HIGH' THEN false END)"""
    )
    return (
        B.table(spark, sf_dir, "orders")
        .withColumn("record", record)
        .select("o_orderkey", C.filter_from_query(F.col("record")).alias("f"))
        .selectExpr("o_orderkey", "f IS NOT NULL AS valid", "f.has_error AS has_error")
    )


@query(
    "judge_targets",
    f"""{TRACES}, pool AS (SELECT * FROM traces WHERE has_atif AND failure_label IS NULL)
    SELECT count(*) FILTER (WHERE has_error = 1)
           + CAST(round_even(count(*) FILTER (WHERE has_error = 0) * 0.1, 0) AS BIGINT) AS n,
           count(*) FILTER (WHERE has_error = 1) AS n_failures FROM pool""",
)
def judge_targets(spark, sf_dir):
    return sampling.judge_sample(B.order_traces(spark, sf_dir)).agg(
        F.count("*").alias("n"), F.sum((F.col("has_error") == 1).cast("long")).alias("n_failures")
    )


# the same seeded order in SQL
HASHED = "CAST('0x' || substr(md5('42/' || {key}), 1, 15) AS BIGINT)"


@query(
    "judge_sample",
    f"""{TRACES}, pool AS (SELECT * FROM traces WHERE has_atif AND failure_label IS NULL),
    good AS (SELECT *, row_number() OVER (ORDER BY {HASHED.format(key="id")}, id) AS rk FROM pool WHERE has_error = 0)
    SELECT 0 AS sample_class, id, has_error FROM pool WHERE has_error = 1
    UNION ALL SELECT 1, id, has_error FROM good
    WHERE rk <= (SELECT CAST(round_even(count(*) * 0.1, 0) AS BIGINT) FROM good)""",
)
def judge_sample(spark, sf_dir):
    return sampling.judge_sample(B.order_traces(spark, sf_dir)).select(
        "sample_class", "id", "has_error"
    )


# Two responses per order: one that is written, and one of a scorer that was run again.

@query(
    "apply_labels",
    f"""{TRACES}, r AS (
        SELECT id, CASE WHEN num_steps % 3 = 0 THEN 'no_such_label' WHEN num_steps % 2 = 0 THEN 'loop' ELSE 'gave_up' END AS label,
               'why ' || num_tool_calls AS reasoning FROM traces WHERE num_steps IS NOT NULL)
    SELECT traces.id, CASE WHEN r.label IN ('loop', 'gave_up') THEN r.label ELSE failure_label END AS failure_label,
           CASE WHEN r.label IN ('loop', 'gave_up') THEN reasoning ELSE '' END AS reasoning,
           CASE WHEN r.label IN ('loop', 'gave_up') THEN 'sonnet_judge' ELSE '' END AS source
    FROM traces LEFT JOIN r ON r.id = traces.id""",
)
def apply_labels(spark, sf_dir):
    traces = B.order_traces(spark, sf_dir).withColumns(
        {c: F.lit(None).cast("string") for c in ("failure_label_source", "failure_label_reasoning")}
    )
    first = traces.filter("num_steps IS NOT NULL").selectExpr(
        "id AS trace_id",
        "CASE WHEN num_steps % 3 = 0 THEN 'no_such_label' WHEN num_steps % 2 = 0 THEN 'loop' ELSE 'gave_up' END AS label",
        "concat(' why ', num_tool_calls, ' ') AS reasoning",
        "2 AS answered",
    )
    earlier = first.selectExpr("trace_id", "'loop' AS label", "'an earlier run' AS reasoning", "1 AS answered")
    earlier = earlier.join(first.filter("label <> 'no_such_label'").select("trace_id"), "trace_id", "left_semi")
    merged = labels.apply_labels(traces, first.union(earlier).union(first), order=[F.col("answered").desc()])
    return merged.selectExpr(
        "id", "failure_label", "coalesce(failure_label_reasoning, '') AS reasoning", "coalesce(failure_label_source, '') AS source"
    )


@query(
    "apply_events",
    f"""{TRACES}, r AS (
        SELECT id, CASE WHEN num_steps % 2 = 0 THEN 'loop' ELSE 'gave_up' END AS label, num_steps % 5 = 0 AS recovered,
               num_steps >= 1 AND num_steps % 7 <> 0 AS valid FROM traces WHERE num_steps IS NOT NULL)
    SELECT traces.id, CASE WHEN valid THEN CASE WHEN recovered THEN 'success' ELSE label END ELSE failure_label END AS failure_label,
           CASE WHEN valid THEN 1 ELSE coalesce(has_error, -1) END AS has_error,
           CASE WHEN valid THEN 'opus_events_derived' ELSE '' END AS source,
           CASE WHEN valid THEN 1 ELSE -1 END AS n_events
    FROM traces LEFT JOIN r ON r.id = traces.id""",
)
def apply_events(spark, sf_dir):
    traces = B.order_traces(spark, sf_dir).withColumn("failure_label_source", F.lit(None).cast("string"))
    traces = traces.withColumn("failure_events", F.lit(None).cast(outcomes.EVENT_SCHEMA))
    event = """array(named_struct('label', CASE WHEN num_steps % 7 = 0 THEN 'no_such_label' WHEN num_steps % 2 = 0 THEN 'loop'
        ELSE 'gave_up' END, 'step_start', 1, 'step_end', num_steps, 'recovered', num_steps % 5 = 0,
        'recovery_step', if(num_steps % 5 = 0, num_steps, NULL), 'recovery_summary', if(num_steps % 5 = 0, 'went on', NULL)))"""
    counted = traces.filter("num_steps IS NOT NULL")
    first = counted.selectExpr("id AS trace_id", f"cast({event} as {outcomes.EVENT_SCHEMA}) AS events", "2 AS answered")
    earlier = counted.filter("num_steps >= 1 AND num_steps % 7 <> 0").selectExpr(
        "id AS trace_id", f"cast(array() as {outcomes.EVENT_SCHEMA}) AS events", "1 AS answered"
    )
    merged = labels.apply_events(traces, first.union(earlier).union(first), order=[F.col("answered").desc()])
    return merged.selectExpr(
        "id",
        "failure_label",
        "coalesce(has_error, -1) AS has_error",
        "coalesce(failure_label_source, '') AS source",
        "coalesce(size(failure_events), -1) AS n_events",
    )


@query(
    "backfill_provenance",
    f"""{TRACES} SELECT id, CASE WHEN failure_label IS NULL THEN NULL
      WHEN source_format = 'swe_agent' THEN 'swe_agent_target' ELSE 'sonnet_judge' END AS failure_label_source
    FROM traces""",
)
def backfill_provenance(spark, sf_dir):
    traces = B.order_traces(spark, sf_dir).withColumn(
        "failure_label_source", F.lit(None).cast("string")
    )
    return upserts.backfill_label_source(traces).select("id", "failure_label_source")


@query(
    "backfill_outcome",
    f"""{TRACES} SELECT id, coalesce(CASE WHEN source_format = 'swe_agent' THEN
        coalesce(ultimately_succeeded, CASE WHEN has_error IS NULL THEN 1 ELSE 1 - has_error END)
        ELSE ultimately_succeeded END, -1) AS ultimately_succeeded FROM traces""",
)
def backfill_outcome(spark, sf_dir):
    target = F.coalesce(F.col("has_error") == 0, F.lit(True))
    filled = upserts.backfill_outcome(B.order_traces(spark, sf_dir), target)
    return filled.selectExpr("id", "coalesce(ultimately_succeeded, -1) AS ultimately_succeeded")


@query(
    "outcome_violations",
    f"""{TRACES} SELECT id FROM traces WHERE source_format = 'swe_agent'
      AND ultimately_succeeded IS NULL AND has_error = 0""",
)
def outcome_violations(spark, sf_dir):
    # every target says "failed", so the rows known as successes contradict it
    return upserts.outcome_violations(B.order_traces(spark, sf_dir), F.lit(False)).select("id")


@query(
    "upsert_last_wins",
    """WITH batch AS (
        SELECT l_orderkey AS id, arg_max(l_extendedprice, (l_shipdate, l_linenumber, l_partkey, l_suppkey, l_extendedprice)) AS price
        FROM lineitem GROUP BY 1)
    SELECT id, price, 'batch' AS origin FROM batch
    UNION ALL
    SELECT o_orderkey, o_totalprice, 'existing' FROM orders
    WHERE NOT EXISTS (SELECT 1 FROM batch WHERE batch.id = o_orderkey)""",
)
def upsert_last_wins(spark, sf_dir):
    existing = B.table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS id", "o_totalprice AS price", "'existing' AS origin"
    )
    writes = B.table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey AS id",
        "l_extendedprice AS price",
        "'batch' AS origin",
        "struct(l_shipdate, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS _at",
    )
    return upserts.upsert(existing, writes, "id", F.col("_at").desc()).drop("_at")


@query(
    "drop_replaced",
    """SELECT vec_id FROM embeddings WHERE vec_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')""",
)
def drop_replaced(spark, sf_dir):
    replaced = B.table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").selectExpr("o_orderkey AS id")
    return upserts.drop_replaced(
        B.table(spark, sf_dir, "embeddings").select("vec_id"), replaced, "vec_id"
    )


@query(
    "unstaged_only",
    """SELECT page_id FROM pages p WHERE NOT EXISTS (
        SELECT 1 FROM documents d WHERE d.doc_id = p.page_id AND d.n_chars // 1000 = length(p.html) // 1000)""",
)
def unstaged_only(spark, sf_dir):
    day = "timestamp_seconds(1700000000)"
    files = B.table(spark, sf_dir, "pages").selectExpr(
        "page_id", "concat('f/', page_id) AS path", "length(html) div 1000 AS size", f"{day} AS mtime"
    )
    staged = B.table(spark, sf_dir, "documents").selectExpr(
        "concat('f/', doc_id) AS path", "n_chars div 1000 AS size", f"{day} + interval 5 milliseconds AS mtime"
    )
    return upserts.unstaged_only(files, staged).select("page_id")
