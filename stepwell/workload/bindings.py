"""How the given tables play the parts of traces, steps, vectors and raw files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from stepwell.functions.outcomes import EVENT_SCHEMA, LABEL_NAMES
from stepwell.operators.sequencing import number_in_key
from stepwell.operators.signals import StepRoles
from stepwell.sources.sessions import CALLS, RESULTS


_SCHEMAS: dict[str, StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; its schema is read from the files once per process."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table as a stream; it may be one file or a folder of files."""
    schema = table(spark, sf_dir, name).schema
    # a pattern, as a stream takes the plain name of a folder only
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parque[t]")


# --- conversations: message-only traces -------------------------------------------------


def conversation_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").selectExpr(
        "cast(conv_id as string) AS trace_id",
        "int(turn + 1) AS step_id",
        "if(role = 'assistant', 'agent', role) AS source",
        "text AS message",
        f"cast(NULL as {CALLS}) AS tool_calls",
        f"cast(NULL as {RESULTS}) AS results",
    )


CONVERSATION_STEPS_SQL = """conv AS (
    SELECT CAST(conv_id AS VARCHAR) AS trace_id, CAST(turn + 1 AS INTEGER) AS step_id,
           CASE WHEN role = 'assistant' THEN 'agent' ELSE role END AS source, text AS message
    FROM conversations)"""


# --- events: tool-call traces, one per user ---------------------------------------------


def numbered_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with their position in the trace of their user; ``chunk`` is the slice."""
    events = table(spark, sf_dir, "events").withColumn("trace_id", F.col("user_id").cast("string"))
    return number_in_key(
        events,
        "trace_id",
        ["ts", "event_id"],
        keep_slice="chunk",
    )


def event_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical steps: sign-ups are user turns, all else calls; views bring results."""
    return numbered_events(spark, sf_dir).selectExpr(
        "trace_id",
        "int(step_id) AS step_id",
        "chunk",
        "if(event_type = 'signup', 'user', 'agent') AS source",
        "concat(event_type, ' ', event_id) AS message",
        f"""cast(if(event_type = 'signup', NULL, array(named_struct('tool_call_id',
            cast(event_id as string), 'function_name', event_type, 'arguments', props,
            'extra', NULL))) as {CALLS}) AS tool_calls""",
        f"""cast(if(event_type = 'view', array(named_struct('source_call_id',
            cast(event_id as string), 'content', concat('seen ', props), 'text',
            concat('seen ', props), 'extra', NULL)), NULL) as {RESULTS}) AS results""",
    )


EVENT_STEPS_SQL = """ev AS (
    SELECT CAST(user_id AS VARCHAR) AS trace_id, event_id, ts, event_type, value, props, user_id,
           row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step_id
    FROM events)"""

# thresholds that split the users of the events table
EVENT_TURNS = 65
EVENT_REPEAT = 5


def event_roles() -> StepRoles:
    kind = F.col("event_type")
    return StepRoles(
        signature=kind,
        loop_source=F.lit("agent"),
        is_agent=F.lit(True),
        is_error=kind == "error",
        speaks=kind == "purchase",
        gives_up=F.col("props").rlike('"k": [0-9]}'),
        has_calls=kind == "click",
        has_results=kind == "view",
    )


EVENT_SIGNALS_SQL = f"""{EVENT_STEPS_SQL},
runs AS (
    SELECT trace_id, event_type, step_id - row_number() OVER (
        PARTITION BY trace_id, event_type ORDER BY step_id) AS run FROM ev),
longest AS (
    SELECT trace_id, max(n) AS longest_run
    FROM (SELECT trace_id, event_type, run, count(*) AS n FROM runs GROUP BY ALL) GROUP BY 1),
facts AS (
    SELECT trace_id, count(*) AS n,
           max(CASE WHEN event_type = 'error' THEN step_id ELSE 0 END) AS last_error,
           max(CASE WHEN event_type = 'click' THEN step_id ELSE 0 END) AS last_call,
           max(CASE WHEN event_type = 'view' THEN step_id ELSE 0 END) AS last_result,
           arg_max(regexp_matches(props, '"k": [0-9]}}'), step_id)
               FILTER (WHERE event_type = 'purchase') AS gives_up
    FROM ev GROUP BY 1),
sig AS (
    SELECT trace_id,
           n >= {EVENT_TURNS} AS hit_max_turns,
           longest_run >= {EVENT_REPEAT} AS repeated_tool_call_loop,
           last_error = n AS ended_on_error,
           coalesce(gives_up, false) AS abandonment,
           last_call > last_result AS incomplete_session
    FROM facts JOIN longest USING (trace_id))"""


def failure_event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One failure event per error event; recovered when its value is high."""
    k = F.get_json_object("props", "$.k").cast("int")
    return (
        numbered_events(spark, sf_dir)
        .filter("event_type = 'error'")
        .select(
            "trace_id",
            F.get(F.array(*[F.lit(n) for n in LABEL_NAMES]), F.least(F.floor(k / 9), F.lit(10)).cast("int")).alias("label"),
            F.col("step_id").alias("step_start"),
            F.col("step_id").alias("step_end"),
            (F.col("value") >= 15).alias("recovered"),
        )
    )


LABEL_LIST_SQL = "[" + ", ".join(f"'{n}'" for n in LABEL_NAMES) + "]"

FAILURE_EVENT_ROWS_SQL = f"""{EVENT_STEPS_SQL},
fe AS (
    SELECT trace_id, step_id,
           {LABEL_LIST_SQL}[least(CAST(json_extract(props, '$.k') AS INTEGER) // 9, 10) + 1] AS label,
           value >= 15 AS recovered
    FROM ev WHERE event_type = 'error')"""


# --- orders: the catalogue of traces, one per row ----------------------------------------

FORMAT_OF_PRIORITY = (
    ("1-URGENT", "atif"),
    ("2-HIGH", "claude_code"),
    ("3-MEDIUM", "codex"),
    ("4-NOT SPECIFIED", "cursor"),
    ("5-LOW", "swe_agent"),
)
AGENT_OF_STATUS = (("F", "Swe-Agent"), ("O", "codex"), ("P", "claude_code"))


def _case(column: str, pairs: tuple[tuple[str, str], ...]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in pairs) + " END"


# the same text is valid in both dialects
TRACE_COLUMNS = {
    "id": "CAST(o_orderkey AS {string})",
    "source_format": _case("o_orderpriority", FORMAT_OF_PRIORITY),
    "agent_name": _case("o_orderstatus", AGENT_OF_STATUS),
    "model": "CASE WHEN month(o_orderdate) <= 3 THEN 'gpt_5' WHEN month(o_orderdate) <= 8 THEN 'sonnet-4' "
    "WHEN month(o_orderdate) <= 11 THEN 'llama-70b' END",
    "num_steps": "CASE WHEN o_totalprice < 480000 THEN CAST(floor(o_totalprice / 2500) AS INTEGER) END",
    "num_tool_calls": "CASE WHEN o_totalprice < 480000 THEN CAST(floor(o_totalprice / 7000) AS INTEGER) END",
    "has_atif": "o_totalprice < 480000",
    "has_error": "CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 0 END",
    "ultimately_succeeded": "CASE WHEN o_totalprice > 300000 THEN 1 WHEN o_totalprice < 150000 THEN 0 END",
    "failure_label": "CASE WHEN o_totalprice > 400000 THEN 'loop' WHEN o_totalprice > 300000 THEN 'gave_up' "
    "WHEN o_totalprice > 250000 THEN 'success' END",
    "ingested_at": "CAST(o_orderdate AS TIMESTAMP)",
}


def order_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    columns = [f"{sql.format(string='string')} AS {name}" for name, sql in TRACE_COLUMNS.items()]
    return orders.selectExpr(*columns, f"{ORDER_EVENTS} AS failure_events")


# Two failure events per order, built from its own columns; some break the contract.
ORDER_EVENTS = f"""cast(CASE WHEN o_orderstatus = 'P' THEN NULL WHEN o_totalprice < 30000 THEN array()
    ELSE array(
        named_struct('label', if(o_totalprice < 60000, 'no_such_label',
                array({", ".join(f"'{n}'" for n in LABEL_NAMES)})[int(o_totalprice / 50000)]),
            'step_start', int(day(o_orderdate)), 'step_end', int(day(o_orderdate) + month(o_orderdate) - 2),
            'recovered', o_totalprice > 200000,
            'recovery_step', int(day(o_orderdate) + 12), 'recovery_summary', '  changed plan '),
        named_struct('label', 'loop', 'step_start', 30, 'step_end', 31,
            'recovered', o_orderstatus = 'O',
            'recovery_step', 31, 'recovery_summary', if(day(o_orderdate) = 5, ' ', 'stopped retrying')))
    END as {EVENT_SCHEMA})"""

# the same events as scalar columns, for the SQL twins
ORDER_TRACES_SQL = f"""traces AS (
    SELECT {", ".join(f"{sql.format(string='VARCHAR')} AS {name}" for name, sql in TRACE_COLUMNS.items())},
           o_orderstatus <> 'P' AS has_events,
           o_orderstatus <> 'P' AND o_totalprice >= 30000 AS two_events,
           CASE WHEN o_totalprice < 60000 THEN 'no_such_label'
                ELSE {LABEL_LIST_SQL}[CAST(floor(o_totalprice / 50000) AS INTEGER) + 1] END AS label_1,
           day(o_orderdate) AS start_1, day(o_orderdate) + month(o_orderdate) - 2 AS end_1,
           o_totalprice > 200000 AS recovered_1, day(o_orderdate) + 12 AS recovery_1,
           o_orderstatus = 'O' AS recovered_2,
           CASE WHEN day(o_orderdate) = 5 THEN ' ' ELSE 'stopped retrying' END AS summary_2
    FROM orders)"""


# --- embeddings --------------------------------------------------------------------------


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").selectExpr(
        "cast(vec_id as string) AS trace_id", "embedding", "label"
    )


def first_query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    """The first benchmark vector: the one with the smallest id."""
    rows = table(spark, sf_dir, "embeddings")
    return list(rows.orderBy("vec_id").select("embedding").first()["embedding"])


