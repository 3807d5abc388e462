"""Renderings over conversations and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from stepwell.functions import text as T
from stepwell.operators import render as R
from stepwell.operators import upserts
from stepwell.workload import query
from stepwell.workload import bindings as B


def truncated(column: str, cap: int) -> str:
    """DuckDB twin of the truncation rule."""
    bare = f"trim({column}, E' \\t\\n\\r')"
    return (
        f"CASE WHEN length({bare}) <= {cap} THEN {bare} "
        f"ELSE rtrim(left({bare}, {cap - 1}), E' \\t\\n\\r') || '…' END"
    )


@query("truncate", f"SELECT doc_id, {truncated('text', 120)} AS lead FROM documents")
def truncate(spark, sf_dir):
    docs = B.table(spark, sf_dir, "documents")
    return docs.select("doc_id", T.truncate(F.col("text"), 120).alias("lead"))


@query(
    "text_markers",
    """SELECT doc_id,
        regexp_matches(text, '(?i)(?:^|\\s)(?:error:|license|keyerror)') AS has_marker,
        regexp_matches(text, '(?i)i (?:cannot|can[''’]t)|unable to complete|@') AS gives_up,
        doc_id % 3 = 0 AS encrypted, source = 'src1' AS exhausted
    FROM documents""",
)
def text_markers(spark, sf_dir):
    text = F.col("text")
    return B.table(spark, sf_dir, "documents").select(
        "doc_id",
        T.has_error_marker(text, r"(?i)(?:^|\s)(?:error:|license|keyerror)").alias("has_marker"),
        T.gives_up(text, "(?i)i (?:cannot|can['’]t)|unable to complete|@").alias("gives_up"),
        T.is_encrypted(F.expr("if(doc_id % 3 = 0, concat('[encrypted ', text, ']'), concat('not [encrypted ', text))")).alias("encrypted"),
        T.context_exhausted(F.expr("if(source = 'src1', 'exit_context', concat('exit_', source))")).alias("exhausted"),
    )


@query("text_hash", "SELECT doc_id, sha256(text) AS hash FROM documents")
def text_hash(spark, sf_dir):
    return B.table(spark, sf_dir, "documents").select("doc_id", T.text_hash(F.col("text")).alias("hash"))


@query(
    "stale_only",
    """SELECT d.doc_id::VARCHAR AS trace_id, sha256(d.text) AS source_text_hash FROM documents d
    WHERE NOT EXISTS (SELECT 1 FROM documents e WHERE e.doc_id = d.doc_id AND e.lang IN ('en', 'fr')
                      AND e.n_chars > 300)""",
)
def stale_only(spark, sf_dir):
    docs = B.table(spark, sf_dir, "documents")
    texts = docs.selectExpr("cast(doc_id as string) AS trace_id", "text")
    # vectors exist for two languages; those of short texts are out of date
    stored = docs.selectExpr(
        "cast(doc_id as string) AS trace_id",
        "if(n_chars > 300, sha2(text, 256), 'old') AS source_text_hash",
        "if(lang IN ('en', 'fr'), 'm1', 'm0') AS model",
    )
    return upserts.stale_only(texts, stored, "m1").select("trace_id", "source_text_hash")


@query(
    "task_text",
    f"""WITH {B.CONVERSATION_STEPS_SQL}
    SELECT trace_id, arg_min(message, step_id) AS task FROM conv
    WHERE source <> 'agent' AND trim(message) <> '' GROUP BY 1""",
)
def task_text(spark, sf_dir):
    return R.task_text(B.conversation_steps(spark, sf_dir))


LEAD_LINE_SQL = r"[trim(x) for x in regexp_split_to_array(message, '\r\n|\n|\r') if trim(x) <> ''][1]"


@query(
    "task_title",
    f"""WITH {B.CONVERSATION_STEPS_SQL},
    ranked AS (SELECT trace_id, {LEAD_LINE_SQL} AS lead, row_number() OVER (PARTITION BY trace_id ORDER BY
        CASE WHEN source = 'user' THEN 0 WHEN source = 'system' AND length(message) >= 80 THEN 1 ELSE 2 END, step_id) AS rn
        FROM conv WHERE trim(message) <> '')
    SELECT trace_id, CASE WHEN length(lead) <= 110 THEN lead ELSE rtrim(left(lead, 109)) || '...' END AS title
    FROM ranked WHERE rn = 1""",
)
def task_title(spark, sf_dir):
    return R.task_title(B.conversation_steps(spark, sf_dir))


def _tail_sql(tail: int, message_cap: int, index: str = "''", first: str = "") -> str:
    return f"""WITH {B.CONVERSATION_STEPS_SQL},
    n AS (SELECT trace_id, max(step_id) AS n FROM conv GROUP BY 1),
    lines AS (SELECT trace_id, step_id, n, {index} || '[' || source || '] ' || {truncated('message', message_cap)} AS line
              FROM conv JOIN n USING (trace_id) WHERE step_id > n - {tail})
    SELECT trace_id, CASE WHEN max(n) > {tail} THEN '(... ' || (max(n) - {tail}) || ' earlier steps omitted{first} ...)' || chr(10) ELSE '' END
        || string_agg(line, chr(10) ORDER BY step_id) AS conversation FROM lines GROUP BY 1"""


@query("render_tail", _tail_sql(3, 300))
def render_tail(spark, sf_dir):
    return R.render_tail(B.conversation_steps(spark, sf_dir), tail=3)


@query(
    "render_tail_indexed",
    _tail_sql(
        2, 80, "'[step ' || step_id || '] '", "; visible steps start at step ' || (max(n) - 1) || '"
    ),
)
def render_tail_indexed(spark, sf_dir):
    return R.render_tail(
        B.conversation_steps(spark, sf_dir), tail=2, message_cap=80, with_index=True
    )


def conversation_facts(spark, sf_dir):
    return B.table(spark, sf_dir, "conversations").groupBy(
        F.col("conv_id").cast("string").alias("trace_id")
    ).agg(
        F.lit("chat").alias("agent_name"),
        F.lit(None).cast("string").alias("model"),
        F.max(F.when(F.col("role") == "system", "unclear")).alias("failure_label"),
        F.lit(None).cast("string").alias("failure_label_reasoning"),
    )


@query(
    "searchable_text",
    f"""WITH {B.CONVERSATION_STEPS_SQL},
    n AS (SELECT trace_id, max(step_id) AS n, bool_or(source = 'system') AS labelled,
                 arg_min(message, step_id) FILTER (WHERE source <> 'agent') AS task FROM conv GROUP BY 1),
    body AS (SELECT trace_id, string_agg(step_id || '. [' || source || '] ' || {truncated('message', 220)}, chr(10) ORDER BY step_id) AS body
             FROM conv JOIN n USING (trace_id) WHERE step_id > n - 12 GROUP BY 1),
    parts AS (SELECT trace_id, 'Agent: chat' || chr(10) || 'Model: unknown' || chr(10) || 'Step count: ' || n
        || CASE WHEN labelled THEN chr(10) || 'Failure label: unclear' ELSE '' END
        || CASE WHEN task IS NOT NULL THEN chr(10) || 'Task: ' || {truncated('task', 600)} ELSE '' END AS header,
        CASE WHEN n > 12 THEN '(... ' || (n - 12) || ' earlier steps omitted ...)' || chr(10) ELSE '' END || body AS body
        FROM n JOIN body USING (trace_id)),
    joined AS (SELECT *, chr(10) || chr(10) || 'Conversation:' || chr(10) AS joint FROM parts)
    SELECT trace_id, CASE WHEN length(header || joint || body) <= 1500 THEN header || joint || body
        WHEN 1500 - length(header) - length(joint) - 32 <= 0 THEN {truncated('header', 1500)}
        ELSE header || joint || rtrim(left(body, 1500 - length(header) - length(joint) - 32), E' \\t\\n\\r') || chr(10) || '(... truncated ...)' END AS text
    FROM joined""",
)
def searchable_text(spark, sf_dir):
    return R.searchable_text(
        conversation_facts(spark, sf_dir), B.conversation_steps(spark, sf_dir), cap=1500
    )


@query(
    "searchable_text_calls",
    f"""WITH {B.EVENT_STEPS_SQL},
    n AS (SELECT trace_id, max(step_id) AS n,
                 arg_min(event_type || ' ' || event_id, step_id) FILTER (WHERE event_type = 'signup') AS task FROM ev GROUP BY 1),
    tools AS (SELECT trace_id, string_agg(event_type, ', ' ORDER BY first) AS tools FROM (
        SELECT trace_id, event_type, min(step_id) AS first FROM ev WHERE event_type <> 'signup' GROUP BY ALL) GROUP BY 1),
    body AS (SELECT trace_id, string_agg(step_id || '. [' || CASE WHEN event_type = 'signup' THEN 'user' ELSE 'agent' END || '] '
        || event_type || ' ' || event_id || CASE WHEN event_type <> 'signup' THEN ' {{' || event_type || '}}' ELSE '' END
        || CASE WHEN event_type = 'view' THEN ' -> seen ' || props ELSE '' END, chr(10) ORDER BY step_id) AS body
        FROM ev JOIN n USING (trace_id) WHERE step_id > n - 12 GROUP BY 1)
    SELECT trace_id, 'Agent: app' || chr(10) || 'Model: m1' || chr(10) || 'Step count: ' || n || chr(10)
        || 'Tools used: ' || tools || coalesce(chr(10) || 'Task: ' || task, '') || chr(10) || chr(10) || 'Conversation:' || chr(10)
        || CASE WHEN n > 12 THEN '(... ' || (n - 12) || ' earlier steps omitted ...)' || chr(10) ELSE '' END || body AS text
    FROM n JOIN tools USING (trace_id) JOIN body USING (trace_id)""",
)
def searchable_text_calls(spark, sf_dir):
    users = B.table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("trace_id"))
    none = F.lit(None).cast("string")
    facts = users.distinct().select(
        "trace_id",
        F.lit("app").alias("agent_name"),
        F.lit("m1").alias("model"),
        none.alias("failure_label"),
        none.alias("failure_label_reasoning"),
    )
    return R.searchable_text(facts, B.event_steps(spark, sf_dir))


@query(
    "tool_names",
    f"""WITH {B.EVENT_STEPS_SQL}, f AS (
        SELECT trace_id, event_type, min(step_id) AS first FROM ev WHERE event_type <> 'signup' GROUP BY ALL)
    SELECT trace_id, string_agg(event_type, ', ' ORDER BY first) AS tools FROM (
        SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY trace_id ORDER BY first) <= 3) GROUP BY 1""",
)
def tool_names(spark, sf_dir):
    return R.tool_names(B.event_steps(spark, sf_dir), shown=3)


@query(
    "prompt_facts",
    f"""WITH {B.EVENT_SIGNALS_SQL},
    c AS (SELECT trace_id, count(*) AS n, count(*) FILTER (WHERE event_type <> 'signup') AS calls FROM ev GROUP BY 1),
    f AS (SELECT trace_id, concat_ws(', ', CASE WHEN abandonment THEN 'abandonment' END,
        CASE WHEN ended_on_error THEN 'ended_on_error' END, CASE WHEN hit_max_turns THEN 'hit_max_turns' END,
        CASE WHEN incomplete_session THEN 'incomplete_session' END,
        CASE WHEN repeated_tool_call_loop THEN 'repeated_tool_call_loop' END) AS fired FROM sig)
    SELECT trace_id, '- Agent: app   Model: unknown' || chr(10) || '- Steps: ' || n || '    Tool calls: ' || calls || chr(10)
        || '- Rule-based signals fired: ' || CASE WHEN fired = '' THEN '(none)' ELSE fired END AS facts
    FROM c JOIN f USING (trace_id)""",
)
def prompt_facts(spark, sf_dir):
    from stepwell.workload.signals import event_signals

    users = B.table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("trace_id"))
    facts = users.distinct().select(
        "trace_id", F.lit("app").alias("agent_name"), F.lit(None).cast("string").alias("model")
    )
    return R.prompt_facts(facts, B.event_steps(spark, sf_dir), event_signals(spark, sf_dir))


@query(
    "compact_thread",
    f"""WITH {B.EVENT_STEPS_SQL}, n AS (SELECT trace_id, max(step_id) AS n FROM ev GROUP BY 1)
    SELECT trace_id, step_id::INTEGER AS step_id, CASE WHEN n > 65 THEN n - 30 ELSE 0 END::INTEGER AS omitted
    FROM ev JOIN n USING (trace_id) WHERE n <= 65 OR step_id <= 10 OR step_id > n - 20""",
)
def compact_thread(spark, sf_dir):
    steps = B.event_steps(spark, sf_dir).select("trace_id", "step_id", "message")
    return R.compact_thread(steps, limit=65, head=10, tail=20).select("trace_id", "step_id", "omitted")
