"""Scans, adapter details and plug-ins over the given tables, each with its SQL twin."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from stepwell.functions import text as T
from stepwell.operators import scoring, signals, similarity
from stepwell.plans.ingest import redact_steps
from stepwell.plans.tables import read_batches, write_batch
from stepwell.session import new_folder
from stepwell.sources import codex, native, registry, swe_agent
from stepwell.sources import files as S
from stepwell.sources import sessions as N
from stepwell.sources.detect import detect_format
from stepwell.sources.session_files import write_session_files
from stepwell.workload import bindings as B
from stepwell.workload import query
from stepwell.workload import raw_files as W

# --- scans --------------------------------------------------------------------------------


@query("utf8_scan", "SELECT page_id, url || chr(65533) || 'x' AS line FROM pages")
def utf8_scan(spark, sf_dir):
    """Lines with a broken byte each, written as they are and read with replacement."""
    folder = new_folder(spark)
    line = F.concat(F.concat(F.col("page_id").cast("string"), F.lit("\t"), F.col("url")).cast("binary"), F.unhex(F.lit("FF78"))).cast("string")
    B.table(spark, sf_dir, "pages").select(line.alias("value")).write.text(folder)
    read = S.read_sessions(spark, folder).select(F.explode(F.split("raw_blob", "\n")).alias("line")).filter("line <> ''")
    return read.selectExpr("bigint(split(line, '\\t')[0]) AS page_id", "split(line, '\\t')[1] AS line")


@query(
    "cursor_folder",
    f"WITH {W.FILES_SQL} SELECT doc AS id, 'cursor' AS source_format, conv_id % 2 = 0 AS export FROM turns GROUP BY doc, conv_id",
)
def cursor_folder(spark, sf_dir):
    """A folder with exports under both names; other files are left alone."""
    folder = new_folder(spark)
    raw = W.cursor_files(W.conversation_files(spark, sf_dir))
    name = F.expr("if(path RLIKE '[02468][.]cursor[.]json$', path, replace(path, '.cursor.json', '.json'))")
    files = raw.select(name.alias("file_name"), F.col("raw_blob").alias("text"))
    notes = raw.select(F.concat("path", F.lit(".txt")).alias("file_name"), F.lit("note").alias("text"))
    write_session_files(files.union(notes), folder)
    found = S.read_collection(spark, folder, "cursor")
    return found.select(
        F.expr("split(file_name, '[.]')[0] AS id"), detect_format().alias("source_format"), F.col("file_name").endswith(".cursor.json").alias("export")
    )


@query(
    "benchmark_rows",
    f"""WITH {W.FILES_SQL} SELECT doc AS trace_id, count(*) FILTER (WHERE trim(text) <> '')::INTEGER AS n_steps,
        count(*) > 5 AS resolved FROM turns GROUP BY doc""",
)
def benchmark_rows(spark, sf_dir):
    """Benchmark rows with a nested trajectory, from Parquet to sessions."""
    folder = new_folder(spark)
    entry = "transform(turns, t -> named_struct('role', if(t.role = 'assistant', 'ai', t.role), 'text', t.text, 'system_prompt', string(NULL)))"
    W.conversation_files(spark, sf_dir).selectExpr(
        "doc AS instance_id", "'llama' AS model_name", "size(turns) > 5 AS target", f"{entry} AS trajectory"
    ).write.parquet(folder)
    found = swe_agent.normalize(S.read_benchmark_rows(spark, folder))
    return found.selectExpr("header.session_id AS trace_id", "size(steps) AS n_steps", "header.resolved AS resolved")


@query(
    "manifest_rows",
    """SELECT 's' || s_suppkey AS task, CASE WHEN s_suppkey % 3 = 0 THEN 'loop' END AS label, s_suppkey % 2 = 0 AS ok,
        (s_suppkey % 40)::INTEGER AS n_steps, s_nationkey AS input_tokens FROM supplier""",
)
def manifest_rows(spark, sf_dir):
    """One manifest per nation, one result per supplier."""
    folder = new_folder(spark)
    result = """named_struct('spec', named_struct('output_format', 'codex', 'primary_failure', if(s_suppkey % 3 = 0, 'loop', NULL), 'task', concat('s', s_suppkey)),
        'ok', s_suppkey % 2 = 0, 'attempts', 1, 'cost', named_struct('input_tokens', s_nationkey), 'atif_summary', named_struct('n_steps', s_suppkey % 40))"""
    runs = B.table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.expr(f"collect_list({result}) AS results"))
    text = F.to_json(F.struct(F.create_map(F.lit("nation"), F.col("s_nationkey").cast("string")).alias("summary"), "results"))
    write_session_files(runs.select(F.concat(F.lit("run-"), "s_nationkey", F.lit(".json")).alias("file_name"), text.alias("text")), folder)
    return S.read_manifest(spark, folder).selectExpr("spec.task AS task", "label", "ok", "n_steps", "cost.input_tokens AS input_tokens")


@query(
    "eval_queries",
    """SELECT 'find ' || item_id AS query, 2 AS n_expected, 2 AS rejected FROM benchmark""",
)
def eval_queries(spark, sf_dir):
    """One evaluation file per item: a sound entry and two of another shape."""
    folder = new_folder(spark)
    items = B.table(spark, sf_dir, "benchmark")
    entry = """concat('[{"query": "find ', item_id, '", "expected": ["loop", "gave_up"]}, {"query": ', item_id, '}, "find ', item_id, '"]')"""
    write_session_files(items.selectExpr("concat('eval-', item_id, '.json') AS file_name", f"{entry} AS text"), folder)
    sound, rejects = S.read_eval_queries(spark, folder)
    per_file = (rejects.agg(F.count("*").alias("n")).first()["n"]) // max(1, items.count())
    return sound.select("query", F.size("expected").alias("n_expected"), F.lit(int(per_file)).alias("rejected"))


@query(
    "signal_targets",
    """SELECT CAST(o_orderkey AS VARCHAR) AS id, o_custkey % 2 = 0 AS gated FROM orders WHERE o_totalprice < 480000""",
)
def signal_targets(spark, sf_dir):
    """Traces still to be enriched, and with ``force`` all normalised ones."""
    orders = B.table(spark, sf_dir, "orders").selectExpr(
        "cast(o_orderkey as string) AS id", "o_totalprice < 480000 AS has_atif", "if(o_custkey % 2 = 0, NULL, named_struct('hit_max_turns', true)) AS signals"
    )
    due = signals.targets(orders).select("id", F.lit(True).alias("gated"))
    return signals.targets(orders, force=True).select("id").join(due, "id", "left").select("id", F.coalesce("gated", F.lit(False)).alias("gated"))


@query(
    "evolving_tables",
    """SELECT doc_id, n_chars, CASE WHEN doc_id % 2 = 1 THEN lang END AS lang, (doc_id % 2)::INTEGER AS batch_id FROM documents""",
)
def evolving_tables(spark, sf_dir):
    """A later batch of a table has a column more; both versions are read as one table."""
    folder = new_folder(spark)
    docs = B.table(spark, sf_dir, "documents")
    write_batch(docs.filter("doc_id % 2 = 0").select("doc_id", "n_chars"), folder, 0)
    write_batch(docs.filter("doc_id % 2 = 1").select("lang", "doc_id", "n_chars"), folder, 1)
    return read_batches(spark, folder).select("doc_id", "n_chars", "lang", "batch_id")


# --- adapter details ------------------------------------------------------------------------


@query(
    "codex_usage",
    f"""WITH {W.FILES_SQL}
    SELECT doc AS trace_id, (max(turn) FILTER (WHERE role = 'assistant') * 10)::BIGINT AS prompt_tokens,
           arg_max(length(text), turn) FILTER (WHERE role = 'assistant') AS completion_tokens,
           max(turn) FILTER (WHERE role = 'assistant') AS cached_tokens,
           coalesce(nullif(count(*) FILTER (WHERE role = 'user'), 0), -1)::BIGINT AS unknown_lines,
           CASE WHEN conv_id % 2 = 0 THEN 'infinite_retry_loop' ELSE '' END AS mode
    FROM turns GROUP BY doc, conv_id""",
)
def codex_usage(spark, sf_dir):
    """Last cumulative usage, counters of unknown lines, and the planted failure mode."""
    usage = """to_json(named_struct('type', 'event_msg', 'payload', named_struct('type', 'token_count', 'info', named_struct('total_token_usage',
        named_struct('input_tokens', t.turn * 10, 'output_tokens', length(t.text), 'cached_input_tokens', t.turn)))))"""
    said = """to_json(named_struct('type', 'response_item', 'payload', named_struct('type', 'message', 'role', t.role,
        'content', array(named_struct('text', t.text)))))"""
    odd = "to_json(named_struct('type', 'weird', 'payload', named_struct('n', t.turn)))"
    head = """to_json(named_struct('type', 'session_meta', 'synthetic', conv_id % 2 = 0, 'synthetic_failure_mode',
        if(conv_id % 2 = 0, 'infinite_retry_loop', NULL), 'payload', named_struct('id', doc)))"""
    lines = f"transform(turns, t -> concat({said}, '\\n', if(t.role = 'assistant', concat({usage}, '\\n'), ''), if(t.role = 'user', concat({odd}, '\\n'), '')))"
    raw = W.raw(W.conversation_files(spark, sf_dir), ".jsonl", f"concat({head}, '\\n', array_join({lines}, ''))")
    found = N.trajectories_of(codex.normalize(raw).withColumn("doc", F.col("header.session_id")), "doc")
    return found.selectExpr(
        "trace_id", "bigint(total_prompt_tokens) AS prompt_tokens", "bigint(total_completion_tokens) AS completion_tokens",
        "bigint(total_cached_tokens) AS cached_tokens", "coalesce(counters['unknown:weird'], -1L) AS unknown_lines",
        "coalesce(synthetic_failure_mode, '') AS mode",
    )


@query(
    "swe_extra",
    """SELECT 'doc-' || doc_id AS trace_id, doc_id % 2 = 0 AS resolved, CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'submitted' END AS exit_status,
        CASE WHEN doc_id % 4 = 0 THEN '' ELSE 'diff ' || doc_id END AS patch, length(text) AS log_chars,
        md5(CASE WHEN length(text) <= 10000 THEN text ELSE left(text, 10000) || chr(10) || '...[truncated, ' || (length(text) - 10000) || ' more bytes]' END) AS log_md5
    FROM documents WHERE length(text) > 0""",
)
def swe_extra(spark, sf_dir):
    """Every document as the evaluation log of a benchmark row."""
    row = """to_json(named_struct('instance_id', concat('doc-', doc_id), 'model_name', 'llama', 'target', doc_id % 2 = 0,
        'exit_status', if(doc_id % 3 = 0, '', 'submitted'), 'generated_patch', if(doc_id % 4 = 0, ' \\n ', concat('diff ', doc_id)), 'eval_logs', text,
        'trajectory', array(named_struct('role', 'ai', 'text', 'done'))))"""
    raw = B.table(spark, sf_dir, "documents").filter("length(text) > 0").selectExpr("concat('doc-', doc_id, '.json') AS path", "path AS file_name", f"{row} AS raw_blob")
    found = swe_agent.normalize(raw).selectExpr("header.session_id AS trace_id", "header.resolved AS resolved", "header.exit_status AS exit_status",
        "from_json(header.extra, 'generated_patch string, eval_logs string, eval_logs_full_bytes bigint') AS x")
    return found.selectExpr(
        "trace_id", "resolved", "coalesce(exit_status, '') AS exit_status", "coalesce(x.generated_patch, '') AS patch",
        "x.eval_logs_full_bytes AS log_chars", "md5(x.eval_logs) AS log_md5",
    )


@query(
    "redacted_steps",
    f"""WITH {W.FILES_SQL} SELECT doc AS trace_id, (turn + 1)::INTEGER AS step_id, regexp_replace(text, '[aeiou]', '*', 'g') AS message FROM turns""",
)
def redacted_steps(spark, sf_dir):
    """The redaction hook over messages."""
    sessions = redact_steps(native.normalize(W.native_files(W.conversation_files(spark, sf_dir))), lambda c: F.regexp_replace(c, "[aeiou]", "*"))
    return N.steps_of(sessions.withColumn("doc", F.col("header.session_id")), "doc").selectExpr("trace_id", "int(step_id) AS step_id", "message")


@query(
    "result_texts",
    """SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN text WHEN 1 THEN 'a ' || doc_id || chr(10) || '{"id":' || doc_id || ',"type":"image"}' || chr(10) || 'b'
            WHEN 2 THEN '{"k":' || doc_id || '}' WHEN 3 THEN '' ELSE '17' END AS searched,
        CASE doc_id % 5 WHEN 0 THEN text WHEN 1 THEN 'a ' || doc_id || chr(10) || 'b' ELSE '' END AS shown
    FROM documents WHERE length(text) > 0""",
)
def result_texts(spark, sf_dir):
    """Results as strings, block lists, objects, NULL and numbers: the text searched and the text shown."""
    content = """CASE doc_id % 5 WHEN 0 THEN to_json(named_struct('v', text))
        WHEN 1 THEN concat('{"v":[{"type":"text","text":"a ', doc_id, '"},{"type":"image","id":', doc_id, '},{"type":"text","text":"b"}]}')
        WHEN 2 THEN concat('{"v":{"k":', doc_id, '}}') WHEN 3 THEN '{"v":null}' ELSE '{"v":17}' END"""
    doc = f"""concat('{{"schema_version":"ATIF-v1.2","session_id":"', doc_id, '","agent":{{"name":"m","version":"1"}},"steps":[{{"step_id":1,"source":"agent","message":"m",',
        '"observation":{{"results":[{{"source_call_id":"c","content":', substring({content}, 6, length({content}) - 6), '}}]}}}}]}}')"""
    raw = B.table(spark, sf_dir, "documents").filter("length(text) > 0").selectExpr("string(doc_id) AS path", "path AS file_name", f"{doc} AS raw_blob")
    return native.normalize(raw).selectExpr(
        "bigint(header.session_id) AS doc_id", "coalesce(steps[0].results[0].content, '') AS searched", "coalesce(steps[0].results[0].text, '') AS shown"
    )


@query(
    "step_errors",
    f"""WITH {B.EVENT_STEPS_SQL}
    SELECT event_id, CASE WHEN event_type = 'error' THEN 'Error: code ' || event_id WHEN event_type = 'click' THEN 'SyntaxError in ' || event_id ELSE '' END AS error_text
    FROM ev""",
)
def step_errors(spark, sf_dir):
    """The first failing result of a step, else its message, else nothing; default markers."""
    steps = B.table(spark, sf_dir, "events").selectExpr(
        "event_id",
        """CASE event_type WHEN 'error' THEN array(named_struct('content', concat('fine ', event_id)), named_struct('content', concat('Error: code ', event_id)),
                named_struct('content', 'KeyError later'))
            WHEN 'view' THEN array(named_struct('content', 'an xError: inside a word')) END AS results""",
        "CASE event_type WHEN 'click' THEN concat('SyntaxError in ', event_id) WHEN 'error' THEN 'TypeError in the message' ELSE 'no errors' END AS message",
    )
    found = T.step_error_text(F.col("results"), F.col("message"))
    return steps.select("event_id", F.coalesce(found, F.lit("")).alias("error_text"))


# --- plug-ins -------------------------------------------------------------------------------


@query(
    "registered_format",
    "SELECT CAST(doc_id AS VARCHAR) AS trace_id, len(string_split(text, chr(10)))::INTEGER AS n_steps FROM documents WHERE length(text) > 0",
)
def registered_format(spark, sf_dir):
    """A caller's own format: every line of a document is a step."""

    def by_line(raw):
        # the adapter lifts lines to the canonical layout and leaves the rest to its normaliser
        step = "named_struct('step_id', i + 1, 'source', 'agent', 'message', l)"
        doc = f"""to_json(named_struct('schema_version', 'ATIF-v1.2', 'session_id', path, 'agent', named_struct('name', 'lines', 'version', '1'),
            'steps', transform(split(raw_blob, '\\n'), (l, i) -> {step})))"""
        return native.normalize(raw.withColumn("raw_blob", F.expr(doc)))

    registry.register_format("lines", by_line)
    try:
        raw = B.table(spark, sf_dir, "documents").filter("length(text) > 0").selectExpr(
            "string(doc_id) AS path", "concat(doc_id, '.lines') AS file_name", "text AS raw_blob", "'lines' AS source_format"
        )
        return registry.normalize_all(raw, only={"lines"}).selectExpr("header.session_id AS trace_id", "size(steps) AS n_steps")
    finally:
        del registry.FORMATS["lines"]


@query(
    "registered_signal",
    f"WITH {B.EVENT_SIGNALS_SQL} SELECT trace_id, longest_run >= 3 AND n >= 40 AS busy_loop FROM facts JOIN longest USING (trace_id)",
)
def registered_signal(spark, sf_dir):
    """A caller's own signal over the same facts, with a parameter of the run."""
    signals.register_signal("busy_loop", lambda p: (F.col("longest_run") >= 3) & (F.col("n_steps") >= p["max_turns"]))
    try:
        found = signals.compute_signals(
            B.numbered_events(spark, sf_dir), roles=B.event_roles(), chunk=F.col("chunk"), names=["busy_loop"], max_turns=40, loop_repeat=B.EVENT_REPEAT
        )
        return found.select("trace_id", "busy_loop")
    finally:
        del signals.SIGNALS["busy_loop"]


def _scorer(prompts):
    """Breaks on some prompts, answers nonsense on others, and counts characters for the rest."""
    if any(len(p) % 97 == 0 for p in prompts):
        raise RuntimeError("overloaded")
    return [scoring.Answer("{oops" if len(p) % 89 == 0 else json.dumps({"n": len(p)}), len(p), 7) for p in prompts]


def _scored(spark, sf_dir):
    prompts = B.table(spark, sf_dir, "documents").selectExpr("cast(doc_id as string) AS trace_id", "text AS prompt")
    return prompts, scoring.score_prompts(prompts, _scorer, "n bigint")


_DEAD = "text IS NULL OR length(text) % 97 = 0 OR length(text) % 89 = 0"


@query(
    "score_prompts",
    f"""SELECT CAST(doc_id AS VARCHAR) AS trace_id, CASE WHEN {_DEAD} THEN -1 ELSE length(text) END AS n,
        CASE WHEN text IS NULL THEN 'no prompt' WHEN length(text) % 97 = 0 THEN 'RuntimeError: overloaded'
             WHEN length(text) % 89 = 0 THEN 'bad answer' ELSE '' END AS error FROM documents""",
)
def score_prompts(spark, sf_dir):
    _, scored = _scored(spark, sf_dir)
    return scored.selectExpr("trace_id", "coalesce(answer.n, -1L) AS n", "coalesce(error, '') AS error")


@query(
    "scoring_cost",
    f"""WITH d AS (SELECT *, {_DEAD} AS dead, text IS NULL OR length(text) % 97 = 0 AS unpaid FROM documents),
    s AS (SELECT count(*) AS prompts, count(*) FILTER (WHERE NOT dead) AS answered, count(*) FILTER (WHERE dead) AS dead,
        coalesce(sum(length(text)) FILTER (WHERE NOT unpaid), 0)::BIGINT AS input_tokens, (7 * count(*) FILTER (WHERE NOT unpaid))::BIGINT AS output_tokens FROM d)
    SELECT *, round((3.0 * input_tokens + 15.0 * output_tokens) / 1000000, 6) AS cost_usd, dead AS letters FROM s""",
)
def scoring_cost(spark, sf_dir):
    """Costs of a run, with the prompts that are to be sent again counted from the dead letters."""
    prompts, scored = _scored(spark, sf_dir)
    letters = scoring.dead_letters(scored, prompts).agg(F.count("*").alias("letters"))
    total = scoring.cost_rollup(scored)
    return total.withColumn("cost_usd", F.round("cost_usd", 6)).withColumn("letters", letters.scalar())


@query(
    "vectorize_norms",
    "SELECT CAST(doc_id AS VARCHAR) AS trace_id, 64 AS dim, CASE WHEN regexp_matches(text, '[A-Za-z0-9_]') THEN 1.0 ELSE 0.0 END::DOUBLE AS norm FROM documents",
)
def vectorize_norms(spark, sf_dir):
    """Text vectors have the asked size and unit length wherever there is a word."""
    texts = B.table(spark, sf_dir, "documents").selectExpr("cast(doc_id as string) AS trace_id", "coalesce(text, '') AS text")
    return similarity.vectorize(texts, 64).selectExpr(
        "trace_id", "size(embedding) AS dim", "round(sqrt(aggregate(embedding, 0D, (a, x) -> a + double(x) * double(x))), 3) AS norm"
    )
