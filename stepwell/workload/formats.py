"""Session files in five layouts: detection, identity, normalisation, ingest."""

from __future__ import annotations

from pyspark.sql import functions as F

from stepwell.plans.ingest import ingest, quality_gate
from stepwell.plans.tables import current, read_batches
from stepwell.session import new_folder
from stepwell.sources import claude_code, codex, cursor, native, swe_agent
from stepwell.sources import sessions as S
from stepwell.sources.detect import detect_format, raw_identity, trace_id
from stepwell.sources.files import read_sessions, scan_json, scan_jsonl, staged_path
from stepwell.sources.session_files import extract_files, write_session_files
from stepwell.streaming.appended import LINE_SCHEMA, ingest_appended, store_lines
from stepwell.streaming.continuous import ingest_batch
from stepwell.streaming.sync import manifest, sync_changed
from stepwell.workload import query
from stepwell.workload import bindings as B
from stepwell.workload import raw_files as W

NO_TOOLS = "0 AS n_calls, '' AS arguments, '' AS result, '' AS reasoning"


def shown(sessions):
    """Steps with the first call and the first result flattened."""
    return S.steps_of(sessions.withColumn("doc", F.col("header.session_id")), "doc").selectExpr(
        "trace_id",
        "int(step_id) AS step_id",
        "source",
        "message",
        "coalesce(model_name, '') AS model_name",
        "coalesce(size(tool_calls), 0) AS n_calls",
        "coalesce(tool_calls[0].arguments, '') AS arguments",
        "coalesce(results[0].text, '') AS result",
        "coalesce(reasoning_content, '') AS reasoning",
    )


def files(spark, sf_dir):
    return W.conversation_files(spark, sf_dir)


AGENT = "CASE WHEN role = 'assistant' THEN 'agent' ELSE role END"
POS = "row_number() OVER (PARTITION BY doc ORDER BY turn)::INTEGER"


@query(
    "normalize_swe_agent",
    f"""WITH {W.FILES_SQL} SELECT doc AS trace_id, {POS} AS step_id,
        CASE WHEN role = 'assistant' THEN 'agent' ELSE 'system' END AS source, text AS message,
        CASE WHEN role = 'assistant' THEN 'llama' ELSE '' END AS model_name, {NO_TOOLS} FROM turns""",
)
def normalize_swe_agent(spark, sf_dir):
    return shown(swe_agent.normalize(W.swe_agent_files(files(spark, sf_dir))))


@query(
    "normalize_atif",
    f"""WITH {W.FILES_SQL} SELECT doc AS trace_id, {POS} AS step_id, {AGENT} AS source, text AS message,
        '' AS model_name, {NO_TOOLS} FROM turns""",
)
def normalize_atif(spark, sf_dir):
    return shown(native.normalize(W.native_files(files(spark, sf_dir))))


@query(
    "step_metrics",
    f"""WITH {W.FILES_SQL} SELECT doc AS trace_id, {POS} AS step_id,
        n AS prompt_tokens, turn AS cached_tokens FROM turns QUALIFY role = 'assistant'""",
)
def step_metrics(spark, sf_dir):
    steps = S.steps_of(native.normalize(W.native_files(files(spark, sf_dir))))
    return steps.filter("metrics IS NOT NULL").selectExpr(
        "regexp_replace(trace_id, '[.]json$', '') AS trace_id",
        "int(step_id) AS step_id",
        "metrics.prompt_tokens",
        "metrics.cached_tokens",
    )


@query(
    "normalize_cursor",
    f"""WITH {W.FILES_SQL} SELECT doc AS trace_id, {POS} AS step_id, {AGENT} AS source, text AS message,
        CASE WHEN role = 'assistant' THEN 'sonnet' ELSE '' END AS model_name,
        CASE WHEN role = 'assistant' THEN 1 ELSE 0 END AS n_calls,
        CASE WHEN role = 'assistant' THEN '{{"n":' || n || '}}' ELSE '' END AS arguments,
        CASE WHEN role = 'assistant' AND lead(role) OVER w = 'user' AND lead(turn) OVER w = turn + 1
             THEN lead(text) OVER w ELSE '' END AS result, '' AS reasoning
    FROM turns WINDOW w AS (PARTITION BY doc ORDER BY turn)""",
)
def normalize_cursor(spark, sf_dir):
    return shown(cursor.normalize(W.cursor_files(files(spark, sf_dir))))


@query(
    "normalize_claude_code",
    f"""WITH {W.FILES_SQL} SELECT doc AS trace_id, {POS} AS step_id, {AGENT} AS source,
        CASE WHEN role = 'user' THEN trim(text, E' \\t\\n\\r') ELSE text END AS message,
        CASE WHEN role = 'assistant' THEN 'opus' ELSE '' END AS model_name,
        CASE WHEN role = 'assistant' THEN 1 ELSE 0 END AS n_calls,
        CASE WHEN role = 'assistant' THEN '{{"n":' || n || '}}' ELSE '' END AS arguments,
        CASE WHEN role = 'assistant' AND {W.ANSWERED.format(turn='turn')} THEN text ELSE '' END AS result, '' AS reasoning
    FROM turns""",
)
def normalize_claude_code(spark, sf_dir):
    return shown(claude_code.normalize(W.claude_code_files(files(spark, sf_dir))))


@query(
    "final_metrics",
    f"""WITH {W.FILES_SQL} SELECT doc AS trace_id, CAST(sum(n) AS BIGINT) AS total_prompt_tokens,
        CAST(sum(turn) AS BIGINT) AS total_completion_tokens FROM turns WHERE role = 'assistant' GROUP BY 1""",
)
def final_metrics(spark, sf_dir):
    sessions = claude_code.normalize(W.claude_code_files(files(spark, sf_dir)))
    return sessions.filter("header.total_prompt_tokens IS NOT NULL").selectExpr(
        "header.session_id AS trace_id", "header.total_prompt_tokens", "header.total_completion_tokens"
    )


CODEX_SQL = f"""{W.FILES_SQL},
parts AS (
    SELECT doc, 0 AS late, turn, 0 AS part, 'agent' AS source, 'Tool call: look' AS message, 1 AS n_calls,
           '{{"n":' || n || '}}' AS arguments, text AS result, 'why ' || turn AS reasoning
    FROM turns WHERE role = 'assistant' AND {W.ANSWERED.format(turn='turn')}
    UNION ALL
    SELECT doc, 1, turn, 0, 'agent', 'Tool call (no output): look', 1, '{{"n":' || n || '}}', '', 'why ' || turn
    FROM turns WHERE role = 'assistant' AND NOT ({W.ANSWERED.format(turn='turn')})
    UNION ALL
    SELECT doc, 0, turn, 1, {AGENT}, text, 0, '', '', '' FROM turns)"""


@query(
    "normalize_codex",
    f"""WITH {CODEX_SQL} SELECT doc AS trace_id,
        row_number() OVER (PARTITION BY doc ORDER BY late, turn, part)::INTEGER AS step_id, source, message,
        CASE WHEN source = 'agent' THEN 'gpt' ELSE '' END AS model_name, n_calls, arguments, result, reasoning FROM parts""",
)
def normalize_codex(spark, sf_dir):
    return shown(codex.normalize(W.codex_files(files(spark, sf_dir))))


def every_file(spark, sf_dir):
    """The same conversations in all layouts, and a few files nothing can read."""
    base = files(spark, sf_dir)
    other = B.table(spark, sf_dir, "pages").selectExpr(
        "concat('page-', page_id, if(page_id % 2 = 0, '.json', '.html')) AS path", "path AS file_name", "html AS raw_blob"
    )
    made = [
        ("swe", W.swe_agent_files),
        ("atif", W.native_files),
        ("cursor", W.cursor_files),
        ("claude", W.claude_code_files),
        ("codex", W.codex_files),
    ]
    raw = other
    for folder, write in made:
        part = write(base).withColumn("path", F.concat(F.lit(f"{folder}/"), F.col("path")))
        raw = raw.unionByName(part)
    return raw


FORMATS_SQL = """fmt AS (SELECT * FROM (VALUES ('swe', '.json', 'swe_agent'), ('atif', '.json', 'atif'),
    ('cursor', '.cursor.json', 'cursor'), ('claude', '.jsonl', 'claude_code'), ('codex', '.jsonl', 'codex'))
    AS t(folder, suffix, source_format))"""
PAGES_SQL = "'page-' || page_id || CASE WHEN page_id % 2 = 0 THEN '.json' ELSE '.html' END"


@query(
    "detect_format",
    f"""WITH {W.FILES_SQL}, {FORMATS_SQL}
    SELECT folder || '/' || doc || suffix AS path, source_format FROM (SELECT DISTINCT doc FROM turns), fmt
    UNION ALL SELECT {PAGES_SQL}, 'unknown' FROM pages""",
)
def detect(spark, sf_dir):
    return every_file(spark, sf_dir).select("path", detect_format().alias("source_format"))


@query(
    "raw_identity",
    f"""WITH {W.FILES_SQL}, {FORMATS_SQL}
    SELECT folder || '/' || doc || suffix AS path, doc AS identity FROM (SELECT DISTINCT doc FROM turns), fmt
    UNION ALL SELECT {PAGES_SQL}, '' FROM pages""",
)
def identity(spark, sf_dir):
    return every_file(spark, sf_dir).select(
        "path", F.coalesce(raw_identity(), F.lit("")).alias("identity")
    )


@query(
    "trace_id",
    f"""WITH {W.FILES_SQL}, {FORMATS_SQL}
    SELECT folder || '/' || doc || suffix AS path, doc AS id FROM (SELECT DISTINCT doc FROM turns), fmt
    UNION ALL SELECT {PAGES_SQL}, 'page-' || page_id FROM pages""",
)
def identify(spark, sf_dir):
    raw = every_file(spark, sf_dir).selectExpr(
        "*", "cast(NULL as string) AS trajectory_id", "'' AS session_id"
    )
    return raw.select("path", trace_id().alias("id"))


@query(
    "scan_jsonl",
    f"""WITH {W.FILES_SQL}, e AS (
        SELECT doc || '.jsonl' AS path, 'session_meta' AS event_type FROM turns GROUP BY 1
        UNION ALL SELECT doc || '.jsonl', 'turn_context' FROM turns GROUP BY 1
        UNION ALL SELECT doc || '.jsonl', 'response_item' FROM turns,
            LATERAL (SELECT unnest(range(CASE WHEN role <> 'assistant' THEN 1 WHEN {W.ANSWERED.format(turn='turn')} THEN 4 ELSE 3 END))))
    SELECT path, event_type, count(*) AS n FROM e GROUP BY ALL""",
)
def scanned(spark, sf_dir):
    events = scan_jsonl(W.codex_files(files(spark, sf_dir)))
    return events.groupBy("path", "event_type").agg(F.count("*").alias("n"))


@query(
    "scan_json",
    f"""WITH {W.FILES_SQL} SELECT doc || '.json' AS path, count(*)::INTEGER AS n FROM turns GROUP BY 1
    UNION ALL SELECT 'page-' || page_id, -1 FROM pages""",
)
def documents_scanned(spark, sf_dir):
    pages = B.table(spark, sf_dir, "pages").selectExpr(
        "concat('page-', page_id) AS path", "path AS file_name", "html AS raw_blob"
    )
    raw = W.native_files(files(spark, sf_dir)).unionByName(pages)
    return scan_json(raw).selectExpr(
        "path", "coalesce(size(try_variant_get(doc, '$.steps', 'array<variant>')), -1) AS n"
    )


@query(
    "staged_path",
    """SELECT page_id, CASE WHEN url LIKE 'http://%' THEN 'data/raw/claude_code/' || url
        WHEN url LIKE '%example.com%' THEN 'data/raw/codex/' || url END AS staged FROM pages""",
)
def staged(spark, sf_dir):
    roots = {"/home/a/claude": "data/raw/claude_code", "/home/a/codex/": "data/raw/codex/"}
    path = F.expr(
        """concat(CASE WHEN url LIKE 'http://%' THEN '/home/a/claude/'
           WHEN url LIKE '%example.com%' THEN '/home/a/codex/' ELSE '/home/b/codex/' END, url)"""
    )
    return B.table(spark, sf_dir, "pages").select("page_id", staged_path(path, roots).alias("staged"))


@query(
    "quality_gate",
    f"""WITH {W.FILES_SQL}, c AS (
        SELECT doc || '.jsonl' AS path, count(*) + count(*) FILTER (WHERE role = 'assistant') AS n,
               count(*) FILTER (WHERE role = 'assistant') AS calls FROM turns GROUP BY 1)
    SELECT path, CASE WHEN n < 5 THEN 'too few steps (' || n || ' < 5)' WHEN n > 9 THEN 'too many steps (' || n || ' > 9)'
        WHEN calls < 1 THEN 'no tool calls in trajectory (degenerate)' ELSE '' END AS error,
        n BETWEEN 5 AND 9 AND calls >= 1 AS ok FROM c
    UNION ALL SELECT 'page-' || page_id, 'adapter returned None', false FROM pages""",
)
def gated(spark, sf_dir):
    pages = B.table(spark, sf_dir, "pages").selectExpr(
        "concat('page-', page_id) AS path", "path AS file_name", "html AS raw_blob"
    )
    raw = W.codex_files(files(spark, sf_dir)).unionByName(pages)
    return quality_gate(raw, codex.normalize(raw), 5, 9)


@query(
    "ingest",
    f"""WITH {W.FILES_SQL}, {FORMATS_SQL},
    c AS (SELECT doc, count(*) AS n, count(*) FILTER (WHERE role = 'assistant') AS calls FROM turns GROUP BY 1),
    t AS (SELECT folder || '-' || doc AS id, source_format, true AS has_atif,
        (n + CASE WHEN folder = 'codex' THEN calls ELSE 0 END)::INTEGER AS num_steps,
        CASE WHEN folder IN ('swe', 'atif') THEN 0 ELSE calls END::INTEGER AS num_tool_calls,
        CASE WHEN folder <> 'swe' THEN -1 WHEN n > 5 THEN 0 ELSE 1 END AS has_error FROM c, fmt)
    SELECT * FROM t UNION ALL SELECT 'page-' || page_id, 'unknown', false, -1, -1, -1 FROM pages""",
)
def ingested(spark, sf_dir):
    """Ingest of all layouts; session ids carry the layout so that no two files collide."""
    raw = every_file(spark, sf_dir).withColumn(
        "raw_blob",
        F.expr("""if(path LIKE '%/%', replace(raw_blob, 'conv-', concat(split(path, '/')[0], '-conv-')), raw_blob)"""),
    )
    return ingest(raw).traces.selectExpr(
        "id",
        "source_format",
        "has_atif",
        "coalesce(num_steps, -1) AS num_steps",
        "coalesce(num_tool_calls, -1) AS num_tool_calls",
        "coalesce(has_error, -1) AS has_error",
    )


@query(
    "continuous_ingest",
    f"""WITH {W.FILES_SQL},
    c AS (SELECT doc, count(*) AS n, count(*) FILTER (WHERE role = 'assistant') AS calls FROM turns GROUP BY 1)
    SELECT doc AS id, 'codex' AS source_format, (n + calls)::INTEGER AS num_steps, calls::INTEGER AS num_tool_calls,
           n + calls >= 50 AS hit_max_turns FROM c""",
)
def continuous_ingest(spark, sf_dir):
    """Conversations as a stream of session files, ingested batch by batch."""
    turns = B.table_stream(spark, sf_dir, "conversations")
    folder = new_folder(spark)

    def run(batch, batch_id):
        ingest_batch(W.codex_files(W.files_of(batch)), f"{folder}/tables", batch_id)

    stream = (
        turns.writeStream.option("checkpointLocation", f"{folder}/progress")
        .foreachBatch(run)
        .trigger(availableNow=True)
        .start()
    )
    stream.awaitTermination()
    return current(spark, f"{folder}/tables/traces").select(
        "id", "source_format", "num_steps", "num_tool_calls", "signals.hit_max_turns"
    )


@query(
    "sync_changed",
    f"""WITH {W.FILES_SQL},
    c AS (SELECT doc, count(*) AS n, count(*) FILTER (WHERE role = 'assistant') AS calls,
                 count(*) FILTER (WHERE turn < 3) AS n_first, count(*) FILTER (WHERE turn < 3 AND role = 'assistant') AS calls_first
          FROM turns GROUP BY 1)
    SELECT doc AS id, (n + calls)::INTEGER AS num_steps, calls::INTEGER AS num_tool_calls,
           CASE WHEN n > n_first THEN 2 ELSE 1 END AS times_taken, (SELECT count(*) FROM c) AS scanned,
           (SELECT count(*) FROM c WHERE n > n_first) AS grown, 0 AS left_over FROM c""",
)
def synced(spark, sf_dir):
    """Session files that grow between two syncs; a third sync finds nothing to do."""
    folder = new_folder(spark)
    turns = files(spark, sf_dir)
    first = turns.withColumn("turns", F.expr("slice(turns, 1, 3)"))
    runs = []
    for state in (first, turns, None):
        if state is not None:
            text = W.codex_files(state).selectExpr("file_name", "raw_blob AS text")
            if runs:
                text = text.join(turns.filter("size(turns) > 3").selectExpr("concat(doc, '.jsonl') AS file_name"), "file_name", "left_semi")
            write_session_files(text, f"{folder}/watched")
        runs.append(sync_changed(spark, f"{folder}/watched", f"{folder}/tables"))
    taken = manifest(spark, f"{folder}/tables").groupBy(F.expr("replace(element_at(split(path, '/'), -1), '.jsonl')").alias("id"))
    return current(spark, f"{folder}/tables/traces").join(taken.agg(F.count("*").alias("times_taken")), "id").select(
        "id", "num_steps", "num_tool_calls", "times_taken",
        F.lit(runs[0].scanned).alias("scanned"), F.lit(runs[1].ingested).alias("grown"), F.lit(runs[2].ingested).alias("left_over"),
    )


@query(
    "extract_files",
    "SELECT 'page__' || page_id || '.json' AS file_name, page_id, url, html FROM pages",
)
def extracted(spark, sf_dir):
    """Every page as a file of its own, read back from the folder."""
    folder = new_folder(spark)
    pages = B.table(spark, sf_dir, "pages")
    extract_files(pages.withColumn("key", F.expr("concat('page/', page_id)")), "key", folder)
    back = read_sessions(spark, folder, "*.json")
    return back.select("file_name", F.from_json("raw_blob", "page_id bigint, url string, html string").alias("d")).select("file_name", "d.*")


@query(
    "appended_ingest",
    f"""WITH {W.FILES_SQL},
    c AS (SELECT doc, conv_id, count(*) AS n, count(*) FILTER (WHERE role = 'assistant') AS calls FROM turns GROUP BY ALL)
    SELECT doc AS id, (n + calls)::INTEGER AS num_steps, calls::INTEGER AS num_tool_calls,
           CASE WHEN conv_id % 2 = 0 THEN 2 ELSE 1 END AS times_taken FROM c""",
)
def appended_ingest(spark, sf_dir):
    """Sessions whose lines come in two deliveries, then a tick of the clock.

    The lines of even conversations are an hour apart, so these settle twice; the others are
    in one burst that goes on over the end of a batch and a restart.
    """
    folder = new_folder(spark)
    text = W.codex_files(files(spark, sf_dir)).select("path", "raw_blob", F.expr("path RLIKE '[02468][.]jsonl$'").alias("even"))
    lines = text.select("path", "even", F.posexplode(F.split("raw_blob", "\n")).alias("line_no", "line")).filter("line <> ''")
    at = "timestamp_seconds(1700000000 + {}) AS event_ts"
    deliveries = (
        lines.filter("line_no < 2").selectExpr("path", "bigint(line_no) AS line_no", "line", at.format("line_no")),
        lines.filter("line_no >= 2").selectExpr("path", "bigint(line_no) AS line_no", "line", at.format("if(even, 3600, 60) + line_no % 60")),
        spark.range(1).selectExpr("string(NULL) AS path", "bigint(NULL) AS line_no", "string(NULL) AS line", at.format("86400")),
    )
    for delivery in deliveries:
        delivery.write.mode("append").parquet(f"{folder}/in")
        store_lines(spark.readStream.schema(LINE_SCHEMA).parquet(f"{folder}/in"), f"{folder}/out").awaitTermination()
        ingest_appended(spark, f"{folder}/out", debounce=600).awaitTermination()
    times = read_batches(spark, f"{folder}/out/traces").groupBy("id").agg(F.count("*").alias("times_taken"))
    return current(spark, f"{folder}/out/traces").join(times, "id").select("id", "num_steps", "num_tool_calls", "times_taken")
