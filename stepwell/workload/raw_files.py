"""Session files written from conversations: one conversation is one file.

All rows of a conversation go into its file, ordered by turn and text; rows that share a
turn stay apart.  ``turn`` is the position in that order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepwell.workload.bindings import table

# turns whose call gets an output; the others leave it pending
ANSWERED = "{turn} % 4 < 2"


def conversation_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc, conv_id, turns): the ordered turns of each file."""
    return files_of(table(spark, sf_dir, "conversations"))


def files_of(conversations: DataFrame) -> DataFrame:
    return (
        conversations.groupBy("conv_id")
        .agg(F.expr("array_sort(collect_list(struct(turn, text, role))) AS said"))
        .selectExpr(
            "concat('conv-', conv_id) AS doc",
            "conv_id",
            "transform(said, (t, i) -> named_struct('turn', i, 'role', t.role, 'text', t.text)) AS turns",
        )
    )


FILES_SQL = """turns AS (
    SELECT 'conv-' || conv_id AS doc, conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text, role) - 1 AS turn,
           role, text, length(text) AS n FROM conversations)"""


def raw(files: DataFrame, suffix: str, text: str) -> DataFrame:
    return files.selectExpr(
        f"concat(doc, '{suffix}') AS path", f"concat(doc, '{suffix}') AS file_name", f"{text} AS raw_blob"
    )


def lines(head: str, per_turn: str) -> str:
    return f"concat({head}, array_join(transform(turns, t -> {per_turn}), ''))"


def swe_agent_files(files: DataFrame) -> DataFrame:
    turn = """named_struct('role', if(t.role = 'assistant', 'ai', t.role), 'text',
        if(t.role = 'system', '', t.text), 'system_prompt', if(t.role = 'system', t.text, ''),
        'mask', t.role = 'assistant')"""
    doc = f"""to_json(named_struct('instance_id', doc, 'model_name', 'llama', 'target', size(turns) > 5,
        'exit_status', if(size(turns) > 5, 'submitted', 'exit_context'),
        'trajectory', transform(turns, t -> {turn})))"""
    return raw(files, ".json", doc)


def native_files(files: DataFrame) -> DataFrame:
    step = """named_struct('step_id', i + 1, 'source', if(t.role = 'assistant', 'agent', t.role),
        'message', t.text,
        'usage', if(t.role = 'assistant', named_struct('prompt_tokens', length(t.text),
                    'cache_tokens', t.turn), NULL))"""
    doc = f"""to_json(named_struct('schema_version', 'ATIF-v1.2', 'session_id', doc,
        'agent', named_struct('name', 'mcp', 'version', '1'),
        'steps', transform(turns, (t, i) -> {step})))"""
    return raw(files, ".json", doc)


def cursor_files(files: DataFrame) -> DataFrame:
    """Assistant turns make a call; the next user turn brings its result."""
    message = """named_struct('role', t.role, 'content', t.text,
        'tool_calls', if(t.role = 'assistant', array(named_struct('id', concat('t', t.turn),
            'name', 'look', 'arguments', named_struct('n', length(t.text)))), NULL),
        'tool_results', if(t.role = 'user', array(named_struct('tool_call_id', concat('t', t.turn - 1),
            'content', t.text)), NULL))"""
    doc = f"""to_json(named_struct('session_id', doc, 'model', 'sonnet',
        'messages', transform(turns, t -> {message})))"""
    return raw(files, ".cursor.json", doc)


def claude_code_files(files: DataFrame) -> DataFrame:
    """Assistant turns make a call; half of the turns get a result line."""
    user = """to_json(named_struct('type', 'user', 'sessionId', doc, 'message', named_struct('content', t.text)))"""
    system = """to_json(named_struct('type', 'system', 'sessionId', doc, 'content', t.text))"""
    agent = """to_json(named_struct('type', 'assistant', 'sessionId', doc, 'message', named_struct('model', 'opus',
        'content', to_variant_object(array(named_struct('type', 'text', 'text', t.text, 'id', NULL, 'name', NULL, 'input', NULL),
            named_struct('type', 'tool_use', 'text', NULL, 'id', concat('t', t.turn), 'name', 'look',
                         'input', named_struct('n', length(t.text))))),
        'usage', named_struct('input_tokens', length(t.text), 'output_tokens', t.turn))))"""
    answer = f"""if({ANSWERED.format(turn='t.turn')}, concat(to_json(named_struct('type', 'user', 'sessionId', doc,
        'message', named_struct('content', array(named_struct('type', 'tool_result', 'tool_use_id', concat('t', t.turn),
            'content', t.text))))), '\\n'), '')"""
    text = lines(
        "concat(to_json(named_struct('type', 'permission-mode', 'sessionId', doc)), '\\n')",
        f"CASE t.role WHEN 'assistant' THEN concat({agent}, '\\n', {answer}) WHEN 'user' THEN concat({user}, '\\n') ELSE concat({system}, '\\n') END",
    )
    return raw(files, ".jsonl", text)


def codex_files(files: DataFrame) -> DataFrame:
    """Assistant turns reason, call, and speak; half of the calls never get their output."""

    def event(payload: str) -> str:
        return f"concat(to_json(named_struct('type', 'response_item', 'payload', {payload})), '\\n')"

    said = event("named_struct('type', 'message', 'role', t.role, 'content', array(named_struct('text', t.text)))")
    thought = event("named_struct('type', 'reasoning', 'summary', array(concat('why ', t.turn)))")
    call = event(
        "named_struct('type', 'function_call', 'call_id', concat('c', t.turn), 'name', 'look', "
        "'arguments', to_json(named_struct('n', length(t.text))))"
    )
    output = event(
        "named_struct('type', 'function_call_output', 'call_id', concat('c', t.turn), "
        "'output', to_json(named_struct('output', t.text)))"
    )
    head = (
        "to_json(named_struct('type', 'session_meta', 'payload', named_struct('id', doc, 'cli_version', '1'))), "
        "'\\n', to_json(named_struct('type', 'turn_context', 'payload', named_struct('model', 'gpt'))), '\\n'"
    )
    per_turn = f"""if(t.role = 'assistant',
        concat({thought}, {call}, if({ANSWERED.format(turn='t.turn')}, {output}, ''), {said}), {said})"""
    return raw(files, ".jsonl", lines(head, per_turn))
