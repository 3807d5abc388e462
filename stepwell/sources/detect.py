"""Format detection and identity of raw session texts, as plain Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stepwell.functions import variants as V
from stepwell.sources.files import LINE_BREAK_SQL

# Outer event types of the rollout format.
CODEX_EVENT_TYPES = ("session_meta", "turn_context", "response_item", "event_msg", "compacted")

# Event types that may open a session log.
CLAUDE_CODE_FIRST_TYPES = (
    "user",
    "assistant",
    "system",
    "permission-mode",
    "last-prompt",
    "file-history-snapshot",
    "attachment",
    "queue-operation",
    "tool_use",
    "tool_result",
    "summary",
)

# Keys every benchmark row carries.
SWE_AGENT_KEYS = ("instance_id", "model_name", "target", "trajectory")


def in_list(values: tuple[str, ...]) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def detect_format(file_name: str = "file_name", raw: str = "raw_blob") -> Column:
    """atif, claude_code, codex, cursor, swe_agent or unknown; never fails."""
    first_message = f"get({V.array('doc', '$.messages')}, 0)"
    envelope = f"{V.has_key('doc', 'session_id')} AND {V.has_key(first_message, 'role')}"
    benchmark = " AND ".join(V.has_key("doc", key) for key in SWE_AGENT_KEYS)
    as_document = V.let("doc", V.parse(raw), f"""CASE
        WHEN NOT {V.is_object('doc')} THEN 'unknown'
        WHEN lower({file_name}) LIKE '%.cursor.json' OR ({envelope}) THEN 'cursor'
        WHEN {benchmark} THEN 'swe_agent'
        WHEN {V.string('doc', '$.schema_version')} LIKE 'ATIF%' THEN 'atif'
        ELSE 'unknown' END""")
    bare = f"trim(LEADING {V.SPACE_LITERAL} FROM {raw})"
    line = V.strip(f"split({bare}, {_EOL}, 2)[0]")
    kind = V.string("event", "$.type")
    as_log = V.let("event", V.parse(line), f"""CASE
        WHEN {kind} IN {in_list(CODEX_EVENT_TYPES)} THEN 'codex'
        WHEN {kind} IN {in_list(CLAUDE_CODE_FIRST_TYPES)} AND {V.has_key('event', 'sessionId')}
            THEN 'claude_code'
        ELSE 'unknown' END""")
    return F.expr(f"""CASE
        WHEN lower({file_name}) LIKE '%.json' THEN {as_document}
        WHEN lower({file_name}) LIKE '%.jsonl' THEN {as_log}
        ELSE 'unknown' END""")


_EOL = r"'\\r\\n|\\r|\\n'"


def _identity(v: str) -> str:
    fields = ("trajectory_id", "session_id", "instance_id", "sessionId")
    meta = f"if({V.loose(v, '$.type')} = 'session_meta', {V.text(v, '$.payload.id')}, NULL)"
    return f"coalesce({', '.join(V.text(v, '$.' + f) for f in fields)}, {meta})"


def raw_identity_sql(raw: str = "raw_blob") -> str:
    line = V.strip(f"split(bare, '{LINE_BREAK_SQL}', 2)[0]")
    whole, first = (V.let("doc", V.parse(text), _identity("doc")) for text in ("bare", line))
    return V.let("bare", V.strip(raw), f"coalesce({whole}, {first})")


def raw_identity(raw: str = "raw_blob") -> Column:
    """Session id found in the document or in its first line."""
    return F.expr(raw_identity_sql(raw))


def stem_sql(file_name: str) -> str:
    return f"regexp_replace({file_name}, '(?<=.)\\\\.[^.]*$', '')"


def file_stem(file_name: str = "file_name") -> Column:
    return F.expr(stem_sql(file_name))


def known_id(
    trajectory_id: str = "trajectory_id",
    session_id: str = "session_id",
    raw_id: str = "raw_id",
    file_name: str = "file_name",
    raw_hash: str = "raw_hash",
) -> Column:
    """Stable key from narrow columns: canonical ids, the id in the text, the file stem, a hash."""
    return F.coalesce(
        F.expr(f"nullif({trajectory_id}, '')"),
        F.expr(f"nullif({session_id}, '')"),
        F.expr(raw_id),
        F.expr(f"nullif({stem_sql(file_name)}, '')"),
        F.expr(f"concat('sha256:', left({raw_hash}, 32))"),
    )


def trace_id(
    trajectory_id: str = "trajectory_id",
    session_id: str = "session_id",
    raw: str = "raw_blob",
    file_name: str = "file_name",
) -> Column:
    """The same key where the text is at hand."""
    return known_id(trajectory_id, session_id, raw_identity_sql(raw), file_name, f"sha2({raw}, 256)")
