"""Session logs with one event per line (user, assistant, system, metadata)."""

from __future__ import annotations

from pyspark.sql import DataFrame

from stepwell.functions import variants as V
from stepwell.sources import blocks as B
from stepwell.sources import sessions as S
from stepwell.sources.detect import in_list, stem_sql
from stepwell.sources.files import parsed_lines

# Metadata events and the counters they feed.
COUNTED_EVENTS = (
    ("permission-mode", "permission_mode_changes"),
    ("file-history-snapshot", "file_history_count"),
    ("last-prompt", "last_prompt_count"),
    ("queue-operation", "queue_operation_count"),
    ("ai-title", "ai_title_count"),
)
STEP_EVENTS = ("user", "assistant", "system", "attachment")
SESSION_FACTS = ("cwd", "gitBranch", "userType", "entrypoint")
STEP_FACTS = ("parentUuid", "promptId", "uuid", "isSidechain", "requestId")
RESULT_FACTS = ("exitCode", "interrupted", "isImage", "stderr_lines", "type")
USAGE_EXTRAS = ("cache_creation_input_tokens", "service_tier", "iterations")


def first_present(values: str, path: str) -> str:
    """First value at ``path`` that is there and not null, over ordered objects."""
    found = f"filter(transform({values}, e -> {V.member('e', path)}), v -> {V.present('v')})"
    return f"get({found}, 0)"


def _metrics() -> str:
    u = V.member("message", "$.usage")
    extra = V.json_object(*[(k, V.json(u, f"$.{k}")) for k in USAGE_EXTRAS])
    fields = {
        "prompt_tokens": V.number(u, "$.input_tokens"),
        "completion_tokens": V.number(u, "$.output_tokens"),
        "cached_tokens": V.number(u, "$.cache_read_input_tokens"),
        "extra": extra,
    }
    packed = ", ".join(f"'{name}', {value}" for name, value in fields.items())
    return f"if(coalesce(cast({'as string), cast('.join(fields.values())} as string)) IS NOT NULL, named_struct({packed}), NULL)"


def _result() -> str:
    content = V.member("x.b", "$.content")
    parts = V.texts(
        V.array(content),
        f"s -> if({V.loose('s', '$.type')} = 'text', {V.string('s', '$.text')}, NULL)",
    )
    failed = f"if({V.boolean('x.b', '$.is_error')}, 'true', NULL)"
    facts = [(k, V.json("e", f"$.toolUseResult.{k}")) for k in RESULT_FACTS]
    return S.result(
        V.string("x.b", "$.tool_use_id"),
        f"coalesce({V.string(content)}, {parts}, '')",
        V.json_object(("is_error", failed), *facts),
    )


def _header(events: str) -> str:
    counted = ", ".join(
        f"struct('{name}' AS key, bigint(size(filter(_kinds, k -> k = '{event}'))) AS value)"
        for event, name in COUNTED_EVENTS
    )
    known = in_list(tuple(event for event, _ in COUNTED_EVENTS) + STEP_EVENTS)
    attachments = (
        f"transform(filter({events}, e -> {V.loose('e', '$.type')} = 'attachment'), "
        f"e -> coalesce({V.loose('e', '$.attachment.type')}, '<unknown>'))"
    )
    usages = (
        f"filter(transform(filter({events}, e -> {V.loose('e', '$.type')} = 'assistant'), "
        f"e -> {V.member('e', '$.message.usage')}), u -> {V.is_object('u')})"
    )
    title = first_present(events, "$.aiTitle")
    facts = [(k, V.json(first_present(events, f"$.{k}"))) for k in SESSION_FACTS]
    facts.append(("ai_title", f"if({V.text(title)} IS NOT NULL, {V.json(title)}, NULL)"))
    return S.header(
        schema_version=f"'{S.SCHEMA_VERSION}'",
        session_id=(
            f"coalesce({V.string(first_present(events, '$.sessionId'))}, {stem_sql('file_name')})"
        ),
        agent_name="'claude-code'",
        agent_version=f"coalesce({V.text(first_present(events, '$.version'))}, 'unknown')",
        model=V.text(first_present(events, "$.message.model")),
        counters=S.counter_map(
            f"array({counted})",
            S.counts_of(attachments, "attachment:"),
            S.counts_of(f"filter(_kinds, k -> k NOT IN {known})", "unknown:"),
        ),
        extra=V.json_object(*facts),
        **B.usage_totals(usages),
    )


def normalize(raw: DataFrame) -> DataFrame:
    """Session logs to sessions; results are joined to calls with one shuffle by file."""
    docs = raw.selectExpr("path", "file_name", f"{parsed_lines('raw_blob')} AS events")
    docs = S.add(
        docs.filter("size(events) > 0"),
        _kinds=f"transform(events, e -> coalesce({V.string('e', '$.type')}, '<no-type>'))",
    )
    rows = S.explode_events(docs, _header("events"), "events")
    rows = S.add(rows, kind=V.loose("e", "$.type"), message=V.obj("e", "$.message"))
    rows = S.add(
        rows,
        said=V.string("message", "$.content"),
        blocks=B.blocks_of(V.member("message", "$.content")),
        ts=V.string("e", "$.timestamp"),
        notice=f"if(kind = 'system', {V.string('e', '$.content')}, NULL)",
        is_turn="coalesce(kind = 'assistant' AND message IS NOT NULL, false)",
    )
    rows = S.add(rows, carries="coalesce(kind = 'user' AND exists(blocks, x -> x.type = 'tool_result'), false)")
    tool_use = (
        f"x -> x.type = 'tool_use' AND {V.string('x.b', '$.id')} IS NOT NULL "
        f"AND {V.string('x.b', '$.name')} IS NOT NULL"
    )
    call = S.call(
        V.string("x.b", "$.id"), V.string("x.b", "$.name"), B.arguments_of(V.member("x.b", "$.input"))
    )
    answered = f"x -> x.type = 'tool_result' AND {V.string('x.b', '$.tool_use_id')} IS NOT NULL"
    rows = S.add(
        rows,
        user_text=V.strip(
            "coalesce(said, " + V.texts("blocks", "x -> if(x.type = 'text', x.text, NULL)") + ")"
        ),
        agent_text=V.texts("blocks", "x -> if(x.type = 'text', nullif(x.text, ''), NULL)"),
        thinking=f"if(is_turn, {B.thinking_of('blocks')}, NULL)",
        calls=f"if(is_turn, transform(filter(blocks, {tool_use}), x -> {call}), NULL)",
        results=f"if(carries, transform(filter(blocks, {answered}), x -> {_result()}), NULL)",
        metrics=f"if(is_turn, {_metrics()}, NULL)",
    )
    facts = [(k, V.json("e", f"$.{k}")) for k in STEP_FACTS]
    rows = S.add(
        rows,
        extra=V.json_object(
            *facts, ("subtype", f"if(kind = 'system', {V.json('e', '$.subtype')}, NULL)")
        ),
        source="""CASE WHEN kind = 'user' AND NOT carries AND user_text <> '' THEN 'user'
                  WHEN is_turn THEN 'agent' END""",
    )
    rows = S.add(rows, source=f"coalesce(source, if(NOT {V.is_blank('notice')}, 'system', NULL))")
    step = S.step(
        ts="ts",
        source="source",
        message="CASE source WHEN 'user' THEN user_text WHEN 'system' THEN notice ELSE coalesce(agent_text, '') END",
        model_name=f"if(is_turn, {V.string('message', '$.model')}, NULL)",
        reasoning_content="thinking",
        tool_calls="if(size(calls) > 0, calls, NULL)",
        metrics="metrics",
        extra="extra",
    )
    return B.attach_results(S.add(rows, step=f"if(source IS NOT NULL, {step}, NULL)"))
