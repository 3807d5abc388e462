"""Exported chat envelopes: one JSON object with a list of messages."""

from __future__ import annotations

from pyspark.sql import DataFrame

from stepwell.functions import variants as V
from stepwell.sources import blocks as B
from stepwell.sources import sessions as S
from stepwell.sources.detect import stem_sql

# Role -> source.
SOURCE = "CASE {role} WHEN 'user' THEN 'user' WHEN 'assistant' THEN 'agent' WHEN 'system' THEN 'system' END"


def _either(v: str, first: str, second: str) -> str:
    return f"coalesce({V.text(v, f'$.{first}')}, {V.string(v, f'$.{second}')})"


def _header() -> str:
    roles = f"transform(_objects, m -> coalesce({V.string('m', '$.role')}, '<no-role>'))"
    strange = f"filter({roles}, r -> {SOURCE.format(role='r')} IS NULL)"
    usages = f"filter(transform(_objects, m -> {V.member('m', '$.usage')}), u -> {V.is_object('u')})"

    def filled(name: str) -> str:
        return f"if({V.text('doc', f'$.{name}')} IS NOT NULL, {V.json('doc', f'$.{name}')}, NULL)"

    return S.header(
        schema_version=f"'{S.SCHEMA_VERSION}'",
        session_id=f"coalesce({V.text('doc', '$.session_id')}, {stem_sql('file_name')})",
        agent_name="'cursor'",
        agent_version=f"coalesce({V.text('doc', '$.cursor_version')}, 'unknown')",
        model=V.text("doc", "$.model"),
        synthetic_failure_mode=V.text("doc", "$.synthetic_failure_mode"),
        counters=S.counter_map(S.counts_of(strange, "unknown_role:")),
        extra=V.json_object(
            ("workspace_path", filled("workspace_path")),
            ("synthetic", f"if({V.boolean('doc', '$.synthetic')}, 'true', NULL)"),
            ("synthetic_failure_mode", filled("synthetic_failure_mode")),
        ),
        **B.usage_totals(usages),
    )


def normalize(raw: DataFrame) -> DataFrame:
    """Envelopes to sessions; results are joined to calls with one shuffle by file."""
    docs = raw.selectExpr("path", "file_name", f"{V.parse('raw_blob')} AS doc")
    docs = S.add(docs.filter(V.is_object("doc")), messages=V.array("doc", "$.messages"))
    docs = S.add(
        docs.filter("size(messages) > 0"), _objects=f"filter(messages, m -> {V.is_object('m')})"
    )
    rows = S.explode_events(docs, _header(), "_objects")
    rows = S.add(
        rows,
        source=SOURCE.format(role=V.loose("e", "$.role")),
        said=V.string("e", "$.content"),
        blocks=B.blocks_of(V.member("e", "$.content")),
        ts=V.text("e", "$.timestamp"),
    )
    named = f"""c -> {_either('c', 'id', 'tool_call_id')} IS NOT NULL
                 AND {_either('c', 'name', 'function_name')} IS NOT NULL"""
    given, other = V.member("c", "$.arguments"), V.member("c", "$.input")
    call = S.call(
        _either("c", "id", "tool_call_id"),
        _either("c", "name", "function_name"),
        f"if({V.present('c', '$.arguments')}, {B.arguments_of(given)}, {B.arguments_of(other)})",
    )
    content = V.member("r", "$.content")
    parts = V.texts(V.array(content), f"s -> {V.string('s', '$.text')}")
    answer = S.result(
        _either("r", "tool_call_id", "id"),
        f"coalesce({V.string(content)}, {parts}, {V.json(content)}, '')",
    )
    answers = f"filter({V.array('e', '$.tool_results')}, r -> {V.is_object('r')})"
    shown = V.texts("blocks", "x -> if(x.type <=> 'thinking', NULL, nullif(x.text, ''))")
    rows = S.add(
        rows,
        text=f"coalesce(said, {shown}, '')",
        thinking=f"if(source = 'agent', {B.thinking_of('blocks')}, NULL)",
        calls=f"""if(source IS NOT NULL,
                  transform(filter({V.array('e', '$.tool_calls')}, {named}), c -> {call}), NULL)""",
        results=f"if(source IS NOT NULL, transform({answers}, r -> {answer}), NULL)",
    )
    step = S.step(
        ts="ts",
        source="source",
        message="text",
        reasoning_content="thinking",
        tool_calls="if(size(calls) > 0, calls, NULL)",
    )
    speaks = f"(NOT {V.is_blank('text')} OR coalesce(size(calls), 0) > 0 OR thinking IS NOT NULL)"
    rows = S.add(rows, step=f"if(source IS NOT NULL AND {speaks}, {step}, NULL)")
    return B.model_on_agent_steps(B.attach_results(rows))
