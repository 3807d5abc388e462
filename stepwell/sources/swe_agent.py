"""Benchmark rows of the SWE-agent harness."""

from __future__ import annotations

from pyspark.sql import DataFrame

from stepwell.functions import variants as V
from stepwell.sources import sessions as S
from stepwell.sources.detect import SWE_AGENT_KEYS

# Fixed value: characters kept of the evaluation log.
EVAL_LOG_CAP = 10_000

# "user" entries are harness output, not a person
SOURCE = "CASE WHEN {role} IN ('system', 'user') THEN 'system' WHEN {role} = 'ai' THEN 'agent' END"


def _extra() -> str:
    log = V.text("doc", "$.eval_logs")
    patch = V.string("doc", "$.generated_patch")
    shown = (
        f"if(length({log}) <= {EVAL_LOG_CAP}, {log}, concat(left({log}, {EVAL_LOG_CAP}), "
        f"'\\n...[truncated, ', length({log}) - {EVAL_LOG_CAP}, ' more bytes]'))"
    )
    return f"""to_json(named_struct(
        'resolved', {V.boolean('doc', '$.target')},
        'exit_status', {V.text('doc', '$.exit_status')},
        'generated_patch', if({V.is_blank(patch)}, NULL, {patch}),
        'eval_logs', {shown},
        'eval_logs_full_bytes', length({log})))"""


def normalize(raw: DataFrame) -> DataFrame:
    """Benchmark documents to sessions, row by row and without a shuffle."""
    docs = S.add(raw.select("path", "raw_blob"), doc=V.parse("raw_blob"))
    needed = " AND ".join(V.has_key("doc", key) for key in SWE_AGENT_KEYS)
    docs = docs.filter(f"{needed} AND {V.text('doc', '$.instance_id')} IS NOT NULL")

    cutoff = f"if({V.text('e', '$.cutoff_date')} IS NOT NULL, {V.json('e', '$.cutoff_date')}, NULL)"
    entry = f"""named_struct(
        'role', {V.string('e', '$.role')},
        'text', coalesce({V.text('e', '$.text')}, {V.text('e', '$.system_prompt')}),
        'extra', {V.json_object(('mask', V.json('e', '$.mask')), ('cutoff_date', cutoff))})"""
    objects = f"filter({V.array('doc', '$.trajectory')}, e -> {V.is_object('e')})"
    docs = S.add(docs, _entries=f"transform({objects}, e -> {entry})")
    docs = S.add(docs, _spoken=f"filter(_entries, x -> NOT {V.is_blank('x.text')})")

    source = SOURCE.format(role="x.role")
    strange = (
        f"transform(filter(_spoken, x -> {source} IS NULL), x -> coalesce(x.role, '<no-role>'))"
    )
    head = S.header(
        schema_version=f"'{S.SCHEMA_VERSION}'",
        session_id=V.text("doc", "$.instance_id"),
        agent_name="'swe-agent'",
        agent_version="'unknown'",
        model=V.text("doc", "$.model_name"),
        agent_extra="""'{"original_format":"swe-agent-hf-row"}'""",
        resolved=V.boolean("doc", "$.target"),
        exit_status=V.text("doc", "$.exit_status"),
        counters=S.counter_map(S.counts_of(strange, "unknown_role:")),
        extra=_extra(),
    )
    docs = S.add(docs, header=head)
    spoken = S.step(
        source=source,
        message="x.text",
        model_name="if(x.role = 'ai', header.model, NULL)",
        extra="x.extra",
    )
    steps = f"transform(filter(_spoken, x -> {source} IS NOT NULL), x -> {spoken})"
    return S.finish(S.add(docs, steps=steps))
