"""Files that already hold the canonical layout; older ones are lifted to the current one."""

from __future__ import annotations

from pyspark.sql import DataFrame

from stepwell.functions import variants as V
from stepwell.sources import sessions as S


def flatten_content(v: str) -> str:
    """Searchable text of a result: strings as they are, blocks by their text, rest as JSON."""
    blocks = f"transform({V.array(v)}, b -> coalesce({V.string('b', '$.text')}, to_json(b)))"
    return f"coalesce({V.string(v)}, array_join({blocks}, '\\n'), {V.json(v)}, '')"


def visible_text(v: str) -> str:
    """Text of a result for display: a string or its text blocks, NULL for other shapes."""
    joined = V.texts(V.array(v), f"b -> {V.text('b', '$.text')}")
    return f"coalesce({V.string(v)}, nullif({joined}, ''))"


def _metrics(s: str) -> str:
    """``metrics``, or the older ``usage`` with its older cache field."""

    def field(name: str, *older: str) -> str:
        then = ", ".join(V.integer(s, f"$.usage.{n}") for n in (name, *older))
        return (
            f"'{name}', if({V.has_key(s, 'metrics')}, {V.integer(s, f'$.metrics.{name}')}, "
            f"coalesce({then}))"
        )

    packed = (
        f"named_struct({field('prompt_tokens')}, {field('completion_tokens')}, "
        f"{field('cached_tokens', 'cache_tokens')}, 'extra', {V.json(s, '$.metrics.extra')})"
    )
    return f"if({V.has_key(s, 'metrics')} OR {V.has_key(s, 'usage')}, {packed}, NULL)"


def _step(s: str) -> str:
    name = f"coalesce({V.string('c', '$.function_name')}, {V.string('c', '$.name')})"
    made = S.call(
        V.string("c", "$.tool_call_id"),
        name,
        f"coalesce({V.json('c', '$.arguments')}, 'null')",
        V.json("c", "$.extra"),
    )
    content = V.member("r", "$.content")
    answer = S.result(
        V.string("r", "$.source_call_id"),
        flatten_content(content),
        V.json("r", "$.extra"),
        visible_text(content),
    )
    return S.step(
        ts=V.string(s, "$.timestamp"),
        source=V.string(s, "$.source"),
        message=f"coalesce({V.string(s, '$.message')}, {visible_text(V.member(s, '$.message'))})",
        model_name=V.string(s, "$.model_name"),
        reasoning_content=V.string(s, "$.reasoning_content"),
        tool_calls=f"transform({V.array(s, '$.tool_calls')}, c -> {made})",
        results=f"transform({V.array(s, '$.observation.results')}, r -> {answer})",
        metrics=_metrics(s),
        extra=V.json(s, "$.extra"),
    )


def normalize(raw: DataFrame) -> DataFrame:
    """Canonical documents to sessions, row by row and without a shuffle."""
    docs = S.add(raw.select("path", "raw_blob"), doc=V.parse("raw_blob"))
    docs = S.add(docs, _steps=V.array("doc", "$.steps"))
    numbers = f"transform(_steps, s -> {V.integer('s', '$.step_id')})"
    speaks = f"s -> {V.string('s', '$.source')} IS NOT NULL AND {V.present('s', '$.message')}"
    docs = docs.filter(f"""
        {V.string('doc', '$.schema_version')} IS NOT NULL
        AND {V.string('doc', '$.agent.name')} IS NOT NULL
        AND {V.string('doc', '$.agent.version')} IS NOT NULL
        AND size(_steps) > 0
        AND {numbers} = cast(sequence(1, size(_steps)) as array<bigint>)
        AND forall(_steps, {speaks})""")
    head = S.header(
        schema_version=V.string("doc", "$.schema_version"),
        trajectory_id=V.string("doc", "$.trajectory_id"),
        session_id=V.string("doc", "$.session_id"),
        agent_name=V.string("doc", "$.agent.name"),
        agent_version=V.string("doc", "$.agent.version"),
        model=V.string("doc", "$.agent.model_name"),
        agent_extra=V.json("doc", "$.agent.extra"),
        total_prompt_tokens=V.integer("doc", "$.final_metrics.total_prompt_tokens"),
        total_completion_tokens=V.integer("doc", "$.final_metrics.total_completion_tokens"),
        total_cached_tokens=V.integer("doc", "$.final_metrics.total_cached_tokens"),
        metrics_extra=V.json("doc", "$.final_metrics.extra"),
        resolved=V.boolean("doc", "$.extra.resolved"),
        exit_status=V.string("doc", "$.extra.exit_status"),
        synthetic_failure_mode=V.string("doc", "$.extra.synthetic_failure_mode"),
        extra=V.json("doc", "$.extra"),
    )
    return S.finish(S.add(docs, header=head, steps=f"transform(_steps, s -> {_step('s')})"))
