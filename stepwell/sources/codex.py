"""Rollout logs: one event per line, calls and outputs as separate events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stepwell.functions import variants as V
from stepwell.sources import blocks as B
from stepwell.sources import sessions as S
from stepwell.sources.claude_code import first_present
from stepwell.sources.detect import CODEX_EVENT_TYPES, in_list, stem_sql
from stepwell.sources.files import parsed_lines

# Inner types of response items that the log is known to carry.
ITEM_TYPES = (
    "reasoning",
    "message",
    "function_call",
    "custom_tool_call",
    "function_call_output",
    "custom_tool_call_output",
    "web_search_call",
)
SEARCH_FIELDS = ("type", "query", "queries", "url")
USAGE_EXTRAS = ("reasoning_output_tokens", "total_tokens")


def reasoning_text(payload: str) -> str:
    """Summary texts, one per line, or a placeholder for withheld reasoning."""
    summary = V.texts(
        V.array(payload, "$.summary"), f"s -> coalesce({V.text('s')}, {V.text('s', '$.text')})"
    )
    hidden = V.text(payload, "$.encrypted_content")
    return (
        f"coalesce(nullif({summary}, ''), concat('[encrypted reasoning, ', length({hidden}), ' bytes]'))"
    )


def coerce_arguments(v: str) -> tuple[str, str]:
    """SQL for (arguments as a JSON object, raw value as JSON or NULL)."""
    parsed = V.parse(V.string(v))
    arguments = f"""CASE
        WHEN {V.is_object(v)} THEN to_json({v})
        WHEN {V.json(v)} IS NULL THEN '{{}}'
        WHEN {V.string(v)} IS NULL THEN concat('{{"value":', to_json({v}), '}}')
        WHEN {V.is_object(parsed)} THEN to_json({parsed})
        WHEN {parsed} IS NOT NULL THEN concat('{{"value":', to_json({parsed}), '}}')
        ELSE concat('{{"input":', to_json({v}), '}}') END"""
    return arguments, f"if({V.is_object(v)}, NULL, {V.json(v)})"


def coerce_output(v: str, parsed: str) -> tuple[str, str]:
    """SQL for (text, metadata as JSON or NULL) of a tool output; ``parsed`` is its document."""
    inner = V.member(parsed, "$.output")
    shown = f"""CASE
        WHEN {V.is_object(parsed)}
            THEN coalesce({V.string(inner)}, {V.json(inner)}, to_json({parsed}))
        WHEN {parsed} IS NULL THEN coalesce({V.string(v)}, '')
        ELSE coalesce({V.loose(parsed)}, '') END"""
    meta = V.obj(parsed, "$.metadata")
    return shown, f"nullif(to_json({meta}), '{{}}')"


def parsed_output(v: str) -> str:
    return f"if({V.string(v)} IS NOT NULL, {V.parse(V.string(v))}, {v})"


def _header(events: str) -> str:
    instructions = (
        f"coalesce({V.json('_meta', '$.base_instructions')}, {V.json('_meta', '$.instructions')})"
    )
    mode = V.text("_first", "$.synthetic_failure_mode")
    mode_json = f"if({mode} IS NOT NULL, {V.json('_first', '$.synthetic_failure_mode')}, NULL)"
    outer = f"transform({events}, e -> coalesce({V.string('e', '$.type')}, '<no-type>'))"
    inner = f"transform(_items, p -> coalesce({V.text('p', '$.type')}, '<no-payload-type>'))"
    strange = (
        f"concat(filter({outer}, t -> t NOT IN {in_list(CODEX_EVENT_TYPES)}), "
        f"filter({inner}, t -> t NOT IN {in_list(ITEM_TYPES)}))"
    )
    usage = V.obj("_info", "$.total_token_usage")
    last = f"if({usage} IS NOT NULL, {V.json(V.obj('_info', '$.last_token_usage'))}, NULL)"
    return S.header(
        schema_version=f"'{S.SCHEMA_VERSION}'",
        session_id=f"coalesce({V.text('_meta', '$.id')}, {stem_sql('file_name')})",
        agent_name="'codex'",
        agent_version=f"coalesce({V.text('_meta', '$.cli_version')}, 'unknown')",
        model=f"get(filter(transform(_contexts, p -> {V.text('p', '$.model')}), m -> m IS NOT NULL), 0)",
        agent_extra=V.json_object(
            *[(k, V.json("_meta", f"$.{k}")) for k in ("originator", "cwd", "git")],
            ("base_instructions", instructions),
            ("user_instructions", V.json(first_present("_contexts", "$.user_instructions"))),
        ),
        total_prompt_tokens=V.number(usage, "$.input_tokens"),
        total_completion_tokens=V.number(usage, "$.output_tokens"),
        total_cached_tokens=V.number(usage, "$.cached_input_tokens"),
        metrics_extra=V.json_object(
            *[(k, V.json(usage, f"$.{k}")) for k in USAGE_EXTRAS], ("last_token_usage", last)
        ),
        synthetic_failure_mode=mode,
        counters=S.counter_map(S.counts_of(strange, "unknown:")),
        extra=V.json_object(
            ("synthetic", f"if({V.boolean('_first', '$.synthetic')}, 'true', NULL)"),
            ("synthetic_failure_mode", mode_json),
        ),
    )


def _facts(docs: DataFrame) -> DataFrame:
    """Payloads the header is read from."""

    def payloads(kind: str) -> str:
        return (
            f"filter(transform(filter(events, e -> {V.loose('e', '$.type')} = '{kind}'), "
            f"e -> {V.member('e', '$.payload')}), p -> {V.is_object('p')})"
        )

    docs = S.add(
        docs,
        _first="get(events, 0)",
        _metas=payloads("session_meta"),
        _contexts=payloads("turn_context"),
        _items=payloads("response_item"),
        _infos=(
            f"filter(transform(filter({payloads('event_msg')}, "
            f"p -> {V.loose('p', '$.type')} = 'token_count'), p -> {V.member('p', '$.info')}), "
            f"i -> {V.is_object('i')})"
        ),
    )
    return S.add(
        docs,
        _meta=(
            f"coalesce(get(filter(_metas, p -> {V.text('p', '$.id')} IS NOT NULL), 0), "
            "try_element_at(_metas, -1))"
        ),
        _info="try_element_at(_infos, -1)",
    )


def _classify(rows: DataFrame) -> DataFrame:
    """What each event contributes; ``kind`` is NULL for events without a step."""
    rows = S.add(
        rows,
        payload=f"if({V.loose('e', '$.type')} = 'response_item', {V.obj('e', '$.payload')}, NULL)",
        ts=V.string("e", "$.timestamp"),
    )
    rows = S.add(rows, ptype=V.loose("payload", "$.type"), _id=V.string("payload", "$.call_id"))
    parts = V.texts(
        V.array("payload", "$.content"), f"b -> {V.string('b', '$.text')}", sep=""
    )
    rows = S.add(
        rows,
        said=f"if(ptype = 'message', coalesce({V.string('payload', '$.content')}, {parts}, ''), NULL)",
        given=(
            f"CASE ptype WHEN 'function_call' THEN {V.member('payload', '$.arguments')} "
            f"WHEN 'custom_tool_call' THEN {V.member('payload', '$.input')} END"
        ),
        answer=f"if(ptype LIKE '%call_output', {V.member('payload', '$.output')}, NULL)",
    )
    rows = S.add(
        rows,
        kind="""CASE
            WHEN ptype = 'reasoning' THEN 'reasoning'
            WHEN ptype = 'message' AND said <> '' THEN 'message'
            WHEN ptype IN ('function_call', 'custom_tool_call') AND _id <> '' THEN 'call'
            WHEN ptype IN ('function_call_output', 'custom_tool_call_output') THEN 'output'
            WHEN ptype = 'web_search_call' THEN 'search' END""",
        parsed=f"if(answer IS NOT NULL, {parsed_output('answer')}, NULL)",
    ).filter("kind IS NOT NULL OR header IS NOT NULL")
    arguments, raw_arguments = coerce_arguments("given")
    output, metadata = coerce_output("answer", "parsed")
    query = V.json_object(*[(k, V.json("payload", f"$.action.{k}")) for k in SEARCH_FIELDS])
    searched = (
        f"coalesce({V.text('payload', '$.action.query')}, {V.text('payload', '$.action.url')}, '<no query>')"
    )
    return rows.selectExpr(
        "path",
        "header",
        "line",
        "kind",
        "ts",
        "if(kind IN ('call', 'output'), _id, NULL) AS call_id",
        f"if(kind = 'search', coalesce({V.string('payload', '$.id')}, ''), NULL) AS search_id",
        f"""CASE WHEN kind <> 'message' THEN 'agent'
             WHEN NOT {V.has_key('payload', 'role')} THEN 'user'
             WHEN {V.loose('payload', '$.role')} = 'user' THEN 'user'
             WHEN {V.loose('payload', '$.role')} = 'assistant' THEN 'agent'
             ELSE 'system' END AS source""",
        f"if(kind = 'search', concat('Web search: ', {searched}), said) AS text",
        f"coalesce({V.string('payload', '$.name')}, '') AS name",
        f"""CASE kind WHEN 'call' THEN {arguments}
             WHEN 'search' THEN coalesce({query}, '{{}}') ELSE '{{}}' END AS arguments""",
        f"if(kind = 'call', {raw_arguments}, NULL) AS raw_arguments",
        f"{V.json('payload', '$.status')} AS status",
        f"if(kind = 'output', {output}, NULL) AS output",
        f"if(kind = 'output', {metadata}, NULL) AS metadata",
        f"if(kind = 'reasoning', {reasoning_text('payload')}, NULL) AS thought",
    )


def carry_reasoning(rows: DataFrame) -> DataFrame:
    """Hand each reasoning text to the next consumer only.

    Consumers are agent messages, calls, searches and unmatched outputs (``consumes``).
    The text arrives when the row before a consumer, among reasoning rows and consumers,
    is a reasoning row.
    """
    before = Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    party = F.expr("if(kind = 'reasoning' OR consumes, struct(kind = 'reasoning' AS gives, thought), NULL)")
    return S.add(
        rows.withColumn("_previous", F.last(party, ignorenulls=True).over(before)),
        carried="if(consumes AND _previous.gives, _previous.thought, NULL)",
    ).drop("_previous")


def _pair(rows: DataFrame) -> DataFrame:
    """Match outputs with calls: an output answers the call right before it, by call id."""
    per_call = Window.partitionBy("path", "call_id").orderBy("line")
    earlier = per_call.rowsBetween(Window.unboundedPreceding, -1)
    is_output = F.expr("if(kind = 'output', 1, 0)")
    rows = rows.withColumns(
        {
            "_before": F.lag("kind").over(per_call),
            "_after": F.lead("kind").over(per_call),
            "_round": F.coalesce(F.sum(is_output).over(earlier), F.lit(0)),
        }
    )
    rows = S.add(
        rows,
        matched="coalesce(kind = 'output' AND call_id IS NOT NULL AND _before = 'call', false)",
        pending="coalesce(kind = 'call' AND _after IS NULL, false)",
    )
    rows = S.add(
        rows,
        consumes="""coalesce(kind IN ('call', 'search') OR (kind = 'message' AND source = 'agent')
                    OR (kind = 'output' AND NOT matched), false)""",
    )
    rows = carry_reasoning(rows)
    call = F.struct("ts", "name", "arguments", "raw_arguments", "status", "carried")
    one_round = Window.partitionBy("path", "call_id", "_round")
    rows = rows.withColumns(
        {
            "_call": F.lag(call).over(per_call),
            "_opened_at": F.min(F.expr("if(kind = 'call', line, NULL)")).over(one_round),
        }
    )
    used = {
        name: f"if(matched, _call.{name}, {name})"
        for name in ("name", "arguments", "raw_arguments", "carried")
    }
    used["status"] = "CASE WHEN matched THEN _call.status WHEN kind <> 'output' THEN status END"
    used["ts"] = "if(matched, coalesce(nullif(_call.ts, ''), ts), ts)"
    return S.add(rows, **used)


def normalize(raw: DataFrame) -> DataFrame:
    """Rollout logs to sessions.

    A call and its output become one step at the place of the output; a call without an
    output comes last and is marked pending.  All windows run inside one file, after one
    shuffle.
    """
    docs = raw.selectExpr("path", "file_name", f"{parsed_lines('raw_blob')} AS events")
    docs = _facts(docs.filter("size(events) > 0"))
    events = S.explode_events(docs, _header("events"), "events")
    rows = _pair(_classify(events).repartition("path"))

    extra = V.json_object(
        ("raw_arguments", "raw_arguments"), ("status", "status"), ("pending", "if(pending, 'true', NULL)")
    )
    call = S.call(
        "coalesce(call_id, search_id, '')",
        "if(kind = 'search', 'web_search_call', name)",
        "arguments",
        extra,
    )
    answer = S.result(
        "call_id", "output", "if(metadata IS NOT NULL, concat('{\"tool_metadata\":', metadata, '}'), NULL)"
    )
    label = "if(name <> '', name, '<unnamed>')"
    step = S.step(
        ts="ts",
        source="source",
        message=f"""CASE WHEN kind = 'output' THEN concat('Tool call: ', {label})
                    WHEN pending THEN concat('Tool call (no output): ', {label}) ELSE text END""",
        reasoning_content="carried",
        tool_calls=f"if(kind <> 'message', array({call}), NULL)",
        results=f"if(kind = 'output', array({answer}), NULL)",
    )
    placed = rows.selectExpr(
        "path",
        "header",
        "if(pending, 1, 0) AS _late",
        "if(pending, _opened_at, line) AS _at",
        f"if(kind IN ('message', 'output', 'search') OR pending, {step}, NULL) AS step",
        "if(kind = 'output' AND NOT matched, 1, 0) AS _unmatched",
    )
    sessions = S.gather(placed, ["_late", "_at"], unmatched="sum(_unmatched)")
    counters = F.expr(S.with_counter("header.counters", "unmatched_tool_outputs", "unmatched"))
    return B.model_on_agent_steps(
        S.finish(sessions.withColumn("header", F.col("header").withField("counters", counters)))
    )
