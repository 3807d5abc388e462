"""Content blocks shared by the chat formats, and the pairing of calls with results.

Blocks are first lifted into structs (type, text, b), so each is looked into once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stepwell.functions import variants as V
from stepwell.sources import sessions as S


def blocks_of(content: str) -> str:
    """Array of (type, text, b) structs of a content list; NULL when it is no list."""
    return (
        f"transform({V.array(content)}, b -> named_struct('type', {V.loose('b', '$.type')}, "
        f"'text', {V.string('b', '$.text')}, 'b', b))"
    )


def thinking_of(blocks: str) -> str:
    """Thinking texts, one per line, with a placeholder where only a signature was sent."""
    signature = V.text("x.b", "$.signature")
    withheld = f"concat('[encrypted thinking, signature ', length({signature}), ' bytes]')"
    thought = f"coalesce({V.text('x.b', '$.thinking')}, nullif(x.text, ''), {withheld})"
    return f"nullif({V.texts(blocks, f'''x -> if(x.type = 'thinking', {thought}, NULL)''')}, '')"


def arguments_of(v: str) -> str:
    """Call arguments as a JSON object; other JSON is kept under ``_raw``."""
    return (
        f"CASE WHEN {V.is_object(v)} THEN to_json({v}) WHEN {V.json(v)} IS NULL THEN '{{}}' "
        f"ELSE concat('{{\"_raw\":', to_json({v}), '}}') END"
    )


def usage_totals(usages: str) -> dict[str, str]:
    """Header fields with the summed token counts of an array of usage objects."""

    def total(name: str) -> str:
        return (
            f"aggregate({usages}, bigint(0), (a, u) -> a + coalesce({V.integer('u', '$.' + name)}, 0))"
        )

    def seen(value: str) -> str:
        return f"if(size({usages}) > 0, {value}, NULL)"

    written = total("cache_creation_input_tokens")
    return {
        "total_prompt_tokens": seen(total("input_tokens")),
        "total_completion_tokens": seen(total("output_tokens")),
        "total_cached_tokens": seen(total("cache_read_input_tokens")),
        "metrics_extra": seen(
            f"if({written} > 0, concat('{{\"cache_creation_input_tokens\":', {written}, '}}'), NULL)"
        ),
    }


def items(rows: DataFrame) -> DataFrame:
    """One row per step, call and result of rows (path, header, line, step, calls, results)."""

    def item(kind: str, pos: str = "0", call_id: str = "NULL", step: str = "NULL", result: str = "NULL") -> str:
        return (
            f"named_struct('kind', '{kind}', 'pos', {pos}, 'call_id', cast({call_id} as string), "
            f"'step', cast({step} as {S.STEP}), 'result', cast({result} as {S.RESULT}))"
        )

    none = "array()"
    own = f"if(step IS NOT NULL OR header IS NOT NULL, array({item('step', step='step')}), {none})"
    made = f"coalesce(transform(calls, (c, i) -> {item('call', 'i', 'c.tool_call_id')}), {none})"
    got = (
        f"coalesce(transform(results, (r, i) -> {item('result', 'i', 'r.source_call_id', result='r')}), {none})"
    )
    return rows.selectExpr("path", "header", "line", f"inline(concat({own}, {made}, {got}))")


def attach_results(rows: DataFrame) -> DataFrame:
    """Sessions in which every result hangs on the latest earlier step that made its call.

    Everything is partitioned by file, once.  Within a line results come before calls,
    so a message cannot answer its own call.
    """
    by_file = items(rows).repartition("path")
    w = (
        Window.partitionBy("path", "call_id")
        .orderBy("line", (F.col("kind") == "call"), "pos")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    opened = F.last(F.when(F.col("kind") == "call", F.col("line")), ignorenulls=True).over(w)
    placed = S.add(
        by_file.withColumn("_opened", opened),
        target="CASE WHEN kind <> 'result' THEN line WHEN call_id IS NOT NULL THEN _opened END",
    ).filter("kind <> 'call'")
    merged = placed.groupBy("path", "target").agg(
        F.expr("first(header, true)").alias("header"),
        F.expr("first(step, true)").alias("_step"),
        F.expr(
            "array_sort(collect_list(if(kind = 'result', struct(line, pos, result), NULL)))"
        ).alias("_answers"),
    )
    results = f"cast(if(size(_answers) > 0, transform(_answers, a -> a.result), NULL) as {S.RESULTS})"
    stepped = S.add(merged, _results=results).withColumn(
        "step", F.when(F.col("_step").isNotNull(), F.col("_step").withField("results", F.col("_results")))
    )
    sessions = S.gather(
        stepped,
        ["target"],
        unmatched="coalesce(sum(if(target IS NULL, size(_answers), 0)), 0)",
    )
    counters = F.expr(S.with_counter("header.counters", "unmatched_tool_results", "unmatched"))
    return S.finish(
        sessions.withColumn("header", F.col("header").withField("counters", counters))
    )


def model_on_agent_steps(sessions: DataFrame) -> DataFrame:
    """Agent steps carry the model of their session."""
    model = F.col("header.model")
    return sessions.withColumn(
        "steps",
        F.transform(
            "steps", lambda s: s.withField("model_name", F.when(s["source"] == "agent", model))
        ),
    )
