"""Bounded text renderings of a trace: search text, prompt bodies, titles, short threads.

Every rendering shows the tail of a trace only, so the steps are cut to that tail before
anything is collected: at most ``tail`` short lines per trace meet in one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepwell.functions import text as T
from stepwell.operators.sequencing import tail as last_steps

# Caps of the search text.
SEARCH_TEXT_CAP = 4096
SEARCH_TAIL = 12
SEARCH_MESSAGE_CAP = 220
SEARCH_RESULT_CAP = 140
TASK_CAP = 600
TOOLS_SHOWN = 20

# Caps of the prompt body.
PROMPT_CAP = 36_000
PROMPT_TAIL = 30
PROMPT_MESSAGE_CAP = 300
PROMPT_RESULT_CAP = 200

# Rules of the task title.
TITLE_CAP = 110
SYSTEM_TITLE_MIN = 80
FRAMING_PREFIXES = (
    "SETTING:",
    "You are an autonomous",
    "You are a helpful",
    "You are an AI",
)
TASK_MARKERS = ("ISSUE:", "TASK:", "BUG:", "PROBLEM:")

# Shape of a shortened thread.
THREAD_LIMIT = 130
THREAD_HEAD = 30
THREAD_TAIL = 100

LINE_BREAK = r"\R|\x1c|\x1d|\x1e"


def step_line(
    message_cap: int = SEARCH_MESSAGE_CAP,
    result_cap: int = SEARCH_RESULT_CAP,
    index: Column | None = None,
    unnamed: str | None = None,
    empty_results: bool = False,
) -> Column:
    """``[source] message {tools} -> result`` for one step, over the canonical columns.

    ``unnamed`` stands for calls without a name; NULL leaves them out.  With
    ``empty_results`` an empty result text still leaves its arrow.
    """
    source = F.when(F.col("source") != "", F.col("source")).otherwise("?")
    message = F.when(
        T.is_blank(F.col("message")), F.lit("(no message)")
    ).otherwise(T.truncate(F.col("message"), message_cap))
    names = F.transform(
        F.col("tool_calls"),
        lambda c: F.when(c["function_name"] != "", c["function_name"]).otherwise(F.lit(unnamed)),
    )
    names = F.filter(names, lambda n: n.isNotNull())
    tools = F.when(F.size(names) > 0, F.concat(F.lit("{"), F.array_join(names, ", "), F.lit("}")))
    result = F.get(F.col("results"), F.lit(0))["text"]
    shown = result.isNotNull() if empty_results else (result != "")
    arrow = F.when(shown, F.concat(F.lit("-> "), T.truncate(result, result_cap)))
    lead = F.concat(F.lit("["), source, F.lit("] "), message)
    if index is not None:
        lead = F.concat(index, lead)
    return F.concat_ws(" ", lead, tools, arrow)


def _ordered_lines(lines: DataFrame, key: str = "trace_id") -> DataFrame:
    """Join the (few) lines of each trace in step order."""
    return lines.groupBy(key).agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("step_id", "line"))), lambda s: s["line"]
            ),
            "\n",
        ).alias("body"),
        F.max("step_id").alias("n_steps"),
        F.count("*").alias("n_shown"),
    )


def task_text(steps: DataFrame) -> DataFrame:
    """First non-blank message from somebody other than the agent, per trace.

    The first such step is picked before the message text is shuffled.
    """
    other = steps.filter(
        ~F.col("source").eqNullSafe(F.lit("agent")) & ~T.is_blank(F.col("message"))
    )
    w = Window.partitionBy("trace_id").orderBy("step_id")
    return (
        other.select("trace_id", "step_id", F.col("message").alias("task"))
        .withColumn("_rn", F.row_number().over(w))
        .filter(F.col("_rn") == 1)
        .select("trace_id", "task")
    )


def tool_names(steps: DataFrame, shown: int = TOOLS_SHOWN) -> DataFrame:
    """First ``shown`` distinct tool names of a trace in order of first use."""
    calls = steps.filter(F.size("tool_calls") > 0).select(
        "trace_id", "step_id", F.posexplode("tool_calls").alias("pos", "call")
    )
    named = calls.select(
        "trace_id",
        F.col("call.function_name").alias("name"),
        (F.col("step_id").cast("long") * 65_536 + F.col("pos")).alias("at"),
    ).filter(F.col("name") != "")
    firsts = named.groupBy("trace_id", "name").agg(F.min("at").alias("at"))
    w = Window.partitionBy("trace_id").orderBy("at")
    kept = firsts.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= shown)
    return kept.groupBy("trace_id").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("at", "name"))), lambda s: s["name"]),
            ", ",
        ).alias("tools")
    )


def render_tail(
    steps: DataFrame,
    tail: int = PROMPT_TAIL,
    message_cap: int = PROMPT_MESSAGE_CAP,
    result_cap: int = PROMPT_RESULT_CAP,
    with_index: bool = False,
    cap: int = PROMPT_CAP,
) -> DataFrame:
    """Prompt body per trace: the last steps, one line each, behind an omission marker."""
    index = (
        F.concat(F.lit("[step "), F.col("step_id").cast("string"), F.lit("] "))
        if with_index
        else None
    )
    lines = last_steps(steps, tail).select(
        "trace_id",
        "step_id",
        step_line(message_cap, result_cap, index, unnamed="?", empty_results=True).alias("line"),
    )
    joined = _ordered_lines(lines)
    omitted = F.col("n_steps") - F.col("n_shown")
    if with_index:
        marker = F.concat(
            F.lit("(... "),
            omitted.cast("string"),
            F.lit(" earlier steps omitted; visible steps start at step "),
            (omitted + 1).cast("string"),
            F.lit(" ...)\n"),
        )
    else:
        marker = F.concat(F.lit("(... "), omitted.cast("string"), F.lit(" earlier steps omitted ...)\n"))
    body = F.concat(F.when(omitted > 0, marker).otherwise(""), F.col("body"))
    short = F.concat(T.rstrip(F.left(body, F.lit(cap - 50))), F.lit("\n(... truncated ...)"))
    return joined.select(
        "trace_id", F.when(F.length(body) > cap, short).otherwise(body).alias("conversation")
    )


def prompt_facts(trajectories: DataFrame, steps: DataFrame, signals: DataFrame | None = None) -> DataFrame:
    """Fact lines of a prompt: agent, model, counts and, if given, the signals that fired."""
    counts = steps.groupBy("trace_id").agg(
        F.count("*").alias("n_steps"),
        F.sum(F.greatest(F.coalesce(F.size("tool_calls"), F.lit(0)), F.lit(0))).alias("n_calls"),
    )
    base = trajectories.join(counts, "trace_id", "left")
    lines = [
        F.concat(
            F.lit("- Agent: "),
            F.coalesce("agent_name", F.lit("unknown")),
            F.lit("   Model: "),
            F.coalesce("model", F.lit("unknown")),
        ),
        F.concat(
            F.lit("- Steps: "),
            F.coalesce("n_steps", F.lit(0)).cast("string"),
            F.lit("    Tool calls: "),
            F.coalesce("n_calls", F.lit(0)).cast("string"),
        ),
    ]
    if signals is not None:
        names = sorted(c for c in signals.columns if c not in ("trace_id", "any_signal"))
        fired = F.filter(
            F.array(*[F.when(F.col(n), F.lit(n)) for n in names]), lambda n: n.isNotNull()
        )
        base = base.join(signals, "trace_id", "left")
        lines.append(
            F.concat(
                F.lit("- Rule-based signals fired: "),
                F.when(F.size(fired) > 0, F.array_join(fired, ", ")).otherwise("(none)"),
            )
        )
    return base.select("trace_id", F.concat_ws("\n", *lines).alias("facts"))


def searchable_text(
    trajectories: DataFrame,
    steps: DataFrame,
    cap: int = SEARCH_TEXT_CAP,
    tail: int = SEARCH_TAIL,
) -> DataFrame:
    """Search text per trace: a header that is always kept and the rendered tail.

    ``trajectories``: (trace_id, agent_name, model, failure_label, failure_label_reasoning).
    """
    index = F.concat(F.col("step_id").cast("string"), F.lit(". "))
    lines = last_steps(steps, tail).select(
        "trace_id", "step_id", step_line(index=index).alias("line")
    )
    joined = _ordered_lines(lines)
    base = (
        trajectories.join(joined, "trace_id", "left")
        .join(tool_names(steps), "trace_id", "left")
        .join(task_text(steps), "trace_id", "left")
    )
    total = F.coalesce("n_steps", F.lit(0))

    def line(title: str, value: Column, present: Column) -> Column:
        return F.when(present, F.concat(F.lit(title), value))

    label, reasoning = F.col("failure_label"), F.col("failure_label_reasoning")
    header = F.concat_ws(
        "\n",
        F.concat(F.lit("Agent: "), F.coalesce(F.when(F.col("agent_name") != "", F.col("agent_name")), F.lit("unknown"))),
        F.concat(F.lit("Model: "), F.coalesce(F.when(F.col("model") != "", F.col("model")), F.lit("unknown"))),
        F.concat(F.lit("Step count: "), total.cast("string")),
        line("Tools used: ", F.col("tools"), F.col("tools") != ""),
        line("Failure label: ", T.strip(label), ~T.is_blank(label)),
        line("Label reasoning: ", T.truncate(reasoning, TASK_CAP), ~T.is_blank(reasoning)),
        line("Task: ", T.truncate(F.col("task"), TASK_CAP), F.col("task").isNotNull()),
    )
    omitted = total - F.col("n_shown")
    body = F.concat(
        F.when(
            omitted > 0,
            F.concat(F.lit("(... "), omitted.cast("string"), F.lit(" earlier steps omitted ...)\n")),
        ).otherwise(""),
        F.col("body"),
    )
    parts = base.select("trace_id", header.alias("_header"), total.alias("_n"), body.alias("_body"))
    joint = F.lit("\n\nConversation:\n")
    full = F.concat("_header", joint, "_body")
    room = F.lit(cap) - F.length("_header") - F.length(joint) - F.lit(32)
    text = (
        F.when(
            F.col("_n") == 0,
            T.truncate(F.concat("_header", F.lit("\n\nConversation: (no steps)")), cap),
        )
        .when(F.length(full) <= cap, full)
        .when(room <= 0, T.truncate(F.col("_header"), cap))
        .otherwise(
            F.concat(
                "_header",
                joint,
                T.rstrip(F.left(F.col("_body"), room)),
                F.lit("\n(... truncated ...)"),
            )
        )
    )
    return parts.select("trace_id", text.alias("text"))


def lead_line(message: Column) -> Column:
    """Line after a task marker, else the first non-empty line."""
    lines = F.transform(F.split(message, LINE_BREAK), lambda s: T.strip(s))
    marks = F.array(*[F.lit(m) for m in TASK_MARKERS])
    filled = F.filter(lines, lambda s: s != "")
    marked = F.filter(
        F.transform(lines, lambda s, i: F.when(F.array_contains(marks, s), i)),
        lambda i: i.isNotNull(),
    )
    at = F.get(marked, F.lit(0))
    after = F.filter(lines, lambda s, i: (s != "") & (i > at))
    return F.coalesce(F.get(after, F.lit(0)), F.get(filled, F.lit(0)), T.strip(message))


def task_title(steps: DataFrame, cap: int = TITLE_CAP) -> DataFrame:
    """Readable title per trace.

    First user message; else the first long system message that is not harness framing;
    else the first message of any kind.  Framing steps never become the title.
    """
    source = F.lower(F.coalesce("source", F.lit("")))
    message = F.col("message")
    bare = T.lstrip(message)
    framing = F.lit(False)
    for prefix in FRAMING_PREFIXES:
        framing = framing | bare.startswith(prefix)
    long_system = (source == "system") & (F.length(message) >= SYSTEM_TITLE_MIN)
    rank = (
        F.when(source == "user", 0)
        .when(long_system & framing, F.lit(None))
        .when(long_system, 1)
        .otherwise(2)
    )
    candidates = steps.filter(~T.is_blank(message)).select(
        "trace_id", "step_id", rank.alias("_rank"), "message"
    )
    w = Window.partitionBy("trace_id").orderBy("_rank", "step_id")
    best = (
        candidates.filter(F.col("_rank").isNotNull())
        .withColumn("_rn", F.row_number().over(w))
        .filter(F.col("_rn") == 1)
    )
    return best.select("trace_id", T.cut(lead_line(message), cap, "...").alias("title"))


def compact_thread(
    steps: DataFrame, limit: int = THREAD_LIMIT, head: int = THREAD_HEAD, tail: int = THREAD_TAIL
) -> DataFrame:
    """Steps to show of each trace, with ``omitted`` = number of left-out middle steps.

    Traces up to ``limit`` steps stay whole; longer ones keep ``head`` and ``tail`` steps.
    Only the last ``limit`` + 1 and the first ``head`` steps of a trace are shuffled.
    """
    by_trace = Window.partitionBy("trace_id")
    recent = last_steps(steps, limit + 1).withColumn("_n", F.max("step_id").over(by_trace))
    long = F.col("_n") > limit
    omitted = F.when(long, F.col("_n") - head - tail).otherwise(0).cast("int")
    shown = recent.filter(
        ~long | (F.col("step_id") > F.col("_n") - tail) | (F.col("step_id") <= head)
    ).withColumn("omitted", omitted)
    cut = recent.filter(long).groupBy("trace_id").agg(F.max("_n").alias("_n"))
    # head steps that are too early to be among the last limit + 1
    early = (
        steps.filter(F.col("step_id") <= head)
        .join(cut, "trace_id")
        .filter(F.col("step_id") < F.col("_n") - limit)
        .withColumn("omitted", (F.col("_n") - head - tail).cast("int"))
    )
    return shown.drop("_n").unionByName(early.drop("_n"))
