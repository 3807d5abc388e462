"""Rule-based failure signals over steps.

The steps table has one row per step with a dense ``step_id`` (1..N per trace).  Four
of the five signals compare positions of the last step of some kind, so they are plain
maxima and merge before any shuffle.  The loop signal needs neighbouring steps: runs
are found inside bounded chunks of a trace and joined across chunk borders.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepwell.functions import text as T
from stepwell.operators.sequencing import slice_by_position

AGENT_SOURCES = ("agent", "assistant")
LOOP_SOURCES = ("agent", "assistant", "system")


@dataclass(frozen=True)
class StepRoles:
    """Which columns of a steps table play which part; defaults read canonical steps."""

    signature: Column
    loop_source: Column
    is_agent: Column
    is_error: Column
    speaks: Column
    gives_up: Column
    has_calls: Column
    has_results: Column


def canonical_roles(
    error_pattern: str = T.ERROR_PATTERN, give_up_pattern: str = T.GIVE_UP_PATTERN
) -> StepRoles:
    source = F.lower(F.coalesce(F.col("source"), F.lit("")))
    is_agent = source.isin(*AGENT_SOURCES)
    calls = F.coalesce(F.size("tool_calls"), F.lit(0)) > 0
    results = F.coalesce(F.size("results"), F.lit(0)) > 0
    return StepRoles(
        signature=T.step_signature(F.col("tool_calls"), F.col("message")),
        loop_source=F.when(source.isin(*LOOP_SOURCES), source),
        is_agent=is_agent,
        is_error=T.step_error_text(F.col("results"), F.col("message"), error_pattern).isNotNull(),
        speaks=is_agent & ~T.is_blank(F.col("message")),
        gives_up=T.gives_up(F.col("message"), give_up_pattern),
        has_calls=is_agent & calls,
        has_results=results,
    )


# name -> (facts, parameters) -> boolean Column; see ``step_facts`` for the facts
SignalBuilder = Callable[[dict[str, int]], Column]
DEFAULT_PARAMETERS = {"max_turns": 50, "loop_repeat": 5, "error_window": 3}


def _ended_on_error(p: dict[str, int]) -> Column:
    before_tail = F.col("n_steps") - p["error_window"] if p["error_window"] > 0 else F.lit(0)
    in_tail = F.col("last_error") > F.greatest(before_tail, F.lit(0))
    stuck = in_tail & (F.col("last_agent") <= F.col("last_error"))
    return F.col("context_exhausted") | stuck


SIGNALS: dict[str, SignalBuilder] = {
    "hit_max_turns": lambda p: F.col("n_steps") >= p["max_turns"],
    "repeated_tool_call_loop": lambda p: F.col("longest_run") >= p["loop_repeat"],
    "ended_on_error": _ended_on_error,
    "abandonment": lambda p: F.col("last_said_gives_up"),
    "incomplete_session": lambda p: F.col("last_call") > F.col("last_result"),
}
SIGNAL_NAMES = tuple(SIGNALS)


def register_signal(name: str, builder: SignalBuilder) -> None:
    """Add a signal: a boolean Column over the facts of :func:`step_facts`."""
    SIGNALS[name] = builder


# signals that can do without ``longest_run``
POSITION_SIGNALS = ("hit_max_turns", "ended_on_error", "abandonment", "incomplete_session")


def _flags(steps: DataFrame, key: str, roles: StepRoles, chunk: Column) -> DataFrame:
    step = F.col("step_id").cast("long")

    def at(condition: Column) -> Column:
        return F.when(condition, step).otherwise(0)

    return steps.select(
        F.col(key).alias("_key"),
        chunk.alias("_chunk"),
        F.coalesce(roles.loop_source, F.lit("")).alias("_source"),
        step.alias("_step"),
        roles.signature.alias("_signature"),
        at(roles.is_error).alias("_error"),
        at(roles.is_agent).alias("_agent"),
        F.when(roles.speaks, step * 2 + roles.gives_up.cast("int")).otherwise(0).alias("_said"),
        at(roles.has_calls).alias("_call"),
        at(roles.has_results).alias("_result"),
    )


def _last_positions() -> list[Column]:
    return [
        F.expr("max(_error) AS last_error"),
        F.expr("max(_agent) AS last_agent"),
        F.expr("pmod(max(_said), 2) = 1 AS last_said_gives_up"),
        F.expr("max(_call) AS last_call"),
        F.expr("max(_result) AS last_result"),
    ]


def position_facts(
    steps: DataFrame, key: str = "trace_id", roles: StepRoles | None = None
) -> DataFrame:
    """The facts of :func:`step_facts` without the runs: one aggregation, combined map-side."""
    flags = _flags(steps, key, roles or canonical_roles(), F.lit(0))
    return flags.groupBy(F.col("_key").alias(key)).agg(
        F.expr("count(*) AS n_steps"), *_last_positions()
    )


def step_facts(
    steps: DataFrame,
    key: str = "trace_id",
    roles: StepRoles | None = None,
    chunk: Column | None = None,
) -> DataFrame:
    """One row of facts per trace: counts, last positions and the longest run.

    Rows are shuffled once, by (trace, source, chunk).  Per chunk a handful of numbers
    remains and only those are shuffled by trace, so a trace of any length spreads over
    many tasks.  A caller that has already partitioned the steps by pieces of a trace
    passes those pieces as ``chunk`` (monotone in ``step_id``); otherwise the steps are
    repartitioned here, also when they arrive hashed by trace.
    """
    pieces = chunk if chunk is not None else slice_by_position(F.col("step_id").cast("long") - 1)
    flags = _flags(steps, key, roles or canonical_roles(), pieces).selectExpr(
        "* except (_signature)",
        # two independent 64-bit hashes stand for the signature text
        "if(_signature IS NOT NULL, xxhash64(_signature), NULL) AS _h1",
        "if(_signature IS NOT NULL, xxhash64(7, _signature), NULL) AS _h2",
    )
    if chunk is None:
        flags = flags.repartition("_key", "_chunk")
    lasts = [F.expr(f"max({c}) AS {c}") for c in ("_error", "_agent", "_said", "_call", "_result")]

    # 1. runs of equal signatures inside a chunk
    upto = " ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    within = "OVER (PARTITION BY _key, _source, _chunk ORDER BY _step)"
    runs = (
        flags.selectExpr(
            "*",
            f"coalesce(_h1 <> lag(_h1) {within} OR _h2 <> lag(_h2) {within}, true) AS _starts",
        )
        .selectExpr("*", f"sum(int(_starts)) {within[:-1]}{upto} AS _run")
        .groupBy("_key", "_source", "_chunk", "_run")
        .agg(
            F.expr("min(_step) AS _from"),
            F.expr("count(*) AS _n"),
            F.expr("count(_h1) AS _len"),
            F.expr("min(_h1) AS _h1"),
            F.expr("min(_h2) AS _h2"),
            *lasts,
        )
    )
    # 2. per chunk: inner maximum, and the two runs that touch its borders
    ends = runs.groupBy("_key", "_source", "_chunk").agg(
        F.expr("sum(_n) AS _n"),
        F.expr("count(*) AS _runs"),
        F.expr("max(_len) AS _longest"),
        *[F.expr(f"min_by({c}, _from) AS {c}_first") for c in ("_h1", "_h2", "_len")],
        *[F.expr(f"max_by({c}, _from) AS {c}_last") for c in ("_h1", "_h2", "_len")],
        *lasts,
    )
    # 3. runs that go on across chunk borders
    border = ends.repartition("_key").selectExpr(
        "*",
        """inline(array(
            struct(0 AS _side, _h1_first AS _h1, _h2_first AS _h2, _len_first AS _len),
            struct(1 AS _side, _h1_last AS _h1, _h2_last AS _h2,
                   if(_runs > 1, _len_last, bigint(0)) AS _len)))""",
    )
    across = "OVER (PARTITION BY _key, _source ORDER BY _chunk, _side)"
    chains = (
        border.selectExpr(
            "*",
            f"""coalesce(_h1 <> lag(_h1) {across} OR _h2 <> lag(_h2) {across}
                OR (_side = 1 AND _runs > 1), true) AS _breaks""",
        )
        .selectExpr("*", f"sum(int(_breaks)) {across[:-1]}{upto} AS _chain")
        .groupBy("_key", "_source", "_chain")
        .agg(
            F.expr("sum(_len) AS _len"),
            F.expr("max(_longest) AS _longest"),
            F.expr("sum(if(_side = 0, _n, 0)) AS _n"),
            *lasts,
        )
    )
    return chains.groupBy(F.col("_key").alias(key)).agg(
        F.expr("sum(_n) AS n_steps"),
        F.expr(
            "coalesce(max(if(_source <> '', greatest(_len, _longest), NULL)), 0) AS longest_run"
        ),
        *_last_positions(),
    )


def compute_signals(
    steps: DataFrame,
    headers: DataFrame | None = None,
    key: str = "trace_id",
    roles: StepRoles | None = None,
    chunk: Column | None = None,
    names: Iterable[str] | None = None,
    **parameters: int,
) -> DataFrame:
    """Boolean signals per trace plus ``any_signal``.

    ``headers`` (key, exit_status) adds the context-window rule to ``ended_on_error``.
    """
    known = {**DEFAULT_PARAMETERS, **parameters}
    chosen = list(names or SIGNALS)
    if set(chosen) <= set(POSITION_SIGNALS):
        facts = position_facts(steps, key, roles)
    else:
        facts = step_facts(steps, key, roles, chunk)
    if headers is not None:
        status = headers.select(key, T.context_exhausted(F.col("exit_status")).alias("_exhausted"))
        facts = facts.join(status, key, "left").withColumn(
            "context_exhausted", F.coalesce("_exhausted", F.lit(False))
        )
    else:
        facts = facts.withColumn("context_exhausted", F.lit(False))
    signals = facts.select(
        key, *[F.coalesce(SIGNALS[n](known), F.lit(False)).alias(n) for n in chosen]
    )
    fired = F.lit(False)
    for name in chosen:
        fired = fired | F.col(name)
    return signals.withColumn("any_signal", fired)


def targets(traces: DataFrame, force: bool = False) -> DataFrame:
    """Traces whose signals are still to be computed; ``force`` takes all normalised ones."""
    gate = F.col("has_atif") & (F.col("signals").isNull() | F.lit(force))
    return traces.filter(gate)


def apply_signals(traces: DataFrame, signals: DataFrame) -> DataFrame:
    """Write signals; fill ``has_error`` from them only where nothing was known."""
    names = [c for c in signals.columns if c not in ("trace_id", "any_signal")]
    packed = signals.select(
        F.col("trace_id").alias("id"),
        F.struct(*names).alias("_new_signals"),
        F.col("any_signal").cast("int").alias("_fired"),
    )
    return (
        traces.join(packed, "id", "left")
        .withColumn("signals", F.coalesce("_new_signals", "signals"))
        .withColumn("has_error", F.coalesce("has_error", "_fired"))
        .drop("_new_signals", "_fired")
    )


def detect_summary(traces: DataFrame, signals: DataFrame) -> DataFrame:
    """Counts of one detection run: processed, fired, newly raised errors, per signal."""
    names = [c for c in signals.columns if c not in ("trace_id", "any_signal")]
    before = traces.select(F.col("id").alias("trace_id"), "has_error")

    def total(condition: Column) -> Column:
        return F.coalesce(F.sum(condition.cast("long")), F.lit(0))

    return signals.join(before, "trace_id").agg(
        F.count("*").alias("processed"),
        total(F.col("any_signal")).alias("any_fired"),
        total(F.col("any_signal") & F.col("has_error").isNull()).alias("new_flips"),
        *[total(F.col(n)).alias(n) for n in names],
    )
