"""Aggregate reports: cross-tabs, confusion matrices, precision at K, profiles, costs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepwell.functions import outcomes

MISSING = "<missing>"
EMBEDDING_PRICE = 0.02
CHARS_PER_TOKEN = 4

# Tokens per generated trace, the shared part of its prompt, its output.
GENERATION_INPUT = 4_500
GENERATION_SHARED = 3_500
GENERATION_OUTPUT = 7_000


def _total(condition: Column) -> Column:
    return F.coalesce(F.sum(condition.cast("long")), F.lit(0))


def by_format(traces: DataFrame) -> DataFrame:
    return traces.groupBy(F.coalesce("source_format", F.lit("<null>")).alias("source_format")).agg(
        F.count("*").alias("n")
    )


def error_crosstab(traces: DataFrame) -> DataFrame:
    """Traces per format by has_error 0 / 1 / unknown."""
    return traces.groupBy(F.coalesce("source_format", F.lit("<null>")).alias("source_format")).agg(
        _total(F.col("has_error") == 0).alias("has_error_0"),
        _total(F.col("has_error") == 1).alias("has_error_1"),
        _total(F.col("has_error").isNull()).alias("has_error_null"),
    )


def model_outcomes(traces: DataFrame) -> DataFrame:
    """Outcomes and success rate per format and model; the rate is NULL without outcomes."""
    success, failure = _total(F.col("has_error") == 0), _total(F.col("has_error") == 1)
    return traces.groupBy(
        F.coalesce("source_format", F.lit("<null>")).alias("source_format"),
        F.coalesce("model", F.lit("<null>")).alias("model"),
    ).agg(
        F.count("*").alias("total"),
        success.alias("success"),
        failure.alias("failure"),
        _total(F.col("has_error").isNull()).alias("unknown"),
        F.try_divide(success, success + failure).alias("success_rate"),
    )


def failure_modes(traces: DataFrame, mode: str = "synthetic_failure_mode") -> DataFrame:
    """Ground-truth failure modes per format."""
    return (
        traces.filter(F.col(mode).isNotNull())
        .groupBy("source_format", F.col(mode).alias("mode"))
        .agg(F.count("*").alias("n"))
    )


def confusion(
    predictions: DataFrame, signals: Sequence[str], truth: str = "has_error"
) -> DataFrame:
    """TP / FP / FN / TN per signal; rows without a 0/1 truth are left out."""
    known = predictions.filter(F.col(truth).isin(0, 1))
    failure = F.col(truth) == 1

    def cell(fired: Column, bad: Column) -> Column:
        return (fired & bad).cast("long")

    sums = [
        F.sum(cell(f, b)).alias(f"{name}__{tag}")
        for name in signals
        for tag, f, b in (
            ("tp", F.col(name), failure),
            ("fp", F.col(name), ~failure),
            ("fn", ~F.col(name), failure),
            ("tn", ~F.col(name), ~failure),
        )
    ]
    # one row of sums for all signals, then turned into one row per signal
    rows = F.array(
        *[
            F.struct(
                F.lit(name).alias("signal"),
                *[
                    F.coalesce(f"{name}__{tag}", F.lit(0)).alias(tag)
                    for tag in ("tp", "fp", "fn", "tn")
                ],
            )
            for name in signals
        ]
    )
    return known.agg(*sums).select(F.inline(rows))


def precision_recall_f1(cells: DataFrame) -> DataFrame:
    """Rates of a confusion table; NULL where a denominator is zero."""
    return (
        cells.withColumn("precision", F.try_divide("tp", F.col("tp") + F.col("fp")))
        .withColumn("recall", F.try_divide("tp", F.col("tp") + F.col("fn")))
        .withColumn(
            "f1",
            F.try_divide(
                2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")
            ),
        )
    )


def report_lines(rates: DataFrame) -> DataFrame:
    """Rows of a Markdown table: counts, then rates with two digits or n/a."""

    cells = ["concat('`', signal, '`')", "tp", "fp", "fn", "tn"]
    for rate in ("precision", "recall", "f1"):
        # only eighths can be exact ties; those go to the even digit
        even = f"if({rate} * 8 = floor({rate} * 8), bround({rate}, 2), {rate})"
        cells.append(f"if({rate} IS NULL, 'n/a', format_string('%.2f', {even}))")
    joined = ", ' | ', ".join(cells)
    return rates.selectExpr("signal", f"concat('| ', {joined}, ' |') AS line")


def attach_truth(hits: DataFrame, truth: DataFrame) -> DataFrame:
    """Ground truth of ranked hits; NULL truth means the hit cannot be scored."""
    return hits.join(truth, "trace_id", "left")


def precision_at_k(
    scored: DataFrame, expected: DataFrame, denominator: str = "scoreable"
) -> DataFrame:
    """Per query and overall: hits, scoreable hits, relevant hits and precision.

    ``scored``: (query_id, trace_id, truth); ``expected``: (query_id, label).  Ground truth
    is measured against the ``scoreable`` hits, assigned labels against all ``hits``.  The
    overall row has a NULL query_id.
    """
    relevant = scored.join(
        expected.withColumn("_relevant", F.lit(1)),
        (scored["query_id"] == expected["query_id"]) & (scored["truth"] == expected["label"]),
        "left",
    ).select(scored["query_id"], "truth", "_relevant")
    per_query = relevant.groupBy("query_id").agg(
        F.count("*").alias("hits"),
        F.count("truth").alias("scoreable"),
        F.count("_relevant").alias("relevant"),
    )
    overall = per_query.agg(
        F.lit(None).cast(per_query.schema["query_id"].dataType).alias("query_id"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("hits", "scoreable", "relevant")],
    )
    return per_query.unionByName(overall).withColumn(
        "precision", F.coalesce(F.try_divide("relevant", denominator), F.lit(0.0))
    )


def count_by_path(results: DataFrame, path: str) -> DataFrame:
    """Rows per value of a nested field."""
    return results.groupBy(
        F.coalesce(F.col(path).cast("string"), F.lit(MISSING)).alias("value")
    ).agg(F.count("*").alias("n"))


def outcome_rates(results: DataFrame) -> DataFrame:
    """Run outcomes of a generation manifest."""
    ok = F.coalesce(F.col("ok"), F.lit(False))
    skipped = F.coalesce(F.col("budget_skipped"), F.lit(False))
    n = F.count("*")
    counted = {
        "ok": _total(ok),
        "failed": _total(~ok & ~skipped),
        "budget_skipped": _total(skipped),
        "second_attempt": _total(F.coalesce(F.col("attempts"), F.lit(1)) > 1),
    }
    return results.agg(
        n.alias("total"),
        *[c.alias(name) for name, c in counted.items()],
        F.try_divide(counted["ok"], n).alias("ok_rate"),
        F.try_divide(counted["failed"], n).alias("failed_rate"),
        F.try_divide(counted["second_attempt"], n).alias("second_attempt_rate"),
    )


def shape_by_label(results: DataFrame) -> DataFrame:
    """Mean and median steps and tool calls per label, ok rows only.

    ``percentile`` keeps one counter per distinct value, so it merges before the shuffle.
    """
    return (
        results.filter(F.col("ok") & F.col("n_steps").isNotNull())
        .groupBy("label")
        .agg(
            F.count("*").alias("n"),
            F.avg("n_steps").alias("mean_steps"),
            F.percentile("n_steps", F.lit(0.5)).alias("median_steps"),
            F.coalesce(F.avg("n_tool_calls"), F.lit(0.0)).alias("mean_tool_calls"),
            F.coalesce(F.percentile("n_tool_calls", F.lit(0.5)), F.lit(0.0)).alias(
                "median_tool_calls"
            ),
        )
    )


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(F.coalesce(F.col(column).cast("string"), F.lit(MISSING)).alias("value")).agg(
        F.count("*").alias("n")
    )


def size_stats(df: DataFrame, size: str, keys: Sequence[str] = (), rank: float = 0.95) -> DataFrame:
    """min / max / floor mean and the rank statistic ``sorted[int(n * rank)]`` of a size.

    Sizes are first counted per distinct value, so the ordered pass sees one row per
    distinct size and not one per input row.
    """
    counted = df.filter(F.col(size).isNotNull()).groupBy(*keys, size).agg(F.count("*").alias("_c"))
    every = Window.partitionBy(*keys)
    upto = every.orderBy(size).rowsBetween(Window.unboundedPreceding, 0)
    placed = counted.withColumn("_n", F.sum("_c").over(every)).withColumn(
        "_seen", F.sum("_c").over(upto)
    )
    at_rank = F.col("_seen") > F.floor(F.col("_n") * F.lit(rank))
    total = F.sum(F.col(size) * F.col("_c"))
    return placed.groupBy(*keys).agg(
        F.sum("_c").alias("n"),
        F.min(size).alias("min_size"),
        F.max(size).alias("max_size"),
        F.floor(total / F.sum("_c")).alias("mean_size"),
        F.min(F.when(at_rank, F.col(size))).alias("p95_size"),
    )


def trace_profile(steps: DataFrame) -> DataFrame:
    """Per trace: steps by source, tool calls, steps with an observation."""
    calls = F.coalesce(F.size("tool_calls"), F.lit(0))
    return steps.groupBy("trace_id").agg(
        F.count("*").alias("n_steps"),
        _total(F.col("source") == "user").alias("user_steps"),
        _total(F.col("source") == "agent").alias("agent_steps"),
        _total(F.col("source") == "system").alias("system_steps"),
        F.sum(F.greatest(calls, F.lit(0)).cast("long")).alias("tool_calls"),
        _total(F.coalesce(F.size("results"), F.lit(0)) > 0).alias("steps_with_observation"),
    )


def health(traces: DataFrame) -> DataFrame:
    """Share of rows whose raw text and whose canonical form are filled."""
    return traces.agg(
        F.count("*").alias("total"),
        _total(F.coalesce(F.length("raw_blob") > 0, F.lit(False))).alias("raw_populated"),
        _total(F.col("has_atif")).alias("atif_populated"),
        F.coalesce(F.sum(F.length("raw_blob").cast("long")), F.lit(0)).alias("raw_chars"),
    )


def usage_totals(
    responses: DataFrame, prices: dict[str, float] | None = None, cap: float | None = None
) -> DataFrame:
    """Token and cost totals of a response table (ok, attempts, input/output tokens)."""
    prices = prices or outcomes.JUDGE_PRICES
    tokens = {n: F.sum(F.coalesce(f"{n}_tokens", F.lit(0))) for n in prices}
    ok = F.coalesce(F.col("ok"), F.lit(False))
    totals = responses.agg(
        _total(ok).alias("succeeded"),
        _total(~ok).alias("failed"),
        _total(F.coalesce(F.col("attempts"), F.lit(1)) > 1).alias("retried"),
        *[F.coalesce(t, F.lit(0)).alias(f"{n}_tokens") for n, t in tokens.items()],
    )
    totals = totals.withColumn(
        "cost_usd", outcomes.cost_usd({n: F.col(f"{n}_tokens") for n in prices}, prices)
    )
    over = F.col("cost_usd") >= F.lit(cap) if cap is not None else F.lit(False)
    return totals.withColumn("over_cap", over)


def project_embedding_cost(
    texts: DataFrame, text: str = "text", batch: int = 100, price: float = EMBEDDING_PRICE
) -> DataFrame:
    """Size of an embedding run: rows, characters, tokens, calls and dollars."""
    return texts.agg(
        F.count("*").alias("rows"),
        F.coalesce(F.sum(F.length(text).cast("long")), F.lit(0)).alias("chars"),
    ).select(
        "rows",
        "chars",
        F.floor(F.col("chars") / CHARS_PER_TOKEN).cast("long").alias("tokens"),
        F.ceil(F.col("rows") / batch).cast("long").alias("calls"),
        (F.floor(F.col("chars") / CHARS_PER_TOKEN) / 1_000_000 * price).alias("cost_usd"),
    )


def project_call_cost(
    targets: DataFrame,
    input_tokens: int,
    output_tokens: int,
    prices: dict[str, float] | None = None,
    worst_case: float = 1.5,
) -> DataFrame:
    """Expected and worst-case cost of one model call per target."""
    prices = prices or outcomes.EVENT_PRICES
    counted = targets.agg(F.count("*").alias("targets")).select(
        "targets",
        (F.col("targets") * input_tokens).alias("input_tokens"),
        (F.col("targets") * output_tokens).alias("output_tokens"),
    )
    return counted.withColumn(
        "cost_usd",
        outcomes.cost_usd({"input": F.col("input_tokens"), "output": F.col("output_tokens")}, prices),
    ).withColumn("worst_case_usd", F.col("cost_usd") * worst_case)


def project_generation_cost(specs: DataFrame, output_format: str = "output_format") -> DataFrame:
    """Projected cost of generating one trace per spec.

    The shared part of a prompt is written to the cache once per format and read from it
    by every other call; the rest is paid for in full; outputs allow for retries.
    """
    live = GENERATION_INPUT - GENERATION_SHARED
    counted = specs.agg(
        F.count("*").alias("specs"), F.count_distinct(output_format).alias("formats")
    )
    tokens = counted.select(
        "specs",
        (F.col("specs") * live).alias("input_tokens"),
        (F.col("formats") * GENERATION_SHARED).alias("cache_write_tokens"),
        ((F.col("specs") - F.col("formats")) * GENERATION_SHARED).alias("cache_read_tokens"),
        F.floor(F.col("specs") * GENERATION_OUTPUT * 1.1).alias("output_tokens"),
    )
    cost = outcomes.cost_usd(
        {n: F.col(f"{n}_tokens") for n in outcomes.GENERATION_PRICES}, outcomes.GENERATION_PRICES
    )
    return tokens.withColumn("cost_usd", F.round(cost, 2))


def top_n(results: DataFrame, column: str, n: int, tie: str) -> DataFrame:
    return results.orderBy(F.col(column).desc_nulls_last(), F.col(tie).asc()).limit(n)
