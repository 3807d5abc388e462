"""Pluggable scorers: batched calls with retry, dead letters and costs in one pass.

A scorer is the caller's function from a list of prompts to as many answers.  It is called
with ``batch_rows`` prompts at once; a call that fails is tried again and then split in two, down
to single prompts, so one bad prompt costs nothing but itself.  Every prompt comes out
once, with its answer or with the error of its last call.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepwell.functions.outcomes import JUDGE_PRICES, cost_usd


@dataclass(frozen=True)
class Answer:
    """One answer: JSON text and the tokens it took."""

    json: str | None
    input_tokens: int = 0
    output_tokens: int = 0


Scorer = Callable[[Sequence[str]], Sequence[Answer]]

RAW = "trace_id string, answer_json string, calls int, error string, input_tokens bigint, output_tokens bigint"


@dataclass
class _Calls:
    """Runs one batch; counts the calls each prompt was part of."""

    scorer: Scorer
    attempts: int
    rows: list = field(default_factory=list)

    def run(self, prompts: list[tuple[str, str]], before: int = 0) -> None:
        error = None
        for attempt in range(1, self.attempts + 1):
            try:
                answers = list(self.scorer([p for _, p in prompts]))
                if len(answers) != len(prompts):
                    raise ValueError(f"{len(answers)} answers for {len(prompts)} prompts")
                for (key, _), a in zip(prompts, answers):
                    self.rows.append((key, a.json, before + attempt, None, a.input_tokens, a.output_tokens))
                return
            except Exception as exc:  # noqa: BLE001 - whatever a scorer raises stays with its prompts
                error = f"{type(exc).__name__}: {exc}"
        if len(prompts) == 1:
            self.rows.append((prompts[0][0], None, before + self.attempts, error, 0, 0))
            return
        middle = len(prompts) // 2
        for half in (prompts[:middle], prompts[middle:]):
            self.run(half, before + self.attempts)


def score_prompts(prompts: DataFrame, scorer: Scorer, out_type: str, attempts: int = 2, batch_rows: int = 16) -> DataFrame:
    """(trace_id, answer, calls, error, answer_json, input_tokens, output_tokens) of every prompt.

    ``prompts``: (trace_id, prompt).  A NULL prompt is not sent and has the error ``no prompt``; an
    answer that is no JSON of ``out_type`` has the error ``bad answer``.  One pass, no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            calls = _Calls(scorer, attempts)
            pairs = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            asked = [p for p in pairs if p[1] is not None]
            for at in range(0, len(asked), batch_rows):
                calls.run(asked[at : at + batch_rows])
            calls.rows += [(key, None, 0, "no prompt", 0, 0) for key, prompt in pairs if prompt is None]
            if calls.rows:
                kinds = (pa.string(), pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int64())
                names = ["trace_id", "answer_json", "calls", "error", "input_tokens", "output_tokens"]
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*calls.rows), kinds)], names=names)

    raw = prompts.select(F.col("trace_id").cast("string"), F.col("prompt").cast("string")).mapInArrow(run, RAW)
    answer = F.from_json("answer_json", out_type, {"mode": "PERMISSIVE"})
    whole = F.try_parse_json("answer_json").isNotNull()
    error = F.coalesce("error", F.when(~whole | F.col("answer_json").isNull(), F.lit("bad answer")))
    return raw.withColumns({"answer": F.when(whole, answer), "error": error})


def dead_letters(scored: DataFrame, prompts: DataFrame) -> DataFrame:
    """(trace_id, prompt, error, calls) of the prompts without a usable answer, to be sent again."""
    failed = scored.filter("error IS NOT NULL").select("trace_id", "error", "calls")
    return prompts.join(failed, "trace_id").select("trace_id", "prompt", "error", "calls")


def cost_rollup(scored: DataFrame, prices: dict[str, float] = JUDGE_PRICES) -> DataFrame:
    """One row: prompts, answered, dead, tokens and cost of a scoring run."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    sums = scored.agg(
        F.count("*").alias("prompts"),
        total(F.col("error").isNull().cast("long")).alias("answered"),
        total(F.col("error").isNotNull().cast("long")).alias("dead"),
        total("input_tokens").alias("input_tokens"),
        total("output_tokens").alias("output_tokens"),
    )
    return sums.withColumn("cost_usd", cost_usd({"input": F.col("input_tokens"), "output": F.col("output_tokens")}, prices))
