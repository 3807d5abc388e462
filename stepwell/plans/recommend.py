"""Recommendations: similar traces that got over a failure of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepwell.functions import outcomes
from stepwell.operators.catalog import recovered_pool
from stepwell.operators.similarity import of_model, restrict, top_k_similar, vector_size

DEFAULT_K = 10
DECIMALS = 4


def failed_targets(traces: DataFrame, vectors: DataFrame) -> DataFrame:
    """Failed traces that have a vector."""
    failed = traces.filter(F.col("has_error") == 1).select(F.col("id").alias("trace_id"))
    return vectors.join(failed, "trace_id")


def candidate_pool_size(traces: DataFrame) -> DataFrame:
    return recovered_pool(traces).agg(F.count("*").alias("candidates"))


def recommend(
    traces: DataFrame,
    vectors: DataFrame,
    k: int = DEFAULT_K,
    model: str | None = None,
    targets: DataFrame | None = None,
) -> DataFrame:
    """Up to ``k`` recommendations per failed trace.

    The best k are taken first; those whose recoveries say nothing are dropped afterwards,
    so a list may be shorter.  ``rank`` is the position among the kept ones.
    """
    vectors = of_model(vectors, model).select("trace_id", "embedding")
    pool_ids = recovered_pool(traces).select(F.col("id").alias("trace_id"))
    queries = failed_targets(traces, vectors) if targets is None else vectors.join(targets.select("trace_id"), "trace_id")
    pool = restrict(vectors, candidates=pool_ids)
    hits = top_k_similar(queries, pool, k, dim=vector_size(vectors))
    # hits without a recovery drop out anyway: leave their traces out of the join
    meta = recovered_pool(traces).select(
        F.col("id").alias("trace_id"), "source_format", "agent_name", "failure_events"
    )
    return (
        hits.join(meta, "trace_id")
        .withColumn("recoveries", outcomes.recoveries(F.col("failure_events")))
        .filter(F.size("recoveries") > 0)
        .select(
            F.col("query_id").alias("trace_id"),
            "rank",
            F.col("trace_id").alias("hit_id"),
            F.round("similarity", DECIMALS).alias("similarity"),
            "source_format",
            "agent_name",
            "recoveries",
        )
    )


def recommendation_lists(traces: DataFrame, recommendations: DataFrame) -> DataFrame:
    """One list per failed trace, empty when nothing was found; other traces have no row.

    A list holds at most k entries.
    """
    entry = F.struct("rank", "hit_id", "similarity", "source_format", "agent_name", "recoveries")
    lists = recommendations.groupBy("trace_id").agg(
        F.array_sort(F.collect_list(entry)).alias("recommendations")
    )
    failed = traces.filter(F.col("has_error") == 1).select(F.col("id").alias("trace_id"))
    return failed.join(lists, "trace_id", "left").withColumn(
        "recommendations", F.coalesce("recommendations", F.array())
    )
