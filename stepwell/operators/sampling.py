"""Deterministic samples and quotas."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stepwell.functions.outcomes import LABEL_NAMES
from stepwell.operators.sequencing import first_per_key, hash_order, number_rows, slice_by_hash

# parts in which a stratum is cut down before it is ranked as a whole
LOTS = 64


def first_n_per_stratum(
    df: DataFrame, stratum: str, n: int, key: str, order: Sequence[str]
) -> DataFrame:
    """First ``n`` rows per stratum in order, after dropping bad and repeated keys.

    A stratum is first cut to n rows in each of ``LOTS`` hash lots of its keys, so the task
    that ranks it sees at most ``LOTS * n`` rows, whatever its size and whatever n.
    """
    usable = df.filter(F.col(key).isNotNull() & F.col(stratum).isNotNull())
    unique = first_per_key(usable, [key], list(order))
    lots = unique.withColumn("_lot", F.pmod(F.xxhash64(key), F.lit(LOTS)))
    for group in ([stratum, "_lot"], [stratum]):
        w = Window.partitionBy(*group).orderBy(*order)
        lots = lots.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")
    return lots.drop("_lot")


def write_extract(df: DataFrame, stratum: str, folder: str) -> None:
    """Write a stratified extract as JSON lines, one folder per stratum.

    ``sources.session_files.extract_files`` writes one file per row instead.
    """
    df.write.mode("overwrite").partitionBy(stratum).json(folder)


def judge_sample(
    traces: DataFrame, rate: float = 0.10, seed: int = 42, rejudge: bool = False
) -> DataFrame:
    """All failures plus a fixed share of successes, failures first, each in id order.

    Successes are ranked by a seeded hash of their id; the ranking is cut into hash
    slices, so no task ever sorts all of them.
    """
    pool = traces.filter(F.col("has_atif"))
    if not rejudge:
        pool = pool.filter(F.col("failure_label").isNull())
    failures = pool.filter(F.col("has_error") == 1).withColumn("sample_class", F.lit(0))
    successes = pool.filter(F.col("has_error") == 0).withColumn(
        "_order", hash_order(F.col("id"), seed=seed)
    )
    wanted = successes.agg(F.bround(F.count("*") * F.lit(rate)).alias("_wanted"))
    ranked = number_rows(successes, ["_order", "id"], slice_by_hash(F.col("_order")), out="_rank")
    sampled = (
        ranked.filter(F.col("_rank") <= wanted.scalar())
        .drop("_order", "_rank")
        .withColumn("sample_class", F.lit(1))
    )
    return failures.unionByName(sampled).orderBy("sample_class", "id")


def validate_weights(weights: dict[str, float], labels: Sequence[str] = LABEL_NAMES) -> None:
    if not weights:
        raise ValueError("weights must not be empty")
    unknown = sorted(set(weights) - set(labels))
    if unknown:
        raise ValueError(f"unknown labels: {unknown}")
    for label, weight in weights.items():
        if not isinstance(weight, (int, float)) or math.isnan(weight) or weight < 0:
            raise ValueError(f"bad weight for {label}: {weight!r}")
    if not 0.99 <= sum(weights.values()) <= 1.01:
        raise ValueError(f"weights must sum to about 1, got {sum(weights.values()):.4f}")


def allocate(weights: DataFrame, total: int) -> DataFrame:
    """Largest-remainder quotas of ``total`` over (label, weight) rows.

    The table holds one row per label of a fixed vocabulary, so its global order is tiny.
    """
    exact = F.col("weight") * F.lit(float(total))
    shares = weights.withColumn("_floor", F.floor(exact)).withColumn(
        "_rest", F.round(exact - F.col("_floor"), 9)
    )
    left = F.lit(total) - F.sum("_floor").over(Window.partitionBy())
    most = F.row_number().over(Window.partitionBy().orderBy(F.col("_rest").desc(), "label"))
    least = F.row_number().over(Window.partitionBy().orderBy(F.col("_rest"), "label"))
    return (
        shares.withColumn("_left", left)
        .withColumn("_most", most)
        .withColumn("_least", least)
        .select(
            "label",
            (
                F.col("_floor")
                + (F.col("_most") <= F.col("_left")).cast("int")
                - ((F.col("_least") <= -F.col("_left")) & (F.col("_floor") > 0)).cast("int")
            )
            .cast("long")
            .alias("quota"),
        )
    )


def quota_sample(
    df: DataFrame, quotas: DataFrame, label: str, key: str, seed: int = 42, max_labels: int = 1000
) -> DataFrame:
    """Up to ``quota`` rows per label, chosen by a seeded hash of ``key``.

    ``quotas`` (label, quota) has one row per label of a vocabulary; it is broadcast after
    its size has been checked, and joined the ordinary way beyond ``max_labels`` rows.
    """
    small = quotas.limit(max_labels + 1).count() <= max_labels
    wanted = quotas.withColumnRenamed("label", "_label")
    ordered = df.withColumn("_order", hash_order(F.col(key), seed=seed))
    ranked = number_rows(
        ordered.filter(F.col(label).isNotNull()),
        ["_order", key],
        slice_by_hash(F.col("_order")),
        keys=[label],
        out="_rank",
    )
    return (
        ranked.join(F.broadcast(wanted) if small else wanted, F.col(label) == F.col("_label"))
        .filter(F.col("_rank") <= F.col("quota"))
        .drop("_order", "_rank", "_label", "quota")
    )


def even_split(df: DataFrame, k: int, key: str, seed: int = 42, out: str = "part") -> DataFrame:
    """Deal rows into ``k`` groups whose sizes differ by at most one."""
    ordered = df.withColumn("_order", hash_order(F.col(key), seed=seed))
    ranked = number_rows(ordered, ["_order", key], slice_by_hash(F.col("_order")), out="_rank")
    return ranked.withColumn(out, F.pmod(F.col("_rank") - 1, F.lit(k)).cast("int")).drop(
        "_order", "_rank"
    )
