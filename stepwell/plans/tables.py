"""Batches of rows in one Parquet folder, newest row per key on read.

A batch is written to its own ``batch_id=N`` folder, so writing it again after a failure
replaces it and nothing else.  Readers keep the newest row per key; ``compact`` folds
the batches into one.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepwell.operators.upserts import last_writer


def write_batch(df: DataFrame, folder: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(f"{folder}/batch_id={batch_id}")


def read_batches(spark: SparkSession, folder: str) -> DataFrame:
    """All rows of all batches; columns added by later batches are NULL in earlier ones."""
    return spark.read.option("mergeSchema", True).parquet(folder)


def read_or_none(spark: SparkSession, folder: str) -> DataFrame | None:
    """All batches, or None where none was written yet."""
    try:
        return read_batches(spark, folder)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def current(spark: SparkSession, folder: str, key: str = "id") -> DataFrame:
    """Newest row per key."""
    return last_writer(read_batches(spark, folder), key, F.col("batch_id").desc()).drop("batch_id")


def current_children(
    spark: SparkSession, folder: str, parents: str, key: str = "trace_id"
) -> DataFrame:
    """Rows of a child table (steps, vectors) that belong to the newest write of their trace."""
    newest = (
        read_batches(spark, parents)
        .groupBy(F.col("id").alias(key))
        .agg(F.max("batch_id").alias("_batch"))
    )
    rows = read_batches(spark, folder).withColumnRenamed("batch_id", "_batch")
    return rows.join(newest, [key, "_batch"], "left_semi").drop("_batch")


def compact(spark: SparkSession, folder: str, target: str, key: str = "id") -> None:
    """Write the newest rows as the single batch 0 of another folder."""
    write_batch(current(spark, folder, key), target, 0)
