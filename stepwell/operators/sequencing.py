"""Ordered totals and step numbers that do not need one task per key.

A window over ``partition by key order by ...`` puts a whole key into one task, which
breaks down when one key holds a large share of the rows.  Here the order is cut into
slices, by a monotone expression of the ordering column or at quantiles of a key's own
order; each (key, slice) is summed on its own, the slice totals give every slice its starting
value, and only rows of one slice meet in a task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

POSITION_WIDTH = 65_536
HOT_ROWS = 1_000_000


def slice_by_position(position: Column, width: int = POSITION_WIDTH) -> Column:
    """Slice of an integer position: at most ``width`` unique positions per slice."""
    return F.floor(position / F.lit(width)).cast("long")


HASH_BITS = 60


def hash_order(*columns: Column, seed: int = 42) -> Column:
    """Deterministic pseudo-random order of rows: 60 bits of md5 over seed and columns."""
    text = F.concat_ws("/", F.lit(str(seed)), *[c.cast("string") for c in columns])
    return F.conv(F.substring(F.md5(text), 1, HASH_BITS // 4), 16, 10).cast("long")


def slice_by_hash(hashed: Column, bits: int = 20) -> Column:
    """Slice of a ``hash_order``: ``2**bits`` slices of about equal size.

    A slice total costs one small row, so many slices are cheap, and each stays small.
    """
    return F.shiftright(hashed, HASH_BITS - bits)


# sampled rows per slice: a slice strays from its size by about an eighth
SAMPLES = 64


def _below(bounds: str, value: str) -> str:
    """SQL: how many entries of a sorted array are not above the value, by bisection."""
    middle = "int((s.lo + s.hi) div 2)"
    return f"""aggregate(sequence(0, int(log2(size({bounds}) + 1))), named_struct('lo', 0, 'hi', size({bounds})),
        (s, i) -> CASE WHEN s.lo >= s.hi THEN s
                       WHEN {bounds}[{middle}] <= {value} THEN named_struct('lo', {middle} + 1, 'hi', s.hi)
                       ELSE named_struct('lo', s.lo, 'hi', {middle}) END,
        s -> s.lo)"""


def number_in_key(
    df: DataFrame,
    key: str,
    order: Sequence[str],
    hot_rows: int = HOT_ROWS,
    out: str = "step_id",
    keep_slice: str | None = None,
) -> DataFrame:
    """Number the rows of each key 1..N in ``order``, which must be total within a key.

    Keys of up to ``hot_rows`` rows form one slice.  A larger key is cut at quantiles of its
    own order: of its rows a fixed share is drawn by hash, ``SAMPLES`` per ``hot_rows``, and every
    ``SAMPLES``-th of these in order is a splitter.  Slices hold about ``hot_rows`` rows however
    the order columns are spread, bursts included.  Rows are shuffled once, by (key, slice).
    Both broadcast tables describe large keys only and hold one splitter or one start per
    ``hot_rows`` rows: raise ``hot_rows`` where that is too much.  The key must not be NULL.
    """
    placed = df.withColumn("_at", F.struct(*order))
    drawn = F.pmod(F.xxhash64(key, *order), F.lit(hot_rows)) < F.lit(SAMPLES)
    hot = (
        placed.select(key, F.when(drawn, F.col("_at")).alias("_sample"))
        .groupBy(key)
        .agg(F.expr("count(*) AS _n"), F.expr("array_sort(collect_list(_sample)) AS _samples"))
        .filter(F.col("_n") > hot_rows)
        .selectExpr(f"{key} AS _key", f"filter(_samples, (s, i) -> i % {SAMPLES} = {SAMPLES - 1}) AS _bounds")
    )
    part = _below("_bounds", "_at")
    marked = placed.join(F.broadcast(hot), F.col(key) == F.col("_key"), "left").withColumn(
        "_slice", F.expr(f"if(_key IS NULL, 0L, bigint({part}))")
    )
    starts = (
        placed.select(key, "_at")
        .join(F.broadcast(hot), F.col(key) == F.col("_key"))
        .selectExpr("_key AS _hot", f"bigint({part}) AS _part")
        .groupBy("_hot", "_part")
        .agg(F.expr("count(*) AS _count"))
        .selectExpr(
            "_hot",
            "_part",
            "sum(_count) OVER (PARTITION BY _hot ORDER BY _part "
            "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS _start",
        )
    )
    w = Window.partitionBy(key, "_slice").orderBy(*order)
    # explicit, so that rows which arrive hashed by key are split as well
    local = marked.drop("_at", "_key", "_bounds").repartition(key, "_slice").withColumn("_local", F.row_number().over(w))
    numbered = local.join(
        F.broadcast(starts), (F.col(key) == F.col("_hot")) & (F.col("_slice") == F.col("_part")), "left"
    ).withColumn(out, F.expr("_local + coalesce(_start, 0)"))
    if keep_slice:
        numbered = numbered.withColumn(keep_slice, F.col("_slice"))
    return numbered.drop("_slice", "_local", "_hot", "_part", "_start")


# slices per block, blocks per block of blocks and so on: 2 to this power
FAN_BITS = 10


def slice_starts(totals: DataFrame, keys: Sequence[str], levels: int) -> DataFrame:
    """(keys, _slice, _start): the total of all earlier slices of the same keys.

    ``totals`` has (keys, _slice, _total).  Slices add up to blocks of 1,024, these to blocks of
    blocks, and so on; a window never sees more than the 1,024 members of one block.
    Slices must be from 0 to below ``2 ** (10 * levels)``; others end the job.
    """
    tables = [totals]
    for _ in range(levels - 1):
        up = tables[-1].withColumn("_slice", F.shiftright("_slice", FAN_BITS))
        tables.append(up.groupBy(*keys, "_slice").agg(F.sum("_total").alias("_total")))
    starts = None
    for table in reversed(tables):
        block = F.shiftright("_slice", FAN_BITS)
        if starts is None:
            fits = (F.col("_slice") >= 0) & (block == 0)
            block = F.when(fits, block).otherwise(F.raise_error(F.lit("a slice is out of range: use wider slices or more levels")).cast("long"))
        inside = Window.partitionBy(*keys, "_block").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
        found = table.withColumn("_block", block).withColumn("_inside", F.coalesce(F.sum("_total").over(inside), F.lit(0)))
        if starts is None:
            starts = found.withColumn("_start", F.col("_inside"))
        else:
            above = starts.withColumnsRenamed({"_slice": "_block", "_start": "_above"})
            starts = found.join(above, [*keys, "_block"]).withColumn("_start", F.col("_inside") + F.col("_above"))
        starts = starts.select(*keys, "_slice", "_start")
    return starts


def running_total(
    df: DataFrame,
    value: Column,
    order: Sequence[str],
    slice_by: Column,
    keys: Sequence[str] = (),
    out: str = "running_before",
    levels: int = 3,
) -> DataFrame:
    """Add the total of ``value`` over all earlier rows (of the same keys).

    ``order`` must be a total order, ``slice_by`` monotone in it, and the keys not NULL.
    Slice totals are added up level by level (``slice_starts``), so no task holds them all.
    """
    sliced = df.withColumns({"_slice": slice_by.cast("long"), "_value": value})
    group = [*keys, "_slice"]
    totals = sliced.groupBy(*group).agg(F.sum("_value").alias("_total"))
    starts = slice_starts(totals, keys, levels)
    inside = (
        Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    )
    local = sliced.repartition(*group).withColumn(
        "_local", F.coalesce(F.sum("_value").over(inside), F.lit(0))
    )
    joined = local.join(starts, group).withColumn(out, F.col("_start") + F.col("_local"))
    return joined.drop("_slice", "_value", "_local", "_start")


def number_rows(
    df: DataFrame,
    order: Sequence[str],
    slice_by: Column,
    keys: Sequence[str] = (),
    out: str = "position",
    levels: int = 2,
) -> DataFrame:
    """Number rows 1..N over the whole table, or within ``keys`` of few values.

    Two levels are right for the slices of ``slice_by_hash``.
    """
    numbered = running_total(df, F.lit(1).cast("long"), order, slice_by, keys, out=out, levels=levels)
    return numbered.withColumn(out, F.col(out) + 1)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """First row of each key.  The limit of one runs before the shuffle as well."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn")


def tail(df: DataFrame, n: int, key: str = "trace_id", order: str = "step_id") -> DataFrame:
    """Last ``n`` rows of each key; each map task ships at most ``n`` rows per key."""
    w = Window.partitionBy(key).orderBy(F.col(order).desc())
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def within_budget(
    df: DataFrame, cost: Column, order: Sequence[str], slice_by: Column, cap: float | int, levels: int = 3
) -> DataFrame:
    """Rows in order until the running cost reaches ``cap``; the crossing row is kept."""
    spent = running_total(df, cost, order, slice_by, out="spent_before", levels=levels)
    return spent.filter(F.col("spent_before") < F.lit(cap))
