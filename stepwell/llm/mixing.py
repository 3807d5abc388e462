"""Mixing sources to target weights with hash-threshold histograms.

Every document has a hash of its key.  A source that must give ``target`` words gives whole
copies of all its documents and, for the remainder, the documents whose hash lies below a
threshold.  Word sums per (source, hash bucket) locate the bucket in which the running sum
passes the remainder; only that bucket is histogrammed again, finer, until a bucket is one
hash value.  Nothing is sorted but histograms of at most ``2 ** BITS`` rows per source, and
a smaller budget always takes a subset of what a larger one takes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepwell.llm.textkit import n_words, stored

BITS, LEVELS = 12, 4
HASH_BITS = BITS * LEVELS
# a table of thresholds up to this many rows is broadcast, a larger one is joined by key
SMALL_ROWS = 20_000


def key_hash(key: str, text: str, seed: str) -> Column:
    """``HASH_BITS`` bits of md5 over seed and key; without a key the text stands for it."""
    name = F.coalesce(F.col(key).cast("string"), F.md5(F.coalesce(F.col(text), F.lit(""))))
    digest = F.md5(F.concat(F.lit(seed), F.lit("/"), name))
    return F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: Sequence[int], cap: float) -> DataFrame:
    """Words that each source (source, source_size) should give.

    Sources by code point, NULL last, weigh ``weights``, repeating, and share the sum of all
    sizes.  A target stops at ``cap`` times its source; the excess goes to the others by
    weight.  With sources ordered by capacity per weight the capped ones come first, so one
    pass of running sums finds the level at which sharing stops.  One row per source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(int(w)) for w in weights])
    named = sizes.withColumn("_rank", F.row_number().over(by_name)).withColumn(
        "_w", F.element_at(cycle, (F.pmod(F.col("_rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    )
    room = F.lit(float(cap)) * F.col("source_size")
    order = Window.orderBy("_ratio", "_rank")
    everything = Window.orderBy("_ratio", "_rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    leveled = (
        named.withColumn("_ratio", room / F.col("_w"))
        .withColumn("_capped", F.coalesce(F.sum(room).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("_rest", F.sum("_w").over(order.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("_total", F.sum("source_size").over(everything).cast("double"))
        .withColumn("_level", (F.col("_total") - F.col("_capped")) / F.col("_rest"))
        .withColumn("_open", F.min(F.when(F.col("_level") <= F.col("_ratio"), F.struct("_ratio", "_rank", "_level"))).over(everything))
    )
    shares = F.struct("_ratio", "_rank") >= F.struct("_open._ratio", "_open._rank")
    return leveled.select(
        "source",
        "source_size",
        F.when(F.coalesce(shares, F.lit(False)), F.col("_open._level") * F.col("_w")).otherwise(room).alias("target"),
    )


def with_small(left: DataFrame, small: DataFrame, on: Column, rows: int, how: str = "inner") -> DataFrame:
    """Join a table of known row count: broadcast when small, else by shuffle."""
    return left.join(F.broadcast(small) if rows <= SMALL_ROWS else small, on, how)


def thresholds(sized: DataFrame, weights: Sequence[int], cap: float, budgets: Sequence[float]) -> tuple[DataFrame, int]:
    """Per source: source_size, target, and per budget the whole copies and the hash limit.

    ``sized`` has _source, _size, _hash.  Returns the stored table and its row count.
    """
    sizes = sized.groupBy(F.col("_source").alias("source")).agg(F.sum("_size").alias("source_size"))
    goal = F.col("target") * F.col("budget")
    full = F.when(F.col("source_size") > 0, F.least(F.floor(goal / F.col("source_size")), F.floor(F.lit(float(cap))))).otherwise(0)
    state = stored(
        targets(sizes, weights, cap)
        .withColumn("budget", F.explode(F.array(*[F.lit(float(b)) for b in budgets])))
        .withColumn("full", full.cast("long"))
        .withColumn("left", goal - F.col("full") * F.col("source_size"))
        .withColumn("prefix", F.lit(0).cast("long"))
        .withColumn("done", F.col("left") <= 0)
    )
    rows = state.count()
    for level in range(1, LEVELS + 1):
        shift = HASH_BITS - level * BITS
        bucket = F.shiftright("_hash", shift)
        # the histogram of the first level serves all budgets; later ones hold boundary buckets only
        hist = sized.withColumn("_bucket", bucket)
        if level > 1:
            edge = state.filter(~F.col("done")).select(F.col("source").alias("_s"), F.col("prefix").alias("_p")).distinct()
            hist = with_small(hist, edge, F.col("_source").eqNullSafe(F.col("_s")) & (F.shiftright("_bucket", BITS) == F.col("_p")), rows, "left_semi")
        sums = hist.groupBy("_source", "_bucket").agg(F.sum("_size").alias("_sum"))
        inside = Window.partitionBy("_source", F.shiftright("_bucket", BITS)).orderBy("_bucket")
        sums = sums.withColumn("_cum", F.sum("_sum").over(inside))
        match = F.col("source").eqNullSafe(F.col("_source")) & (F.shiftright("_bucket", BITS) == F.col("prefix")) & (F.col("_cum") > F.col("left"))
        first = (
            with_small(sums, state.filter(~F.col("done")), match, rows)
            .groupBy(F.col("source").alias("_s"), F.col("budget").alias("_b"))
            .agg(F.min(F.struct("_bucket", "_sum", "_cum")).alias("_at"))
        )
        # no bucket passes the remainder: everything below the end of the prefix is taken
        end = (F.col("prefix") + 1) * (1 << BITS)
        found = F.col("_at").isNotNull()
        state = stored(
            state.join(first, F.col("source").eqNullSafe(F.col("_s")) & (F.col("budget") == F.col("_b")), "left").select(
                "source", "source_size", "target", "budget", "full",
                F.when(found, F.col("left") - (F.col("_at._cum") - F.col("_at._sum"))).otherwise(F.col("left")).alias("left"),
                F.when(F.col("done"), F.col("prefix") * (1 << BITS)).when(found, F.col("_at._bucket")).otherwise(end).alias("prefix"),
                (F.col("done") | ~found).alias("done"),
                F.when(found, F.col("_at._sum")).otherwise(F.lit(0)).cast("long").alias("edge"),
            )
        )
    # the last bucket is one hash value: taken when that brings the sum nearer
    limit = F.col("prefix") + F.when(~F.col("done") & (2 * F.col("left") >= F.col("edge")), 1).otherwise(0)
    per_source = state.groupBy("source").agg(
        F.first("source_size").alias("source_size"),
        F.first("target").alias("target"),
        F.array_sort(F.collect_list(F.struct("budget", "full", limit.alias("limit")))).alias("cuts"),
    )
    return stored(per_source), rows


def mix(
    docs: DataFrame,
    weights: Sequence[int] = (5, 2, 1),
    cap: float = 3.0,
    seed: str = "mix",
    budgets: Sequence[float] = (1.0,),
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """Append to every row how often the mix takes it.

    Added columns: ``size`` (words), ``source_size``, ``target`` (double), ``copies`` (for
    the largest budget), ``taken`` (copies times size) and ``first_budget`` (the smallest
    budget, a share of the targets, that takes the row; NULL for none).  Columns of these
    names in ``docs`` are replaced; all others pass through.

    NULL and empty texts have size 0; they are taken like any other row but weigh nothing.
    NULL sources form one source, ranked last.  Rows with equal key (or, without a key,
    equal text) share one hash and one fate.  An empty table gives an empty result.  A
    source misses its target by at most half the words of one hash value.
    """
    added = ("size", "source_size", "target", "copies", "taken", "first_budget")
    keep = [c for c in docs.columns if c not in added]
    named = docs.select(
        F.struct(*[docs[c] for c in keep]).alias("_row"),
        docs[key].alias("_key"), docs[text].alias("_text"), docs[source].alias("_source"),
    )
    sized = named.withColumn("_size", n_words("_text")).withColumn("_hash", key_hash("_key", "_text", seed))
    narrow = stored(sized.select("_source", "_size", "_hash"))
    cuts, rows = thresholds(narrow, weights, cap, budgets)
    joined = with_small(sized, cuts, F.col("_source").eqNullSafe(F.col("source")), rows, "left")
    copies = F.transform("cuts", lambda c: c["full"] + F.when(F.col("_hash") < c["limit"], 1).otherwise(0))
    joined = joined.withColumn("_copies", copies)
    hit = F.get(F.filter("cuts", lambda c: c["full"] + F.when(F.col("_hash") < c["limit"], 1).otherwise(0) > 0), F.lit(0))
    last = F.element_at("_copies", -1)
    return joined.select(
        *[F.col("_row").getField(c).alias(c) for c in keep],
        F.col("_size").alias("size"),
        F.col("source_size"),
        F.col("target"),
        last.alias("copies"),
        (last * F.col("_size")).alias("taken"),
        hit["budget"].alias("first_budget"),
    )


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The rows of the mix itself: each row of ``docs`` as often as it is taken."""
    own = docs.select(F.struct(*docs.columns).alias("_doc"), *[docs[c].alias(c) for c in ("doc_id", "text", "source")])
    taken = mix(own, **options)
    repeated = taken.filter("copies > 0").withColumn("_n", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))))
    return repeated.select("_doc.*")
