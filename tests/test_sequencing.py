import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from stepwell.operators import sequencing as Q


@pytest.fixture(scope="module")
def skewed(spark):
    """Half of the rows belong to one key."""
    rng = random.Random(3)
    data = [("hot" if rng.random() < 0.5 else f"k{rng.randrange(40)}", rng.randrange(10_000), i) for i in range(3000)]
    return data, spark.createDataFrame(data, "k string, at bigint, id bigint")


def expected_numbers(data):
    seen, out = {}, {}
    for k, _, i in sorted(data, key=lambda r: (r[0], r[1], r[2])):
        seen[k] = seen.get(k, 0) + 1
        out[i] = seen[k]
    return out


@pytest.mark.parametrize("hot_rows", [10, 100, 1_000_000])
def test_number_in_key(skewed, hot_rows):
    data, df = skewed
    got = Q.number_in_key(df, "k", ["at", "id"], hot_rows=hot_rows, keep_slice="part")
    found = got.collect()
    assert {r["id"]: r["step_id"] for r in found} == expected_numbers(data)
    biggest = got.groupBy("k", "part").count().agg(F.max("count")).first()[0]
    if hot_rows == 100:
        assert biggest < 300  # the hot key no longer sits in one group


def test_number_in_key_with_equal_positions(spark):
    df = spark.createDataFrame([("a", 5, i) for i in range(50)], "k string, at int, id int")
    got = Q.number_in_key(df, "k", ["at", "id"], hot_rows=10)
    assert sorted(r["step_id"] for r in got.collect()) == list(range(1, 51))


@pytest.mark.parametrize("spread", ["burst", "one", "gaps", "nulls"])
def test_no_slice_is_much_larger_than_hot_rows(spark, spread):
    """One key with nearly all rows, most of them at (almost) one position."""
    at = {"burst": lambda i: 10**15 + i % 7 if i % 50 else i, "one": lambda i: 5, "gaps": lambda i: 2 ** (i % 60), "nulls": lambda i: None if i % 3 else i}[spread]
    data = [("hot", at(i), i) for i in range(20_000)] + [(f"k{i % 9}", i, i) for i in range(300)]
    df = spark.createDataFrame(data, "k string, at bigint, id bigint").repartition(6)
    got = Q.number_in_key(df, "k", ["at", "id"], hot_rows=1000, keep_slice="part")
    sizes = {(r["k"], r["part"]): r["count"] for r in got.groupBy("k", "part").count().collect()}
    assert max(sizes.values()) <= 2 * 1000 and len(sizes) > 10
    assert [p for k, p in sizes if k != "hot"] == [0] * 9
    seen, want = {}, {}
    for k, a, i in sorted(data, key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2])):
        seen[k] = seen.get(k, 0) + 1
        want[k, i] = seen[k]
    assert {(r["k"], r["id"]): r["step_id"] for r in got.collect()} == want


def test_number_rows_over_hash_slices(skewed):
    data, df = skewed
    ordered = df.withColumn("o", Q.hash_order(F.col("id")))
    got = Q.number_rows(ordered, ["o", "id"], Q.slice_by_hash(F.col("o"))).orderBy("o", "id").collect()
    assert [r["position"] for r in got] == list(range(1, len(data) + 1))


def test_running_total_and_budget(spark):
    costs = [3, 4, 5, 6, 7]
    df = spark.createDataFrame(list(enumerate(costs)), "id int, cost int")
    for width in (1, 2, 100):
        kept = Q.within_budget(df, F.col("cost"), ["id"], Q.slice_by_position(F.col("id"), width), 12)
        # 3 + 4 + 5 reaches the cap with the third row, which is still kept
        assert [r["id"] for r in rows(kept, "id")] == [0, 1, 2]


def test_first_and_tail_limit_before_the_shuffle(skewed):
    data, df = skewed
    first = Q.first_per_key(df, ["k"], ["at", "id"])
    plan = first._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    best = {}
    for k, at, i in data:
        best[k] = min(best.get(k, (10**9, 0)), (at, i))
    assert {r["k"]: (r["at"], r["id"]) for r in first.collect()} == best
    last = Q.tail(df.withColumnRenamed("k", "trace_id"), 3, order="id")
    assert last.filter("trace_id = 'hot'").count() == 3


def test_totals_of_sparse_slices_level_by_level(spark):
    rng = random.Random(4)
    data = sorted({(f"k{i % 3}", rng.randrange(2**62)) for i in range(500)} | {("k0", i) for i in range(1500)} | {("k1", 2**20 + i * 1024) for i in range(50)})
    df = spark.createDataFrame([(k, i, i % 11) for k, i in data], "k string, id bigint, v bigint")
    for keys in ([], ["k"]):
        got = Q.running_total(df, F.col("v"), ["id", "k"], Q.slice_by_position(F.col("id"), 4), keys, levels=7)
        sums, want = {}, {}
        for k, i in sorted(data, key=lambda r: (r[1], r[0])):
            g = k if keys else None
            want[k, i] = sums.get(g, 0)
            sums[g] = want[k, i] + i % 11
        assert {(r["k"], r["id"]): r["running_before"] for r in got.collect()} == want
    # no window sees all slices: every one has a block in its partitioning
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    windows = [x for x in plan.splitlines() if "Window [" in x]
    assert windows and all("_block" in x or "_slice" in x for x in windows)
    with pytest.raises(Exception, match="out of range"):
        Q.running_total(df, F.col("v"), ["id", "k"], Q.slice_by_position(F.col("id"), 4), levels=3).collect()
