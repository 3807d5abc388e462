import pytest
from conftest import rows

from stepwell.functions.outcomes import LABEL_NAMES
from stepwell.operators import sampling as S


def test_first_n_per_stratum(spark):
    data = [(i, f"k{i % 12}", i % 3 == 0) for i in range(40)] + [(99, None, True), (98, "z", None)]
    df = spark.createDataFrame(data, "ord int, key string, target boolean")
    got = rows(S.first_n_per_stratum(df, "target", 3, "key", ["ord"]), "ord")
    assert [(r["ord"], r["target"]) for r in got] == [(0, True), (1, False), (2, False), (3, True), (4, False), (6, True)]


def test_judge_sample(spark):
    data = [(f"{i:03}", i % 4 == 0, None, True) for i in range(104)] + [("x", None, None, True), ("y", True, "loop", True), ("z", True, None, False)]
    df = spark.createDataFrame(data, "id string, bad boolean, failure_label string, has_atif boolean").selectExpr("*", "int(bad) AS has_error")
    got = S.judge_sample(df).collect()
    failures = [r["id"] for r in got if r["has_error"] == 1]
    others = [r["id"] for r in got if r["has_error"] == 0]
    assert failures == [f"{i:03}" for i in range(0, 104, 4)]
    assert len(others) == 8 and others == sorted(others)  # 78 * 0.1 = 7.8
    assert got[: len(failures)] == [r for r in got if r["has_error"] == 1]
    assert [r["id"] for r in S.judge_sample(df).collect()] == [r["id"] for r in got]
    assert [r["id"] for r in S.judge_sample(df, seed=1).collect()] != [r["id"] for r in got]
    assert len(S.judge_sample(df, rejudge=True).collect()) == len(got) + 1


def weights(spark, w):
    return spark.createDataFrame(list(w.items()), "label string, weight double")


def quotas(spark, w, total):
    return {r["label"]: r["quota"] for r in S.allocate(weights(spark, w), total).collect()}


def test_allocate(spark):
    assert quotas(spark, {"loop": 0.5, "gave_up": 0.3, "success": 0.2}, 10) == {"loop": 5, "gave_up": 3, "success": 2}
    # equal remainders: the first labels by name get the rest
    assert quotas(spark, {"c": 1 / 3, "a": 1 / 3, "b": 1 / 3}, 8) == {"a": 3, "b": 3, "c": 2}
    # weights above 1: each label gives back at most one
    assert quotas(spark, {"a": 0.505, "b": 0.505}, 1000) == {"a": 504, "b": 504}
    assert sum(quotas(spark, {n: 1 / 11 for n in LABEL_NAMES}, 97).values()) == 97


def test_weights_are_checked():
    S.validate_weights({"loop": 0.4, "success": 0.6})
    for bad in ({}, {"nope": 1.0}, {"loop": -0.5, "success": 1.5}, {"loop": float("nan")}, {"loop": 0.5}):
        with pytest.raises(ValueError):
            S.validate_weights(bad)


def test_quota_sample_and_even_split(spark):
    data = [(i, "loop" if i % 3 else "success") for i in range(300)]
    df = spark.createDataFrame(data, "id long, label string")
    q = spark.createDataFrame([("loop", 7), ("success", 500), ("gave_up", 2)], "label string, quota long")
    got = S.quota_sample(df, q, "label", "id")
    assert {r["label"]: r["count"] for r in got.groupBy("label").count().collect()} == {"loop": 7, "success": 100}
    assert rows(got, "id") == rows(S.quota_sample(df, q, "label", "id", max_labels=1), "id")
    parts = S.even_split(df, 7, "id").groupBy("part").count().collect()
    assert sorted(r["count"] for r in parts) == [42] + [43] * 6
