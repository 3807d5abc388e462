import numpy as np
import pytest
from conftest import rows

from stepwell.functions.outcomes import EVENT_SCHEMA
from stepwell.operators import similarity as M
from stepwell.plans.recommend import candidate_pool_size, failed_targets, recommend


def frame(spark, vectors):
    return spark.createDataFrame(
        [(i, [float(x) for x in v]) for i, v in vectors.items()], "trace_id string, embedding array<float>"
    )


@pytest.fixture(scope="module")
def cloud():
    """Clustered vectors with copies, so that ties and hot groups occur."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 8))
    vectors = {f"v{i:03}": centres[i % 6] + 0.2 * rng.normal(size=8) for i in range(120)}
    for i in range(60):
        vectors[f"copy{i:03}"] = vectors["v000"]
    return {k: np.float32(v) for k, v in vectors.items()}


def brute_force(vectors, queries, k):
    ids = sorted(vectors)
    m = np.stack([vectors[i] for i in ids]).astype(float)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    out = {}
    for q in queries:
        v = vectors[q].astype(float)
        scores = np.round(m @ (v / np.linalg.norm(v)), 9)
        ranked = sorted((-s, i) for s, i in zip(scores, ids) if i != q)
        out[q] = [i for _, i in ranked[:k]]
    return out


def ranking(df):
    out = {}
    for r in rows(df, "query_id", "rank"):
        out.setdefault(r["query_id"], []).append(r["trace_id"])
    return out


@pytest.mark.parametrize("limits", ["few candidates", "few queries", "neither"])
def test_top_k_is_exact_on_every_path(spark, cloud, monkeypatch, limits):
    queries = {k: v for k, v in cloud.items() if k.endswith("0")}
    monkeypatch.setattr(M, "BLOCK_ROWS", 16)
    if limits == "few queries":
        monkeypatch.setattr(M, "SMALL_SIDE_VALUES", 8 * len(queries))
    if limits == "neither":
        monkeypatch.setattr(M, "SMALL_SIDE_VALUES", 8)
    got = ranking(M.top_k_similar(frame(spark, queries), frame(spark, cloud), 7))
    assert got == brute_force(cloud, queries, 7)


def test_k_larger_than_the_pool(spark, cloud, monkeypatch):
    small = {k: cloud[k] for k in ("v000", "v001", "v002")}
    monkeypatch.setattr(M, "SMALL_SIDE_VALUES", 8)
    got = ranking(M.top_k_similar(frame(spark, small), frame(spark, small), 10))
    assert got == brute_force(small, small, 10)


def test_find_similar(spark, cloud):
    pool = frame(spark, cloud)
    query = [float(x) for x in cloud["v001"]]
    best = [r["trace_id"] for r in M.find_similar(pool, query, 5).collect()]
    assert best[0] == "v001"
    some = spark.createDataFrame([("v001",), ("v007",), ("v013",)], "trace_id string")
    got = [r["trace_id"] for r in M.find_similar(pool, query, 5, candidates=some, excluded=some.limit(0)).collect()]
    assert set(got) == {"v001", "v007", "v013"}
    assert M.find_similar(pool, query, 5, candidates=some.limit(0)).count() == 0
    hits, problem = M.similar_to(pool, "v001", 3)
    assert problem is None and "v001" not in [r["trace_id"] for r in hits.collect()]
    assert M.similar_to(pool, "nobody")[1]
    zero = M.find_similar(frame(spark, {"z": np.zeros(8)}), query).collect()
    assert zero[0]["similarity"] == 0.0


def test_wrong_size_fails(spark, cloud):
    with pytest.raises(Exception, match="expected vectors of 3 values"):
        M.find_similar(frame(spark, cloud), [1.0, 2.0, 3.0]).collect()


def test_packed_vectors_round_trip(spark, cloud):
    back = M.decode_packed(M.pack(frame(spark, cloud)))
    got = {r["trace_id"]: r["embedding"] for r in back.collect()}
    assert all(np.float32(got[k]).tolist() == v.tolist() for k, v in cloud.items())


def test_vectorize(spark):
    texts = spark.createDataFrame([("a", "run the tests"), ("b", "run the tests"), ("c", "something else")], "trace_id string, text string")
    got = {r["trace_id"]: r["embedding"] for r in M.vectorize(texts, 32).collect()}
    assert got["a"] == got["b"] != got["c"] and len(got["a"]) == 32


def test_recommendations(spark):
    def events(*recovered):
        return [("loop", 1, 1, r, 2 if r else None, s) for r, s in recovered]

    traces = spark.createDataFrame(
        [
            ("q", "codex", "codex", 1, events((False, None))),
            ("near", "atif", "mcp", 0, events((True, " rested "), (False, None))),
            ("silent", "atif", "mcp", 0, events((True, None))),
            ("far", "cursor", "cursor", 1, events((True, "again"))),
            ("open", "atif", "mcp", 1, events((False, None))),
            ("unembedded", "atif", "mcp", 1, None),
        ],
        f"id string, source_format string, agent_name string, has_error int, failure_events {EVENT_SCHEMA}",
    )
    vectors = frame(spark, {"q": [1, 0], "near": [1, 0.1], "silent": [1, 0.01], "far": [0, 1], "open": [1, 0]})
    assert candidate_pool_size(traces).first()[0] == 3
    assert sorted(r["trace_id"] for r in failed_targets(traces, vectors).collect()) == ["far", "open", "q"]
    got = [r for r in rows(recommend(traces, vectors, k=2), "trace_id", "rank")]
    # "silent" takes a place among the best two and is dropped afterwards
    assert [(r["trace_id"], r["hit_id"]) for r in got] == [("far", "near"), ("open", "near"), ("q", "near")]
    assert got[2]["similarity"] == 0.995 and got[2]["recoveries"] == [{"label": "loop", "summary": "rested", "recovery_step": 2}]


def test_a_query_goes_to_a_bundle_once(spark, monkeypatch):
    """Evenly spread vectors let no group be skipped; a query was then copied once per group."""
    import numpy as np

    rng = np.random.default_rng(5)
    rows = [(str(i), rng.normal(size=16).tolist()) for i in range(400)]
    df = spark.createDataFrame(rows, "trace_id string, embedding array<float>")
    sent, plain = [], M._visit
    monkeypatch.setattr(M, "_visit", lambda routed, *rest: sent.append(routed.count()) or plain(routed, *rest))
    hits = M.rank_hits(M.by_pivot_groups(df.withColumnRenamed("trace_id", "query_id"), df, 16, 3), 3)
    assert hits.count() == 1200 and sum(sent) == 400


def test_shortlists_lose_no_hit_and_no_tie():
    import numpy as np

    rng = np.random.default_rng(6)
    rows = rng.normal(size=(9000, 8)).round(1).astype(np.float32)
    rows[5000:5040] = rows[7]
    ids = np.array([f"{i:05}" for i in range(9000)], dtype=object)
    got = M._score(ids[:60], rows[:60], ids, rows, 6).to_pylist()
    unit = M.unit(rows.astype(np.float64))
    for q in range(60):
        scores = np.round(unit @ unit[q], M.TIE_DECIMALS)
        order = [j for j in np.lexsort((ids, -scores)) if j != q][:6]
        assert [r["trace_id"] for r in got if r["query_id"] == ids[q]] == [ids[j] for j in order]


def test_copies_and_near_ties_are_cut_to_those_that_count(monkeypatch):
    import numpy as np

    monkeypatch.setattr(M, "SCORE_CELLS", 3200)
    monkeypatch.setattr(M, "SCAN_ROWS", 64)
    rng = np.random.default_rng(8)
    one = rng.normal(size=8)
    # one direction at many lengths, and many copies of one row
    rows = np.concatenate([one * rng.integers(1, 9, size=(500, 1)), np.repeat(rng.normal(size=(1, 8)), 300, axis=0), rng.normal(size=(200, 8))]).astype(np.float32)
    ids = np.array([f"{i:04}" for i in rng.permutation(1000)], dtype=object)
    held = M._few_copies(ids, rows, 5)
    assert len(held[0]) < 300
    unit = M.unit(rows.astype(np.float64))
    some = np.arange(0, 1000, 37)
    for pool in ((ids, rows), held):
        got = M._score(ids[some], rows[some], *pool, 4).to_pylist()
        for q in some:
            scores = np.round(unit @ unit[q], M.TIE_DECIMALS)
            best = [ids[j] for j in np.lexsort((ids, -scores)) if j != q][:4]
            assert [r["trace_id"] for r in got if r["query_id"] == ids[q]] == best
