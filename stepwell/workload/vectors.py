"""Vector search over the embeddings table."""

from __future__ import annotations

from pyspark.sql import functions as F

from stepwell.operators import reports, similarity, upserts
from stepwell.plans import recommend as rec
from stepwell.workload import query
from stepwell.workload import bindings as B

VEC = """vec AS (SELECT vec_id, CAST(vec_id AS VARCHAR) AS trace_id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings),
first AS (SELECT v AS q FROM vec WHERE vec_id = (SELECT min(vec_id) FROM vec))"""
SIM = "round(list_cosine_similarity(v, q), 12)"


def ranked(pool: str, k: int) -> str:
    return f"""SELECT trace_id, round(s, 4) AS similarity FROM (
        SELECT trace_id, {SIM} AS s FROM {pool}, first) ORDER BY s DESC, trace_id LIMIT {k}"""


def rounded(hits):
    return hits.withColumn("similarity", F.round("similarity", 4))


@query("find_similar", f"WITH {VEC} {ranked('vec', 10)}")
def find_similar(spark, sf_dir):
    target = B.first_query_vector(spark, sf_dir)
    return rounded(similarity.find_similar(B.vectors(spark, sf_dir), target, 10))


@query(
    "similar_to",
    f"WITH {VEC}, others AS (SELECT * FROM vec WHERE vec_id <> (SELECT min(vec_id) FROM vec)) {ranked('others', 10)}",
)
def similar_to(spark, sf_dir):
    first = B.table(spark, sf_dir, "embeddings").agg(F.min("vec_id")).first()[0]
    hits, _ = similarity.similar_to(B.vectors(spark, sf_dir), str(first), 10)
    return rounded(hits)


@query(
    "restricted_similar",
    f"""WITH {VEC}, pool AS (SELECT * FROM vec WHERE vec_id IN (SELECT doc_id FROM labels WHERE quality = 1)
        AND vec_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en')) {ranked('pool', 15)}""",
)
def restricted_similar(spark, sf_dir):
    wanted = B.table(spark, sf_dir, "labels").filter("quality = 1").selectExpr("cast(doc_id as string) AS trace_id")
    banned = B.table(spark, sf_dir, "documents").filter("lang = 'en'").selectExpr("cast(doc_id as string) AS trace_id")
    target = B.first_query_vector(spark, sf_dir)
    return rounded(
        similarity.find_similar(
            B.vectors(spark, sf_dir), target, 15, candidates=wanted, excluded=banned
        )
    )


@query(
    "hybrid_search",
    f"""WITH {VEC}, {B.ORDER_TRACES_SQL}, pool AS (SELECT vec.* FROM vec JOIN traces ON vec.trace_id = traces.id
        WHERE has_error = 1 AND has_atif) {ranked('pool', 20)}""",
)
def hybrid_search(spark, sf_dir):
    hits, _ = similarity.hybrid_search(
        B.order_traces(spark, sf_dir),
        B.vectors(spark, sf_dir),
        F.col("has_error") == 1,
        B.first_query_vector(spark, sf_dir),
    )
    return rounded(hits)


@query("pool_size", "SELECT count(*) AS candidates FROM embeddings WHERE vec_id <> 3")
def pool_size(spark, sf_dir):
    return similarity.pool_size(B.vectors(spark, sf_dir), "3")


TOP_SQL = f"""WITH {VEC},
    pairs AS (SELECT a.trace_id AS query_id, b.trace_id, round(list_cosine_similarity(a.v, b.v), 12) AS s
              FROM vec a JOIN vec b ON a.vec_id <> b.vec_id)
    SELECT query_id, trace_id, round(s, 4) AS similarity, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, trace_id)::INTEGER AS rank
    FROM pairs QUALIFY rank <= 5"""


@query("similarity_join", TOP_SQL)
def similarity_join(spark, sf_dir):
    v = B.vectors(spark, sf_dir)
    return rounded(similarity.top_k_similar(v, v, 5))


@query("similarity_join_grouped", TOP_SQL)
def similarity_join_grouped(spark, sf_dir):
    """The path for two large sides, on the same data."""
    v = B.vectors(spark, sf_dir).select("trace_id", "embedding")
    queries = v.withColumnRenamed("trace_id", "query_id")
    dim = len(B.first_query_vector(spark, sf_dir))
    hits = similarity.by_pivot_groups(queries, v, dim, 5)
    return rounded(similarity.rank_hits(hits, 5))


@query(
    "failed_targets",
    f"WITH {VEC}, {B.ORDER_TRACES_SQL} SELECT trace_id, vec.label FROM vec JOIN traces ON trace_id = id WHERE has_error = 1",
)
def failed_targets(spark, sf_dir):
    return rec.failed_targets(B.order_traces(spark, sf_dir), B.vectors(spark, sf_dir)).select(
        "trace_id", "label"
    )


@query(
    "recommendations",
    f"""WITH {VEC}, {B.ORDER_TRACES_SQL},
    pairs AS (
        SELECT a.trace_id, b.trace_id AS hit_id, round(list_cosine_similarity(a.v, b.v), 12) AS s,
               h.source_format, h.agent_name,
               CAST(h.recovered_1 AS INTEGER) + CAST(h.recovered_2 AND trim(h.summary_2) <> '' AS INTEGER) AS n_recoveries
        FROM vec a JOIN traces f ON a.trace_id = f.id AND f.has_error = 1
        JOIN vec b ON a.vec_id <> b.vec_id
        JOIN traces h ON b.trace_id = h.id AND h.two_events AND (h.recovered_1 OR h.recovered_2)),
    top AS (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY s DESC, hit_id)::INTEGER AS rank FROM pairs QUALIFY rank <= 10)
    SELECT trace_id, rank, hit_id, round(s, 4) AS similarity, source_format, agent_name, n_recoveries
    FROM top WHERE n_recoveries > 0""",
)
def recommendations(spark, sf_dir):
    found = rec.recommend(B.order_traces(spark, sf_dir), B.vectors(spark, sf_dir))
    return found.withColumn("n_recoveries", F.size("recoveries")).drop("recoveries")


@query(
    "recommendation_lists",
    f"""WITH {VEC}, {B.ORDER_TRACES_SQL},
    pairs AS (
        SELECT a.trace_id, h.recovered_1 OR trim(h.summary_2) <> '' AS useful, b.trace_id AS hit_id,
               round(list_cosine_similarity(a.v, b.v), 12) AS s
        FROM vec a JOIN traces f ON a.trace_id = f.id AND f.has_error = 1
        JOIN vec b ON a.vec_id <> b.vec_id
        JOIN traces h ON b.trace_id = h.id AND h.two_events AND (h.recovered_1 OR h.recovered_2)),
    top AS (SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY trace_id ORDER BY s DESC, hit_id) <= 10),
    lists AS (SELECT trace_id, count(*)::INTEGER AS n, arg_max(hit_id, s) AS best FROM top WHERE useful GROUP BY 1)
    SELECT traces.id AS trace_id, coalesce(n, 0) AS n, coalesce(best, '') AS best
    FROM traces LEFT JOIN lists ON lists.trace_id = traces.id WHERE has_error = 1""",
)
def recommendation_lists(spark, sf_dir):
    traces = B.order_traces(spark, sf_dir)
    lists = rec.recommendation_lists(traces, rec.recommend(traces, B.vectors(spark, sf_dir)))
    return lists.selectExpr(
        "trace_id",
        "size(recommendations) AS n",
        "coalesce(get(recommendations, 0).hit_id, '') AS best",
    )


PRECISION_SQL = f"""{VEC},
    top AS (SELECT a.trace_id AS query_id, a.label AS wanted, b.label AS got,
                   row_number() OVER (PARTITION BY a.trace_id ORDER BY round(list_cosine_similarity(a.v, b.v), 12) DESC, b.trace_id) AS rank
            FROM vec a JOIN vec b ON a.vec_id <> b.vec_id QUALIFY rank <= 5),
    c AS (SELECT query_id, count(*) AS hits, count(*) FILTER (WHERE got < 7) AS scoreable,
                 count(*) FILTER (WHERE got < 7 AND got = wanted) AS relevant FROM top GROUP BY 1),
    every AS (SELECT * FROM c UNION ALL SELECT NULL, sum(hits)::BIGINT, sum(scoreable)::BIGINT, sum(relevant)::BIGINT FROM c)"""


def _precision(name: str, denominator: str) -> None:
    @query(
        name,
        f"""WITH {PRECISION_SQL}
        SELECT *, round(coalesce(relevant / nullif({denominator}, 0), 0), 6) AS precision FROM every""",
    )
    def run(spark, sf_dir):
        v = B.vectors(spark, sf_dir)
        hits = similarity.top_k_similar(v, v, 5)
        # labels from 7 on count as unknown, so such hits cannot be scored
        truth = v.selectExpr("trace_id", "if(label < 7, cast(label as string), NULL) AS truth")
        expected = v.selectExpr("trace_id AS query_id", "cast(label as string) AS label")
        scored = reports.attach_truth(hits, truth)
        found = reports.precision_at_k(scored, expected, denominator)
        return found.withColumn("precision", F.round("precision", 6))


_precision("precision_at_k", "scoreable")
_precision("precision_at_k_labels", "hits")


@query(
    "decode_packed",
    """SELECT CAST(vec_id AS VARCHAR) AS trace_id, len(embedding)::INTEGER AS dim,
    round(list_sum(CAST(embedding AS DOUBLE[])), 6) AS total FROM embeddings""",
)
def decode_packed(spark, sf_dir):
    packed = similarity.pack(B.vectors(spark, sf_dir))
    return similarity.decode_packed(packed).selectExpr(
        "trace_id",
        "size(embedding) AS dim",
        "round(aggregate(embedding, 0D, (a, x) -> a + double(x)), 6) AS total",
    )


@query(
    "upsert_embeddings",
    """SELECT CAST(vec_id AS VARCHAR) AS trace_id, CASE WHEN vec_id % 3 = 0 THEN 'new' ELSE 'old' END AS model,
              CASE WHEN vec_id % 3 = 0 THEN 0.0 ELSE round(embedding[1]::DOUBLE, 6) END AS first FROM embeddings""",
)
def upsert_embeddings(spark, sf_dir):
    """Every third vector is replaced by a batch that brings it three times."""
    stored = B.vectors(spark, sf_dir).selectExpr("trace_id", "embedding", "'old' AS model")
    dim = "size(embedding)"
    batch = stored.filter("cast(trace_id as bigint) % 3 = 0")
    newest = batch.selectExpr("trace_id", f"cast(array_repeat(0, {dim}) as array<float>) AS embedding", "'new' AS model", "2 AS at")
    earlier = batch.selectExpr("trace_id", "embedding", "'old' AS model", "1 AS at")
    width = B.table(spark, sf_dir, "embeddings").selectExpr(f"max({dim}) AS d").first()["d"]
    merged = upserts.upsert_embeddings(stored, newest.union(earlier).union(newest), width, F.col("at").desc())
    return merged.selectExpr("trace_id", "model", "round(cast(embedding[0] as double), 6) AS first")


@query("vectorize")
def vectorize(spark, sf_dir):
    texts = B.table(spark, sf_dir, "documents").selectExpr("cast(doc_id as string) AS trace_id", "text")
    return similarity.vectorize(texts, 64).selectExpr(
        "trace_id",
        "size(embedding) AS dim",
        "round(sqrt(aggregate(embedding, 0D, (a, x) -> a + double(x) * double(x))), 3) AS norm",
    )
