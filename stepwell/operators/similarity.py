"""Exact cosine nearest neighbours.

Scores are computed with numpy over Arrow batches inside tasks.  Which side travels is
decided by a size check:

* few candidates: they are broadcast and every query batch is scored against them;
* few queries: they are broadcast and every task keeps its best k per query;
* neither: candidates are grouped around pivot vectors.  The angle between unit vectors
  obeys the triangle inequality, so a group whose nearest possible member is worse than
  the k-th hit found so far cannot hold an answer and is skipped.  Groups are
  bundled up to a block; surviving (query, bundle) pairs are joined, in blocks of bounded size on both sides.

All three return the same rows.  Ties are broken by id; similarities count as equal when
they agree to twelve decimals.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepwell.session import cut_lineage

EPS = 1e-12
# an angle near zero is off by about 1e-8 after its cosine was rounded
ANGLE_SLACK = 1e-7
TIE_DECIMALS = 12
SMALL_SIDE_VALUES = 16_000_000  # vector values in a broadcast side: 128 MB as float64
BLOCK_ROWS = 32_768
BLOCK_VALUES = 2_097_152  # vector values in a block: 8 MB as float32
SCAN_ROWS = 4096
MAX_PIVOTS = 1024
SCORE_CELLS = 2_000_000  # scores, angles or routed vector values held at once inside a task

HITS = "query_id string, trace_id string, similarity double"
HIT_FIELDS = pa.schema(
    [("query_id", pa.string()), ("trace_id", pa.string()), ("similarity", pa.float64())]
)


def matrix(column: pa.Array | pa.ChunkedArray, dim: int | None = None, kind: type | None = np.float64) -> np.ndarray:
    """Dense matrix of an Arrow list column, in its own type for no ``kind``; rows of another length raise."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return np.zeros((0, dim or 0))
    lengths = np.diff(column.offsets.to_numpy())
    wanted = dim if dim is not None else int(lengths[0])
    if not (lengths == wanted).all():
        raise ValueError(f"expected vectors of {wanted} values, got {sorted(set(lengths.tolist()))}")
    kind = kind or column.type.value_type.to_pandas_dtype()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, wanted).astype(kind, copy=False)


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), EPS)


def _unit(rows: np.ndarray) -> np.ndarray:
    return unit(rows.astype(np.float64))


def _first(owner: np.ndarray, n: int) -> np.ndarray:
    """True for the first ``n`` entries of each run of equal owners."""
    begins = np.flatnonzero(np.append(True, owner[1:] != owner[:-1])) if len(owner) else owner
    return np.arange(len(owner)) - np.repeat(begins, np.diff(np.append(begins, len(owner)))) < n


def _few_copies(ids: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` ids of each group of equal rows; no other can be among the ``n`` best."""
    if len(rows) == 0:
        return ids, rows
    rows = np.ascontiguousarray(rows)
    group = np.unique(rows.view(np.dtype((np.void, rows[0].nbytes))).ravel(), return_inverse=True)[1]
    order = np.lexsort((ids, group))
    keep = np.sort(order[_first(group[order], n)])
    return ids[keep], rows[keep]


def _exact(queries: np.ndarray, rows: np.ndarray, query: np.ndarray, at: np.ndarray) -> np.ndarray:
    step = max(1, SCORE_CELLS // max(1, queries.shape[1]))
    parts = [slice(lo, lo + step) for lo in range(0, len(query), step)]
    scores = [np.einsum("ij,ij->i", queries[query[p]], _unit(rows[at[p]])) for p in parts]
    return np.round(np.concatenate([np.zeros(0), *scores]), TIE_DECIMALS)


def _shortlist(queries: np.ndarray, ids: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) pairs that may be among the ``n`` best of a query, from single-precision scores.

    ``rows`` are read block by block; a row is left out when its score is below the n-th best
    by more than both scores can be off.  Where too many pairs are that close, their exact
    scores and ids say which are the ``n`` best so far.
    """
    slack = np.float32((queries.shape[1] + 4) * 2.0**-22)
    asked = queries.astype(np.float32)
    owner, at, scored = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)
    floor = np.full(len(asked), -np.inf, np.float32)
    for lo in range(0, len(rows), SCAN_ROWS):
        scores = asked @ _unit(rows[lo : lo + SCAN_ROWS]).astype(np.float32).T
        if lo == 0 and scores.shape[1] > n:
            floor = np.partition(scores, scores.shape[1] - n, axis=1)[:, scores.shape[1] - n] - slack
        query, row = np.divmod(np.flatnonzero(scores >= floor[:, None]), scores.shape[1])
        if len(query) == 0:
            continue
        owner, at = np.append(owner, query), np.append(at, row + lo)
        scored = np.append(scored, scores[query, row])
        order = np.lexsort((-scored, owner))
        owner, at, scored = owner[order], at[order], scored[order]
        # the n-th best of each query that has so many
        last = np.flatnonzero(_first(owner, n) & ~_first(owner, n - 1))
        floor[owner[last]] = scored[last] - slack
        keep = scored >= floor[owner]
        owner, at, scored = owner[keep], at[keep], scored[keep]
        if len(owner) > max(SCORE_CELLS // 16, 2 * n * len(asked)):
            order = np.lexsort((ids[at], -_exact(queries, rows, owner, at), owner))
            order = order[_first(owner[order], n)]
            owner, at, scored = owner[order], at[order], scored[order]
    return owner, at


def _score(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> pa.Table:
    """Best ``k`` rows per query by (score desc, id asc), never the query itself.

    Pairs are told apart in single precision; those that may be hits are scored in double.
    """
    found: list[pa.Table] = []
    times = pd.Series(ids).value_counts()
    own = times.reindex(query_ids).fillna(0).to_numpy(np.int64)
    # the rows of a query's own id come first and are dropped
    for extra in np.unique(own):
        these = np.flatnonzero(own == extra)
        step = max(1, SCORE_CELLS // SCAN_ROWS)
        for part in (these[lo : lo + step] for lo in range(0, len(these), step)):
            asked = _unit(queries[part])
            query, at = _shortlist(asked, ids, rows, k + int(extra))
            other = ids[at] != query_ids[part[query]]
            query, at = query[other], at[other]
            scores = _exact(asked, rows, query, at)
            order = np.lexsort((ids[at], -scores, query))
            order = order[_first(query[order], k)]
            columns = (query_ids[part[query[order]]], ids[at[order]], scores[order])
            found.append(pa.table([pa.array(c, f.type) for c, f in zip(columns, HIT_FIELDS)], schema=HIT_FIELDS))
    return pa.concat_tables(found) if found else HIT_FIELDS.empty_table()


def _names(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.array(column.to_pylist(), dtype=object)


def score_against(vectors: DataFrame, query: list[float]) -> DataFrame:
    """Add ``similarity`` to one fixed query vector (trace_id, embedding -> trace_id, similarity)."""
    target = np.asarray(query, dtype=np.float64)
    target = target / max(float(np.linalg.norm(target)), EPS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = unit(matrix(batch.column("embedding"), len(target)))
            scores = np.round(rows @ target, TIE_DECIMALS) if len(rows) else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("trace_id"), pa.array(scores, pa.float64())],
                names=["trace_id", "similarity"],
            )

    return vectors.select(F.col("trace_id").cast("string"), "embedding").mapInArrow(
        run, "trace_id string, similarity double"
    )


def restrict(
    pool: DataFrame, candidates: DataFrame | None = None, excluded: DataFrame | None = None
) -> DataFrame:
    """Pool cut to candidate ids and without excluded ids, before any vector is scored."""
    if candidates is not None:
        pool = pool.join(candidates.select("trace_id"), "trace_id", "left_semi")
    if excluded is not None:
        pool = pool.join(excluded.select("trace_id"), "trace_id", "left_anti")
    return pool


def of_model(vectors: DataFrame, model: str | None) -> DataFrame:
    return vectors if model is None else vectors.filter(F.col("model") == model)


def find_similar(
    vectors: DataFrame,
    query: list[float],
    k: int = 10,
    candidates: DataFrame | None = None,
    excluded: DataFrame | None = None,
    model: str | None = None,
) -> DataFrame:
    """Best ``k`` traces for one query vector (trace_id, similarity), best first."""
    pool = restrict(of_model(vectors, model), candidates, excluded)
    return score_against(pool, query).orderBy(F.desc("similarity"), "trace_id").limit(k)


def stored_vector(vectors: DataFrame, trace_id: str) -> list[float] | None:
    row = vectors.filter(F.col("trace_id") == trace_id).select("embedding").first()
    return None if row is None else list(row["embedding"])


def similar_to(
    vectors: DataFrame, trace_id: str, k: int = 10, model: str | None = None
) -> tuple[DataFrame | None, str | None]:
    """Neighbours of a stored trace without itself, or a message when it has no vector."""
    query = stored_vector(of_model(vectors, model), trace_id)
    if query is None:
        return None, "this trace has no embedding yet"
    others = of_model(vectors, model).filter(F.col("trace_id") != trace_id)
    return find_similar(others, query, k), None


def pool_size(vectors: DataFrame, trace_id: str | None = None, model: str | None = None) -> DataFrame:
    pool = of_model(vectors, model)
    if trace_id is not None:
        pool = pool.filter(F.col("trace_id") != trace_id)
    return pool.agg(F.count("*").alias("candidates"))


def hybrid_search(
    traces: DataFrame, vectors: DataFrame, condition: Column, query: list[float], k: int = 20
) -> tuple[DataFrame, DataFrame]:
    """Structured filter first, then the vector ranking over what is left."""
    candidates = traces.filter(condition & F.col("has_atif")).select(F.col("id").alias("trace_id"))
    hits = find_similar(vectors, query, k, candidates=candidates)
    return hits, candidates.agg(F.count("*").alias("candidates"))


def rank_hits(hits: DataFrame, k: int) -> DataFrame:
    """Number the best ``k`` hits per query; tasks keep k per query before the shuffle."""
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "trace_id")
    return hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def vector_size(vectors: DataFrame) -> int | None:
    """Number of values per vector, read from one row; NULL for an empty table."""
    row = vectors.select(F.size("embedding").alias("dim")).first()
    return None if row is None else row["dim"]


def _small(side: DataFrame, dim: int) -> pa.Table | None:
    """The side as an Arrow table when it has at most ``SMALL_SIDE_VALUES`` values.

    Never more than one row beyond that bound is fetched.
    """
    rows = SMALL_SIDE_VALUES // max(1, dim)
    table = side.limit(rows + 1).toArrow()
    return table if table.num_rows <= rows else None


def top_k_similar(
    queries: DataFrame, candidates: DataFrame, k: int = 10, dim: int | None = None
) -> DataFrame:
    """Exact top ``k`` candidates of every query, never the query itself.

    ``queries`` and ``candidates``: (trace_id, embedding).  Returns (query_id, trace_id,
    similarity, rank).
    """
    queries = queries.select(F.col("trace_id").cast("string").alias("query_id"), "embedding").filter("embedding IS NOT NULL")
    candidates = candidates.select(F.col("trace_id").cast("string"), "embedding").filter("embedding IS NOT NULL")
    dim = dim or vector_size(candidates)
    if dim is None:
        return rank_hits(queries.sparkSession.createDataFrame([], HITS), k)
    if (small := _small(candidates, dim)) is not None:
        return rank_hits(_few_candidates(queries, small, dim, k), k)
    if (small := _small(queries, dim)) is not None:
        return rank_hits(_few_queries(small, candidates, dim, k), k)
    return rank_hits(by_pivot_groups(queries, candidates, dim, k), k)


def _few_candidates(queries: DataFrame, table: pa.Table, dim: int, k: int) -> DataFrame:
    ids = _names(table.column("trace_id"))
    most = int(pd.Series(ids).value_counts().max()) if len(ids) else 1
    side = queries.sparkSession.sparkContext.broadcast(
        _few_copies(ids, matrix(table.column("embedding"), dim, None), k + most)
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, rows = side.value
        for batch in batches:
            asked = matrix(batch.column("embedding"), dim, None)
            yield from _score(_names(batch.column("query_id")), asked, ids, rows, k).to_batches()

    return queries.mapInArrow(run, HITS)


def _few_queries(table: pa.Table, candidates: DataFrame, dim: int, k: int) -> DataFrame:
    side = candidates.sparkSession.sparkContext.broadcast(
        (_names(table.column("query_id")), matrix(table.column("embedding"), dim, None))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, asked = side.value
        best = HIT_FIELDS.empty_table()
        for batch in batches:
            ids, rows = _names(batch.column("trace_id")), matrix(batch.column("embedding"), dim, None)
            # one running top-k per query and task
            best = pa.concat_tables([best, _score(query_ids, asked, ids, rows, k)])
            best = best.sort_by([("query_id", "ascending"), ("similarity", "descending"), ("trace_id", "ascending")])
            owner = best.column("query_id").combine_chunks().dictionary_encode().indices.to_numpy() if best.num_rows else np.zeros(0, np.int64)
            best = best.filter(pa.array(_first(owner, k)))
        yield from best.to_batches()

    return candidates.mapInArrow(run, HITS)


# --- neither side is small -------------------------------------------------------------


def _angles(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(rows @ pivots.T, -1.0, 1.0))


def _assign(candidates: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Nearest pivot of every candidate and the angle to it."""
    dim = pivots.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, SCORE_CELLS // len(pivots))
        for batch in (b.slice(at, step) for b in batches for at in range(0, b.num_rows, step)):
            angles = _angles(unit(matrix(batch.column("embedding"), dim)), pivots)
            group = angles.argmin(axis=1) if len(angles) else np.zeros(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("trace_id"),
                    batch.column("embedding"),
                    pa.array(group.astype(np.int32)),
                    pa.array(angles[np.arange(len(group)), group] if len(group) else np.zeros(0)),
                ],
                names=["trace_id", "embedding", "grp", "angle"],
            )

    kind = candidates.schema["embedding"].dataType.simpleString()
    return candidates.mapInArrow(run, f"trace_id string, embedding {kind}, grp int, angle double")


def _route(
    queries: DataFrame, pivots: np.ndarray, radius: np.ndarray, size: np.ndarray, bundle: np.ndarray, k: int, second: bool
) -> DataFrame:
    """Bundles of groups each query has to visit.

    First pass: those of its nearest groups until these hold k + 1 candidates.  Second pass
    (``floor`` = similarity of the k-th hit so far): every other bundle with a group that may
    hold a candidate at least that similar.
    """
    dim = pivots.shape[1]

    # a query may have to visit every group, so a slice of them is bounded by what it may send out
    by_bundle = np.argsort(bundle, kind="stable")
    begins = np.flatnonzero(np.append(True, np.diff(bundle[by_bundle]) > 0))
    step = max(1, SCORE_CELLS // max(len(pivots), len(begins) * dim))

    def bundles(groups: np.ndarray) -> np.ndarray:
        return np.logical_or.reduceat((groups & (size > 0))[:, by_bundle], begins, axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, step) for b in batches for at in range(0, b.num_rows, step)):
            angles = _angles(unit(matrix(batch.column("embedding"), dim)), pivots)
            order = np.argsort(angles, axis=1, kind="stable")
            held = np.cumsum(size[order], axis=1)
            near_sorted = np.concatenate(
                [np.ones((len(order), 1), bool), held[:, :-1] < k + 1], axis=1
            )
            near = np.zeros_like(near_sorted)
            np.put_along_axis(near, order, near_sorted, axis=1)
            if second:
                floor = batch.column("floor").to_numpy(zero_copy_only=False)
                reach = np.cos(np.maximum(angles - radius, 0.0))
                visit = bundles(reach >= floor[:, None] - ANGLE_SLACK) & ~bundles(near)
            else:
                visit = bundles(near)
            query, group = np.nonzero(visit)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("query_id").take(pa.array(query)),
                    batch.column("embedding").take(pa.array(query)),
                    pa.array(group.astype(np.int32)),
                ],
                names=["query_id", "embedding", "grp"],
            )

    kind = queries.schema["embedding"].dataType.simpleString()
    return queries.mapInArrow(run, f"query_id string, embedding {kind}, grp int")


def _bundles(pivots: np.ndarray, size: np.ndarray, rows: int) -> np.ndarray:
    """Bundle of every group: a chain of near groups is cut where ``rows`` candidates are full.

    A query is sent once per bundle, not once per group, so where vectors are spread too evenly
    for groups to be skipped, the copies of a query grow with the blocks of candidates only.
    """
    close = pivots @ pivots.T
    bundle, at, number, held = np.zeros(len(pivots), dtype=np.int64), 0, 0, 0
    for _ in range(len(pivots)):
        if held and held + size[at] > rows:
            number, held = number + 1, 0
        bundle[at], held = number, held + size[at]
        close[:, at] = -np.inf
        at = int(close[at].argmax())
    return bundle


def _visit(routed: DataFrame, members: DataFrame, parts: np.ndarray, block: int, dim: int, k: int) -> DataFrame:
    """Score routed queries against the members of their bundles (``grp``), block by block.

    A bundle is cut by hash into ``parts`` candidate blocks, and its queries into blocks as
    well, so a hot group becomes many bounded (query block, candidate block) tasks.
    """
    asked = {
        r["grp"]: -(-r["count"] // block) for r in routed.groupBy("grp").count().collect()
    }  # one row per bundle, at most MAX_PIVOTS
    blocks = np.ones(len(parts), dtype=np.int64)
    for group, n in asked.items():
        blocks[group] = n
    query_blocks = F.array(*[F.lit(int(n)) for n in blocks])
    member_blocks = F.array(*[F.lit(int(n)) for n in parts])

    def numbers(n: Column) -> Column:
        return F.explode(F.sequence(F.lit(0), n - 1))

    left = routed.withColumn(
        "qpart", F.pmod(F.xxhash64("query_id"), F.get(query_blocks, F.col("grp"))).cast("int")
    ).withColumn("cpart", numbers(F.get(member_blocks, F.col("grp"))))
    right = (
        members.filter(F.col("grp").isin(*asked) if asked else F.lit(False))
        .select("trace_id", "embedding", "grp")
        .withColumn(
            "cpart", F.pmod(F.xxhash64("trace_id"), F.get(member_blocks, F.col("grp"))).cast("int")
        )
        .withColumn("qpart", numbers(F.get(query_blocks, F.col("grp"))))
    )
    key = ["grp", "cpart", "qpart"]

    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        if queries.num_rows == 0 or rows.num_rows == 0:
            return HIT_FIELDS.empty_table()
        asked, held = (matrix(side.column("embedding"), dim, None) for side in (queries, rows))
        return _score(_names(queries.column("query_id")), asked, _names(rows.column("trace_id")), held, k)

    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(run, HITS)


def by_pivot_groups(queries: DataFrame, candidates: DataFrame, dim: int, k: int) -> DataFrame:
    """Hits of every query when neither side may be broadcast."""
    # of identical vectors only the first k + 1 ids can be hits, so copies do not pile up
    copies = Window.partitionBy(F.xxhash64("embedding"), "embedding").orderBy("trace_id")
    candidates = cut_lineage(
        candidates.withColumn("_copy", F.row_number().over(copies))
        .filter(F.col("_copy") <= k + 1)
        .drop("_copy")
    )
    n = candidates.count()
    wanted = int(np.clip(np.sqrt(n), 1, MAX_PIVOTS))
    # a bounded, deterministic pick: the ids with the smallest hashes
    chosen = (
        candidates.orderBy(F.xxhash64("trace_id"), "trace_id")
        .limit(wanted)
        .select("embedding")
        .toArrow()
    )
    pivots = unit(matrix(chosen.column("embedding"), dim))
    members = cut_lineage(_assign(candidates, pivots))
    radius, size = np.zeros(len(pivots)), np.zeros(len(pivots), dtype=np.int64)
    for row in members.groupBy("grp").agg(F.count("*").alias("n"), F.max("angle").alias("r")).collect():
        radius[row["grp"]], size[row["grp"]] = row["r"], row["n"]
    block = max(1, min(BLOCK_ROWS, BLOCK_VALUES // max(1, dim)))
    bundle = _bundles(pivots, size, block)
    members = members.withColumn("grp", F.get(F.array(*[F.lit(int(b)) for b in bundle]), F.col("grp")))
    parts = np.maximum(1, -(-np.bincount(bundle, weights=size).astype(np.int64) // block))

    near = cut_lineage(
        rank_hits(_visit(_route(queries, pivots, radius, size, bundle, k, False), members, parts, block, dim, k), k)
    )
    floors = near.groupBy("query_id").agg(
        F.when(F.count("*") >= k, F.min("similarity")).otherwise(-2.0).alias("floor")
    )
    rest = queries.join(floors, "query_id", "left").withColumn(
        "floor", F.coalesce("floor", F.lit(-2.0))
    )
    routed = cut_lineage(_route(rest, pivots, radius, size, bundle, k, True))
    far = _visit(routed, members, parts, block, dim, k)
    return near.select("query_id", "trace_id", "similarity").unionByName(far)


# --- vectors in and out -----------------------------------------------------------------


def decode_packed(packed: DataFrame, column: str = "embedding") -> DataFrame:
    """Import of vectors stored as packed little-endian float32 bytes."""

    @F.pandas_udf("array<float>")
    def decode(blobs: pd.Series) -> pd.Series:
        return blobs.map(lambda b: None if b is None else np.frombuffer(b, dtype="<f4"))

    return packed.withColumn(column, decode(F.col(column)))


def pack(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """Export of vectors as packed little-endian float32 bytes."""

    @F.pandas_udf("binary")
    def encode(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else np.asarray(v, dtype="<f4").tobytes())

    return vectors.withColumn(column, encode(F.col(column)))


def vectorize(texts: DataFrame, dim: int = 256) -> DataFrame:
    """Offline text -> unit vector (trace_id, text -> trace_id, embedding).

    Hashed term frequencies weighted by inverse document frequency.  Any other transformer
    with the same shape can take its place.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import IDF, HashingTF, Normalizer, RegexTokenizer
    from pyspark.ml.functions import vector_to_array

    stages = [
        RegexTokenizer(inputCol="text", outputCol="_words", pattern="\\W+"),
        HashingTF(inputCol="_words", outputCol="_tf", numFeatures=dim),
        IDF(inputCol="_tf", outputCol="_idf"),
        Normalizer(inputCol="_idf", outputCol="_unit"),
    ]
    model = Pipeline(stages=stages).fit(texts)
    return model.transform(texts).select(
        "trace_id", vector_to_array("_unit", "float32").alias("embedding")
    )
