"""Whitening of embeddings from an exact, bit-sliced scatter matrix.

Entries become whole numbers ``x = floor(SCALE * c) + SHIFT``.  Per dimension the least value
is taken off, so that few bits are left.  The bits of one place of one dimension over many
rows are a plane, packed into 64-bit words; a product of two dimensions summed over the rows
is the sum over all pairs of their planes of 2^(a + b) times the number of ones in the AND of
both.  These counts are exact, add up over tasks in any order, and are centred as whole
numbers (``n * sum(xy) - sum(x) * sum(y)``) before anything is rounded; only then ``eigh``
sees the matrix.  What reaches the driver are sums by dimension and by pair of dimensions.

Results: a NULL vector and one with a NULL, non-finite or too large entry (``|SCALE * c|`` of
2^62 or more) is left out.  Vectors of several lengths have no common matrix: the most
frequent length counts (the longest of equals) and the others are left out.  Ties and repeated rows are
rows like others.  An empty table, or one without a vector, gives an empty result.  A
component without variance (constant entries, fewer rows than dimensions) has no scale: its
``whitened`` entry is NULL, ``explained`` is 0, and ``identity_error`` leaves it out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, SHIFT = 64, 1_000_000
# entries of a block whose planes are packed and multiplied at once
BLOCK_VALUES = 1 << 19
# products are summed apart per LIMB places of two, so that 64 bits suffice inside a task
LIMB = 30
# an eigenvalue below this share of the largest, times the dimensions, is rounding
NO_VARIANCE = 1e-13


@dataclass(frozen=True)
class Fit:
    """What the fit list says: exact sums, and the components found from them."""

    n: int
    dims: int
    sums: list[int]  # of x, per dimension
    means: np.ndarray  # S / n
    values: np.ndarray  # eigenvalues of the covariance of x, falling
    vectors: np.ndarray  # dims x components, unit columns
    trace: float

    @property
    def scales(self) -> np.ndarray:
        """1 / sqrt(eigenvalue); NaN where there is no variance."""
        least = NO_VARIANCE * self.dims * (self.values[0] if len(self.values) else 0.0)
        return np.where(self.values > max(least, 0.0), 1 / np.sqrt(np.maximum(self.values, 1e-300)), np.nan)

    @property
    def explained(self) -> np.ndarray:
        return np.where(np.isnan(self.scales), 0.0, self.values / self.trace if self.trace > 0 else 0.0)


def usable(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """The rows whose vector is there and has finite entries of fitting size only."""
    limit = float(2**62) / SCALE
    return vectors.filter(F.col(column).isNotNull() & F.forall(column, lambda c: F.coalesce(F.abs(c.cast("double")) < limit, F.lit(False)) ))


def _of_length(rows: DataFrame, column: str) -> tuple[DataFrame, int]:
    lengths = rows.groupBy(F.size(column).alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if lengths is None or not lengths["d"]:
        return rows.limit(0), 0
    return rows.filter(F.size(column) == lengths["d"]), lengths["d"]


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """x of a list column: rows x dims."""
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    return (np.floor(flat * SCALE).astype(np.int64) + SHIFT).reshape(-1, dims)


def _ranges(rows: DataFrame, column: str, dims: int) -> list:
    """(dim, n, least, most, total) of x, summed per task in Python and then by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, low, high, total = 0, None, None, [0] * dims
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(0), dims)
            n += len(x)
            low = x.min(0) if low is None else np.minimum(low, x.min(0))
            high = x.max(0) if high is None else np.maximum(high, x.max(0))
            # two halves of a value: their sums fit
            upper, lower = (x >> 32).sum(0), (x & 0xFFFFFFFF).sum(0)
            total = [t + (int(u) << 32) + int(v) for t, u, v in zip(total, upper, lower)]
        if n:
            columns = [range(dims), [n] * dims, low.tolist(), high.tolist(), [t >> 62 for t in total], [t & (2**62 - 1) for t in total]]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], names=["dim", "n", "low", "high", "upper", "lower"])

    found = rows.select(column).mapInArrow(run, "dim long, n long, low long, high long, upper long, lower long")
    wide = lambda c: F.sum(F.col(c).cast("decimal(20,0)")).alias(c)
    return found.groupBy("dim").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), wide("upper"), wide("lower")).orderBy("dim").collect()


def bit_planes(y: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(planes, dimension, place): the bits of each column of ``y`` over all rows, in words.

    ``bits`` is the number of places of each column.  Rows are filled up with zeros.
    """
    n = len(y)
    dim = np.repeat(np.arange(len(bits)), bits)
    place = np.concatenate([np.arange(b) for b in bits]) if len(dim) else np.zeros(0, np.int64)
    padded = np.zeros((len(dim), -(-n // 64) * 64), np.uint8)
    if len(dim):
        padded[:, :n] = ((y.T[dim] >> place[:, None].astype(np.uint64)) & np.uint64(1)).astype(np.uint8)
    return np.packbits(padded, axis=1).view(np.uint64), dim, place


def add_products(limbs: np.ndarray, planes: np.ndarray, dim: np.ndarray, place: np.ndarray) -> None:
    """Add the cross-products of all pairs of dimensions (i <= j) to ``limbs`` (limb, i, j)."""
    for k in range(len(planes)):
        ones = np.bitwise_count(planes[k:] & planes[k]).sum(axis=1, dtype=np.int64)
        weight = place[k:] + place[k]
        # the diagonal block of one dimension holds each pair of different places twice
        ones[1:][dim[k + 1 :] == dim[k]] *= 2
        np.add.at(limbs, (weight // LIMB, dim[k], dim[k:]), ones << (weight % LIMB))


def _scatter(rows: DataFrame, column: str, dims: int, low: np.ndarray, bits: np.ndarray) -> list[list[int]]:
    """Exact sums of y_i * y_j (i <= j) with y = x - low."""
    widest = int(bits.max()) if dims else 0
    depth = max(1, -(-max(1, 2 * widest - 1) // LIMB))
    block = max(64, BLOCK_VALUES // dims // 64 * 64)
    # rows after which a task hands over its sums, so that none can overflow
    most = max(block, 2**62 // (max(1, widest) ** 2 << LIMB))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        limbs, waiting, held, seen = np.zeros((depth, dims, dims), np.int64), [], 0, 0
        upper = np.triu_indices(dims)

        def handed() -> pa.RecordBatch:
            parts = [np.tile(upper[0], depth), np.tile(upper[1], depth), np.repeat(np.arange(depth), len(upper[0])), limbs[:, upper[0], upper[1]].ravel()]
            some = parts[3] != 0
            return pa.RecordBatch.from_arrays([pa.array(c[some].astype(np.int64)) for c in parts], names=["i", "j", "limb", "total"])

        def multiply(y: np.ndarray) -> None:
            for lo in range(0, len(y), block):
                add_products(limbs, *bit_planes(y[lo : lo + block], bits))

        for batch in batches:
            waiting.append((_matrix(batch.column(0), dims) - low).view(np.uint64))
            held += batch.num_rows
            if held >= block:
                multiply(np.concatenate(waiting))
                seen, waiting, held = seen + held, [], 0
                if seen >= most:
                    yield handed()
                    limbs[:], seen = 0, 0
        if held:
            multiply(np.concatenate(waiting))
        yield handed()

    found = rows.select(column).mapInArrow(run, "i long, j long, limb long, total long")
    out = [[0] * dims for _ in range(dims)]
    for r in found.groupBy("i", "j", "limb").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect():
        out[r["i"]][r["j"]] += int(r["total"]) << (LIMB * r["limb"])
    return out


def covariance(n: int, sums: list[int], products: list[list[int]]) -> np.ndarray:
    """Covariance (divisor n) from whole sums; each entry is rounded once, at the end."""
    dims = len(sums)
    out = np.zeros((dims, dims))
    for i in range(dims):
        for j in range(i, dims):
            out[i, j] = out[j, i] = (n * products[i][j] - sums[i] * sums[j]) / (n * n)
    return out


def fit(vectors: DataFrame, column: str = "embedding", components: int = 32) -> Fit:
    """Exact mean and covariance of all usable vectors, and the leading components.

    Three passes over the column alone.  The driver gets one row per dimension and one per
    pair of dimensions, whatever the number of vectors.
    """
    rows, dims = _of_length(usable(vectors, column), column)
    if not dims:
        return Fit(0, 0, [], np.zeros(0), np.zeros(0), np.zeros((0, 0)), 0.0)
    ranges = _ranges(rows, column, dims)
    n = ranges[0]["n"]
    low = np.array([r["low"] for r in ranges], np.int64)
    bits = np.array([(r["high"] - r["low"]).bit_length() for r in ranges], np.int64)
    sums = [(int(r["upper"]) << 62) + int(r["lower"]) for r in ranges]
    products = _scatter(rows, column, dims, low, bits)
    shifted = [s - n * int(v) for s, v in zip(sums, low)]
    values, axes = np.linalg.eigh(covariance(n, shifted, products))
    order = np.argsort(-values, kind="stable")
    values = np.maximum(values[order], 0.0)
    means = np.array([s / n for s in sums])
    return Fit(n, dims, sums, means, values[:components], axes[:, order[:components]], float(values.sum()))


def _projected(x: np.ndarray, model: Fit) -> np.ndarray:
    """Whitened rows; NaN in components without variance."""
    # whole part and rest of the mean apart: x - S/n loses nothing to the size of x
    whole = np.array([s // model.n for s in model.sums], np.int64)
    rest = np.array([(s % model.n) / model.n for s in model.sums])
    return ((x - whole) - rest) @ model.vectors * model.scales


def identity_error(vectors: DataFrame, model: Fit, column: str = "embedding") -> float | None:
    """Largest absolute entry of the whitened covariance minus the identity, as measured.

    Whitened vectors are centred already; their mean, which is rounding, is taken off again.
    None where there is no vector or no variance.
    """
    live = np.flatnonzero(~np.isnan(model.scales))
    if not model.n or not len(live):
        return None
    k, dims = len(live), model.dims

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            w = _projected(_matrix(batch.column(0), dims), model)[:, live]
            first += w.sum(0)
            second += w.T @ w
        names = ["i", "j", "first", "second"]
        i, j = (c.ravel() for c in np.indices((k, k)))
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (i, j, first[i], second.ravel())], names=names)

    rows = usable(vectors, column).filter(F.size(column) == dims).select(column)
    found = rows.mapInArrow(run, "i long, j long, first double, second double").groupBy("i", "j").agg(F.sum("first").alias("first"), F.sum("second").alias("second")).collect()
    mean, cov = np.zeros(k), np.zeros((k, k))
    for r in found:
        mean[r["i"]] = r["first"] / model.n
        cov[r["i"], r["j"]] = r["second"] / model.n
    return float(np.abs(cov - np.outer(mean, mean) - np.eye(k)).max())


def whiten(vectors: DataFrame, model: Fit, column: str = "embedding") -> DataFrame:
    """Append ``whitened`` (array<double>) and ``deviation`` (decimal) to every usable row.

    ``whitened`` has one entry per component; ``deviation`` is the exact sum over dimensions
    of (n * x - S)^2 (NULL beyond 38 digits).  Columns of these names are replaced, all others
    pass through.  One pass without a shuffle.
    """
    added = ["whitened", "deviation"]
    keep = [c for c in vectors.columns if c not in added]
    rows = usable(vectors, column).filter(F.size(column) == (model.dims or -1)).select(*[vectors[c] for c in keep])
    at = keep.index(column)
    kinds = [f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in rows.schema]
    n, sums, dims = model.n, model.sums, model.dims

    def deviations(x: np.ndarray) -> pa.Array:
        # S = n * whole + rest, so n * x - S = n * (x - whole) - rest
        whole = np.array([s // n for s in sums], np.int64)
        rest = np.array([s % n for s in sums], np.int64)
        away = x - whole
        reach = (int(np.abs(away).max()) + 1) * n
        if reach * reach * dims < 2**63:
            return pa.array(((n * away - rest) ** 2).sum(1)).cast(pa.decimal128(38, 0))
        from decimal import Decimal

        exact = [sum((n * int(v) - int(r)) ** 2 for v, r in zip(row, rest)) for row in away]
        return pa.array([Decimal(v) if v < 10**38 else None for v in exact], pa.decimal128(38, 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(at), dims)
            w = _projected(x, model)
            values = pa.array(w.ravel(), from_pandas=True)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * w.shape[1], pa.int32()), values)
            yield pa.RecordBatch.from_arrays([*batch.columns, lists, deviations(x)], names=[*keep, *added])

    return rows.mapInArrow(run, ", ".join([*kinds, "whitened array<double>", "deviation decimal(38,0)"]))
