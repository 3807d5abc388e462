"""Helpers shared by the text operators: words and shingles as numpy arrays, scratch tables.

A word is a run of bytes outside space and ``\\t\\n\\v\\f\\r``; on UTF-8 text this equals the
pattern ``[^\\x20\\x09-\\x0D]+``, as those bytes never occur inside another character.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepwell.session import new_folder
from stepwell.session import prepare as prepare_session

SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

# bytes of text handled at once inside a task
BLOCK_BYTES = 1 << 20

_MULT = 0x9E3779B97F4A7C15


def prepare(spark: SparkSession) -> SparkSession:
    """The session's settings, and few rows at once to Python, as whole texts go there."""
    prepare_session(spark).conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return spark


def stored(df: DataFrame) -> DataFrame:
    """Write the rows as Parquet below the shared folder and read them back.

    Cuts lineage, so a lost executor costs no recomputation of what lies before.
    """
    path = new_folder(df.sparkSession)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._stored_path = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete tables made by ``stored`` that nothing reads any more, and old shuffle files.

    The files of a finished shuffle stay on the executors until the driver's garbage collector
    finds its plan unused, which may take half an hour: a chain of many jobs asks for it.
    """
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table._stored_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    gc.collect()
    spark._jvm.System.gc()


def n_words(text: str = "text"):
    """Number of words of a text column; NULL counts as no text."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


# --- Arrow text columns as bytes -------------------------------------------------------


def text_blocks(column: pa.Array, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a string column into blocks of whole texts of about ``most`` bytes.

    Yields (first row, row after the last, bytes, offsets into them).  NULL is an empty text.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return
    _, raw_offsets, raw_data = column.buffers()
    offsets = np.frombuffer(raw_offsets, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(raw_data, np.uint8) if raw_data else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text number) of every word; no word crosses two texts."""
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    begin = ~blank
    begin[1:] &= blank[:-1]
    cuts = offsets[:-1][np.diff(offsets) > 0]
    begin[cuts] = ~blank[cuts]
    starts = np.flatnonzero(begin)
    stop = ~blank
    stop[:-1] &= blank[1:]
    last = offsets[1:][np.diff(offsets) > 0] - 1
    stop[last] = ~blank[last]
    ends = np.flatnonzero(stop) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _tables(fold: bool) -> np.ndarray:
    codes = np.arange(256, dtype=np.uint64)
    if fold:
        codes[65:91] += np.uint64(32)
    return mix64((codes + np.uint64(1)) * np.uint64(_MULT))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    base = 0xD6E8FEB86659FD93
    inverse = pow(base, -1, 1 << 64)
    out = []
    for b in (base, inverse):
        p = np.full(n + 1, b, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = False) -> np.ndarray:
    """64-bit hash of each byte span (in order); ``fold`` hashes A-Z as a-z."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    if len(data) > 4 * BLOCK_BYTES and len(starts) > 1:
        # the running sums take many times the bytes: go on block by block
        parts, lo = [], 0
        while lo < len(starts):
            hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + BLOCK_BYTES, "right")))
            begin = starts[lo]
            parts.append(span_hashes(data[begin : ends[hi - 1]], starts[lo:hi] - begin, ends[lo:hi] - begin, fold))
            lo = hi
        return np.concatenate(parts)
    power, inverse = _powers(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_tables(fold)[data] * power[:-1], out=sums[1:])
    raw = (sums[ends] - sums[starts]) * inverse[starts]
    return mix64(raw + (ends - starts).astype(np.uint64) * np.uint64(_MULT))


def shingles(hashes: np.ndarray, owner: np.ndarray, k: int, texts: int, short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of ``k`` words and the text of each.

    With ``short``, a text with words but fewer than ``k`` has one shingle: all its words.
    """
    counts = np.bincount(owner, minlength=texts)
    n = len(hashes)
    if n < k:
        whole, of = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    else:
        whole = hashes[: n - k + 1].copy()
        for j in range(1, k):
            whole = mix64(whole) + hashes[j : n - k + 1 + j] * np.uint64(2 * j + 1)
        inside = owner[: n - k + 1] == owner[k - 1 :]
        whole, of = mix64(whole)[inside], owner[: n - k + 1][inside]
    if short:
        few = np.flatnonzero((counts > 0) & (counts < k))
        if len(few):
            first = np.concatenate([[0], np.cumsum(counts)])
            extra = np.array([_fold(hashes[first[t] : first[t + 1]]) for t in few], np.uint64)
            whole, of = np.concatenate([whole, extra]), np.concatenate([of, few])
            order = np.argsort(of, kind="stable")
            whole, of = whole[order], of[order]
    return whole, of


def _fold(hashes: np.ndarray) -> int:
    """Hash of a short word sequence, apart from the hashes of windows."""
    value = len(hashes) + 0x51
    for h in hashes.tolist():
        value = ((value ^ h) * 0xBF58476D1CE4E5B9 + 0x94D049BB133111EB) & 0xFFFFFFFFFFFFFFFF
        value ^= value >> 29
    return value


def distinct_by_text(values: np.ndarray, owner: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each text, with bounds (texts + 1) into them."""
    bounds = np.searchsorted(owner, np.arange(texts + 1))
    parts, sizes = [], np.zeros(texts, np.int64)
    for t in range(texts):
        if bounds[t] < bounds[t + 1]:
            v = np.sort(values[bounds[t] : bounds[t + 1]])
            keep = np.ones(len(v), bool)
            keep[1:] = v[1:] != v[:-1]
            v = v[keep]
            parts.append(v)
            sizes[t] = len(v)
    flat = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    return flat, np.concatenate([[0], np.cumsum(sizes)])


def permutations(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd multipliers and offsets of ``n`` universal hash functions on 64 bits."""
    rng = np.random.default_rng(seed)
    full = np.iinfo(np.uint64).max
    a = rng.integers(0, full, n, dtype=np.uint64, endpoint=True) | np.uint64(1)
    return a, rng.integers(0, full, n, dtype=np.uint64, endpoint=True)


def minhashes(values: np.ndarray, bounds: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(texts, len(a)) 32-bit minima of a*x+b (upper half) over each text's values.

    A text without values has the largest number everywhere.
    """
    texts = len(bounds) - 1
    out = np.full((texts, len(a)), 0xFFFFFFFF, np.uint32)
    filled = np.flatnonzero(np.diff(bounds) > 0)
    lo = 0
    while lo < len(filled):
        # blocks that stay in the processor's cache
        hi = max(lo + 1, int(np.searchsorted(bounds[filled], bounds[filled[lo]] + 32768, "right")) - 1)
        rows = filled[lo:hi]
        x = values[bounds[rows[0]] : bounds[rows[-1] + 1]]
        at = bounds[rows] - bounds[rows[0]]
        y = np.empty_like(x)
        for j in range(len(a)):
            np.multiply(x, a[j], out=y)
            y += b[j]
            out[rows, j] = np.minimum.reduceat(y, at) >> np.uint64(32)
        lo = hi
    return out


def take_spans(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The spans of ``data`` one after another."""
    total = int(lengths.sum())
    before = np.cumsum(lengths) - lengths
    return data[np.repeat(starts - before, lengths) + np.arange(total)]
