"""Weak-label quality classifier.

Overlapping heuristic labellers vote good, bad or nothing on every document.  The corpus is
reduced to counts of vote patterns (at most ``3 ** labellers`` rows), and expectation
maximisation estimates from them how often each labeller is right about good and about bad
documents; nobody has to label anything.  The posteriors of a bounded sample of documents
train a linear scorer on hashed word shapes, and the scorer judges every document.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepwell.llm.textkit import mix64, shingles, span_hashes, text_blocks, word_spans

GOOD, BAD, SILENT = 1, 0, 2

# (name, votes bad from, votes good up to) on a share between 0 and 1; between them silent
SHARE_RULES = (
    ("symbol_words", 0.10, 0.02),
    ("upper_letters", 0.50, 0.20),
    ("exclaimed_words", 0.20, 0.02),
    ("odd_word_ends", 0.30, 0.05),
    ("stutter_words", 0.20, 0.05),
    ("repeated_windows", 0.50, 0.20),
    ("lone_symbols", 0.15, 0.02),
)
# words below which a text is voted bad, and from which it is voted good
SHORT_WORDS, ENOUGH_WORDS = 3, 8
LABELLERS = (*(name for name, _, _ in SHARE_RULES), "length")

SHAPE_BUCKETS = 1 << 12


@dataclass(frozen=True)
class Model:
    """Labeller accuracies (labellers, class, vote), share of good ones, and the scorer."""

    prior: float
    votes: np.ndarray
    weights: np.ndarray
    bias: float


def _shares(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, dict]:
    """Per text: the shares the rules look at, and the number of words; plus what words are."""
    texts = len(offsets) - 1
    starts, ends, owner = word_spans(data, offsets)
    n = np.bincount(owner, minlength=texts)
    word = span_hashes(data, starts, ends)
    is_symbol = np.isin(data, np.frombuffer(b"#*$%&|<>", np.uint8))
    symbols = np.concatenate([[0], np.cumsum(is_symbol)])
    with_symbol = symbols[ends] > symbols[starts]
    lone = with_symbol & (symbols[ends] - symbols[starts] == ends - starts)
    last = data[ends - 1] if len(ends) else np.zeros(0, np.uint8)
    letter_or_digit = ((last | 32) >= 97) & ((last | 32) <= 122) | (last >= 48) & (last <= 57) | (last >= 128)
    odd = ~letter_or_digit & ~np.isin(last, np.frombuffer(b".,;:?!'\")]", np.uint8))
    upper = np.concatenate([[0], np.cumsum((data >= 65) & (data <= 90))])
    lower = np.concatenate([[0], np.cumsum((data >= 97) & (data <= 122))])
    stutter = np.zeros(len(word), bool)
    stutter[1:] = (word[1:] == word[:-1]) & (owner[1:] == owner[:-1])
    windows, of = shingles(word, owner, 3, texts, short=False)
    again = np.zeros(len(windows), bool)
    if len(windows):
        tagged = mix64(windows + of.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(tagged, kind="stable")
        again[order[1:]] = tagged[order[1:]] == tagged[order[:-1]]
    per = lambda mask, at=owner: np.bincount(at, weights=mask, minlength=texts)
    u, low = upper[offsets[1:]] - upper[offsets[:-1]], lower[offsets[1:]] - lower[offsets[:-1]]
    some = np.maximum(n, 1)
    shares = np.stack(
        [
            per(with_symbol) / some,
            u / np.maximum(u + low, 1),
            per(last == 33) / some,
            per(odd) / some,
            per(stutter) / some,
            per(again, of) / np.maximum(n - 2, 1),
            per(lone) / some,
        ],
        axis=1,
    )
    return shares, n, {"starts": starts, "ends": ends, "owner": owner, "stutter": stutter, "again": again, "again_of": of}


def _votes(shares: np.ndarray, n: np.ndarray) -> np.ndarray:
    """(texts, labellers) votes; share rules are silent on texts without words."""
    out = np.full((len(n), len(LABELLERS)), SILENT, np.int8)
    for j, (_, bad, good) in enumerate(SHARE_RULES):
        out[shares[:, j] >= bad, j] = BAD
        out[shares[:, j] <= good, j] = GOOD
    out[n == 0] = SILENT
    out[n < SHORT_WORDS, -1] = BAD
    out[n >= ENOUGH_WORDS, -1] = GOOD
    return out


def _pattern(votes: np.ndarray) -> np.ndarray:
    return votes.astype(np.int64) @ 3 ** np.arange(votes.shape[1])


def _unpack(patterns: np.ndarray) -> np.ndarray:
    return patterns[:, None] // 3 ** np.arange(len(LABELLERS)) % 3


def _features(data: np.ndarray, offsets: np.ndarray, n: np.ndarray, words: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed shape features as (text, bucket, value); the values of a text have length 1.

    A word's shape keeps its marks and turns letters into one of two classes and digits into
    one, runs shortened; features are shapes, pairs of shapes, and repetition.
    """
    texts = len(offsets) - 1
    classes = data.copy()
    classes[(data >= 97) & (data <= 122) | (data >= 128)] = 97
    classes[(data >= 65) & (data <= 90)] = 65
    classes[(data >= 48) & (data <= 57)] = 48
    keep = np.ones(len(data), bool)
    keep[1:] = classes[1:] != classes[:-1]
    keep[words["starts"]] = True
    short = classes[keep]
    place = np.concatenate([[0], np.cumsum(keep)])
    starts, ends, owner = place[words["starts"]], place[words["ends"]], words["owner"]
    shape = span_hashes(short, starts, ends)
    pair, pair_of = shingles(shape, owner, 2, texts, short=False)
    marks = [
        (owner, shape),
        (pair_of, pair),
        (owner[words["stutter"]], np.full(int(words["stutter"].sum()), 11, np.uint64)),
        (words["again_of"][words["again"]], np.full(int(words["again"].sum()), 13, np.uint64)),
    ]
    of = np.concatenate([m[0] for m in marks])
    bucket = (mix64(np.concatenate([m[1] for m in marks])) % np.uint64(SHAPE_BUCKETS - 8)).astype(np.int64)
    key, count = np.unique(of * SHAPE_BUCKETS + bucket, return_counts=True)
    row, bucket = key // SHAPE_BUCKETS, key % SHAPE_BUCKETS
    value = np.sqrt(count / np.maximum(n[row], 1))
    # a length feature in the last buckets
    size = np.minimum(np.log2(n + 1).astype(np.int64), 7)
    row, bucket = np.concatenate([row, np.arange(texts)]), np.concatenate([bucket, SHAPE_BUCKETS - 8 + size])
    value = np.concatenate([value, np.full(texts, 0.2)])
    norm = np.sqrt(np.bincount(row, weights=value**2, minlength=texts))
    return row, bucket, value / norm[row]


def _map(docs: DataFrame, text: str, fn: Callable, schema: str) -> DataFrame:
    """Apply ``fn`` (columns before text, bytes, offsets) to blocks of whole texts."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in text_blocks(batch.column(batch.num_columns - 1)):
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays(fn(part.columns[:-1], data, offsets), names=names)

    return docs.mapInArrow(run, schema)


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[float, np.ndarray]:
    """Expectation maximisation over counted vote patterns: (share of good, accuracies).

    Starts from the share of good votes in each pattern; accuracies are smoothed by one
    pseudo-count per vote, so a labeller that never speaks changes nothing.
    """
    votes = _unpack(patterns)
    good, bad = (votes == GOOD).sum(1), (votes == BAD).sum(1)
    # a bad vote outweighs good ones: rules are silent about what they do not cover
    post = np.where(bad > 0, 0.2 * good / np.maximum(good + bad, 1), 0.9)
    table = np.full((len(LABELLERS), 2, 3), 1 / 3)
    prior = 0.5
    for _ in range(rounds if len(patterns) else 0):
        for c, weight in ((GOOD, post * counts), (BAD, (1 - post) * counts)):
            for v in range(3):
                table[:, c, v] = (weight @ (votes == v) + 1) / (weight.sum() + 3)
        prior = float(np.clip((post @ counts + 1) / (counts.sum() + 2), 1e-6, 1 - 1e-6))
        new = posterior(patterns, prior, table)
        if np.abs(new - post).max() < 1e-9:
            break
        post = new
    return prior, table


def posterior(patterns: np.ndarray, prior: float, table: np.ndarray) -> np.ndarray:
    """Chance that documents with these vote patterns are good."""
    votes = _unpack(patterns)
    log = np.zeros((len(patterns), 2)) + np.log([1 - prior, prior])
    for j in range(len(LABELLERS)):
        log += np.log(table[j][:, votes[:, j]]).T
    return 1 / (1 + np.exp(np.clip(log[:, BAD] - log[:, GOOD], -60, 60)))


def train(row: np.ndarray, bucket: np.ndarray, value: np.ndarray, target: np.ndarray, rounds: int = 250) -> tuple[np.ndarray, float]:
    """Logistic weights for soft targets; both classes weigh alike.  Adam on the whole sample."""
    n = len(target)
    weights, bias = np.zeros(SHAPE_BUCKETS), 0.0
    if not n:
        return weights, bias
    good = max(target.sum(), 1e-9)
    balance = target * (n / 2 / good) + (1 - target) * (n / 2 / max(n - good, 1e-9))
    balance = np.minimum(balance, 50)
    m, v = np.zeros(SHAPE_BUCKETS + 1), np.zeros(SHAPE_BUCKETS + 1)
    for step in range(1, rounds + 1):
        score = np.bincount(row, weights=weights[bucket] * value, minlength=n) + bias
        error = (1 / (1 + np.exp(-score)) - target) * balance / n
        slope = np.append(np.bincount(bucket, weights=error[row] * value, minlength=SHAPE_BUCKETS) + 1e-5 * weights, error.sum())
        m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope**2
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
        weights, bias = weights - move[:-1], bias - move[-1]
    return weights, float(bias)


def fit(docs: DataFrame, text: str = "text", key: str = "doc_id", sample: int = 8000) -> Model:
    """Vote counts over all documents, accuracies by EM, and a scorer from ``sample`` documents.

    ``sample`` bounds the rows that reach the driver; they are those with the smallest
    hash of key and text, so the choice depends on the data alone.
    """

    def patterns(_, data, offsets):
        shares, n, _ = _shares(data, offsets)
        return [pa.array(_pattern(_votes(shares, n)))]

    counted = _map(docs.select(text), text, patterns, "pattern long").groupBy("pattern").count().toPandas().sort_values("pattern")
    counts = counted["count"].to_numpy(np.float64)
    total = counts.sum()
    prior, table = estimate(counted["pattern"].to_numpy(), counts)

    def rows(columns, data, offsets):
        shares, n, words = _shares(data, offsets)
        row, bucket, value = _features(data, offsets, n, words)
        order = np.argsort(row, kind="stable")
        cuts = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(n)))]).astype(np.int32)
        lists = [pa.ListArray.from_arrays(pa.array(cuts), pa.array(x[order], t)) for x, t in ((bucket, pa.int32()), (value, pa.float32()))]
        return [columns[0], pa.array(_pattern(_votes(shares, n))), *lists]

    draw = F.xxhash64(F.col(key).cast("string"), F.xxhash64(text))
    picked = docs.select(draw.alias("_draw"), F.col(text))
    if total > sample:
        # keep a little more than the bound before the exact cut
        share = min(1.0, 1.2 * sample / total)
        picked = picked.filter(F.col("_draw") < F.lit(int(-(2**63) + share * 2**64) if share < 1 else 2**63 - 1))
    schema = "_draw long, pattern long, bucket array<int>, value array<float>"
    chosen = _map(picked, text, rows, schema).orderBy("_draw").limit(sample).toArrow()
    if not chosen.num_rows:
        return Model(prior, table, np.zeros(SHAPE_BUCKETS), 0.0)
    target = posterior(chosen.column("pattern").to_numpy(), prior, table)
    bucket, value = (chosen.column(c).combine_chunks() for c in ("bucket", "value"))
    row = np.repeat(np.arange(chosen.num_rows), np.diff(bucket.offsets.to_numpy()))
    bucket, value = bucket.flatten().to_numpy(), value.flatten().to_numpy().astype(np.float64)
    weights, bias = train(row, bucket, value, target)
    return Model(prior, table, weights, bias)


def classify(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """Append ``pattern`` (votes, base 3), ``posterior``, ``score`` and ``kept`` to every row.

    ``kept`` is ``score >= threshold``.  NULL, empty and blank texts count as texts without
    words: share rules are silent, the length rule votes bad.  Columns named like an added
    one are replaced, all others pass through; repeated rows get equal verdicts.
    """
    added = ("pattern", "posterior", "score", "kept")
    keep = [c for c in docs.columns if c not in added]
    whole = docs.select(F.struct(*[docs[c] for c in keep]).alias("_row"), docs[text].alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in text_blocks(batch.column(1)):
                shares, n, words = _shares(data, offsets)
                pattern = _pattern(_votes(shares, n))
                row, bucket, value = _features(data, offsets, n, words)
                raw = np.bincount(row, weights=model.weights[bucket] * value, minlength=len(n)) + model.bias
                score = 1 / (1 + np.exp(-raw))
                new = [pattern, posterior(pattern, model.prior, model.votes), score, score >= threshold]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *map(pa.array, new)], names=["_row", *added])

    schema = f"_row {whole.schema['_row'].dataType.simpleString()}, pattern long, posterior double, score double, kept boolean"
    found = whole.mapInArrow(run, schema)
    return found.select(*[F.col("_row").getField(c).alias(c) for c in keep], *added)


def judge(docs: DataFrame, text: str = "text", key: str = "doc_id", sample: int = 8000, threshold: float = 0.5) -> DataFrame:
    """Fit on ``docs`` and classify all of it.  An empty table gives an empty result."""
    return classify(docs, fit(docs, text, key, sample), text, threshold)
