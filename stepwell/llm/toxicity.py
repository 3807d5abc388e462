"""Toxicity by a bidirectional gated recurrent network with attention pooling, in numpy.

A word enters as a hashed word vector and the mean of its hashed character-trigram vectors.
Two recurrent layers read a window of words from both ends, attention pools their states,
and a logistic unit scores the window.  Windows overlap by half and cover the whole text;
a document scores as its worst window.  Training sees a bounded sample of labelled rows:
rounds of choosing each document's worst window so far and learning from it, the first
choice being made by smoothed log odds of words, which also start one word dimension.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepwell.llm.textkit import mix64, span_hashes, take_spans, text_blocks, word_spans

WORD_BUCKETS, CHAR_BUCKETS = 1 << 13, 1 << 12
WORD_DIM, CHAR_DIM, HIDDEN, ATTEND = 8, 6, 8, 6
WINDOW, STRIDE = 32, 16
# learning rates: a rare word must not move far by the few rows that hold it
RATES = {"word": 0.0003, "char": 0.0005}
# windows that go through the network together
LOT = 4096


class Words:
    """The distinct words of a block of texts, and the texts as numbers of them."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        texts = len(offsets) - 1
        low = data + 32 * ((data >= 65) & (data <= 90)).astype(np.uint8)
        starts, ends, owner = word_spans(data, offsets)
        plain = ((low >= 97) & (low <= 122)) | ((low >= 48) & (low <= 57)) | (low >= 128)
        for _ in range(4):  # marks around a word do not belong to it
            starts = starts + (~plain[starts] & (starts < ends - 1))
            ends = ends - (~plain[ends - 1] & (ends - 1 > starts))
        hashes = span_hashes(low, starts, ends)
        distinct, at, self.word = np.unique(hashes, return_index=True, return_inverse=True)
        self.bucket = (distinct % np.uint64(WORD_BUCKETS)).astype(np.int64)
        size = ends[at] - starts[at]
        # each word with a blank on both sides; a trigram starts at every byte but the last two
        line = np.full(int((size + 2).sum()), 32, np.uint8)
        first = np.cumsum(size + 2) - (size + 2)
        place = np.repeat(first + 1 - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        line[place] = take_spans(low, starts[at], size)
        begin = place - 1
        code = line[begin].astype(np.uint64) | line[begin + 1].astype(np.uint64) << np.uint64(8) | line[begin + 2].astype(np.uint64) << np.uint64(16)
        self.trigram = (mix64(code) % np.uint64(CHAR_BUCKETS)).astype(np.int64)
        self.trigram_at = np.cumsum(size) - size
        self.trigrams = size
        self.counts = np.bincount(owner, minlength=texts)

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """(windows, WINDOW) word numbers, -1 for none, and the text of each window."""
        n = self.counts
        each = np.maximum(1, -(-(n - STRIDE) // STRIDE))
        text = np.repeat(np.arange(len(n)), each)
        turn = np.arange(len(text)) - np.repeat(np.cumsum(each) - each, each)
        first = np.cumsum(n) - n
        place = turn[:, None] * STRIDE + np.arange(WINDOW)
        inside = place < n[text][:, None]
        index = np.where(inside, first[text][:, None] + place, 0)
        padded = np.append(self.word, 0)
        return np.where(inside, padded[index], -1), text


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Network:
    """Parameters, the forward pass and its gradient."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        inputs = WORD_DIM + CHAR_DIM
        draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.p = {
            "word": (rng.standard_normal((WORD_BUCKETS, WORD_DIM)) * 0.05).astype(np.float32),
            "char": (rng.standard_normal((CHAR_BUCKETS, CHAR_DIM)) * 0.1).astype(np.float32),
            "attend": draw(2 * HIDDEN, ATTEND),
            "attend_b": np.zeros(ATTEND, np.float32),
            "query": draw(ATTEND),
            "out": draw(2 * HIDDEN),
            "bias": np.full(1, -1, np.float32),
        }
        for side in "fb":
            self.p |= {f"x{side}": draw(inputs, 3 * HIDDEN), f"b{side}": np.zeros(3 * HIDDEN, np.float32), f"u{side}": draw(HIDDEN, 3 * HIDDEN)}

    def inputs(self, words: Words) -> np.ndarray:
        """Input vector of every distinct word."""
        sums = np.add.reduceat(self.p["char"][words.trigram], words.trigram_at, axis=0) if len(words.trigram) else np.zeros((0, CHAR_DIM), np.float32)
        return np.concatenate([self.p["word"][words.bucket], sums / np.maximum(words.trigrams, 1)[:, None]], axis=1).astype(np.float32)

    def _layer(self, side: str, gates: np.ndarray, keep: list | None) -> np.ndarray:
        """States (WINDOW, lot, HIDDEN) of one direction; ``gates`` in reading order."""
        u = self.p[f"u{side}"]
        h = np.zeros((gates.shape[1], HIDDEN), np.float32)
        out = np.empty((gates.shape[0], gates.shape[1], HIDDEN), np.float32)
        for t in range(gates.shape[0]):
            a = h @ u
            zr = _sigmoid(gates[t, :, : 2 * HIDDEN] + a[:, : 2 * HIDDEN])
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            n = np.tanh(gates[t, :, 2 * HIDDEN :] + r * a[:, 2 * HIDDEN :])
            new = n + z * (h - n)
            if keep is not None:
                keep.append((h, z, r, n, a[:, 2 * HIDDEN :]))
            h = out[t] = new
        return out

    def forward(self, x: np.ndarray, windows: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Log odds of each window; ``x`` are the inputs of the distinct words."""
        order = windows.T
        both = []
        for side in "fb":
            # the last row stands for no word
            gates = np.append(x @ self.p[f"x{side}"], np.zeros((1, 3 * HIDDEN), np.float32), axis=0) + self.p[f"b{side}"]
            steps = order if side == "f" else order[::-1]
            tape = [] if keep is not None else None
            states = self._layer(side, gates[steps], tape)
            both.append(states if side == "f" else states[::-1])
            if keep is not None:
                keep[side] = tape
        h = np.concatenate(both, axis=2)
        mood = np.tanh(h @ self.p["attend"] + self.p["attend_b"])
        e = mood @ self.p["query"]
        e = np.where(order >= 0, e, -1e9)
        e = np.exp(e - e.max(axis=0))
        e = np.where(order >= 0, e, 0)
        weight = e / np.maximum(e.sum(axis=0), 1e-9)
        pooled = (weight[:, :, None] * h).sum(axis=0)
        if keep is not None:
            keep |= {"h": h, "mood": mood, "weight": weight, "pooled": pooled}
        return pooled @ self.p["out"] + self.p["bias"][0]

    def gradient(self, x: np.ndarray, windows: np.ndarray, target: np.ndarray) -> tuple[dict, np.ndarray]:
        """Gradients of the mean logistic loss by parameter, and by distinct word input."""
        tape: dict = {}
        log_odds = self.forward(x, windows, tape)
        order = windows.T
        d = (_sigmoid(log_odds) - target).astype(np.float32) / len(target)
        g = {"bias": np.array([d.sum()], np.float32), "out": tape["pooled"].T @ d}
        pooled = d[:, None] * self.p["out"]
        h, weight, mood = tape["h"], tape["weight"], tape["mood"]
        dh = weight[:, :, None] * pooled
        dw = (h * pooled).sum(axis=2)
        de = weight * (dw - (weight * dw).sum(axis=0))
        g["query"] = np.einsum("tb,tba->a", de, mood)
        dm = de[:, :, None] * self.p["query"] * (1 - mood**2)
        g["attend"], g["attend_b"] = np.einsum("tbh,tba->ha", h, dm), dm.sum(axis=(0, 1))
        dh = dh + dm @ self.p["attend"].T
        dx = np.zeros((len(x) + 1, x.shape[1]), np.float32)
        for side, part in (("f", dh[:, :, :HIDDEN]), ("b", dh[::-1, :, HIDDEN:])):
            u = self.p[f"u{side}"]
            gu, carry = np.zeros_like(u), np.zeros_like(part[0])
            dg = np.empty((len(part), part.shape[1], 3 * HIDDEN), np.float32)
            for t in range(len(part) - 1, -1, -1):
                before, z, r, n, a = tape[side][t]
                total = part[t] + carry
                dn = total * (1 - z) * (1 - n**2)
                dz = total * (before - n) * z * (1 - z)
                dr = dn * a * r * (1 - r)
                dg[t] = np.concatenate([dz, dr, dn], axis=1)
                da = np.concatenate([dz, dr, dn * r], axis=1)
                gu += before.T @ da
                carry = total * z + da @ u.T
            steps = (order if side == "f" else order[::-1]).ravel()
            flat = dg.reshape(-1, 3 * HIDDEN)
            per_word = np.zeros((len(x) + 1, 3 * HIDDEN), np.float32)
            np.add.at(per_word, steps, flat)
            g[f"u{side}"], g[f"b{side}"] = gu, flat.sum(axis=0)
            g[f"x{side}"] = x.T @ per_word[:-1]
            dx[:-1] += per_word[:-1] @ self.p[f"x{side}"].T
        return g, dx[:-1]

    def score(self, words: Words) -> np.ndarray:
        """Probability of each text: that of its worst window."""
        x = self.inputs(words)
        windows, text = words.windows()
        odds = np.concatenate([self.forward(x, windows[i : i + LOT]) for i in range(0, len(windows), LOT)])
        worst = np.maximum.reduceat(odds, np.searchsorted(text, np.arange(len(words.counts))))
        return _sigmoid(worst.astype(np.float64))

    def worst(self, words: Words) -> np.ndarray:
        """The worst window of each text."""
        x = self.inputs(words)
        windows, text = words.windows()
        odds = np.concatenate([self.forward(x, windows[i : i + LOT]) for i in range(0, len(windows), LOT)])
        return _pick(odds, windows, text)


def _pick(value: np.ndarray, windows: np.ndarray, text: np.ndarray) -> np.ndarray:
    order = np.lexsort((-value, text))
    first = np.ones(len(order), bool)
    first[1:] = text[order[1:]] != text[order[:-1]]
    return windows[order[first]]


def train(texts: list[str], labels: np.ndarray, rounds: int = 4, passes: int = 4, lot: int = 64, dropped: float = 0.15, seed: int = 5) -> Network:
    """Fit the network on whole labelled texts."""
    net = Network(seed)
    if not len(texts) or labels.min() == labels.max():
        net.p["bias"][:] = -4 if not len(texts) or labels.max() == 0 else 4
        net.p["out"][:] = 0
        return net
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    words = Words(data, np.concatenate([[0], np.cumsum([len(r) for r in raw])]))
    target = labels.astype(np.float32)
    # in how many texts of each class a word bucket occurs
    owner = np.repeat(np.arange(len(texts)), words.counts)
    pair = np.unique(words.bucket[words.word] * len(texts) + owner)
    bucket, of = pair // len(texts), pair % len(texts)
    counts = [np.bincount(bucket[target[of] == c], minlength=WORD_BUCKETS) for c in (0, 1)]
    sizes = [(target == c).sum() for c in (0, 1)]
    odds = np.log((counts[1] + 0.5) / (sizes[1] + 1)) - np.log((counts[0] + 0.5) / (sizes[0] + 1))
    # words seen a few times say nothing yet
    odds *= (counts[0] + counts[1]) / (counts[0] + counts[1] + 10)
    net.p["word"][:, 0] = 2 * odds
    windows, text = words.windows()
    padded = np.append(odds[words.bucket], 0)
    chosen = _pick(padded[windows].max(axis=1), windows, text)
    rng = np.random.default_rng(seed)
    first = {k: np.zeros_like(v) for k, v in net.p.items()}
    second = {k: np.zeros_like(v) for k, v in net.p.items()}
    start = {k: net.p[k].copy() for k in ("word", "char")}
    step, decay = 0, np.float32(2e-4)
    for turn in range(rounds):
        if turn:
            chosen = net.worst(words)
        for _ in range(passes):
            order = rng.permutation(len(texts))
            for i in range(0, len(order), lot):
                rows = order[i : i + lot]
                # words dropped at random: no document is known by its rare words alone
                part = np.where(rng.random((len(rows), WINDOW)) < dropped, -1, chosen[rows])
                used, local = np.unique(part, return_inverse=True)
                local = local.reshape(part.shape) - (used[0] == -1)
                used = used[used >= 0]
                if not len(used):
                    continue
                sub = _Subset(words, used)
                x = net.inputs(sub)
                g, dx = net.gradient(x, local, target[rows])
                g["word"] = np.zeros_like(net.p["word"])
                np.add.at(g["word"], sub.bucket, dx[:, :WORD_DIM])
                g["char"] = np.zeros_like(net.p["char"])
                share = dx[:, WORD_DIM:] / np.maximum(sub.trigrams, 1)[:, None]
                np.add.at(g["char"], sub.trigram, np.repeat(share, sub.trigrams, axis=0))
                step += 1
                for k in ("word", "char"):
                    g[k] += decay * (net.p[k] - start[k])
                for k, v in g.items():
                    first[k] = 0.9 * first[k] + 0.1 * v
                    second[k] = 0.99 * second[k] + 0.01 * v * v
                    move = (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)
                    net.p[k] -= np.float32(RATES.get(k, 0.01)) * move.astype(np.float32)
    return net


class _Subset(Words):
    """Some of the distinct words of a block."""

    def __init__(self, words: Words, used: np.ndarray):
        self.bucket = words.bucket[used]
        self.trigrams = words.trigrams[used]
        self.trigram = take_spans(words.trigram, words.trigram_at[used], self.trigrams)
        self.trigram_at = np.cumsum(self.trigrams) - self.trigrams


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = 4000) -> Network:
    """Train on at most ``sample`` labelled documents, as many of either class where there are.

    The rows are those with the smallest hash of the key among the given labels.  Labels
    without a key or value, and labels of absent documents, are left out.
    """
    draw = F.xxhash64(F.col(key).cast("string"), F.lit("toxicity"))
    known = labels.select(key, F.col(label).cast("int").alias("_y"), draw.alias("_draw")).filter(F.col(key).isNotNull() & F.col("_y").isin(0, 1))
    sizes = {r["_y"]: r["n"] for r in known.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    picked = None
    for y, n in sorted(sizes.items()):
        share = min(1.0, 1.5 * (sample // 2) / n)
        own = known.filter(F.col("_y") == y)
        if share < 1:
            own = own.filter(F.col("_draw") < F.lit(int(-(2**63) + share * 2**64)))
        own = own.orderBy("_draw").limit(sample // 2)
        picked = own if picked is None else picked.union(own)
    if picked is None:
        return train([], np.zeros(0))
    # at most ``sample`` rows
    rows = docs.select(key, F.coalesce(text, F.lit("")).alias("_text")).join(F.broadcast(picked), key).orderBy("_draw", "_text").limit(sample).toArrow()
    return train(rows.column("_text").to_pylist(), rows.column("_y").to_numpy())


def score(docs: DataFrame, net: Network, text: str = "text") -> DataFrame:
    """Append ``score`` (0 to 1) to every row; a column of that name is replaced.

    All windows of the whole text are scored.  NULL, empty and blank texts have one window
    without words.  Equal texts score alike; an empty table gives an empty result.
    """
    keep = [c for c in docs.columns if c != "score"]
    whole = docs.select(F.struct(*[docs[c] for c in keep]).alias("_row"), docs[text].alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in text_blocks(batch.column(1), 1 << 19):
                found = net.score(Words(data, offsets))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(found)], names=["_row", "score"])

    schema = f"_row {whole.schema['_row'].dataType.simpleString()}, score double"
    return whole.mapInArrow(run, schema).select(*[F.col("_row").getField(c).alias(c) for c in keep], "score")
