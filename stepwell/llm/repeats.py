"""Removal of byte strings that occur more than once, by suffix arrays of shards.

Every string of ``LENGTH`` bytes has an anchor: its smallest hashed ``GRAM``-byte piece, the
leftmost of equals.  Equal strings have equal anchors, so strings are dealt to shards by
anchor, and no repeat is missed however the corpus is split.  The strings with one anchor
occurrence are consecutive; their span is a context.  Equal contexts count as one, anchors
that occur once cannot hold a repeat.  A string reaches from its anchor at least half of the
rest of ``LENGTH`` to one side, so a context whose halves no other context of its anchor has
shares nothing, and only the contexts left go to shards.  A shard's suffix
array (``suffix_array``) with its common prefixes tells which starts share ``LENGTH`` bytes
with another.  An anchor whose contexts exceed ``HOT_BYTES`` has no shard: its strings are
counted by 128-bit hash, combined before the shuffle, so no task holds them together.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepwell.llm.forest import SMALL_IDS, _bounds, _groups, row_key
from stepwell.llm.suffix_array import common_prefixes, suffix_array
from stepwell.llm.textkit import mix64, stored, text_blocks

LENGTH, GRAM = 400, 16
SHARD_BYTES = 1 << 20
HOT_BYTES = 1 << 20
# bytes of one text that are hashed at once
PIECE = 1 << 22

BASES = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


class Sums:
    """Polynomial hashes of any span of a byte string or of 64-bit word hashes, from running sums."""

    def __init__(self, data: np.ndarray, base: int):
        n = len(data)
        if data.dtype == np.uint8:
            values = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(base))[data]
        else:
            values = mix64(data + np.uint64(base))
        power = np.full(n + 1, base, np.uint64)
        power[0] = 1
        np.multiply.accumulate(power, out=power)
        self.back = np.full(n + 1, pow(base, -1, 1 << 64), np.uint64)
        self.back[0] = 1
        np.multiply.accumulate(self.back, out=self.back)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values * power[:-1], out=self.sums[1:])

    def of(self, starts, ends):
        raw = (self.sums[ends] - self.sums[starts]) * self.back[starts]
        return mix64(raw + (ends - starts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest of every ``width`` consecutive values."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, gram: int):
    """(text, first start, starts, anchor hash, two context hashes, two halves) per anchor occurrence.

    ``data`` holds bytes, or hashes of words; ``length`` and ``gram`` count these.  The halves
    are 31-bit hashes of the anchor with half of the rest of ``length`` to its left and to its
    right, -1 where the context does not reach so far.
    """
    n = len(data)
    if n < length:
        return None
    sums, more = Sums(data, BASES[0]), Sums(data, BASES[1])
    at = np.arange(n - gram + 1)
    grams = sums.of(at, at + gram)
    # the upper 40 bits decide, then the place
    least = _sliding_least((grams >> np.uint64(24) << np.uint64(24)) | at.astype(np.uint64), length - gram + 1)
    anchor = (least & np.uint64((1 << 24) - 1)).astype(np.int64)
    sizes = np.diff(offsets)
    valid = np.zeros(n + 1, np.int64)
    long = sizes >= length
    np.add.at(valid, offsets[:-1][long], 1)
    np.add.at(valid, offsets[1:][long] - length + 1, -1)
    starts = np.flatnonzero(np.cumsum(valid[: len(anchor)]) > 0)
    if not len(starts):
        return None
    chosen = anchor[starts]
    begins = np.ones(len(starts), bool)
    begins[1:] = (chosen[1:] != chosen[:-1]) | (starts[1:] != starts[:-1] + 1)
    first = np.flatnonzero(begins)
    count = np.diff(np.append(first, len(starts)))
    s1 = starts[first]
    end = s1 + count - 1 + length
    text = np.searchsorted(offsets, s1, "right") - 1
    place = chosen[first]
    half = (length - gram + 1) // 2
    left = sums.of(np.maximum(place - half, s1), place + gram) >> np.uint64(33)
    right = sums.of(place, np.minimum(place + gram + half, end)) >> np.uint64(33)
    left = np.where(place - half >= s1, left.view(np.int64), -1)
    right = np.where(place + gram + half <= end, right.view(np.int64), -1)
    return text, s1 - offsets[text], count, grams[place], sums.of(s1, end), more.of(s1, end), left, right


def _pieces(data: np.ndarray, offsets: np.ndarray, length: int):
    """Cut a block with a very long text into overlapping pieces that share no start."""
    if len(data) <= 2 * PIECE or len(offsets) > 2:
        yield 0, data, offsets
        return
    for lo in range(0, len(data) - length + 1, PIECE):
        part = data[lo : lo + PIECE + length - 1]
        yield lo, part, np.array([0, len(part)])


_OCC = "id long, th long, s1 long, starts long, anchor long, c1 long, c2 long, l int, r int"


def _occurrences(keyed: DataFrame, length: int, gram: int) -> DataFrame:
    names = [c.split()[0] for c in _OCC.split(", ")]

    def run(batches):
        for batch in batches:
            ids, th = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
            for lo, _, data, offsets in text_blocks(batch.column(2)):
                for shift, part, bounds in _pieces(data, offsets, length):
                    found = anchors(part, bounds, length, gram)
                    if found is None:
                        continue
                    text, s1, count, anchor, c1, c2, *halves = found
                    columns = [ids[lo + text], th[lo + text], s1 + shift, count, *(h.view(np.int64) for h in (anchor, c1, c2))]
                    halves = [pa.array(h, pa.int32()) for h in halves]
                    yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns), *halves], names=names)

    return keyed.mapInArrow(run, _OCC)


_CTX = "anchor long, c1 long, c2 long, n long, starts long, bytes binary"


def _context_bytes(keyed: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The bytes of each wanted context, cut from one text that holds it."""
    lists = wanted.groupBy("rep.id", "rep.th").agg(F.collect_list(F.struct("anchor", "c1", "c2", "n", "starts", "rep.s1")).alias("cuts"))
    lists = stored(lists)
    texts = _only(keyed, lists).dropDuplicates(["id", "th"])
    names = [c.split()[0] for c in _CTX.split(", ")]

    def run(batches):
        for batch in batches:
            for text, cuts in zip(batch.column(0), batch.column(1)):
                raw = text.as_py().encode()
                out = [(*(c[k] for k in names[:5]), raw[c["s1"] : c["s1"] + c["starts"] - 1 + length]) for c in cuts.as_py()]
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in zip(*out)], names=names)

    return texts.join(lists, ["id", "th"]).select("text", "cuts").mapInArrow(run, _CTX)


def _only(keyed: DataFrame, ids: DataFrame, how: str = "left_semi") -> DataFrame:
    """Rows of the given (id, th), or with left_anti the others; small id sets are broadcast."""
    wanted = ids.select("id", "th").distinct()
    return keyed.join(F.broadcast(wanted) if wanted.count() <= SMALL_IDS else wanted, ["id", "th"], how)


_HIT = "anchor long, c1 long, c2 long, first array<int>, last array<int>"


def _runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1


def _shard_hits(contexts: DataFrame, length: int) -> DataFrame:
    """Repeated starts of every context (runs, from the context's first start)."""
    names = [c.split()[0] for c in _HIT.split(", ")]

    def judge(table: pa.Table):
        n, starts = table.column("n").to_numpy(), table.column("starts").to_numpy()
        parts = table.column("bytes").to_pylist()
        sizes = np.array([len(p) + 1 for p in parts])
        at = np.cumsum(sizes) - sizes
        text = np.frombuffer(b"\xff".join(parts) + b"\xff", np.uint8)
        order = suffix_array(text)
        shared = common_prefixes(text, order)
        allowed = np.zeros(len(text) + 1, np.int64)
        np.add.at(allowed, at, 1)
        np.add.at(allowed, at + starts, -1)
        allowed = np.cumsum(allowed[:-1]) > 0
        ranks = np.flatnonzero(allowed[order])
        repeated = np.zeros(len(text), bool)
        if len(ranks) > 1:
            # least common prefix between each allowed suffix and the one before
            least = np.minimum.reduceat(shared[: ranks[-1] + 1], ranks[:-1] + 1)
            same = least >= length
            repeated[order[ranks[1:][same]]] = True
            repeated[order[ranks[:-1][same]]] = True
        out = []
        for i in range(len(parts)):
            mask = repeated[at[i] : at[i] + starts[i]] | (n[i] > 1)
            if mask.any():
                out.append((i, *_runs(mask)))
        if out:
            rows = table.take([o[0] for o in out])
            lists = [pa.array([o[j].tolist() for o in out], pa.list_(pa.int32())) for j in (1, 2)]
            columns = [rows.column(c).combine_chunks() for c in names[:3]]
            yield pa.RecordBatch.from_arrays([*columns, *lists], names=names)

    def run(batches):
        for table in _groups(batches, 1):
            cuts = _bounds(table, 1)
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                yield from judge(table.slice(lo, hi - lo))

    dealt = contexts.repartition("shard").sortWithinPartitions("shard", "anchor", "c1", "c2")
    return dealt.select("shard", "anchor", "c1", "c2", "n", "starts", "bytes").mapInArrow(run, _HIT)


def _hot_hits(contexts: DataFrame, length: int) -> DataFrame:
    """The same for anchors without a shard: strings counted by their hash."""
    schema = "w1 long, w2 long, anchor long, c1 long, c2 long, n long, at int"
    names = [c.split()[0] for c in schema.split(", ")]

    def windows(batches):
        for batch in batches:
            for row in batch.to_pylist():
                data = np.frombuffer(row["bytes"], np.uint8)
                at = np.arange(row["starts"])
                w = [Sums(data, b).of(at, at + length).view(np.int64) for b in BASES]
                same = [np.full(len(at), row[c]) for c in ("anchor", "c1", "c2", "n")]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (*w, *same)] + [pa.array(at, pa.int32())], names=names)

    each = stored(contexts.select("anchor", "c1", "c2", "n", "starts", "bytes").mapInArrow(windows, schema))
    often = each.groupBy("w1", "w2").agg(F.sum("n").alias("times")).filter("times > 1").select("w1", "w2")
    hits = each.join(often, ["w1", "w2"], "left_semi").groupBy("anchor", "c1", "c2").agg(F.array_sort(F.collect_list("at")).alias("at"))
    return hits.select("anchor", "c1", "c2", F.col("at").alias("first"), F.col("at").alias("last"))


def with_near(contexts: DataFrame, *shared: Column) -> DataFrame:
    """The contexts with ``near``: whether one half is in a group of equals that is ``shared``."""
    for half in ("l", "r"):
        groups = contexts.filter(F.col(half) >= 0).groupBy("anchor", half).agg(*(c.alias(f"s{i}") for i, c in enumerate(shared)))
        groups = groups.filter(" AND ".join(f"s{i}" for i in range(len(shared)))).select("anchor", half, F.lit(True).alias(f"near_{half}"))
        contexts = contexts.join(groups, ["anchor", half], "left")
    near = F.coalesce("near_l", F.lit(False)) | F.coalesce("near_r", F.lit(False))
    return stored(contexts.withColumn("near", near).drop("near_l", "near_r"))


def repeated_spans(keyed: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(id, th, spans): byte ranges of each text of (id, th, text) that occur elsewhere.

    ``spans`` holds (lo, hi) pairs, which may overlap.  Texts without any are left out.
    """
    occ = stored(_occurrences(keyed, length, gram))
    # stored, so that the join deals both sides itself and a frequent anchor is split
    often = stored(occ.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1").select("anchor"))
    occ = stored(occ.join(often, "anchor", "left_semi"))
    place = F.min(F.struct("id", "th", "s1")).alias("rep")
    once = [F.first(c).alias(c) for c in ("starts", "l", "r")]
    contexts = stored(occ.groupBy("anchor", "c1", "c2").agg(F.count("*").alias("n"), *once, place))
    # a context that occurs twice is settled by that, one that is alone with its halves as well
    near = with_near(contexts, F.sum("n") > F.max("n"), F.min("n") == 1)
    alone = near.filter("NOT near AND n > 1").select("anchor", "c1", "c2", F.array(F.lit(0)).alias("first"), F.array((F.col("starts") - 1).cast("int")).alias("last"))
    several = near.filter("near")
    sizes = stored(several.groupBy("anchor").agg(F.sum(F.col("starts") + length).alias("size")))
    total = sizes.filter(F.col("size") <= HOT_BYTES).agg(F.sum("size")).first()[0] or 0
    shards = max(1, -(-total // SHARD_BYTES))
    bodies = stored(
        _context_bytes(keyed, several, length)
        .join(sizes.select("anchor", (F.col("size") > HOT_BYTES).alias("hot")), "anchor")
        .withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards)))
    )
    hits = _shard_hits(bodies.filter("NOT hot"), length).union(alone)
    hot = bodies.filter("hot")
    if not hot.isEmpty():
        hits = hits.union(_hot_hits(hot, length))
    hits = stored(hits)
    runs = F.explode(F.arrays_zip(F.col("first").alias("a"), F.col("last").alias("b")))
    spans = occ.join(hits, ["anchor", "c1", "c2"]).select("id", "th", "s1", runs.alias("r"))
    span = F.struct((F.col("s1") + F.col("r.a")).alias("lo"), (F.col("s1") + F.col("r.b") + length).alias("hi"))
    return spans.select("id", "th", span.alias("s")).groupBy("id", "th").agg(F.collect_list("s").alias("spans"))


def cut(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Per row: key, n_bytes, n_removed, n_spans, ``kept``, the bytes that remain, and row_id.

    Each byte covered by a string of ``length`` bytes that also starts anywhere else goes;
    strings are judged on the input and never cross texts.  A span is a maximal run of
    removed bytes.  NULL and empty texts have no bytes; a text below ``length`` bytes loses
    none.  Repeated rows repeat each other's strings.  A removed run may end inside a
    character, so ``kept`` is binary.  NULL keys stay NULL; their ``row_id`` is a number made
    from the text, that of the others is the key.  Only key and text are read.  An empty
    table gives an empty result.  ``gram`` is at most ``length``.
    """
    th = F.xxhash64("text")
    keyed = docs.select(row_key(docs[key], docs[text]).alias("id"), docs[key].cast("long").alias("key"), F.coalesce(docs[text], F.lit("")).alias("text")).withColumn("th", th)
    spans = stored(repeated_spans(keyed.select("id", "th", "text"), length, gram))
    names = ["key", "n_bytes", "n_removed", "n_spans", "kept", "row_id"]

    def run(batches):
        for batch in batches:
            out = []
            for k, t, s, i in zip(*batch.columns):
                data = np.frombuffer(t.as_py().encode(), np.uint8)
                lo = s.values.field("lo").to_numpy()
                hi = s.values.field("hi").to_numpy()
                marks = np.zeros(len(data) + 1, np.int64)
                np.add.at(marks, lo, 1)
                np.add.at(marks, hi, -1)
                gone = np.cumsum(marks[:-1]) > 0
                first, _ = _runs(gone)
                out.append((k.as_py(), len(data), int(gone.sum()), len(first), data[~gone].tobytes(), i.as_py()))
            if out:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(v, kind) for v, kind in zip(zip(*out), kinds)], names=names)

    touched = _only(keyed, spans).join(spans, ["id", "th"]).select("key", "text", "spans", "id")
    changed = touched.mapInArrow(run, "key long, n_bytes long, n_removed long, n_spans long, kept binary, row_id long")
    zero = F.lit(0).cast("long")
    whole = _only(keyed, spans, "left_anti").select(
        "key", F.octet_length("text").cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.col("text").cast("binary").alias("kept"), F.col("id").alias("row_id")
    )
    return changed.union(whole).withColumnRenamed("key", key)
