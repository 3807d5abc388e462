"""Texts that share a passage of many words with another one, however few bytes it has.

Every passage of ``WORDS`` words has an anchor, as the byte strings of ``repeats`` have: its
smallest hashed piece of ``GRAM`` words, the leftmost of equals.  Equal passages have equal
anchors, and the passages with one anchor occurrence are consecutive; their span is a context.
A text with a context that another text has as well is settled by that.  For the few that are
left, with half of a context in common, the passages themselves are compared.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepwell.llm.forest import SMALL_IDS, row_key
from stepwell.llm.repeats import BASES, Sums, anchors, with_near
from stepwell.llm.textkit import span_hashes, stored, text_blocks, word_spans

WORDS, GRAM = 51, 8
# words of one text that are handled at once
SLICE = 1 << 20


def _slices(column: pa.Array, length: int):
    """(first text, hashes of words, bounds of the texts among them) per block of texts.

    A very long text comes in overlapping slices that share no passage.
    """
    for lo, hi, data, offsets in text_blocks(column):
        starts, ends, owner = word_spans(data, offsets)
        words = span_hashes(data, starts, ends)
        if hi - lo > 1 or len(words) <= 2 * SLICE:
            yield lo, words, np.searchsorted(owner, np.arange(hi - lo + 1))
            continue
        for at in range(0, len(words) - length + 1, SLICE):
            part = words[at : at + SLICE + length - 1]
            yield lo, part, np.array([0, len(part)])


def _occurrences(keyed: DataFrame, length: int, gram: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for lo, words, bounds in _slices(batch.column(1), length):
                found = anchors(words, bounds, length, gram)
                if found is not None:
                    text, _, _, anchor, c, _, *halves = found
                    columns = [ids[lo + text], anchor.view(np.int64), c.view(np.int64)]
                    columns = [pa.array(x, pa.int64()) for x in columns] + [pa.array(h, pa.int32()) for h in halves]
                    yield pa.RecordBatch.from_arrays(columns, names=["id", "anchor", "c", "l", "r"])

    return keyed.select("id", "text").mapInArrow(run, "id long, anchor long, c long, l int, r int")


def _passages(keyed: DataFrame, wanted: DataFrame, length: int, gram: int) -> DataFrame:
    """The passages (hashes ``w``) of each wanted context, cut from the first text that holds it."""
    lists = stored(wanted.groupBy(F.col("lo").alias("id")).agg(F.collect_list("c").alias("cs"), F.collect_list("hi").alias("his")))
    names = ["anchor", "c", "w", "lo", "hi"]

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for i in range(len(ids)):
                cs, his = (batch.column(k)[i].values.to_numpy(zero_copy_only=False) for k in (2, 3))
                order = np.argsort(cs)
                cs, his = cs[order], his[order]
                for _, words, bounds in _slices(batch.column(1).slice(i, 1), length):
                    found = anchors(words, bounds, length, gram)
                    if found is None:
                        continue
                    _, first, count, anchor, c, *_ = found
                    c = c.view(np.int64)
                    at = np.minimum(np.searchsorted(cs, c), len(cs) - 1)
                    mine = np.flatnonzero(cs[at] == c)
                    count = count[mine]
                    before = np.cumsum(count) - count
                    starts = np.repeat(first[mine] - before, count) + np.arange(count.sum())
                    w = Sums(words, BASES[1]).of(starts, starts + length).view(np.int64)
                    each = [np.repeat(x, count) for x in (anchor.view(np.int64)[mine], c[mine])]
                    ends = [np.full(len(w), ids[i]), np.repeat(his[at[mine]], count)]
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (*each, w, *ends)], names=names)

    ids = lists.select("id")
    few = lists.count() <= SMALL_IDS
    texts = keyed.join(F.broadcast(ids) if few else ids, "id", "left_semi").join(lists, "id").select("id", "text", "cs", "his")
    return texts.mapInArrow(run, ", ".join(f"{n} long" for n in names))


def sharing(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, gram: int = GRAM) -> DataFrame:
    """``row_id`` of every document with a passage of ``words`` words that another one has, once each.

    ``row_id`` is the key, or for a NULL key a number made from the text, as ``repeats.cut``
    gives it.  A word is a run of bytes outside white space; words are compared byte by byte,
    the white space between them is not.  Rows with one ``row_id`` are one document, so a
    passage that repeats only inside it does not count.  NULL, empty and short texts share
    nothing.  An empty table gives an empty result.  ``gram`` is at most ``words``.
    """
    keyed = docs.select(row_key(docs[key], docs[text]).alias("id"), F.coalesce(docs[text], F.lit("")).alias("text"))
    ends = F.min("id").alias("lo"), F.max("id").alias("hi")
    occ = stored(_occurrences(keyed, words, gram))
    # stored, so that the join deals both sides itself and a frequent anchor is split
    often = stored(occ.groupBy("anchor").agg(*ends).filter("lo < hi").select("anchor"))
    occ = stored(occ.join(often, "anchor", "left_semi"))
    contexts = stored(occ.groupBy("anchor", "c").agg(*ends, F.first("l").alias("l"), F.first("r").alias("r")))
    whole = stored(contexts.filter("lo < hi").select("anchor", "c"))
    sure = stored(occ.join(whole, ["anchor", "c"], "left_semi").select("id").distinct())
    near = with_near(contexts, F.min("lo") < F.max("hi")).filter("near")
    rest = occ.select("id", "anchor", "c").join(sure, "id", "left_anti")
    rest = stored(rest.join(near.select("anchor", "c"), ["anchor", "c"], "left_semi"))
    if rest.isEmpty():
        return sure.withColumnRenamed("id", "row_id")
    open_anchors = stored(rest.select("anchor").distinct())
    each = stored(_passages(keyed, near.join(open_anchors, "anchor", "left_semi"), words, gram))
    twice = each.groupBy("anchor", "w").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).filter("lo < hi").select("anchor", "w")
    found = stored(each.join(twice, ["anchor", "w"], "left_semi").select("anchor", "c").distinct())
    more = rest.join(found, ["anchor", "c"], "left_semi").select("id").distinct()
    return sure.union(more).withColumnRenamed("id", "row_id")
