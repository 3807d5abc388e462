"""Fill-in-middle texts: a pyarrow.compute pipeline over batches of whole texts.

A text is cut into units (lines with their line end).  Two cuts among the units, drawn from a
hash of the row's id, make a prefix, a middle and a suffix.  The batch is split into lists of
units, flattened with the number of each unit's text, and every unit gets its ordinal; the
units of one role are filtered, put back into lists and joined, and the three pieces of a
text are joined with their marks.  No text is looked at row by row.

Forms: ``psm`` is prefix mark, prefix, suffix mark, suffix, middle mark, middle; ``spm`` is
suffix mark, suffix, prefix mark, prefix, middle mark, middle; ``plain`` is the text as it
was.  A text that is empty or holds a mark stays plain, so every output can be turned back.

Results: NULL texts count as empty.  A row without an id draws from the hash of its text in
place of the id.  Rows that repeat an id draw the same numbers; repeated rows stay.  Columns of the names added
are replaced, all others pass through.  An empty table gives an empty result.  Texts of any
length are handled whole; a batch goes through in slices of about ``SLICE_BYTES``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The marks before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
# bytes of text whose units are held at once
SLICE_BYTES = 4 << 20

ADDED = "n_units long, form string, prefix_chars long, middle_chars long, output string"


def units(texts: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array, pa.Array]:
    """(unit, text number, ordinal, units per text) of a string column without NULLs.

    The units are the matches of ``[^\\n]*\\n|[^\\n]+``.
    """
    lists = pc.split_pattern(texts, "\n")
    pieces, parent = pc.list_flatten(lists), pc.list_parent_indices(lists).cast(pa.int64())
    ordinal = _ordinals(parent, pc.list_value_length(lists).cast(pa.int64()))
    last = pc.equal(ordinal, pc.subtract(pc.take(pc.list_value_length(lists).cast(pa.int64()), parent), 1))
    # every piece but the last had a line end; an empty last piece is none
    ends = pc.if_else(last, pa.scalar("", pa.string()), pa.scalar("\n", pa.string()))
    whole = pc.binary_join_element_wise(pieces, ends, pa.scalar("", pa.string()))
    there = pc.greater(pc.binary_length(whole), 0)
    whole, parent, ordinal = (pc.filter(c, there) for c in (whole, parent, ordinal))
    return whole, parent, ordinal, _counts(parent, len(texts))


def _counts(parent: pa.Array, texts: int) -> pa.Array:
    """How often each text number occurs in ``parent``, which is sorted."""
    bounds = np.searchsorted(parent.to_numpy(), np.arange(texts + 1))
    return pa.array(np.diff(bounds), pa.int64())


def _ordinals(parent: pa.Array, sizes: pa.Array) -> pa.Array:
    """Place of each flattened item in its list."""
    firsts = pc.subtract(pc.cumulative_sum(sizes), sizes)
    return pc.subtract(pa.array(np.arange(len(parent))), pc.take(firsts, parent))


def _joined(unit: pa.Array, parent: pa.Array, role: pa.Array, texts: int) -> pa.Array:
    """The units of one role, joined text by text."""
    chosen, of = pc.filter(unit, role), pc.filter(parent, role)
    bounds = pc.cumulative_sum(_counts(of, texts))
    offsets = pa.concat_arrays([pa.array([0], pa.int64()), bounds]).cast(pa.int32())
    return pc.binary_join(pa.ListArray.from_arrays(offsets, chosen), "")


def rearranged(texts: pa.Array, draws: list[np.ndarray], fim_percent: int, spm_percent: int) -> list[pa.Array]:
    """The added columns of one slice; ``draws`` are four numbers per text."""
    texts = texts.cast(pa.string()).fill_null("")
    n_texts = len(texts)
    unit, parent, ordinal, n = units(texts)
    slots = n.to_numpy() + 1
    low, high = np.sort([draws[0] % slots, draws[1] % slots], axis=0)
    first, second = (pc.take(pa.array(v), parent) for v in (low, high))
    before = pc.less(ordinal, first)
    after = pc.greater_equal(ordinal, second)
    between = pc.and_not(pc.invert(before), after)
    prefix, middle, suffix = (_joined(unit, parent, role, n_texts) for role in (before, between, after))
    marked = pc.equal(texts, pa.scalar("", pa.string()))
    for mark in (PREFIX, SUFFIX, MIDDLE):
        marked = pc.or_(marked, pc.match_substring(texts, mark))
    plain = pc.or_(marked, pa.array(draws[2] % 100 >= fim_percent))
    spm = pa.array(draws[3] % 100 < spm_percent)
    glue, mark = pa.scalar("", pa.string()), {m: pa.scalar(m, pa.string()) for m in (PREFIX, SUFFIX, MIDDLE)}
    psm_text = pc.binary_join_element_wise(mark[PREFIX], prefix, mark[SUFFIX], suffix, mark[MIDDLE], middle, glue)
    spm_text = pc.binary_join_element_wise(mark[SUFFIX], suffix, mark[PREFIX], prefix, mark[MIDDLE], middle, glue)
    form = pc.if_else(plain, "plain", pc.if_else(spm, "spm", "psm"))
    nothing = pa.scalar(None, pa.int64())
    chars = [pc.if_else(plain, nothing, pc.utf8_length(c).cast(pa.int64())) for c in (prefix, middle)]
    output = pc.if_else(plain, texts, pc.if_else(spm, spm_text, psm_text))
    return [n, form.cast(pa.string()), *chars, output.cast(pa.string())]


def _slices(column: pa.Array) -> Iterator[tuple[int, int]]:
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, lo = np.cumsum(sizes), 0
    while lo < len(sizes):
        before = ends[lo] - sizes[lo]
        hi = max(lo + 1, int(np.searchsorted(ends, before + SLICE_BYTES, "right")))
        yield lo, hi
        lo = hi


def draws(key: Column, text: Column, seed: int) -> list[Column]:
    """Four 32-bit numbers of a row, from the SHA-256 of ``seed:key``."""
    name = F.coalesce(key.cast("string"), F.sha2(F.coalesce(text, F.lit("")), 256))
    digits = F.sha2(F.concat(F.lit(f"{seed}:"), name), 256)
    return [F.conv(F.substring(digits, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def rearrange(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 7, fim_percent: int = 100, spm_percent: int = 50) -> DataFrame:
    """Append n_units, form, prefix_chars, middle_chars and output to every row.

    ``fim_percent`` of the rows are rearranged, of these ``spm_percent`` with the suffix first.
    Characters are code points; both counts are NULL for plain rows.  One pass, no shuffle.
    """
    added = [c.split()[0] for c in ADDED.split(", ")]
    keep = [c for c in docs.columns if c not in added]
    numbers = [c.alias(f"_h{i}") for i, c in enumerate(draws(docs[key], docs[text], seed))]
    row = F.struct(*[docs[c] for c in keep]).alias("row")
    rows = docs.select(row, docs[text].alias("text"), *numbers)
    schema = T.StructType([rows.schema["row"], *T.StructType.fromDDL(ADDED)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in _slices(batch.column(1)):
                part = batch.slice(lo, hi - lo)
                found = rearranged(part.column(1), [part.column(i).to_numpy() for i in (2, 3, 4, 5)], fim_percent, spm_percent)
                yield pa.RecordBatch.from_arrays([part.column(0), *found], names=["row", *added])

    found = rows.mapInArrow(run, schema)
    return found.select(*[F.col("row").getField(c).alias(c) for c in keep], *added)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from.

    Texts with marks stay plain, and no mark begins inside another, so the first of each mark
    is the one that was put there.
    """
    p, s, m = (F.locate(mark, output) for mark in (PREFIX, SUFFIX, MIDDLE))
    piece = lambda mark, at, end: F.substr(output, at + len(mark), end - at - len(mark))
    middle = F.substr(output, m + len(MIDDLE))
    psm = F.concat(piece(PREFIX, p, s), middle, piece(SUFFIX, s, m))
    spm = F.concat(piece(PREFIX, p, m), middle, piece(SUFFIX, s, p))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
