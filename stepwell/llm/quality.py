"""Quality rules with thresholds that follow the data.

Every document gets a few shares (symbols, repetition, repeated lines, capitals, length of
words).  Per language and source a mergeable quantile sketch of each share is kept: counts
per bucket, where a bucket is the leading ``SKETCH_BITS`` bits of the number, so sketches of
any two parts of the corpus add up and quantiles are right to 1/32 of their size.  A
threshold lies beyond the ninth decile of its own group by ``REACH`` times the distance between
the median and that decile, and by ``STEPS`` of the smallest steps that the share can take in a
usual document of the group (one word or line more), so the group's own upper tail decides.  The
quantiles of a group are blended with those of its language, and these with those of everything,
by the number of documents: a group of ``PRIOR`` documents speaks for itself by half.  The
thresholds, one row per language and source, are joined to the documents, which are filtered.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepwell.llm.mixing import with_small
from stepwell.llm.textkit import mix64, span_hashes, stored, text_blocks, word_spans

SKETCH_BITS = 6
# documents that a group's parent counts for
PRIOR = 1000
# distances between median and ninth decile, and steps, from that decile to a threshold
REACH, STEPS = 6, 3
# share: (expression in hundredths of a percent or of a character, its step, two-sided)
SHARES = {
    "symbols": ("n_symbols * 10000 div greatest(n_words, 1)", "10000 div greatest(n_words, 1)", False),
    "repeats": ("n_repeat_words * 10000 div greatest(n_words, 1)", "30000 div greatest(n_words, 1)", False),
    "dup_lines": ("n_dup_lines * 10000 div greatest(n_lines, 1)", "10000 div greatest(n_lines, 1)", False),
    "capitals": ("n_capitals * 10000 div greatest(word_chars, 1)", "10000 div greatest(word_chars, 1)", False),
    "word_length": ("word_chars * 100 div greatest(n_words, 1)", "100 div greatest(n_words, 1)", True),
}
# what a group's sketches tell of a share: (quantile in tenths, of the share or of its step)
QUANTILES = {"low": (1, ""), "mid": (5, ""), "high": (9, ""), "step": (5, "step_")}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals")
BASE_FAILED = "n_words < 50 OR 100 * n_repeat_words > 50 * n_words"


def _again(values: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(occurs before in its text, occurs more than once in its text) for each value."""
    later, shared = np.zeros(len(values), bool), np.zeros(len(values), bool)
    if len(values):
        order = np.lexsort((values, of))
        same = (values[order[1:]] == values[order[:-1]]) & (of[order[1:]] == of[order[:-1]])
        later[order[1:]] = same
        shared[order[1:]] |= same
        shared[order[:-1]] |= same
    return later, shared


def _measure(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    texts = len(offsets) - 1
    starts, ends, owner = word_spans(data, offsets)
    n = np.bincount(owner, minlength=texts)

    def per_text(mask: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(mask)])
        return sums[offsets[1:]] - sums[offsets[:-1]]

    blank = (data == 32) | ((data >= 9) & (data <= 13))
    chars = per_text(((data & 0xC0) != 0x80) & ~blank)
    symbols = per_text(np.isin(data, np.frombuffer(b"#*$%&|<>", np.uint8)))
    capitals = per_text((data >= 65) & (data <= 90))
    # lines: cut at \n and at the ends of texts
    breaks = np.flatnonzero(data == 10)
    line_starts = np.unique(np.concatenate([offsets[:-1], breaks + 1]))
    line_starts = line_starts[line_starts < len(data)]
    line_of = np.searchsorted(offsets, line_starts, "right") - 1
    line_ends = np.minimum(np.append(line_starts[1:], len(data)), offsets[line_of + 1])
    line_ends = line_ends - (data[line_ends - 1] == 10) if len(line_ends) else line_ends
    inked = np.concatenate([[0], np.cumsum(~blank)])
    real = inked[line_ends] > inked[line_starts]
    line_starts, line_ends, line_of = line_starts[real], line_ends[real], line_of[real]
    again, _ = _again(span_hashes(data, line_starts, line_ends), line_of)
    dup_lines = np.bincount(line_of, weights=again, minlength=texts).astype(np.int64)
    # words inside three-word windows that occur more than once
    word = span_hashes(data, starts, ends)
    covered = np.zeros(len(word) + 2, bool)
    if len(word) > 2:
        window = mix64(mix64(word[:-2]) + word[1:-1] * np.uint64(3)) + word[2:] * np.uint64(5)
        at = np.flatnonzero(owner[:-2] == owner[2:])
        _, shared = _again(mix64(window)[at], owner[at])
        for j in range(3):
            covered[at[shared] + j] = True
    repeats = np.bincount(owner, weights=covered[: len(word)], minlength=texts).astype(np.int64)
    return [n, chars, symbols, dup_lines, repeats, np.bincount(line_of, minlength=texts), capitals]


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """Append the counts of ``COUNTS``; columns of these names are replaced."""
    keep = [c for c in docs.columns if c not in COUNTS]
    whole = docs.select(F.struct(*[docs[c] for c in keep]).alias("_row"), docs[text].alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in text_blocks(batch.column(1)):
                found = [pa.array(c, pa.int64()) for c in _measure(data, offsets)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *found], names=["_row", *COUNTS])

    schema = f"_row {whole.schema['_row'].dataType.simpleString()}, " + ", ".join(f"{c} long" for c in COUNTS)
    return whole.mapInArrow(run, schema).select(*[F.col("_row").getField(c).alias(c) for c in keep], *COUNTS)


def bucket(value: Column) -> Column:
    """The number with all but its leading bits cleared."""
    drop = F.greatest(F.length(F.bin(value)) - SKETCH_BITS, F.lit(0)).cast("int")
    return F.call_function("shiftleft", F.call_function("shiftright", value, drop), drop)


def sketches(measured: DataFrame) -> DataFrame:
    """Counts per (lang, source, share, bucket), also of the steps; merging sketches is adding counts."""
    sketched = {s: e for s, (e, _, _) in SHARES.items()} | {f"step_{s}": e for s, (_, e, _) in SHARES.items()}
    pairs = F.explode(F.array(*[F.struct(F.lit(s).alias("share"), F.expr(e).alias("value")) for s, e in sketched.items()]))
    each = measured.filter(f"NOT ({BASE_FAILED})").select("lang", "source", pairs.alias("_s"))
    return each.groupBy("lang", "source", F.col("_s.share").alias("share"), bucket(F.col("_s.value")).alias("bucket")).agg(F.count("*").alias("n"))


def thresholds(counts: DataFrame, groups: DataFrame) -> DataFrame:
    """One row per (lang, source) of ``groups``: ``hi_*`` and, for two-sided shares, ``lo_*``.

    Without any document that passes the base rules all thresholds are NULL.
    """
    levels = F.explode(
        F.array(
            F.struct(F.lit(0).alias("level"), F.col("lang"), F.col("source")),
            F.struct(F.lit(1).alias("level"), F.col("lang"), F.lit(None).cast("string").alias("source")),
            F.struct(F.lit(2).alias("level"), F.lit(None).cast("string").alias("lang"), F.lit(None).cast("string").alias("source")),
        )
    )
    merged = counts.select(levels.alias("g"), "share", "bucket", "n").groupBy("g", "share", "bucket").agg(F.sum("n").alias("n"))
    running = Window.partitionBy("g", "share").orderBy("bucket")
    total = Window.partitionBy("g", "share")
    ranked = merged.withColumns({"cum": F.sum("n").over(running), "all": F.sum("n").over(total)})
    at = lambda tenths: F.min(F.when(F.col("cum") * 10 >= F.col("all") * tenths, F.col("bucket")))
    tenths = sorted({t for t, _ in QUANTILES.values()})
    quantiles = ranked.groupBy("g", "share").agg(*[at(t).alias(f"q{t}") for t in tenths], F.max("all").alias("all"))
    told = {f"{name}_{s}": (t, f"{of}{s}") for s in SHARES for name, (t, of) in QUANTILES.items()}
    per_group = stored(
        quantiles.groupBy("g").agg(F.max("all").alias("all"), *[F.max(F.when(F.col("share") == share, F.col(f"q{t}"))).alias(c) for c, (t, share) in told.items()])
    )
    row = F.struct("all", *told)
    own = lambda level: per_group.filter(F.col("g.level") == level)
    fine = own(0).select(F.col("g.lang").alias("_l0"), F.col("g.source").alias("_s0"), row.alias("_f"))
    mid = own(1).select(F.col("g.lang").alias("_l1"), row.alias("_m"))
    # one row at most
    top = own(2).select(row.alias("_t")).first()
    found = (
        groups
        .join(fine, F.col("lang").eqNullSafe(F.col("_l0")) & F.col("source").eqNullSafe(F.col("_s0")), "left")
        .join(mid, F.col("lang").eqNullSafe(F.col("_l1")), "left")
    )

    def blended(group: str, c: str, parent: str) -> str:
        n = f"coalesce({group}.all, 0)"
        return f"(({n} * coalesce({group}.{c}, 0) + {PRIOR} * ({parent})) div ({n} + {PRIOR}))"

    everything = {c: str(top["_t"][c]) if top else "cast(NULL as bigint)" for c in told}
    value = {c: blended("_f", c, blended("_m", c, everything[c])) for c in told}
    limits = {}
    for s, (_, _, both) in SHARES.items():
        # the decile is the lower end of its bucket, which is up to 1/32 wide
        limits[f"hi_{s}"] = f"{value[f'high_{s}']} + {value[f'high_{s}']} div {1 << SKETCH_BITS - 1} + {REACH} * ({value[f'high_{s}']} - {value[f'mid_{s}']}) + {STEPS} * {value[f'step_{s}']}"
        if both:
            limits[f"lo_{s}"] = f"{value[f'low_{s}']} - {REACH} * ({value[f'mid_{s}']} - {value[f'low_{s}']}) - {STEPS} * {value[f'step_{s}']}"
    return found.select("lang", "source", F.coalesce("_f.all", F.lit(0)).alias("group_docs"), *[F.expr(e).cast("long").alias(c) for c, e in limits.items()])


def verdict() -> Column:
    """True for a row within all its thresholds; a missing threshold stops nothing."""
    within = ~F.expr(BASE_FAILED)
    for s, (expression, _, both) in SHARES.items():
        value = F.expr(expression)
        within &= F.coalesce(value <= F.col(f"hi_{s}"), F.lit(True))
        if both:
            within &= F.coalesce(value >= F.col(f"lo_{s}"), F.lit(True))
    return within


def rate(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """Per row: key, the counts, ``base_failed``, ``kept`` and the thresholds used.

    NULL, empty and blank texts have no words and fail the base rules.  NULL languages and
    sources are groups of their own.  Repeated rows are measured and kept alike.  An empty
    table gives an empty result.  Only the named columns are read.
    """
    narrow = docs.select(docs[key], docs[lang].alias("lang"), docs[source].alias("source"), docs[text].alias("text"))
    measured = stored(measure(narrow).drop("text"))
    groups = stored(measured.select("lang", "source").distinct())
    limits = stored(thresholds(stored(sketches(measured)), groups)).withColumnsRenamed({"lang": "_lang", "source": "_source"})
    match = F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source"))
    joined = with_small(measured, limits, match, groups.count(), "left")
    limit_names = [c for c in limits.columns if c.startswith(("hi_", "lo_"))]
    return joined.select(key, *COUNTS, F.expr(BASE_FAILED).alias("base_failed"), verdict().alias("kept"), "group_docs", *limit_names)


def filtered(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The rows of ``docs`` that keep within the base rules and their group's thresholds.

    Texts are measured twice and never shuffled; see ``rate`` for the cases.
    """
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_doc"), docs[lang].alias("lang"), docs[source].alias("source"), docs[text].alias("_words"))
    measured = measure(rows, "_words")
    sketch = stored(sketches(measured))
    groups = stored(rows.select("lang", "source").distinct())
    limits = stored(thresholds(sketch, groups)).withColumnsRenamed({"lang": "_lang", "source": "_source"})
    match = F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source"))
    return with_small(measured, limits, match, groups.count(), "left").filter(verdict()).select("_doc.*")
