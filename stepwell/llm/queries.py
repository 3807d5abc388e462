"""The operators bound to the given tables: one query each, with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepwell.llm import classifier, fingerprints, forest, idfiles, infill, mixing, passages, pii, quality, repeats, tokens, toxicity, webpages, whitening
from stepwell.llm.textkit import prepare
from stepwell.session import new_folder

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: fn(prepare(spark), sf_dir)
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


# --- 1: quality rules ------------------------------------------------------------------


def _duck(expression: str) -> str:
    return expression.replace(" div ", " // ")


_HALF_OPEN = " AND ".join(
    f"coalesce({_duck(e)} <= hi_{s}, true)" + (f" AND coalesce({_duck(e)} >= lo_{s}, true)" if both else "")
    for s, (e, _, both) in quality.SHARES.items()
)
_FENCE_NAMES = [f"{side}_{s}" for side in ("hi", "lo") for s, (_, _, both) in quality.SHARES.items() if side == "hi" or both]

_SKETCHED = {s: e for s, (e, _, _) in quality.SHARES.items()} | {f"step_{s}": e for s, (_, e, _) in quality.SHARES.items()}
_TOLD = {f"{name}_{s}": (t, f"{of}{s}") for s in quality.SHARES for name, (t, of) in quality.QUANTILES.items()}
_LIMITS = {f"hi_{s}": f"high_{s} + high_{s} // {1 << quality.SKETCH_BITS - 1} + {quality.REACH} * (high_{s} - mid_{s}) + {quality.STEPS} * step_{s}" for s in quality.SHARES} | {
    f"lo_{s}": f"low_{s} - {quality.REACH} * (mid_{s} - low_{s}) - {quality.STEPS} * step_{s}" for s, (_, _, both) in quality.SHARES.items() if both
}

QUALITY_SQL = rf"""WITH w AS (
    SELECT doc_id, lang, source, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws,
           list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
    FROM documents),
tri AS (
    SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i], ws[i + 1], ws[i + 2]) AS c
    FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
rep AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM tri, (SELECT unnest([0, 1, 2]) AS j) WHERE c > 1 GROUP BY doc_id),
m AS (
    SELECT w.doc_id, lang, source, CAST(coalesce(len(ws), 0) AS BIGINT) AS n_words,
           CAST(coalesce(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')), 0) AS BIGINT) AS word_chars,
           CAST(coalesce(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')), 0) AS BIGINT) AS n_symbols,
           CAST(coalesce(len(ls) - len(list_distinct(ls)), 0) AS BIGINT) AS n_dup_lines,
           CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
           CAST(coalesce(len(ls), 0) AS BIGINT) AS n_lines,
           CAST(coalesce(length(regexp_replace(text, '[^A-Z]+', '', 'g')), 0) AS BIGINT) AS n_capitals
    FROM w LEFT JOIN rep ON rep.doc_id = w.doc_id),
v AS ({" UNION ALL ".join(f"SELECT lang, source, '{s}' AS share, {_duck(e)} AS value FROM m WHERE NOT ({quality.BASE_FAILED})" for s, e in _SKETCHED.items())}),
b AS (SELECT lang, source, share, (value >> greatest(length(bin(value)) - {quality.SKETCH_BITS}, 0)) << greatest(length(bin(value)) - {quality.SKETCH_BITS}, 0) AS bucket FROM v),
g AS (SELECT 0 AS level, lang, source, share, bucket FROM b UNION ALL SELECT 1, lang, NULL, share, bucket FROM b UNION ALL SELECT 2, NULL, NULL, share, bucket FROM b),
c AS (SELECT level, lang, source, share, bucket, count(*) AS n FROM g GROUP BY ALL),
r AS (
    SELECT *, sum(n) OVER (PARTITION BY level, lang, source, share ORDER BY bucket) AS cum,
           sum(n) OVER (PARTITION BY level, lang, source, share) AS all_n FROM c),
p AS (
    SELECT level, lang, source, CAST(max(all_n) AS BIGINT) AS all_n,
           {", ".join(f"min(CASE WHEN share = '{share}' AND cum * 10 >= all_n * {t} THEN bucket END) AS {c}" for c, (t, share) in _TOLD.items())}
    FROM r GROUP BY level, lang, source),
x AS (
    SELECT l.lang, l.all_n, {", ".join(f"(l.all_n * l.{c} + {quality.PRIOR} * t.{c}) // (l.all_n + {quality.PRIOR}) AS {c}" for c in _TOLD)}
    FROM p l, p t WHERE l.level = 1 AND t.level = 2),
y AS (
    SELECT d.lang, d.source, coalesce(f.all_n, 0) AS group_docs,
           {", ".join(f"(coalesce(f.all_n * f.{c}, 0) + {quality.PRIOR} * coalesce(x.{c}, t.{c})) // (coalesce(f.all_n, 0) + {quality.PRIOR}) AS {c}" for c in _TOLD)}
    FROM (SELECT DISTINCT lang, source FROM m) d
    LEFT JOIN p f ON f.level = 0 AND f.lang IS NOT DISTINCT FROM d.lang AND f.source IS NOT DISTINCT FROM d.source
    LEFT JOIN x ON x.lang IS NOT DISTINCT FROM d.lang LEFT JOIN p t ON t.level = 2),
z AS (SELECT lang, source, group_docs, {", ".join(f"{e} AS {c}" for c, e in _LIMITS.items())} FROM y),
t AS (
    SELECT m.*, z.group_docs, {", ".join(f"z.{c}" for c in _FENCE_NAMES)}
    FROM m JOIN z ON z.lang IS NOT DISTINCT FROM m.lang AND z.source IS NOT DISTINCT FROM m.source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_capitals, CAST(group_docs AS BIGINT) AS group_docs,
       ({quality.BASE_FAILED}) AS base_failed, NOT ({quality.BASE_FAILED}) AND {_HALF_OPEN} AS kept,
       {", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in _FENCE_NAMES)}
FROM t"""


@query("op1_quality_rules", QUALITY_SQL)
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.rate(documents(spark, sf_dir))


# --- 3: fingerprints -------------------------------------------------------------------


@query("op3_fingerprints")
def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return fingerprints.compare_edits(docs, notes=fingerprints.likest(docs)).select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        "fingerprint", "edited_fingerprint", "near_edited", "near_next", *fingerprints.near_columns("note"),
    )


# --- 2: mixing -------------------------------------------------------------------------

MIX_SQL = rf"""WITH d AS (
    SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
           CAST('0x' || substr(md5('mix/' || coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, '')))), 1, {mixing.HASH_BITS // 4}) AS BIGINT) AS h
    FROM documents),
s AS (
    SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
           [5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INTEGER) + 1] AS w,
           row_number() OVER (ORDER BY source NULLS LAST) AS rk
    FROM d GROUP BY source),
r AS (SELECT *, 3.0::DOUBLE * source_size / w AS ratio FROM s),
l AS (
    SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE)
               - coalesce(sum(3.0::DOUBLE * source_size) OVER (ORDER BY ratio, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
              / sum(w) OVER (ORDER BY ratio, rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lvl
    FROM r),
o AS (SELECT ratio AS o_ratio, rk AS o_rk, lvl AS o_lvl FROM l WHERE lvl <= ratio ORDER BY ratio, rk LIMIT 1),
t AS (
    SELECT source, source_size,
           CASE WHEN o_rk IS NOT NULL AND (ratio, rk) >= (o_ratio, o_rk) THEN o_lvl * w ELSE 3.0::DOUBLE * source_size END AS target
    FROM l LEFT JOIN o ON true),
f AS (
    SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 3) ELSE 0 END AS full_copies FROM t),
g AS (SELECT *, target - full_copies * source_size AS rest FROM f),
hs AS (SELECT source, h, sum(size) AS hsize FROM d GROUP BY ALL),
c AS (SELECT *, sum(hsize) OVER (PARTITION BY source ORDER BY h) AS cum FROM hs),
k AS (
    SELECT c.source, c.h, (cum <= rest OR (cum > rest AND cum - hsize <= rest AND 2 * (rest - (cum - hsize)) >= hsize)) AND rest > 0 AS extra
    FROM c JOIN g ON c.source IS NOT DISTINCT FROM g.source)
SELECT d.doc_id, d.size, g.source_size, g.target,
       CAST((full_copies + CASE WHEN extra THEN 1 ELSE 0 END) * d.size AS BIGINT) AS taken
FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source
JOIN k ON d.source IS NOT DISTINCT FROM k.source AND d.h = k.h"""


@query("op2_mixing", MIX_SQL)
def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


# --- 4: quality classifier -------------------------------------------------------------


@query("op4_quality_classifier")
def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.judge(documents(spark, sf_dir)).select("doc_id", "pattern", "posterior", "score", "kept")


# --- 5: main text of pages -------------------------------------------------------------


@query("op5_html_extraction")
def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return webpages.extract(pages).select("page_id", "url", "text", "n_chars")


# --- 6: toxicity -----------------------------------------------------------------------


@query("op6_toxicity")
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~held_out)
    scored = toxicity.score(docs, toxicity.fit(docs, labels))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


# --- 8: personal data ------------------------------------------------------------------


@query("op8_pii")
def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = pii.pseudonymise(documents(spark, sf_dir).select("doc_id", "text"), details=True)
    return clean.withColumn("n_entities", F.size("entities").cast("long"))


# --- 7: byte-level BPE -----------------------------------------------------------------


def rank_file() -> tuple[str, str]:
    """Path and pattern of the rank file that the token queries use."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def id_digests(coded: DataFrame, keep_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (32-bit little-endian ids), decoded_sha256, and the ids."""
    found = coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2("packed", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), "ids"
    )
    return found if keep_ids else found.drop("ids")


@query("op7_bpe")
def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return id_digests(tokens.encode_decode(documents(spark, sf_dir), *rank_file()))


# --- 9: repeated byte strings ----------------------------------------------------------


@query("op9_suffix_array")
def op9_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = repeats.cut(docs).select(
        "row_id", "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), (F.col("n_removed") > 0).alias("has_repeats")
    )
    shared = passages.sharing(docs).withColumn("shares_passage", F.lit(True))
    return found.join(shared, "row_id", "left").drop("row_id").fillna(False, "shares_passage")


# --- 10: near-duplicates ---------------------------------------------------------------

NEAR_SQL = r"""WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
    FROM documents),
sh AS (
    SELECT DISTINCT doc_id, g FROM (
        SELECT doc_id, unnest(CASE WHEN len(ws) > 1 THEN list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])
                                   WHEN len(ws) = 1 THEN [ws[1]] ELSE [] END) AS g FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (
    SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 80 * (nx.n + ny.n - c)),
both_ways AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT a, y FROM reach JOIN both_ways ON b = x),
c AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN c ON a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id"""


@query("op10_forest", NEAR_SQL)
def op10_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.groups(documents(spark, sf_dir), k=2, percent=80)


# --- 11: whitened embeddings -----------------------------------------------------------


@query("op11_whitening")
def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    model = whitening.fit(vectors)
    error = whitening.identity_error(vectors, model)
    each = whitening.whiten(vectors, model).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    # one number per component
    explained = F.element_at(F.array(*[F.lit(float(v)) for v in model.explained]).cast("array<double>"), F.col("at") + 1)
    return each.select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), F.col("deviation").cast("long").alias("deviation"),
        "whitened", explained.alias("explained"), F.lit(error).cast("double").alias("identity_error"),
    )


# --- 12: token ids as binary files -----------------------------------------------------


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query("op12_id_files")
def op12_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark)
    idfiles.write_ids(documents(spark, sf_dir), folder, tokenizer_file())
    return idfiles.read_ids(spark, folder, packed=True).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


# --- 13: fill-in-middle ----------------------------------------------------------------

INFILL_SQL = r"""WITH d AS (
    SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), sha256(coalesce(text, '')))) AS h FROM documents),
u AS (
    SELECT *, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS us,
           CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
           CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM d),
c AS (
    SELECT *, len(us) AS n, least(h1 % (len(us) + 1), h2 % (len(us) + 1)) AS a, greatest(h1 % (len(us) + 1), h2 % (len(us) + 1)) AS b FROM u),
p AS (
    SELECT doc_id, t, n, array_to_string(list_slice(us, 1, a), '') AS pre, array_to_string(list_slice(us, a + 1, b), '') AS mid,
           array_to_string(list_slice(us, b + 1, n), '') AS suf,
           CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain'
                WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
                        ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p"""


@query("op13_fill_in_middle", INFILL_SQL)
def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = infill.rearrange(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select(
        "doc_id", F.col("n_units").alias("n"), "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(infill.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )
