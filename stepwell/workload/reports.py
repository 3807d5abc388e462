"""Reports, samples and cost roll-ups."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from stepwell.operators import reports as R
from stepwell.operators import sampling
from stepwell.sources.files import safe_filename
from stepwell.workload import query
from stepwell.workload import bindings as B

PATTERNS = {"has_digit": "[0-9]", "has_license": "(?i)license|copyright", "has_at": "@"}
SIGNALS = [*PATTERNS, "any_signal"]


def predictions(spark, sf_dir):
    """Pattern signals of documents beside their quality label (0 counts as failure)."""
    docs = B.table(spark, sf_dir, "documents").select(
        "doc_id", *[F.col("text").rlike(p).alias(name) for name, p in PATTERNS.items()]
    )
    truth = B.table(spark, sf_dir, "labels").select("doc_id", (1 - F.col("quality")).alias("has_error"))
    return docs.join(truth, "doc_id").withColumn(
        "any_signal", F.expr(" OR ".join(PATTERNS))
    )


PREDICTIONS_SQL = f"""pred AS (
    SELECT doc_id, 1 - quality AS has_error,
           {", ".join(f"regexp_matches(text, '{p}') AS {n}" for n, p in PATTERNS.items())}
    FROM documents JOIN labels USING (doc_id)),
fired AS (
    {" UNION ALL ".join(f"SELECT '{n}' AS signal, {n} AS fired, has_error = 1 AS bad FROM pred" for n in PATTERNS)}
    UNION ALL SELECT 'any_signal', {" OR ".join(PATTERNS)}, has_error = 1 FROM pred),
cells AS (
    SELECT signal, count(*) FILTER (WHERE fired AND bad) AS tp,
           count(*) FILTER (WHERE fired AND NOT bad) AS fp,
           count(*) FILTER (WHERE NOT fired AND bad) AS fn,
           count(*) FILTER (WHERE NOT fired AND NOT bad) AS tn FROM fired GROUP BY 1)"""


@query("confusion_matrix", f"WITH {PREDICTIONS_SQL} SELECT * FROM cells")
def confusion_matrix(spark, sf_dir):
    return R.confusion(predictions(spark, sf_dir), SIGNALS)


@query(
    "precision_recall_f1",
    f"""WITH {PREDICTIONS_SQL}, r AS (SELECT signal, tp / nullif(tp + fp, 0) AS p, tp / nullif(tp + fn, 0) AS r FROM cells)
    SELECT signal, round(p, 6) AS precision, round(r, 6) AS recall,
           round(2 * p * r / nullif(p + r, 0), 6) AS f1 FROM r""",
)
def precision_recall_f1(spark, sf_dir):
    rates = R.precision_recall_f1(R.confusion(predictions(spark, sf_dir), SIGNALS))
    return rates.select("signal", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query(
    "validation_report",
    f"""WITH {PREDICTIONS_SQL}, r AS (SELECT *, tp / nullif(tp + fp, 0) AS p, tp / nullif(tp + fn, 0) AS r FROM cells),
    f AS (SELECT *, 2 * p * r / nullif(p + r, 0) AS f1 FROM r)
    SELECT signal, '| `' || signal || '` | ' || tp || ' | ' || fp || ' | ' || fn || ' | ' || tn || ' | '
        || coalesce(format('{{:.2f}}', p), 'n/a') || ' | ' || coalesce(format('{{:.2f}}', r), 'n/a') || ' | '
        || coalesce(format('{{:.2f}}', f1), 'n/a') || ' |' AS line FROM f""",
)
def validation_report(spark, sf_dir):
    return R.report_lines(R.precision_recall_f1(R.confusion(predictions(spark, sf_dir), SIGNALS)))


@query(
    "generation_cost",
    f"""WITH {B.ORDER_TRACES_SQL}, c AS (SELECT count(*) AS specs, count(DISTINCT source_format) AS formats FROM traces),
    t AS (SELECT specs, specs * 1000 AS input_tokens, formats * 3500 AS cache_write_tokens,
          (specs - formats) * 3500 AS cache_read_tokens,
          CAST(floor(specs * 7000 * 1.1::DOUBLE) AS BIGINT) AS output_tokens FROM c)
    SELECT *, round((input_tokens * 3.0::DOUBLE + cache_write_tokens * 3.75::DOUBLE + cache_read_tokens * 0.3::DOUBLE
        + output_tokens * 15.0::DOUBLE) / 1000000, 2) AS cost_usd FROM t""",
)
def generation_cost(spark, sf_dir):
    return R.project_generation_cost(B.order_traces(spark, sf_dir), "source_format")


@query(
    "count_by_path",
    """SELECT coalesce(CASE WHEN n_chars > 200 THEN lang END, '<missing>') AS value, count(*) AS n
    FROM documents GROUP BY 1""",
)
def count_by_path(spark, sf_dir):
    results = B.table(spark, sf_dir, "documents").selectExpr(
        "named_struct('output_format', if(n_chars > 200, lang, NULL)) AS spec"
    )
    return R.count_by_path(results, "spec.output_format")


def order_results(spark, sf_dir):
    """Orders in the shape of generation results."""
    return B.table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey",
        "o_orderpriority AS label",
        "o_orderstatus = 'F' AS ok",
        "o_orderstatus = 'P' AS budget_skipped",
        "if(o_totalprice > 400000, 2, 1) AS attempts",
        "int(o_totalprice / 1000) AS n_steps",
        "if(o_totalprice > 100000, int(o_totalprice / 3000), NULL) AS n_tool_calls",
        "o_totalprice AS cost_usd",
    )


@query(
    "outcome_rates",
    """WITH c AS (SELECT count(*) AS total, count(*) FILTER (WHERE o_orderstatus = 'F') AS ok,
        count(*) FILTER (WHERE o_orderstatus = 'O') AS failed,
        count(*) FILTER (WHERE o_orderstatus = 'P') AS budget_skipped,
        count(*) FILTER (WHERE o_totalprice > 400000) AS second_attempt FROM orders)
    SELECT *, round(ok / total, 6) AS ok_rate, round(failed / total, 6) AS failed_rate,
        round(second_attempt / total, 6) AS second_attempt_rate FROM c""",
)
def outcome_rates(spark, sf_dir):
    rates = R.outcome_rates(order_results(spark, sf_dir))
    return rates.withColumns(
        {c: F.round(c, 6) for c in ("ok_rate", "failed_rate", "second_attempt_rate")}
    )


@query(
    "shape_by_label",
    """SELECT o_orderpriority AS label, count(*) AS n,
        round(avg(floor(o_totalprice / 1000)), 6) AS mean_steps,
        round(median(floor(o_totalprice / 1000)), 6) AS median_steps,
        round(avg(floor(o_totalprice / 3000)) FILTER (WHERE o_totalprice > 100000), 6) AS mean_tool_calls,
        round(median(floor(o_totalprice / 3000)) FILTER (WHERE o_totalprice > 100000), 6) AS median_tool_calls
    FROM orders WHERE o_orderstatus = 'F' GROUP BY 1""",
)
def shape_by_label(spark, sf_dir):
    shape = R.shape_by_label(order_results(spark, sf_dir))
    names = ("mean_steps", "median_steps", "mean_tool_calls", "median_tool_calls")
    return shape.withColumns({c: F.round(c, 6) for c in names})


@query(
    "top_n",
    """SELECT o_orderkey, label, cost_usd FROM (SELECT o_orderkey, o_orderpriority AS label, o_totalprice AS cost_usd FROM orders)
    ORDER BY cost_usd DESC, o_orderkey LIMIT 20""",
)
def top_n(spark, sf_dir):
    results = order_results(spark, sf_dir).select("o_orderkey", "label", "cost_usd")
    return R.top_n(results, "cost_usd", 20, "o_orderkey")


@query(
    "value_counts",
    "SELECT coalesce(source, '<missing>') AS value, count(*) AS n FROM documents GROUP BY 1",
)
def value_counts(spark, sf_dir):
    return R.value_counts(B.table(spark, sf_dir, "documents"), "source")


@query(
    "size_profile",
    """WITH s AS (SELECT lang, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars) - 1 AS i,
                  count(*) OVER (PARTITION BY lang) AS n FROM documents)
    SELECT lang, max(n) AS n, min(n_chars) AS min_size, max(n_chars) AS max_size,
           CAST(floor(sum(n_chars) / max(n)) AS BIGINT) AS mean_size,
           max(n_chars) FILTER (WHERE i = floor(n * 0.95)) AS p95_size FROM s GROUP BY 1""",
)
def size_profile(spark, sf_dir):
    docs = B.table(spark, sf_dir, "documents").select("lang", "n_chars")
    return R.size_stats(docs, "n_chars", ["lang"])


@query(
    "size_profile_all",
    """WITH s AS (SELECT length(html) AS size, row_number() OVER (ORDER BY length(html)) - 1 AS i,
                  count(*) OVER () AS n FROM pages)
    SELECT max(n) AS n, min(size) AS min_size, max(size) AS max_size,
           CAST(floor(sum(size) / max(n)) AS BIGINT) AS mean_size,
           max(size) FILTER (WHERE i = floor(n * 0.95)) AS p95_size FROM s""",
)
def size_profile_all(spark, sf_dir):
    pages = B.table(spark, sf_dir, "pages").selectExpr("cast(length(html) as bigint) AS size")
    return R.size_stats(pages, "size")


@query(
    "trace_profile",
    f"""WITH {B.EVENT_STEPS_SQL}
    SELECT trace_id, count(*) AS n_steps, count(*) FILTER (WHERE event_type = 'signup') AS user_steps,
           count(*) FILTER (WHERE event_type <> 'signup') AS agent_steps, 0::BIGINT AS system_steps,
           count(*) FILTER (WHERE event_type <> 'signup') AS tool_calls,
           count(*) FILTER (WHERE event_type = 'view') AS steps_with_observation FROM ev GROUP BY 1""",
)
def trace_profile(spark, sf_dir):
    return R.trace_profile(B.event_steps(spark, sf_dir))


@query(
    "health",
    """SELECT count(*) AS total, count(*) FILTER (WHERE length(text) > 0) AS raw_populated,
      count(*) FILTER (WHERE lang = 'en') AS atif_populated, CAST(sum(length(text)) AS BIGINT) AS raw_chars FROM documents""",
)
def health(spark, sf_dir):
    traces = B.table(spark, sf_dir, "documents").selectExpr("text AS raw_blob", "lang = 'en' AS has_atif")
    return R.health(traces)


@query(
    "usage_totals",
    """WITH u AS (SELECT count(*) FILTER (WHERE l_returnflag <> 'R') AS succeeded,
        count(*) FILTER (WHERE l_returnflag = 'R') AS failed,
        count(*) FILTER (WHERE l_linenumber > 1) AS retried,
        CAST(sum(CAST(l_quantity AS BIGINT) * 100) AS BIGINT) AS input_tokens,
        CAST(sum(l_linenumber * 10) AS BIGINT) AS output_tokens FROM lineitem)
    SELECT *, round((input_tokens * 3.0::DOUBLE + output_tokens * 15.0::DOUBLE) / 1000000, 4) AS cost_usd,
        (input_tokens * 3.0::DOUBLE + output_tokens * 15.0::DOUBLE) / 1000000 >= 50 AS over_cap FROM u""",
)
def usage_totals(spark, sf_dir):
    responses = B.table(spark, sf_dir, "lineitem").selectExpr(
        "l_returnflag <> 'R' AS ok",
        "l_linenumber AS attempts",
        "cast(l_quantity as bigint) * 100 AS input_tokens",
        "l_linenumber * 10 AS output_tokens",
    )
    return R.usage_totals(responses, cap=50).withColumn("cost_usd", F.round("cost_usd", 4))


@query(
    "embedding_cost",
    """WITH c AS (SELECT count(*) AS rows, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents)
    SELECT rows, chars, chars // 4 AS tokens, CAST(ceil(rows / 100) AS BIGINT) AS calls,
           round((chars // 4) / 1000000 * 0.02::DOUBLE, 8) AS cost_usd FROM c""",
)
def embedding_cost(spark, sf_dir):
    cost = R.project_embedding_cost(B.table(spark, sf_dir, "documents").select("text"))
    return cost.withColumn("cost_usd", F.round("cost_usd", 8))


@query(
    "call_cost",
    f"""WITH {B.ORDER_TRACES_SQL}, c AS (SELECT count(*) AS targets FROM traces
        WHERE has_atif AND (has_error = 1 OR failure_label IS NOT NULL) AND NOT has_events)
    SELECT targets, targets * 8000 AS input_tokens, targets * 1000 AS output_tokens,
           round((targets * 8000 * 15.0::DOUBLE + targets * 1000 * 75.0::DOUBLE) / 1000000, 4) AS cost_usd,
           round((targets * 8000 * 15.0::DOUBLE + targets * 1000 * 75.0::DOUBLE) / 1000000 * 1.5, 4) AS worst_case_usd FROM c""",
)
def call_cost(spark, sf_dir):
    from stepwell.operators.catalog import event_targets

    cost = R.project_call_cost(event_targets(B.order_traces(spark, sf_dir)), 8_000, 1_000)
    return cost.withColumns({c: F.round(c, 4) for c in ("cost_usd", "worst_case_usd")})


@query(
    "first_n_per_stratum",
    """SELECT doc_id, source FROM documents
    QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 5""",
)
def first_n_per_stratum(spark, sf_dir):
    docs = B.table(spark, sf_dir, "documents").select("doc_id", "source")
    return sampling.first_n_per_stratum(docs, "source", 5, "doc_id", ["doc_id"])


@query(
    "safe_filename",
    "SELECT page_id, replace(replace(url, '/', '__'), ' ', '_') || '.json' AS file_name FROM pages",
)
def safe_filenames(spark, sf_dir):
    return B.table(spark, sf_dir, "pages").select("page_id", safe_filename(F.col("url")).alias("file_name"))


QUOTA_TOTAL = 101


def language_weights(spark, sf_dir):
    docs = B.table(spark, sf_dir, "documents")
    share = F.col("n") / F.sum("n").over(Window.partitionBy())
    return docs.groupBy(F.col("lang").alias("label")).agg(F.count("*").alias("n")).select(
        "label", share.alias("weight")
    )


QUOTA_SQL = f"""n AS (SELECT lang AS label, count(*) AS n FROM documents GROUP BY 1),
w AS (SELECT label, n, n / sum(n) OVER () * {QUOTA_TOTAL}.0::DOUBLE AS exact FROM n),
f AS (SELECT label, n, CAST(floor(exact) AS BIGINT) AS base, round(exact - floor(exact), 9) AS rest FROM w),
q AS (SELECT label, n, base + (row_number() OVER (ORDER BY rest DESC, label) <= {QUOTA_TOTAL} - sum(base) OVER ())::INT AS quota FROM f)"""


@query("allocate_quotas", f"WITH {QUOTA_SQL} SELECT label, quota FROM q")
def allocate_quotas(spark, sf_dir):
    return sampling.allocate(language_weights(spark, sf_dir), QUOTA_TOTAL)


def quota_rows(spark, sf_dir):
    docs = B.table(spark, sf_dir, "documents").select("doc_id", "lang")
    quotas = sampling.allocate(language_weights(spark, sf_dir), QUOTA_TOTAL)
    return sampling.quota_sample(docs, quotas, "lang", "doc_id")


HASHED = "CAST('0x' || substr(md5('42/' || doc_id), 1, 15) AS BIGINT)"


@query(
    "quota_sample",
    f"""WITH {QUOTA_SQL}, d AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {HASHED}, doc_id) AS rk FROM documents)
    SELECT doc_id, lang FROM d JOIN q ON q.label = d.lang WHERE rk <= quota""",
)
def quota_sample(spark, sf_dir):
    return quota_rows(spark, sf_dir)


@query(
    "quota_sample_sizes",
    f"WITH {QUOTA_SQL} SELECT label AS lang, least(n, quota) AS n FROM q WHERE quota > 0",
)
def quota_sample_sizes(spark, sf_dir):
    return quota_rows(spark, sf_dir).groupBy("lang").agg(F.count("*").alias("n"))


@query(
    "even_split_sizes",
    """SELECT part::INTEGER AS part, (SELECT count(*) FROM documents) // 7
        + (part < (SELECT count(*) FROM documents) % 7)::INT AS n FROM range(7) t(part)""",
)
def even_split_sizes(spark, sf_dir):
    docs = B.table(spark, sf_dir, "documents").select("doc_id")
    return sampling.even_split(docs, 7, "doc_id").groupBy("part").agg(F.count("*").alias("n"))


@query(
    "even_split",
    f"SELECT doc_id, CAST((row_number() OVER (ORDER BY {HASHED}, doc_id) - 1) % 7 AS INTEGER) AS part FROM documents",
)
def even_split(spark, sf_dir):
    return sampling.even_split(B.table(spark, sf_dir, "documents").select("doc_id"), 7, "doc_id")
