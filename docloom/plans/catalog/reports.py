"""Analytics over query logs, feedback, documents and tenants."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from docloom.functions import text as tx
from docloom.operators import analytics as an
from docloom.operators import sketches as sk
from docloom.plans import views as v
from docloom.plans.registry import cte, query
from docloom.plans.tables import Tables
from docloom.scale import one_row
from docloom.session import materialize


def doc_status(t: Tables):
    """Documents with a processing status, size and score taken from labels."""
    scored = t.labels.select("doc_id", (F.col("quality") * 0.5 + 0.25).alias("parse_score"))
    status = F.element_at(F.array(F.lit("done"), F.lit("pending"), F.lit("failed")), (F.col("doc_id") % 3 + 1).cast("int"))
    return (
        t.documents.select(
            "doc_id", "source", "lang", "n_chars", status.alias("status"),
            F.ceil(F.col("n_chars") / 500).alias("chunk_count"),
        )
        .join(scored, "doc_id", "left")
        .na.fill(0.0, ["parse_score"])
    )


cte(
    "doc_status",
    """SELECT d.doc_id, source, lang, n_chars, ['done', 'pending', 'failed'][d.doc_id % 3 + 1] AS status,
              CAST(ceil(n_chars / 500.0) AS BIGINT) AS chunk_count,
              coalesce(quality * 0.5::DOUBLE + 0.25, 0.0)::DOUBLE AS parse_score
       FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""",
)


@query(
    "overview",
    """SELECT d.*, q.* FROM
         (SELECT count(*) AS documents, count(*) FILTER (status = 'done') AS done_documents FROM doc_status) d,
         (SELECT count(*) AS queries, count(DISTINCT user_id) AS active_users, round(avg(latency_ms), 6) AS avg_latency_ms,
                 round(count(*) FILTER (cache_hit) / count(*)::DOUBLE, 4) AS cache_hit_rate FROM query_log) q""",
    ("doc_status", "query_log"),
)
def _(t: Tables):
    return an.overview(doc_status(t), v.query_log(t))


@query(
    "rag_metrics",
    """SELECT l.*, e.*, f.*, round(likes / (likes + dislikes)::DOUBLE, 4) AS like_ratio FROM
        (SELECT count(*) AS queries, round(avg(confidence), 6) AS avg_confidence, round(avg(latency_ms), 6) AS avg_latency_ms
         FROM query_log WHERE created_at >= TIMESTAMP '2024-01-24 00:00:00') l,
        (SELECT round(avg(quality), 6) AS avg_quality, round(avg(toxic), 6) AS avg_toxic FROM labels) e,
        (SELECT count(*) FILTER (feedback = 'like') AS likes, count(*) FILTER (feedback = 'dislike') AS dislikes
         FROM feedback WHERE created_at >= TIMESTAMP '2024-01-24 00:00:00') f""",
    ("query_log", "feedback"),
)
def _(t: Tables):
    return an.rag_metrics(
        an.since(v.query_log(t), "created_at", v.AS_OF, "7 DAYS"),
        t.labels,
        an.since(v.feedback(t), "created_at", v.AS_OF, "7 DAYS"),
    )


@query(
    "daily_series",
    """SELECT CAST(created_at AS DATE) AS day, count(*) AS queries, round(avg(latency_ms), 6) AS avg_latency_ms,
              round(avg(confidence), 6) AS avg_score FROM query_log GROUP BY 1""",
    ("query_log",),
)
def _(t: Tables):
    return an.daily_series(v.query_log(t))


@query(
    "cache_report",
    """SELECT layer, count(*) FILTER (hit) AS hits, count(*) FILTER (NOT hit) AS misses,
              round(count(*) FILTER (hit) / count(*)::DOUBLE, 4) AS hit_rate
       FROM (SELECT concat('l', k % 4 + 1) AS layer, cache_hit AS hit FROM query_log) GROUP BY ROLLUP (layer)""",
    ("query_log",),
)
def _(t: Tables):
    lookups = v.query_log(t).select(
        F.concat(F.lit("l"), F.col("k") % 4 + 1).alias("layer"), F.col("cache_hit").alias("hit")
    )
    return an.cache_report(lookups)


@query(
    "documents_by_status",
    """SELECT s.status, coalesce(n, 0) AS documents, coalesce(chunks, 0) AS chunks, avg_parse_score
       FROM (VALUES ('pending'), ('processing'), ('done'), ('failed')) AS s(status)
       LEFT JOIN (SELECT status, count(*) AS n, CAST(sum(chunk_count) AS BIGINT) AS chunks,
                         round(avg(parse_score) FILTER (parse_score > 0), 6) AS avg_parse_score
                  FROM doc_status GROUP BY 1) d ON d.status = s.status""",
    ("doc_status",),
)
def _(t: Tables):
    names = t.spark.createDataFrame([("pending",), ("processing",), ("done",), ("failed",)], "status string")
    return an.documents_by_status(doc_status(t), names)


@query(
    "score_histogram",
    "SELECT CAST(least(floor(parse_score * 10), 9) AS INT) AS bin, count(*) AS n FROM doc_status GROUP BY 1",
    ("doc_status",),
)
def _(t: Tables):
    return an.score_histogram(doc_status(t), "parse_score")


@query(
    "queries_per_minute",
    """SELECT date_trunc('minute', created_at) AS minute, count(*) AS queries FROM query_log
       WHERE created_at >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 24 HOURS GROUP BY 1""",
    ("query_log",),
)
def _(t: Tables):
    return an.per_minute(an.since(v.query_log(t), "created_at", v.AS_OF, "24 HOURS"))


@query(
    "feedback_stats",
    """SELECT total, likes, dislikes, round(likes / greatest(dislikes, 1)::DOUBLE, 2) AS ratio,
              round(likes / (likes + dislikes)::DOUBLE, 4) AS satisfaction
       FROM (SELECT count(*) AS total, count(*) FILTER (feedback = 'like') AS likes,
                    count(*) FILTER (feedback = 'dislike') AS dislikes FROM feedback)""",
    ("feedback",),
)
def _(t: Tables):
    return an.feedback_stats(v.feedback(t))


@query(
    "dislike_reasons",
    "SELECT reason, count(*) AS n FROM feedback WHERE feedback = 'dislike' GROUP BY 1",
    ("feedback",),
)
def _(t: Tables):
    return an.dislike_reasons(v.feedback(t))


@query(
    "most_disliked",
    """SELECT question, count(*) AS dislikes FROM feedback f LEFT JOIN query_log q USING (log_id)
       WHERE feedback = 'dislike' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""",
    ("feedback",),
)
def _(t: Tables):
    log = v.query_log(t).select("log_id", "question")
    return an.most_disliked(v.feedback(t).join(log, "log_id", "left"))


@query("count_by_tenant", "SELECT tenant_id, count(*) AS n FROM files GROUP BY 1", ("files",))
def _(t: Tables):
    return an.count_by(v.files(t), "tenant_id")


def _sql_pct(group: str) -> str:
    key, part = (f"{group}, ", f"PARTITION BY {group}") if group else ("", "")
    by = f"GROUP BY {group}" if group else ""
    return f"""SELECT {key}max(latency_ms) FILTER (r = least(floor(n * 0.50), n - 1)) AS p50,
          max(latency_ms) FILTER (r = least(floor(n * 0.95), n - 1)) AS p95,
          max(latency_ms) FILTER (r = least(floor(n * 0.99), n - 1)) AS p99
        FROM (SELECT {key}latency_ms, row_number() OVER ({part} ORDER BY latency_ms) - 1 AS r,
                     count(*) OVER ({part}) AS n FROM query_log) {by}"""


@query("latency_percentiles", _sql_pct(""), ("query_log",))
def _(t: Tables):
    return an.latency_percentiles(v.query_log(t))


@query("latency_percentiles_by_endpoint", _sql_pct("endpoint"), ("query_log",))
def _(t: Tables):
    return an.latency_percentiles(v.query_log(t), by="endpoint")


@query(
    "endpoint_report",
    """SELECT endpoint, count(*) AS requests, count(*) FILTER (status_code >= 400) AS errors,
              CAST(sum(k) AS BIGINT) AS tokens, count(*) FILTER (k > 0) AS model_calls FROM query_log GROUP BY 1""",
    ("query_log",),
)
def _(t: Tables):
    return an.endpoint_report(v.query_log(t).withColumnRenamed("k", "tokens"))


def quality_records(t: Tables):
    votes = F.when(F.col("endpoint") == "/api/purchase", "like").when(F.col("status_code") == 500, "dislike")
    return v.query_log(t).withColumn("feedback", votes.otherwise(""))


cte(
    "quality_records",
    """SELECT *, CASE WHEN endpoint = '/api/purchase' THEN 'like' WHEN status_code = 500 THEN 'dislike' ELSE '' END AS feedback
       FROM query_log""",
    ("query_log",),
)
cte(
    "quality_summary",
    """SELECT r.*, l.* FROM
        (SELECT count(*) AS recent_queries,
                round(count(*) FILTER (feedback = 'like') / greatest(count(*) FILTER (feedback IN ('like', 'dislike')), 1)::DOUBLE, 6) AS satisfaction_rate,
                round(avg(confidence), 4) AS avg_confidence, round(avg(latency_ms), 0) AS avg_latency_ms
         FROM (SELECT * FROM quality_records ORDER BY created_at DESC, log_id DESC LIMIT 1000)) r,
        (SELECT count(*) AS total_queries, count(*) FILTER (feedback = 'like') AS total_likes,
                count(*) FILTER (feedback = 'dislike') AS total_dislikes FROM quality_records) l""",
    ("quality_records",),
)
cte(
    "clusters",
    """SELECT pattern, round(a, 4) AS avg_confidence, samples FROM
         (SELECT trim(lower(substr(question, 1, 50))) AS pattern, avg(confidence) AS a, count(*) AS samples
          FROM query_log GROUP BY 1) WHERE samples >= 5 AND a < 0.3""",
    ("query_log",),
)


@query("quality_summary", "SELECT * FROM quality_summary", ("quality_summary",))
def _(t: Tables):
    return an.quality_summary(quality_records(t))


@query(
    "low_quality_clusters",
    "SELECT * FROM clusters ORDER BY avg_confidence, pattern LIMIT 20",
    ("clusters",),
)
def _(t: Tables):
    return an.low_quality_clusters(v.query_log(t))


@query(
    "disliked_queries",
    """SELECT log_id, substr(question, 1, 500) AS question, confidence FROM quality_records
       WHERE feedback = 'dislike' ORDER BY created_at DESC, log_id DESC LIMIT 50""",
    ("quality_records",),
)
def _(t: Tables):
    return an.disliked(quality_records(t))


@query(
    "ab_test",
    """SELECT experiment, a_n, b_n, round(a_mean, 6) AS a_mean, round(b_mean, 6) AS b_mean, round(z, 6) AS z,
              coalesce(z >= 1.96 AND a_n >= 100 AND b_n >= 100, false) AS concluded,
              CASE WHEN z >= 1.96 AND a_n >= 100 AND b_n >= 100 THEN CASE WHEN b_mean > a_mean THEN 'B' ELSE 'A' END ELSE '' END AS winner
       FROM (SELECT *, CASE WHEN se > 0 THEN abs(b_mean - a_mean) / se END AS z FROM
             (SELECT *, sqrt(a_sd * a_sd / a_n + b_sd * b_sd / b_n) AS se FROM
              (SELECT endpoint AS experiment,
                  count(*) FILTER (user_id % 2 = 0) AS a_n, count(*) FILTER (user_id % 2 = 1) AS b_n,
                  avg(confidence) FILTER (user_id % 2 = 0) AS a_mean, avg(confidence) FILTER (user_id % 2 = 1) AS b_mean,
                  stddev_samp(confidence) FILTER (user_id % 2 = 0) AS a_sd, stddev_samp(confidence) FILTER (user_id % 2 = 1) AS b_sd
               FROM query_log GROUP BY 1)))""",
    ("query_log",),
)
def _(t: Tables):
    results = v.query_log(t).select(
        F.col("endpoint").alias("experiment"),
        F.when(F.col("user_id") % 2 == 0, "A").otherwise("B").alias("arm"),
        F.col("confidence").alias("score"),
    )
    return an.ab_test(results)


def benchmark_runs(t: Tables):
    """Benchmark items judged against the document of the same number."""
    cases = t.benchmark.select(
        F.col("item_id").alias("doc_id"),
        tx.keywords("text").alias("expected"),
        F.concat(F.lit("cat"), F.col("item_id") % 3).alias("category"),
        F.lit(0.2).alias("min_confidence"),
    )
    answers = doc_status(t).select(
        "doc_id", F.col("parse_score").alias("confidence"), (F.col("n_chars") / 10).alias("latency_ms")
    )
    texts = t.documents.select("doc_id", F.col("text").alias("answer"))
    return cases.join(texts, "doc_id", "left").join(answers, "doc_id", "left").na.fill(0.0, ["confidence"])


cte(
    "benchmark_results",
    f"""SELECT item_id AS doc_id, concat('cat', item_id % 3) AS category, confidence, latency_ms, matched,
               matched >= len(expected) * 0.5 AND confidence >= 0.2 AS passed
        FROM (SELECT *, len(list_filter(expected, lambda k: contains(answer, lower(k)))) AS matched FROM
              (SELECT item_id, kws AS expected,
                      lower(coalesce(d.text, '')) AS answer, coalesce(s.parse_score, 0)::DOUBLE AS confidence,
                      s.n_chars / 10.0::DOUBLE AS latency_ms
               FROM (SELECT item_id, (SELECT list(k ORDER BY f) FROM
                         (SELECT k, min(p) AS f FROM (SELECT unnest(ks) AS k, unnest(range(len(ks))) AS p) GROUP BY k)) AS kws
                     FROM (SELECT item_id, regexp_extract_all(text, '{tx.KEYWORD}') AS ks FROM benchmark)) b
               LEFT JOIN documents d ON d.doc_id = item_id LEFT JOIN doc_status s ON s.doc_id = item_id))""",
    ("doc_status",),
)
cte(
    "benchmark_summary",
    """SELECT category, count(*) AS cases, count(*) FILTER (passed) AS passed, count(*) FILTER (NOT passed) AS failed,
              round(count(*) FILTER (passed) / count(*)::DOUBLE, 6) AS pass_rate,
              round(avg(confidence), 4) AS avg_confidence, round(avg(latency_ms), 0) AS avg_latency_ms
       FROM benchmark_results GROUP BY ROLLUP (category)""",
    ("benchmark_results",),
)


@query("benchmark_summary", "SELECT * FROM benchmark_summary", ("benchmark_summary",))
def _(t: Tables):
    return an.benchmark_summary(an.benchmark_results(benchmark_runs(t)))


@query(
    "benchmark_regressions",
    """SELECT category, pass_rate, CASE WHEN category IS NULL THEN 0.6::DOUBLE ELSE 1.0::DOUBLE END AS baseline_rate,
              CASE WHEN category IS NULL THEN 0.6 ELSE 1.0 END - pass_rate > 0.1 AS regressed FROM benchmark_summary""",
    ("benchmark_summary",),
)
def _(t: Tables):
    summary = an.benchmark_summary(an.benchmark_results(benchmark_runs(t)))
    baseline = t.spark.createDataFrame([(None, 0.6)], "category string, pass_rate double")
    return an.regressions(summary, baseline)


@query(
    "parameter_suggestions",
    """SELECT parameter, current_value, suggested_value, confidence, impact FROM (
        SELECT 'CONF_WEIGHT_RERANK' AS parameter, '0.5' AS current_value, '0.6' AS suggested_value, 0.7::DOUBLE AS confidence,
               'medium' AS impact, avg_confidence < 0.4 AS fires FROM quality_summary
        UNION ALL SELECT 'TOP_K', '10', '5', 0.6, 'high', avg_latency_ms > 2000 FROM quality_summary
        UNION ALL SELECT 'CHUNK_SIZE', '500', '800', 0.5, 'medium', (SELECT count(*) FROM clusters) > 5
        UNION ALL SELECT 'RERANKER_MODE', 'simple', 'cross_encoder', 0.8, 'high', satisfaction_rate < 0.7 FROM quality_summary)
       WHERE fires""",
    ("quality_summary", "clusters"),
)
def _(t: Tables):
    return an.parameter_suggestions(
        an.quality_summary(quality_records(t)), an.low_quality_clusters(v.query_log(t), n=None)
    )


@query(
    "quota_report",
    """SELECT tenant_id, documents_used, queries_used, storage_used, max_documents, max_queries_per_day, max_storage_bytes,
              round(storage_used / 1000000.0::DOUBLE, 1) AS storage_mb_used,
              NOT (documents_used >= max_documents OR storage_used >= max_storage_bytes) AS can_upload,
              queries_used < max_queries_per_day AS can_query,
              CASE WHEN documents_used >= max_documents THEN 'documents' WHEN storage_used >= max_storage_bytes THEN 'storage' ELSE '' END AS violation
       FROM (SELECT u.*, coalesce(30 + n_nationkey, 1000)::BIGINT AS max_documents,
                    coalesce(n_nationkey * 3, 10000)::BIGINT AS max_queries_per_day,
                    coalesce(120000, 1000000000)::BIGINT AS max_storage_bytes
             FROM (SELECT tenant_id, CAST(sum(d) AS BIGINT) AS documents_used, CAST(sum(q) AS BIGINT) AS queries_used,
                          CAST(sum(s) AS BIGINT) AS storage_used
                   FROM (SELECT source AS tenant_id, 1 AS d, 0 AS q, n_chars AS s FROM documents
                         UNION ALL SELECT concat('src', user_id % 20), 0, 1, 0 FROM query_log
                         WHERE CAST(created_at AS DATE) = DATE '2024-01-15') GROUP BY 1) u
             LEFT JOIN nation ON concat('src', n_nationkey) = tenant_id)""",
    ("query_log",),
)
def _(t: Tables):
    docs = t.documents.select(F.col("source").alias("tenant_id"), F.col("n_chars").alias("file_size"))
    log = v.query_log(t).withColumn("tenant_id", F.concat(F.lit("src"), F.col("user_id") % 20))
    quotas = t.nation.select(
        F.concat(F.lit("src"), "n_nationkey").alias("tenant_id"),
        (F.col("n_nationkey") + 30).alias("max_documents"),
        (F.col("n_nationkey") * 3).alias("max_queries_per_day"),
        F.lit(120_000).alias("max_storage_bytes"),
    )
    return an.quota_report(docs, log, quotas, "2024-01-15")


@query(
    "chunking_report",
    "SELECT doc_id, count(*) AS chunks, round(avg(char_count), 6) AS avg_chars FROM chunks GROUP BY 1",
    ("chunks",),
)
def _(t: Tables):
    return an.chunking_report(v.chunks(t))


@query(
    "chunk_distribution",
    """SELECT structure_type, language, count(*) AS chunks
       FROM (SELECT structure_type, lang AS language FROM structure_types) GROUP BY CUBE (structure_type, language)""",
    ("structure_types",),
)
def _(t: Tables):
    from docloom.functions import classify as cl

    kinds = v.markup(t).select(cl.structure_type("text").alias("structure_type"), F.col("lang").alias("language"))
    return an.chunk_distribution(kinds)


@query(
    "popular_questions",
    "SELECT question, count(*) AS asked FROM query_log GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5",
    ("query_log",),
)
def _(t: Tables):
    return an.popular_questions(v.query_log(t))


@query(
    "distinct_documents_per_user",
    "SELECT user_id, count(DISTINCT k) AS documents FROM query_log GROUP BY 1",
    ("query_log",),
)
def _(t: Tables):
    return v.query_log(t).select("user_id", "k").distinct().groupBy("user_id").agg(F.count("*").alias("documents"))


# --- sketches -----------------------------------------------------------------------
QUANTILES = {"p50": 0.5, "p95": 0.95, "p99": 0.99}


def ranks_hold(estimates, records, keys):
    """Whether each estimated quantile has its rank among the records, but for the sketches' error."""
    joined = records.join(estimates.withColumnRenamed("n", "_n"), list(keys))
    checks = []
    for name, q in QUANTILES.items():
        below, upto = F.count_if(F.col("latency_ms") < F.col(name)), F.count_if(F.col("latency_ms") <= F.col(name))
        checks.append((below / F.count("*") <= q + sk.KLL_ERROR) & (upto / F.count("*") >= q - sk.KLL_ERROR))
    right = checks[0] & checks[1] & checks[2] & (F.count("*") == F.first("_n"))
    return joined.groupBy(*keys).agg(F.count("*").alias("requests"), right.alias("within_bound"))


def timed_log(t: Tables):
    return v.query_log(t).select("endpoint", "user_id", "latency_ms", F.col("created_at").cast("timestamp").alias("ts"))


@query(
    "latency_sketches",
    """SELECT CAST(created_at AS DATE) AS day, endpoint, count(*) AS requests, true AS within_bound FROM query_log GROUP BY 1, 2
       UNION ALL SELECT NULL, endpoint, count(*), true FROM query_log GROUP BY 2""",
    ("query_log",),
)
def _(t: Tables):
    """Quantiles by day and for all time from the sketches of minutes, held against the exact ranks."""
    log = timed_log(t).withColumn("day", F.to_date("ts"))
    slices = materialize(sk.quantile_slices(log, ["endpoint"], "latency_ms"), "minutes").withColumn("day", F.to_date("slice"))
    by_day = ranks_hold(sk.merged_quantiles(slices, ["day", "endpoint"], QUANTILES), log, ("day", "endpoint"))
    ever = ranks_hold(sk.merged_quantiles(slices, ["endpoint"], QUANTILES), log, ("endpoint",))
    return by_day.unionByName(ever.withColumn("day", F.lit(None).cast("date")))


@query(
    "distinct_sketches",
    """SELECT endpoint, true AS within_bound, true AS any_slicing FROM query_log GROUP BY 1
       UNION ALL SELECT 'shared', true, true""",
    ("query_log",),
)
def _(t: Tables):
    """Users per endpoint, and users of all endpoints, from sketches of hours and of days."""
    log = timed_log(t)
    hours = materialize(sk.distinct_slices(log, ["endpoint"], "user_id"), "hours")
    days = sk.distinct_slices(log, ["endpoint"], "user_id", width="1 day")
    exact = log.groupBy("endpoint").agg(F.count_distinct("user_id").alias("exact"))
    both = sk.merged_distinct(hours, ["endpoint"]).join(
        sk.merged_distinct(days, ["endpoint"]).withColumnRenamed("distinct", "by_day"), "endpoint"
    ).join(exact, "endpoint")
    near = F.abs(F.col("distinct") - F.col("exact")) <= F.greatest(F.lit(1.0), 0.05 * F.col("exact"))
    each = both.select("endpoint", near.alias("within_bound"), (F.col("distinct") == F.col("by_day")).alias("any_slicing"))
    kinds = log.select("endpoint").distinct().count()
    everywhere = log.groupBy("user_id").agg(F.count_distinct("endpoint").alias("n")).filter(F.col("n") == kinds)
    shared = one_row(
        everywhere.agg(F.count("*").alias("exact")), sk.shared_distinct(hours, "endpoint"),
        sk.shared_distinct(days, "endpoint").withColumnRenamed("shared", "by_day"),
        log.agg(F.count_distinct("user_id").alias("all")),
    )
    # The error of an intersection follows the size of the union.
    near = F.abs(F.col("shared") - F.col("exact")) <= F.greatest(F.lit(1.0), 0.05 * F.col("all"))
    return each.unionByName(
        shared.select(F.lit("shared").alias("endpoint"), near.alias("within_bound"), (F.col("shared") == F.col("by_day")).alias("any_slicing"))
    )


@query(
    "last_records_quality",
    """SELECT n AS asked, count(*) AS queries, count(*) FILTER (feedback = 'like') AS likes, count(*) FILTER (feedback = 'dislike') AS dislikes,
              round(avg(confidence), 6) AS avg_confidence
       FROM (SELECT *, row_number() OVER (ORDER BY created_at DESC, log_id DESC) AS pos FROM quality_records), (VALUES (100), (1000), (10000)) v(n)
       WHERE pos <= n GROUP BY 1""",
    ("quality_records",),
)
def _(t: Tables):
    records = quality_records(t)
    parts = [an.quality_of_last(records, n).withColumn("asked", F.lit(n)) for n in (100, 1000, 10_000)]
    return reduce(lambda a, b: a.unionByName(b), parts)
