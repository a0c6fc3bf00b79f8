"""Reports over logs, feedback, documents and tenants.

All reports are conditional aggregates: one pass per table, map-side combined,
so a tenant or endpoint holding a third of the rows costs no more than another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.functions import text as tx
from docloom.scale import one_row, rank_values


def _ratio(part: Column, whole: Column, digits: int = 4) -> Column:
    return F.round(F.when(whole > 0, part / whole).otherwise(F.lit(0.0)), digits)


def since(df: DataFrame, ts: str, as_of: str, interval: str) -> DataFrame:
    """Rows of the last ``interval`` before ``as_of`` (given, never now())."""
    return df.filter(F.col(ts) >= F.expr(f"TIMESTAMP_NTZ '{as_of}' - INTERVAL {interval}"))


def overview(documents: DataFrame, log: DataFrame) -> DataFrame:
    docs = documents.agg(
        F.count("*").alias("documents"), F.count_if(F.col("status") == "done").alias("done_documents")
    )
    # Distinct users first: grouping is map-side combined and spreads over the
    # cluster, where count_distinct beside other aggregates expands every row.
    users = log.select("user_id").distinct().agg(F.count("*").alias("active_users"))
    queries = log.agg(
        F.count("*").alias("queries"),
        F.round(F.avg("latency_ms"), 6).alias("avg_latency_ms"),
        _ratio(F.count_if("cache_hit"), F.count("*")).alias("cache_hit_rate"),
    )
    return one_row(docs, queries, users)


def rag_metrics(log: DataFrame, evaluations: DataFrame, feedback: DataFrame) -> DataFrame:
    quality = log.agg(
        F.count("*").alias("queries"),
        F.round(F.avg("confidence"), 6).alias("avg_confidence"),
        F.round(F.avg("latency_ms"), 6).alias("avg_latency_ms"),
    )
    scores = evaluations.agg(
        *[F.round(F.avg(c), 6).alias(f"avg_{c}") for c in evaluations.columns if c != "doc_id"]
    )
    votes = feedback.agg(
        F.count_if(F.col("feedback") == "like").alias("likes"),
        F.count_if(F.col("feedback") == "dislike").alias("dislikes"),
    )
    return one_row(quality, scores, votes).withColumn(
        "like_ratio", _ratio(F.col("likes"), F.col("likes") + F.col("dislikes"))
    )


def daily_series(log: DataFrame) -> DataFrame:
    return log.groupBy(F.to_date("created_at").alias("day")).agg(
        F.count("*").alias("queries"),
        F.round(F.avg("latency_ms"), 6).alias("avg_latency_ms"),
        F.round(F.avg("confidence"), 6).alias("avg_score"),
    )


def cache_report(lookups: DataFrame) -> DataFrame:
    """Hits and misses per layer and overall (layer NULL)."""
    return lookups.rollup("layer").agg(
        F.count_if("hit").alias("hits"),
        F.count_if(~F.col("hit")).alias("misses"),
        _ratio(F.count_if("hit"), F.count("*")).alias("hit_rate"),
    )


def documents_by_status(documents: DataFrame, statuses: DataFrame) -> DataFrame:
    """Every status appears, with zeros where no document has it."""
    per_status = documents.groupBy("status").agg(
        F.count("*").alias("documents"),
        F.sum("chunk_count").alias("chunks"),
        F.round(F.avg(F.when(F.col("parse_score") > 0, F.col("parse_score"))), 6).alias("avg_parse_score"),
    )
    return statuses.join(per_status, "status", "left").na.fill(0, ["documents", "chunks"])


def score_histogram(df: DataFrame, score: str, bins: int = 10) -> DataFrame:
    bin_ = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).cast("int")
    return df.groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"))


def per_minute(log: DataFrame) -> DataFrame:
    minute = F.date_trunc("minute", "created_at").cast("timestamp_ntz")
    return log.groupBy(minute.alias("minute")).agg(F.count("*").alias("queries"))


def feedback_stats(feedback: DataFrame) -> DataFrame:
    like, dislike = F.count_if(F.col("feedback") == "like"), F.count_if(F.col("feedback") == "dislike")
    return feedback.agg(
        F.count("*").alias("total"),
        like.alias("likes"),
        dislike.alias("dislikes"),
        F.round(like / F.greatest(dislike, F.lit(1)), 2).alias("ratio"),
        _ratio(like, like + dislike).alias("satisfaction"),
    )


def dislike_reasons(feedback: DataFrame) -> DataFrame:
    return (
        feedback.filter("feedback = 'dislike'")
        .groupBy("reason")
        .agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), "reason")
    )


def most_disliked(feedback_with_query: DataFrame, n: int = 10) -> DataFrame:
    return (
        feedback_with_query.filter("feedback = 'dislike'")
        .groupBy("question")
        .agg(F.count("*").alias("dislikes"))
        .orderBy(F.desc("dislikes"), "question")
        .limit(n)
    )


def count_by(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def latency_percentiles(requests: DataFrame, by: str | None = None) -> DataFrame:
    return rank_values(
        requests, [by] if by else [], "latency_ms", {"p50": 0.50, "p95": 0.95, "p99": 0.99}
    )


def endpoint_report(requests: DataFrame) -> DataFrame:
    return requests.groupBy("endpoint").agg(
        F.count("*").alias("requests"),
        F.count_if(F.col("status_code") >= 400).alias("errors"),
        F.sum("tokens").alias("tokens"),
        F.count_if(F.col("tokens") > 0).alias("model_calls"),
    )


def quality_summary(records: DataFrame, recent: int = 1000) -> DataFrame:
    """Averages over the last ``recent`` records beside lifetime totals."""
    like, dislike = F.col("feedback") == "like", F.col("feedback") == "dislike"
    last = records.orderBy(F.desc("created_at"), F.desc("log_id")).limit(recent)
    window = last.agg(
        F.count("*").alias("recent_queries"),
        F.round(
            F.count_if(like) / F.greatest(F.count_if(like) + F.count_if(dislike), F.lit(1)), 6
        ).alias("satisfaction_rate"),
        F.round(F.avg("confidence"), 4).alias("avg_confidence"),
        F.round(F.avg("latency_ms"), 0).alias("avg_latency_ms"),
    )
    lifetime = records.agg(
        F.count("*").alias("total_queries"),
        F.count_if(like).alias("total_likes"),
        F.count_if(dislike).alias("total_dislikes"),
    )
    return one_row(window, lifetime)


def low_quality_clusters(records: DataFrame, threshold: float = 0.3, min_samples: int = 5,
                         n: int | None = 20, pattern_chars: int = 50) -> DataFrame:
    """Openings of questions with low confidence. Questions are told apart by their first
    ``pattern_chars`` characters, and the ``n`` worst are listed (all if None)."""
    key = F.btrim(F.lower(F.substring("question", 1, pattern_chars)))
    found = (
        records.groupBy(key.alias("pattern"))
        .agg(F.avg("confidence").alias("_avg"), F.count("*").alias("samples"))
        .filter((F.col("samples") >= min_samples) & (F.col("_avg") < threshold))
        .select("pattern", F.round("_avg", 4).alias("avg_confidence"), "samples")
    )
    return found if n is None else found.orderBy("avg_confidence", "pattern").limit(n)


def disliked(records: DataFrame, limit: int = 50, max_chars: int = 500) -> DataFrame:
    """The newest disliked questions: ``limit`` of them, cut to ``max_chars`` characters."""
    newest = records.filter("feedback = 'dislike'").orderBy(F.desc("created_at"), F.desc("log_id")).limit(limit)
    return newest.select("log_id", F.substring("question", 1, max_chars).alias("question"), "confidence")


def ab_test(results: DataFrame, min_samples: int = 100, z_needed: float = 1.96) -> DataFrame:
    """Both arms of every experiment on one row, with the z-test verdict."""

    def arm(name: str) -> list[Column]:
        score = F.when(F.col("arm") == name, F.col("score"))
        tag = name.lower()
        return [
            F.count(score).alias(f"{tag}_n"),
            F.avg(score).alias(f"{tag}_mean"),
            F.stddev_samp(score).alias(f"{tag}_sd"),
        ]

    arms = results.groupBy("experiment").agg(*arm("A"), *arm("B"))
    spread = F.sqrt(
        F.pow("a_sd", F.lit(2)) / F.col("a_n") + F.pow("b_sd", F.lit(2)) / F.col("b_n")
    )
    z = F.when(spread > 0, F.abs(F.col("b_mean") - F.col("a_mean")) / spread)
    done = (z >= z_needed) & (F.col("a_n") >= min_samples) & (F.col("b_n") >= min_samples)
    return arms.select(
        "experiment",
        "a_n",
        "b_n",
        F.round("a_mean", 6).alias("a_mean"),
        F.round("b_mean", 6).alias("b_mean"),
        F.round(z, 6).alias("z"),
        F.coalesce(done, F.lit(False)).alias("concluded"),
        F.when(done, F.when(F.col("b_mean") > F.col("a_mean"), "B").otherwise("A"))
        .otherwise("").alias("winner"),
    )


def benchmark_results(runs: DataFrame) -> DataFrame:
    """Judge answers: half of the expected keywords and enough confidence."""
    matched = tx.bind(
        F.lower(F.coalesce("answer", F.lit(""))),
        lambda answer: F.size(F.filter("expected", lambda k: F.contains(answer, F.lower(k)))),
    )
    passed = (matched >= F.size("expected") * 0.5) & (F.col("confidence") >= F.col("min_confidence"))
    return runs.withColumn("matched", matched).withColumn("passed", passed)


def benchmark_summary(results: DataFrame) -> DataFrame:
    """Totals per category and overall (category NULL)."""
    return results.rollup("category").agg(
        F.count("*").alias("cases"),
        F.count_if("passed").alias("passed"),
        F.count_if(~F.col("passed")).alias("failed"),
        _ratio(F.count_if("passed"), F.count("*"), 6).alias("pass_rate"),
        F.round(F.avg("confidence"), 4).alias("avg_confidence"),
        F.round(F.avg("latency_ms"), 0).alias("avg_latency_ms"),
    )


def regressions(current: DataFrame, baseline: DataFrame, threshold: float = 0.1) -> DataFrame:
    """Compare pass rates with a stored baseline per category; NULL = overall."""
    base = baseline.select(F.col("category"), F.col("pass_rate").alias("baseline_rate"))
    rate = F.coalesce("baseline_rate", F.lit(1.0))
    return (
        current.alias("c")
        .join(base.alias("b"), F.col("c.category").eqNullSafe(F.col("b.category")), "left")
        .select(
            "c.category", "pass_rate", rate.alias("baseline_rate"),
            (rate - F.col("pass_rate") > threshold).alias("regressed"),
        )
    )


def parameter_suggestions(summary: DataFrame, clusters: DataFrame) -> DataFrame:
    """Rules over the quality summary; one row per rule that fires."""
    state = one_row(
        summary.select("avg_confidence", "avg_latency_ms", "satisfaction_rate"),
        clusters.agg(F.count("*").alias("clusters")),
    )

    # Parameter, condition, current, suggested, confidence, impact.
    rules = [
        ("CONF_WEIGHT_RERANK", F.col("avg_confidence") < 0.4, "0.5", "0.6", 0.7, "medium"),
        ("TOP_K", F.col("avg_latency_ms") > 2000, "10", "5", 0.6, "high"),
        ("CHUNK_SIZE", F.col("clusters") > 5, "500", "800", 0.5, "medium"),
        ("RERANKER_MODE", F.col("satisfaction_rate") < 0.7, "simple", "cross_encoder", 0.8, "high"),
    ]
    fired = F.array(
        *[
            F.when(
                cond,
                F.struct(
                    F.lit(p).alias("parameter"), F.lit(cur).alias("current_value"),
                    F.lit(new).alias("suggested_value"), F.lit(conf).alias("confidence"),
                    F.lit(impact).alias("impact"),
                ),
            )
            for p, cond, cur, new, conf, impact in rules
        ]
    )
    return state.select(F.explode(F.array_compact(fired)).alias("s")).select("s.*")


# Limits of a tenant without its own quota.
DEFAULT_QUOTA = {"max_documents": 1000, "max_queries_per_day": 10_000, "max_storage_bytes": 1_000_000_000}


def quota_report(documents: DataFrame, log: DataFrame, quotas: DataFrame, day: str) -> DataFrame:
    """Usage against limits per tenant, with upload and query verdicts."""
    stored = documents.groupBy("tenant_id").agg(
        F.count("*").alias("documents_used"), F.sum("file_size").alias("storage_used"),
        F.lit(0).cast("long").alias("queries_used"),
    )
    asked = (
        log.filter(F.to_date("created_at") == F.lit(day).cast("date"))
        .groupBy("tenant_id")
        .agg(
            F.lit(0).cast("long").alias("documents_used"), F.lit(0).cast("long").alias("storage_used"),
            F.count("*").alias("queries_used"),
        )
    )
    used = stored.unionByName(asked).groupBy("tenant_id").agg(
        *[F.sum(c).alias(c) for c in ("documents_used", "storage_used", "queries_used")]
    )
    limits = [F.coalesce(c, F.lit(d)).cast("long").alias(c) for c, d in DEFAULT_QUOTA.items()]
    joined = used.join(quotas, "tenant_id", "left").select(
        "tenant_id", "documents_used", "queries_used", "storage_used", *limits
    )
    over_docs = F.col("documents_used") >= F.col("max_documents")
    over_storage = F.col("storage_used") >= F.col("max_storage_bytes")
    return joined.withColumns(
        {
            "storage_mb_used": F.round(F.col("storage_used") / 1_000_000, 1),
            "can_upload": ~(over_docs | over_storage),
            "can_query": F.col("queries_used") < F.col("max_queries_per_day"),
            "violation": F.when(over_docs, "documents").when(over_storage, "storage").otherwise(""),
        }
    )


def chunking_report(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("doc_id").agg(
        F.count("*").alias("chunks"), F.round(F.avg("char_count"), 6).alias("avg_chars")
    )


def chunk_distribution(chunks: DataFrame) -> DataFrame:
    """Counts by structure and language, with both margins and the total."""
    return chunks.cube("structure_type", "language").agg(F.count("*").alias("chunks"))


def popular_questions(log: DataFrame, n: int = 5) -> DataFrame:
    return (
        log.groupBy("question").agg(F.count("*").alias("asked")).orderBy(F.desc("asked"), "question").limit(n)
    )


def last_records(records: DataFrame, n: int, ts: str = "created_at", tie: str = "log_id", width: str = "1 hour") -> DataFrame:
    """The ``n`` newest records (ties: largest ``tie``; nulls oldest).

    Records are counted by slices of time. Slices that the last n cover whole are taken as they
    are; only of the slice that n ends in the newest rows are picked, n at most, so no
    task holds all records. A row per slice is put in order.
    """
    if n <= 0:
        return records.limit(0)
    slot = F.coalesce(F.window(F.col(ts).cast("timestamp"), width)["start"], F.lit("0001-01-01").cast("timestamp"))
    placed = records.withColumn("_slice", slot)
    newer = Window.orderBy(F.desc("_slice")).rowsBetween(Window.unboundedPreceding, -1)
    counted = placed.groupBy("_slice").agg(F.count("*").alias("_n")).withColumn("_newer", F.coalesce(F.sum("_n").over(newer), F.lit(0)))
    edge = counted.filter((F.col("_newer") < n) & (F.col("_newer") + F.col("_n") >= n)).first()
    if edge is None:
        return records
    whole = placed.filter(F.col("_slice") > F.lit(edge["_slice"])).drop("_slice")
    part = placed.filter(F.col("_slice") == F.lit(edge["_slice"])).drop("_slice")
    return whole.unionByName(part.orderBy(F.desc_nulls_last(ts), F.desc_nulls_last(tie)).limit(n - edge["_newer"]))


def quality_of_last(records: DataFrame, n: int, ts: str = "created_at", tie: str = "log_id") -> DataFrame:
    """Counts of votes and mean confidence of the ``n`` newest records."""
    return last_records(records, n, ts, tie).agg(
        F.count("*").alias("queries"), F.count_if(F.col("feedback") == "like").alias("likes"),
        F.count_if(F.col("feedback") == "dislike").alias("dislikes"), F.round(F.avg("confidence"), 6).alias("avg_confidence"),
    )
