"""Files, stored rows and streams."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.functions import text as tx
from docloom.functions import vectors as vx
from docloom.operators import ranking as rk
from docloom.operators import sketches as qs
from docloom.plans import views as v
from docloom.plans.catalog import quality  # noqa: F401  registers the rules of chunks
from docloom.plans.catalog.chunks import csv_files
from docloom.plans.catalog.reports import QUANTILES, doc_status, quality_records, ranks_hold
from docloom.plans.catalog.search import clean_hits
from docloom.plans.registry import CTES, cte, query, sql_strip
from docloom.plans.tables import Tables
from docloom.sources import files as fl
from docloom.sources import sinks as sk
from docloom.streaming import streams as ss


# --- files --------------------------------------------------------------------------
@query("text_corpus", "SELECT doc_id, text FROM documents")
def _(t: Tables):
    return t.documents.select("doc_id", fl.decode_text(F.encode("text", "UTF-8")).alias("text"))


@query("csv_markdown", "SELECT doc_id, md FROM csv_tables", ("csv_tables",))
def _(t: Tables):
    return csv_files(t).select("doc_id", fl.csv_markdown("content").alias("md")).filter("md <> ''")


@query(
    "manifest",
    """SELECT filename, CASE lower(split_part(filename, '.', 2)) WHEN 'htm' THEN 'html' ELSE lower(split_part(filename, '.', 2)) END AS file_type,
              CAST(strlen(text) AS BIGINT) AS file_size, sha256(text) AS content_hash, 'pending' AS status FROM files""",
    ("files",),
)
def _(t: Tables):
    stored = v.files(t).select(F.concat(F.lit("/in/"), "filename").alias("path"), F.encode("text", "UTF-8").alias("content"))
    return fl.manifest(stored)


@query(
    "allowed_files",
    "SELECT doc_id, filename FROM files WHERE lower(split_part(filename, '.', 2)) IN ('pdf','docx','pptx','xlsx','csv','txt','md','html','json','xml','zip')",
    ("files",),
)
def _(t: Tables):
    return v.files(t).filter(fl.allowed("filename")).select("doc_id", "filename")


@query("pending_documents", "SELECT doc_id FROM doc_status WHERE status = 'pending'", ("doc_status",))
def _(t: Tables):
    return fl.pending(doc_status(t)).select("doc_id")


_IP = "concat(k + 100, '.', user_id % 40, '.', user_id % 3, '.', event_id % 250)"


@query(
    "url_admission",
    """SELECT id, reason = '' AS admitted, reason FROM
        (SELECT concat('p', page_id) AS id, CASE WHEN regexp_matches(url, '^(?i:https?):') THEN '' ELSE 'bad_scheme' END AS reason FROM pages
         UNION ALL
         SELECT concat('e', event_id), CASE WHEN event_type = 'error' THEN 'bad_scheme'
                WHEN a IN (0, 10, 127) OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b = 168) OR (a = 169 AND b = 254)
                  OR (a = 192 AND b = 0 AND c IN (0, 2)) OR (a = 198 AND b IN (18, 19)) OR (a = 198 AND b = 51 AND c = 100)
                  OR (a = 203 AND b = 0 AND c = 113) OR a >= 240 THEN 'private_address' ELSE '' END
         FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) + 100 AS a, user_id % 40 AS b, user_id % 3 AS c FROM events))""",
)
def _(t: Tables):
    k = F.get_json_object("props", "$.k").cast("int")
    host = F.concat_ws(".", k + 100, F.col("user_id") % 40, F.col("user_id") % 3, F.col("event_id") % 250)
    scheme = F.when(F.col("event_type") == "error", "ftp").otherwise("http")
    links = t.pages.select(F.concat(F.lit("p"), "page_id").alias("id"), "url").unionByName(
        t.events.select(F.concat(F.lit("e"), "event_id").alias("id"), F.concat(scheme, F.lit("://"), host, F.lit(":80/x")).alias("url"))
    )
    return links.select("id", fl.url_admission("url").alias("a")).select("id", "a.admitted", "a.reason")


# --- stored rows -----------------------------------------------------------------------
@query(
    "vector_rows",
    """SELECT chunk_id, CAST(doc_id AS VARCHAR) AS doc_id, chunk_idx, content AS text, '' AS heading, 'text' AS chunk_type, 0 AS page
       FROM chunks""",
    ("chunks",),
)
def _(t: Tables):
    vectors = v.chunks(t).select("chunk_id", vx.hash_embed("content").alias("vec"))
    return sk.vector_rows(v.chunks(t), vectors).select(
        "chunk_id", "doc_id", "chunk_idx", "text", "heading", "chunk_type", "page"
    )


@query(
    "query_log_sources",
    "SELECT query_id, rnk + 1 AS idx, substr(text, 1, 50) AS text, CAST(id AS VARCHAR) AS doc_id FROM clean_hits",
    ("clean_hits",),
)
def _(t: Tables):
    rows = sk.query_log_rows(rk.sources(clean_hits(t)), preview=50)
    return rows.select("query_id", F.explode("sources").alias("s")).select("query_id", "s.idx", "s.text", "s.doc_id")


@query(
    "append_new",
    "SELECT doc_id, lang, source FROM documents WHERE lang IN ('de', 'fr')",
)
def _(t: Tables):
    # A second run with overlapping documents adds only the new ones.
    out = ss.scratch(t.spark, "docs")
    rows = t.documents.select("doc_id", "lang", "source")
    sk.append_new(rows.filter("lang = 'de'"), out, "doc_id")
    sk.append_new(rows.filter("lang IN ('de', 'fr')"), out, "doc_id")
    return t.spark.read.parquet(out)


# --- streams and their batch twins ----------------------------------------------------------
def _events(t: Tables):
    return t.events.withColumn("ts", F.col("ts").cast("timestamp"))


def _stream(t: Tables):
    return ss.read_table_stream(t.spark, t.sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query(
    "stream_throughput",
    """SELECT minute, requests FROM (SELECT date_trunc('minute', ts) AS minute, count(*) AS requests FROM events GROUP BY 1)
       WHERE minute + INTERVAL 1 MINUTE <= (SELECT date_trunc('millisecond', max(ts)) FROM events) - INTERVAL 10 MINUTES""",
)
def _(t: Tables):
    out = ss.run_to_table(ss.throughput(_stream(t)), "throughput")
    return out.select(F.col("minute").cast("timestamp_ntz").alias("minute"), "requests")


@query(
    "rate_violations",
    """SELECT user_id, window_start, requests FROM
       (SELECT user_id, time_bucket(INTERVAL 1 HOUR, ts) AS window_start, count(*) AS requests FROM events GROUP BY 1, 2) WHERE requests > 2""",
)
def _(t: Tables):
    found = ss.rate_violations(_events(t), limit=2, window="1 hour")
    return found.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query(
    "rate_violations_sliding",
    """SELECT user_id, window_start, count(*) AS requests FROM
       (SELECT user_id, time_bucket(INTERVAL 10 MINUTES, ts) - to_minutes(CAST(10 * i AS INT)) AS window_start
        FROM events, range(6) r(i)) GROUP BY 1, 2 HAVING count(*) > 2""",
)
def _(t: Tables):
    found = ss.rate_violations(_events(t), limit=2, window="1 hour", slide="10 minutes")
    return found.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query(
    "stream_rate_violations",
    """SELECT user_id, window_start, requests FROM
       (SELECT user_id, time_bucket(INTERVAL 1 HOUR, ts) AS window_start, count(*) AS requests FROM events GROUP BY 1, 2) WHERE requests > 2
       AND window_start + INTERVAL 1 HOUR <= (SELECT date_trunc('millisecond', max(ts)) FROM events) - INTERVAL 10 MINUTES""",
)
def _(t: Tables):
    out = ss.run_to_table(ss.rate_violations(_stream(t), limit=2, window="1 hour"), "rates")
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


def _uploads(events):
    return events.select("ts", F.concat_ws("-", "event_type", F.col("user_id") % 10).alias("content_hash"))


@query(
    "upload_leaders",
    """SELECT content_hash, slot, min(ts) AS first_at, count(*) AS uploads FROM
       (SELECT concat(event_type, '-', user_id % 10) AS content_hash, CAST(floor(epoch(ts) / 300) AS BIGINT) AS slot, ts FROM events) GROUP BY 1, 2""",
)
def _(t: Tables):
    return ss.upload_leaders(_uploads(t.events))


@query("stream_dedup_uploads")
def _(t: Tables):
    out = ss.run_to_table(ss.dedup_uploads(_uploads(_stream(t))), "uploads")
    return out.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query(
    "user_sessions",
    """SELECT user_id, min(ts) AS started_at, count(*) AS requests FROM
       (SELECT *, sum(CASE WHEN gap IS NULL OR gap >= INTERVAL 12 HOURS THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS n
        FROM (SELECT user_id, ts, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS gap FROM events)) GROUP BY user_id, n""",
)
def _(t: Tables):
    found = ss.sessions(_events(t), gap="12 hours")
    return found.withColumn("started_at", F.col("started_at").cast("timestamp_ntz"))


def newest_histories(t: Tables, stream):
    """The last row that a stream of histories gives of each session."""
    out = ss.scratch(t.spark, "history")
    found: list[str] = []

    def keep(batch, batch_id):
        path = f"{out}/batch={batch_id}"
        batch.write.mode("overwrite").parquet(path)
        found.append(path)

    ss.run_batches(stream, "history-state", keep, mode="update")
    rows = t.spark.read.option("basePath", out).parquet(*found)
    newest = rows.groupBy("conv_id").agg(F.max_by(F.struct("n", "last_turn", "history"), "batch").alias("s"))
    said = F.transform("s.history", lambda m: F.concat(m["turn"].cast("string"), F.lit(" "), m["role"], F.lit(": "), m["content"]))
    return newest.select("conv_id", "s.n", "s.last_turn", F.array_join(said, "\n").alias("history"))


@query(
    "stream_session_history",
    """SELECT conv_id, CAST(count(*) AS INT) AS n, max(turn) AS last_turn,
              string_agg(concat(turn, ' ', role, ': ', text), chr(10) ORDER BY turn) AS history
       FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS pos FROM conversations) WHERE pos <= 40 GROUP BY 1""",
)
def _(t: Tables):
    turns = ss.read_table_stream(t.spark, t.sf_dir, "conversations")
    turns = turns.select("conv_id", "turn", "role", F.col("text").alias("content"))
    return newest_histories(t, ss.session_history(turns))


@query(
    "latest_status",
    "SELECT user_id AS doc_id, arg_max(event_type, (ts, event_type)) AS status, max(ts) AS updated_at FROM events GROUP BY 1",
)
def _(t: Tables):
    return ss.latest_status(t.events.select(F.col("user_id").alias("doc_id"), "ts", F.col("event_type").alias("status")))


@query(
    "rolling_quality",
    """SELECT window_start, count(*) AS queries, count(*) FILTER (feedback = 'like') AS likes, count(*) FILTER (feedback = 'dislike') AS dislikes,
              round(avg(confidence), 6) AS avg_confidence FROM
       (SELECT *, time_bucket(INTERVAL 6 HOURS, created_at) - to_hours(CAST(6 * i AS INT)) AS window_start FROM quality_records, range(4) r(i)) GROUP BY 1""",
    ("quality_records",),
)
def _(t: Tables):
    records = quality_records(t).withColumn("ts", F.col("created_at").cast("timestamp"))
    found = ss.rolling_quality(records)
    return found.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query(
    "retry_failed",
    """SELECT log_id, CAST(CASE WHEN r < 3 THEN r + 1 ELSE r END AS INT) AS retries, r < 3 AS retried FROM (SELECT log_id, k % 6 AS r FROM query_log WHERE status_code = 500)""",
    ("query_log",),
)
def _(t: Tables):
    dead = v.query_log(t).filter("status_code = 500").select("log_id", (F.col("k") % 6).cast("int").alias("retries"))
    again, given_up = ss.retry_failed(dead)
    return again.withColumn("retried", F.lit(True)).unionByName(given_up.withColumn("retried", F.lit(False)))


# The chunk rules of the ingestion: chunks of 50 characters or more, no repeated chunk.
cte("rated_in", CTES["rated"][1].replace("all_chunks", "chunks").replace("< 20", "< 50"), ("chunks",))
cte("walk_in", CTES["walk"][1].replace("FROM walk w JOIN rated r", "FROM walk_in w JOIN rated_in r"), ("rated_in",))
cte(
    "judged_in",
    CTES["judged"][1].replace("FROM rated r JOIN walk w", "FROM rated_in r JOIN walk_in w"),
    ("rated_in", "walk_in", "profile"),
)
INGESTED = "SELECT doc_id, count(*) AS chunks, CAST(sum(char_count) AS BIGINT) AS chars FROM judged_in WHERE reject_reason IS NULL GROUP BY 1"


@query("stream_ingestion", INGESTED, ("judged_in",))
def _(t: Tables):
    out = ss.scratch(t.spark, "ingest")
    docs = ss.read_table_stream(t.spark, t.sf_dir, "documents").select("doc_id", "text")
    ss.run_batches(docs, "ingest-state", ss.ingest_batch(out))
    chunks = t.spark.read.option("basePath", f"{out}/chunks").parquet(f"{out}/chunks")
    return chunks.groupBy("doc_id").agg(F.count("*").alias("chunks"), F.sum("char_count").alias("chars"))


_OVER = "(SELECT date_trunc('millisecond', max(ts)) FROM events) - INTERVAL 10 MINUTES"


@query(
    "stream_latency_sketches",
    f"""SELECT concat('/api/', event_type) AS endpoint, count(*) AS requests, true AS within_bound FROM events
        WHERE date_trunc('minute', ts) + INTERVAL 1 MINUTE <= {_OVER} GROUP BY 1""",
)
def _(t: Tables):
    """Sketches of minutes that are over, written by a stream, then merged and held against exact ranks."""
    log = _stream(t).select("ts", F.concat(F.lit("/api/"), "event_type").alias("endpoint"), F.col("value").alias("latency_ms"))
    slices = ss.run_to_table(qs.quantile_slices(log, ["endpoint"], "latency_ms", delay="10 minutes"), "minutes")
    records = _events(t).select(F.concat(F.lit("/api/"), "event_type").alias("endpoint"), F.col("value").alias("latency_ms"), F.date_trunc("minute", "ts").alias("slice"))
    over = records.join(slices.select("endpoint", "slice"), ["endpoint", "slice"], "left_semi")
    return ranks_hold(qs.merged_quantiles(slices, ["endpoint"], QUANTILES), over, ("endpoint",))


@query(
    "feedback_stream_join",
    f"""SELECT f.event_id AS log_id, f.event_type AS feedback, q.value AS latency_ms
        FROM (SELECT * FROM events WHERE event_type IN ('purchase', 'error')) f
        LEFT JOIN (SELECT * FROM events WHERE user_id % 5 <> 0) q ON q.event_id = f.event_id
        WHERE q.event_id IS NOT NULL OR date_trunc('millisecond', f.ts) < {_OVER}""",
)
def _(t: Tables):
    """Feedback with its query, both streams; users of every fifth number leave no query."""
    events = _stream(t)
    votes = events.select(F.col("event_id").alias("log_id"), F.col("event_type").alias("feedback"), "ts")
    asked = events.select(F.col("event_id").alias("log_id"), F.col("value").alias("latency_ms"), "ts", "user_id")
    out = ss.run_to_table(
        ss.feedback_with_queries(votes, asked, F.col("feedback").isin("purchase", "error"), F.col("user_id") % 5 != 0), "feedback"
    )
    return out.select("log_id", "feedback", "latency_ms")


@query(
    "stream_history_from_table",
    """SELECT conv_id, CAST(count(*) AS INT) AS n, max(turn) AS last_turn,
              string_agg(concat(turn, ' ', role, ': ', text), chr(10) ORDER BY turn) AS history
       FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS pos FROM conversations
             WHERE conv_id IN (SELECT conv_id FROM conversations WHERE turn % 2 = 1)) WHERE pos <= 3 GROUP BY 1""",
)
def _(t: Tables):
    """Histories of three messages: even turns are known from a table, odd ones arrive."""
    turns = ss.read_table_stream(t.spark, t.sf_dir, "conversations").select("conv_id", "turn", "role", F.col("text").alias("content"))
    known = t.conversations.select("conv_id", "turn", "role", F.col("text").alias("content")).filter("turn % 2 = 0")
    return newest_histories(t, ss.session_history(turns.filter("turn % 2 = 1"), keep=3, known=known))


# --- a queue with dead letters --------------------------------------------------------------
@query(
    "queue_ingestion",
    f"""SELECT doc_id, chunks, chars, -1 AS retries FROM ({INGESTED})
        UNION ALL SELECT doc_id, 0, 0, 3 FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM chunks)""",
    ("judged_in", "chunks"),
)
def _(t: Tables):
    """Documents from a queue, stopped after a batch and started again, then the dead letters
    until they are given up: chunks of each document, and documents without text."""
    spark, out, state = t.spark, ss.scratch(t.spark, "queue"), ss.scratch(t.spark, "queue-state")
    limit = max(1, t.documents.count() // 4)

    def run(batches=None):
        docs = ss.queue_stream(spark, f"{t.sf_dir}/documents.parquet", f"{state}/docs.json", "doc_id long, text string", limit)
        return ss.drain(docs, ss.admit_batch(out), f"{state}/docs", batches)

    run(1)
    run()
    dead = ss.queue_stream(spark, f"{out}/dead", f"{state}/dead.json", "doc_id long, text string, error string, retries int", limit)
    ss.drain(dead, ss.retry_batch(out), f"{state}/dead")
    chunks = spark.read.option("basePath", f"{out}/chunks").parquet(f"{out}/chunks")
    over = spark.read.option("basePath", f"{out}/given_up").parquet(f"{out}/given_up")
    zero = F.lit(0).cast("long")
    return chunks.groupBy("doc_id").agg(F.count("*").alias("chunks"), F.sum("char_count").alias("chars"), F.lit(-1).alias("retries")).unionByName(
        over.select("doc_id", zero.alias("chunks"), zero.alias("chars"), "retries")
    )
