"""Structured Streaming operators.

Aggregating operators are ordinary DataFrame functions: on a stream they need the
watermark they set, on a table the same function is the batch twin.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import StreamingQueryException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from docloom.functions import text as tx
from docloom.operators import chunking as ch
from docloom.operators import quality as ql
from docloom.scale import broadcast_if_small
from docloom.session import materialize, once, scratch
from docloom.sources.queue import QueueSource
from docloom.sources.sinks import replace_partition

# Fixed values.
REQUESTS_PER_MINUTE = 60
UPLOAD_LOCK = "300 seconds"
HISTORY_MESSAGES = 40
HISTORY_TTL_MS = 24 * 3600 * 1000
MAX_RETRIES = 3


# --- aggregates ------------------------------------------------------------------
def throughput(requests: DataFrame, ts: str = "ts", delay: str = "10 minutes") -> DataFrame:
    """Requests per minute."""
    return (
        requests.withWatermark(ts, delay)
        .groupBy(F.window(ts, "1 minute").alias("w"))
        .agg(F.count("*").alias("requests"))
        .select(F.col("w.start").alias("minute"), "requests")
    )


def rate_violations(requests: DataFrame, ts: str = "ts", user: str = "user_id", limit: int = REQUESTS_PER_MINUTE,
                    window: str = "1 minute", slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """Users over the limit per fixed window, or per sliding one with ``slide``."""
    span = F.window(ts, window, slide) if slide else F.window(ts, window)
    return (
        requests.withWatermark(ts, delay)
        .groupBy(user, span.alias("w"))
        .agg(F.count("*").alias("requests"))
        .filter(F.col("requests") > limit)
        .select(user, F.col("w.start").alias("window_start"), "requests")
    )


def latest_status(events: DataFrame, key: str = "doc_id", ts: str = "ts", status: str = "status") -> DataFrame:
    """Newest status per document (update mode on a stream)."""
    return events.groupBy(key).agg(
        F.max_by(F.col(status), F.struct(ts, status)).alias(status), F.max(ts).alias("updated_at")
    )


def rolling_quality(records: DataFrame, ts: str = "ts", window: str = "1 day", slide: str = "6 hours",
                    delay: str = "1 hour") -> DataFrame:
    """Quality over sliding windows of event time."""
    return (
        records.withWatermark(ts, delay)
        .groupBy(F.window(ts, window, slide).alias("w"))
        .agg(
            F.count("*").alias("queries"),
            F.count_if(F.col("feedback") == "like").alias("likes"),
            F.count_if(F.col("feedback") == "dislike").alias("dislikes"),
            F.round(F.avg("confidence"), 6).alias("avg_confidence"),
        )
        .select(F.col("w.start").alias("window_start"), "queries", "likes", "dislikes", "avg_confidence")
    )


def sessions(requests: DataFrame, ts: str = "ts", user: str = "user_id", gap: str = "24 hours",
             delay: str = "1 hour") -> DataFrame:
    """Activity sessions that end after ``gap`` without a request."""
    return (
        requests.withWatermark(ts, delay)
        .groupBy(user, F.session_window(ts, gap).alias("w"))
        .agg(F.count("*").alias("requests"))
        .select(user, F.col("w.start").alias("started_at"), "requests")
    )


# --- joins -----------------------------------------------------------------------
def feedback_with_queries(feedback: DataFrame, queries: DataFrame, wanted: Column | None = None, kept: Column | None = None,
                          delay: str = "10 minutes", within: str = "1 hour") -> DataFrame:
    """Every feedback (log_id, ts, ...) with the query (log_id, ts, ...) it is about, which
    came at most ``within`` before it; feedback without one has nulls and comes out when
    no such query can come any more. ``wanted`` and ``kept`` select rows of the two streams
    after their watermarks. State is held for ``within`` and ``delay`` only.
    """
    votes = feedback.withWatermark("ts", delay)
    asked = queries.withColumnsRenamed({"log_id": "_log_id", "ts": "_ts"}).withWatermark("_ts", delay)
    votes = votes if wanted is None else votes.filter(wanted)
    asked = asked if kept is None else asked.filter(kept)
    near = (F.col("_ts") <= F.col("ts")) & (F.col("_ts") >= F.col("ts") - F.expr(f"INTERVAL {within}"))
    return votes.join(asked, (F.col("log_id") == F.col("_log_id")) & near, "left").drop("_log_id", "_ts")


# --- deduplication ------------------------------------------------------------------
def dedup_uploads(uploads: DataFrame, ts: str = "ts", key: str = "content_hash") -> DataFrame:
    """Drops repeats of a content hash within the lock time (stream only). A hash
    is held for at least that long."""
    return uploads.withWatermark(ts, UPLOAD_LOCK).dropDuplicatesWithinWatermark([key])


def upload_leaders(uploads: DataFrame, ts: str = "ts", key: str = "content_hash", seconds: int = 300) -> DataFrame:
    """Batch twin per fixed lock slot: the first upload of a hash in each slot. The
    slot is part of the key, so a hash uploaded all day does not gather anywhere."""
    slot = F.floor(F.unix_timestamp(F.col(ts).cast("timestamp")) / seconds)
    return uploads.groupBy(key, slot.alias("slot")).agg(
        F.min(ts).alias("first_at"), F.count("*").alias("uploads")
    )


# --- session history --------------------------------------------------------------------
HISTORY_SCHEMA = "conv_id long, n int, last_turn long, history array<struct<turn:long,role:string,content:string>>"
_TURN = "turn long, role string, content string"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class SessionHistory(StatefulProcessor):
    """The newest messages of a session as a list in the state store, dropped when the
    session has not been used for the time to live."""

    def __init__(self, keep: int, ttl_ms: int):
        self.keep, self.ttl_ms = keep, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.turns = handle.getListState("turns", _TURN, ttlDurationMs=self.ttl_ms)

    def _held(self) -> dict[int, tuple]:
        return {int(turn): (role, content) for turn, role, content in self.turns.get()} if self.turns.exists() else {}

    def _hold(self, kept: dict[int, tuple], timer_values) -> None:
        self.turns.put([(turn, role, content) for turn, (role, content) in kept.items()])
        # One timer a session: the last message's.
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(timer_values.getCurrentProcessingTimeInMs() + self.ttl_ms)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        kept = self._held() | {int(m.turn): (m.role, m.content) for m in initialState.itertuples(index=False)}
        self._hold(dict(sorted(kept.items())[-self.keep :]), timerValues)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        kept = self._held()
        for fresh in rows:
            kept |= {int(m.turn): (m.role, m.content) for m in fresh.itertuples(index=False)}
            kept = dict(sorted(kept.items())[-self.keep :])
        self._hold(kept, timerValues)
        history = [{"turn": turn, "role": role, "content": content} for turn, (role, content) in kept.items()]
        yield pd.DataFrame({"conv_id": [key[0]], "n": [len(history)], "last_turn": [max(kept)], "history": [history]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.turns.clear()
        return iter([])

    def close(self) -> None:
        pass


def session_history(messages: DataFrame, keep: int = HISTORY_MESSAGES, ttl_ms: int = HISTORY_TTL_MS,
                    known: DataFrame | None = None) -> DataFrame:
    """Stateful stream: (conv_id, turn, role, content) in, one row per session and batch
    out with the newest ``keep`` messages. A turn sent again replaces the earlier one.
    Unused sessions expire after the TTL, which every message extends; state per session
    is bounded by ``keep`` messages and lies in RocksDB. A new stream starts from the
    sessions of ``known``, a table of the same columns; a restarted one from its checkpoint."""
    messages.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)
    grouped = messages.select("conv_id", "turn", "role", "content").groupBy("conv_id")
    first = known.select("conv_id", "turn", "role", "content").groupBy("conv_id") if known is not None else None
    return grouped.transformWithStateInPandas(
        SessionHistory(keep, ttl_ms), HISTORY_SCHEMA, "Update", "ProcessingTime", initialState=first
    )


# --- ingestion ----------------------------------------------------------------------------
def _dealt(docs: DataFrame) -> DataFrame:
    """Four parts a core, whatever the splits of the source: chunking takes the time, and a few
    large row groups come in few parts. Dealt by text too, since one key may hold many rows."""
    return docs.repartition(4 * docs.sparkSession.sparkContext.defaultParallelism, "doc_id", "text")


def prepare(docs: DataFrame, size: int = 500) -> tuple[DataFrame, DataFrame]:
    """Cleaned, chunked and judged documents: (passed chunks, failed documents).
    A document fails with a reason instead of failing the batch."""
    text = tx.clean_text("text").alias("text")
    # Few documents have to be cleaned to know that nothing is left of them.
    failed = docs.filter(~tx.surely_kept("text")).select("doc_id", text).filter("text = ''").select(
        "doc_id", F.lit("failed").alias("status"), F.lit("no text").alias("error"), F.lit(0).alias("retries")
    )
    good = once(_dealt(docs), "doc_id", text).filter("text <> ''").select(
        "doc_id", ch.fixed_pieces("text", size).alias("pieces"), tx.language_shares("text").alias("profile")
    )
    passed = ql.judge_chunks(good, min_length=size // 10).filter("reject_reason IS NULL").drop("reject_reason")
    return passed, failed


def ingest_batch(out: str, size: int = 500) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: a batch writes its own partition and overwrites it when
    retried, so a lost driver or executor never doubles rows."""

    def run(batch: DataFrame, batch_id: int) -> None:
        passed, failed = prepare(batch, size)
        replace_partition(passed, f"{out}/chunks", batch=batch_id)
        replace_partition(failed, f"{out}/failed", batch=batch_id)

    return run


def retry_failed(dead: DataFrame, max_retries: int = MAX_RETRIES) -> tuple[DataFrame, DataFrame]:
    """Dead letters split into those to try again (count raised) and those given up."""
    again = dead.filter(F.col("retries") < max_retries).withColumn("retries", F.col("retries") + 1)
    return again, dead.filter(F.col("retries") >= max_retries)


def queue_stream(spark: SparkSession, path: str, state: str, schema: str | StructType, limit: int) -> DataFrame:
    """A folder of Parquet files, at most ``limit`` rows a batch."""
    spark.dataSource.register(QueueSource)
    return spark.readStream.format("docqueue").schema(schema).option("path", path).option("state", state).option("limit", limit).load()


class Enough(Exception):
    """A stream has run as many batches as it should."""


def drain(stream: DataFrame, each: Callable[[DataFrame, int], None], state: str, batches: int | None = None) -> int:
    """Run a stream until its source has no more; with ``batches`` it breaks off at the batch
    after that many. How many batches ran whole; the same ``state`` goes on from there."""
    done: list[int] = []

    def counted(batch: DataFrame, batch_id: int) -> None:
        if batches is not None and len(done) == batches:
            raise Enough
        each(batch, batch_id)
        done.append(batch_id)

    query = stream.writeStream.foreachBatch(counted).option("checkpointLocation", state).start()
    try:
        query.processAllAvailable()
    except StreamingQueryException as exc:
        if len(done) != batches or "Enough" not in str(exc):
            raise
    finally:
        query.stop()
    return len(done)


def _stored(batch: DataFrame) -> DataFrame:
    """The batch, written once: its source is decoded again for everything made from it."""
    return materialize(batch, "batch")


def retry_batch(out: str, size: int = 500, max_retries: int = MAX_RETRIES) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch`` over dead letters with their texts: each is tried again. What passes
    joins the chunks; what fails again is a dead letter with one more try, or is given up."""

    def run(batch: DataFrame, batch_id: int) -> None:
        again, over = retry_failed(_stored(batch), max_retries)
        passed, failed = prepare(again, size)
        tried = failed.drop("retries", "status").join(again.select("doc_id", "text", "retries"), "doc_id")
        # The name of a later file sorts behind all that were read.
        replace_partition(passed, f"{out}/chunks", batch=f"r{batch_id:08d}")
        replace_partition(tried.select("doc_id", "text", "error", "retries"), f"{out}/dead", batch=f"r{batch_id:08d}")
        replace_partition(over, f"{out}/given_up", batch=f"r{batch_id:08d}")

    return run


def admit_batch(out: str, size: int = 500) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch`` over documents: chunks, and dead letters with their texts."""

    def run(batch: DataFrame, batch_id: int) -> None:
        batch = _stored(batch)
        passed, failed = prepare(batch, size)
        # Stored and measured, so that the texts of the whole batch are not shuffled for the few that failed.
        dead = broadcast_if_small(materialize(failed, "failed")).join(batch.select("doc_id", "text"), "doc_id")
        replace_partition(passed, f"{out}/chunks", batch=f"a{batch_id:08d}")
        replace_partition(dead.select("doc_id", "text", "error", "retries"), f"{out}/dead", batch=f"a{batch_id:08d}")

    return run


# --- running ------------------------------------------------------------------------------
def read_table_stream(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A stored table, one file or a folder of files, as a stream of its files."""
    schema = spark.read.parquet(f"{sf_dir}/{table}.parquet").schema
    # As a pattern, the path may be that of a single file.
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 100).parquet(f"{sf_dir}/{{{table}.parquet}}")


def run_to_table(stream: DataFrame, name: str) -> DataFrame:
    """Run a stream over what is available now into a table and read it back."""
    spark = stream.sparkSession
    out = scratch(spark, name)
    schema = stream.schema
    q = (
        stream.writeStream.format("parquet").outputMode("append").option("path", f"{out}/data")
        .option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return spark.read.schema(schema).parquet(f"{out}/data")


def run_batches(stream: DataFrame, name: str, each: Callable[[DataFrame, int], None], mode: str = "append",
                state: str | None = None) -> None:
    """Run a stream over what is available now through ``each(batch, batch_id)``; ``state`` is the
    checkpoint to go on from, a new one by default.

    Batches without data are switched off: a processing-time timeout asks for one
    after another, and the run would never end.
    """
    spark = stream.sparkSession
    state = state or scratch(spark, name)
    flag = "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(flag, "true")
    spark.conf.set(flag, "false")
    try:
        q = (
            stream.writeStream.outputMode(mode).foreachBatch(each).option("checkpointLocation", state)
            .trigger(availableNow=True).start()
        )
        q.awaitTermination()
    finally:
        spark.conf.set(flag, before)
