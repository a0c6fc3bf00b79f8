"""Relational operators over documents, tags, permissions, logs and sessions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.functions import text as tx
from docloom.functions import vectors as vx

# Fixed value: id lists up to this size are inlined as literals.
INLINE_IDS = 500


# --- lookups and filters ---------------------------------------------------------
def find(df: DataFrame, ids: Sequence | DataFrame, key: str = "id") -> DataFrame:
    """Rows by id: literals for a short list, a semi-join for a table of ids."""
    if isinstance(ids, DataFrame):
        return df.join(ids.select(F.col(ids.columns[0]).alias(key)), key, "left_semi")
    if len(ids) <= INLINE_IDS:
        return df.filter(F.col(key).isin(list(ids)))
    table = df.sparkSession.createDataFrame([(i,) for i in ids], [key])
    return df.join(table.select(F.col(key).cast(df.schema[key].dataType)), key, "left_semi")


def scoped(df: DataFrame, **equals) -> DataFrame:
    """Equality scoping by any of tenant, status, session, user, active."""
    for column, value in equals.items():
        if value is not None:
            df = df.filter(F.col(column) == value)
    return df


def browse_chunks(chunks: DataFrame, kind: str | None = None, needle: str | None = None) -> DataFrame:
    """Chunks of a structure type that contain a substring, ignoring case."""
    if kind:
        chunks = chunks.filter(F.col("structure_type") == kind)
    if needle:
        chunks = chunks.filter(F.contains(F.lower("content"), F.lit(needle.lower())))
    return chunks


# --- tags and permissions -----------------------------------------------------------
def tag_counts(tags: DataFrame, doc_tags: DataFrame) -> DataFrame:
    """All tags with their number of documents; links are counted before the join."""
    used = doc_tags.groupBy("tag").agg(F.count("*").alias("documents"))
    return tags.join(used, "tag", "left").na.fill(0, ["documents"])


def with_any_tag(df: DataFrame, doc_tags: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """Documents or hits carrying at least one of the tags."""
    return df.join(doc_tags.filter(F.col("tag").isin(list(wanted))), "doc_id", "left_semi")


def visible(requests: DataFrame, permissions: DataFrame) -> DataFrame:
    """Requests (doc_id, tenant_id, dept_id, user_id) whose document is public or
    granted to the tenant, department or user. Each request names its scopes, so
    the disjunction becomes one equality semi-join."""
    scopes = F.array(
        F.struct(F.lit("public").alias("scope_type"), F.lit("").alias("scope_value")),
        F.struct(F.lit("tenant").alias("scope_type"), F.col("tenant_id").alias("scope_value")),
        F.struct(F.lit("dept").alias("scope_type"), F.col("dept_id").alias("scope_value")),
        F.struct(F.lit("user").alias("scope_type"), F.col("user_id").cast("string").alias("scope_value")),
    )
    asked = ["doc_id", "tenant_id", "dept_id", "user_id"]
    probes = requests.select(*asked).distinct().select(*asked, F.explode(scopes).alias("_s"))
    granted = probes.select(*asked, "_s.scope_type", "_s.scope_value").join(
        permissions, ["doc_id", "scope_type", "scope_value"], "left_semi"
    ).select(*asked).distinct()
    # Equal requests are checked once and all come back.
    same = reduce(lambda a, b: a & b, [requests[c].eqNullSafe(granted[c]) for c in asked])
    return requests.join(granted, same, "left_semi")


def name_sources(hits: DataFrame, names: DataFrame) -> DataFrame:
    """Hits with the file name of their document, unknown documents kept."""
    return hits.join(names, "doc_id", "left")


# --- deletion ---------------------------------------------------------------------------
def cascade_delete(tables: dict[str, DataFrame], doomed: DataFrame, key: str = "doc_id") -> dict[str, DataFrame]:
    """Every table without the rows of the doomed documents."""
    return {name: df.join(doomed.select(key), key, "left_anti") for name, df in tables.items()}


# --- sessions -----------------------------------------------------------------------------
def recent_messages(messages: DataFrame, n: int, session: str = "conv_id", order: str = "turn") -> DataFrame:
    """The last n messages per session. Each partition keeps only n rows per
    session before the shuffle, so a huge session stays small."""
    w = Window.partitionBy(session).orderBy(F.desc(order))
    return messages.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def histories(messages: DataFrame, n: int, session: str = "conv_id", order: str = "turn") -> DataFrame:
    """session, history: ordered array of the last n (role, content)."""
    entry = F.struct(F.col(order), F.col("role"), F.col("text").alias("content"))
    return recent_messages(messages, n, session, order).groupBy(session).agg(
        F.transform(
            F.array_sort(F.collect_list(entry)),
            lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")),
        ).alias("history")
    )


def topic_switches(messages: DataFrame, threshold: float = 0.35, session: str = "conv_id",
                   embed=vx.hash_embed) -> DataFrame:
    """Turns whose similarity to the turn before falls under the threshold.

    The previous turn is met by equality on (session, turn), which spreads the
    turns of one session over the cluster.
    """
    turns = messages.select(session, "turn", embed("text").alias("vec"))
    before = turns.select(session, (F.col("turn") + 1).alias("turn"), F.col("vec").alias("prev"))
    sim = vx.cosine("vec", "prev")
    return turns.join(before, [session, "turn"]).select(
        session, "turn", F.round(sim, 6).alias("similarity"), (sim < threshold).alias("switched")
    )


def conversation_markdown(messages: DataFrame, session: str = "conv_id", order: str = "turn",
                          part_turns: int | None = None) -> DataFrame:
    """Sessions as Markdown, one row each. Sessions too long for one row can be written
    in parts: with ``part_turns``, one row for so many turns, numbered in ``part``."""
    entry = F.struct(
        F.col(order), F.concat(F.lit("## "), "role", F.lit("\n\n"), F.col("text")).alias("md")
    )
    part = [] if part_turns is None else [F.floor(F.col(order) / part_turns).cast("int").alias("part")]
    return messages.groupBy(session, *part).agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(entry)), lambda m: m["md"]), "\n\n"
        ).alias("markdown")
    )


# --- paging -----------------------------------------------------------------------------------
def page(df: DataFrame, *order: Column, limit: int = 20, offset: int = 0) -> DataFrame:
    """A page plus one look-ahead row that tells whether another page follows."""
    return df.orderBy(*order).offset(offset).limit(limit + 1)


def keyset_page(df: DataFrame, after: tuple | None, ts: str = "created_at", key: str = "id",
                limit: int = 20) -> DataFrame:
    """The page after a (timestamp, id) cursor, newest first. Unlike an offset, the
    cursor is a filter and costs the same on every page."""
    if after is not None:
        at, last = F.lit(after[0]).cast(df.schema[ts].dataType), F.lit(after[1])
        df = df.filter((F.col(ts) < at) | ((F.col(ts) == at) & (F.col(key) < last)))
    return df.orderBy(F.desc(ts), F.desc(key)).limit(limit)


def cursor_of(page_df: DataFrame, ts: str = "created_at", key: str = "id") -> DataFrame:
    """The cursor a page ends with."""
    return page_df.agg(F.min(F.struct(ts, key)).alias("c")).select(f"c.{ts}", f"c.{key}")


# --- set operations ------------------------------------------------------------------------------
def hash_sets(old: DataFrame, new: DataFrame) -> DataFrame:
    """content_hash, side: shared, deleted (old only) or created (new only)."""
    return (
        old.intersect(new).withColumn("side", F.lit("shared"))
        .unionByName(old.subtract(new).withColumn("side", F.lit("deleted")))
        .unionByName(new.subtract(old).withColumn("side", F.lit("created")))
    )


def contains_any(df: DataFrame, column: str, needles: Sequence[str]) -> DataFrame:
    """One row per needle found in the column, ignoring case. The needles are
    literals of the expression, so no pairs are formed."""
    lowered = F.array(*[F.lit(n.lower()) for n in needles])
    found = tx.bind(F.lower(column), lambda text: F.filter(lowered, lambda n: F.contains(text, n)))
    return df.select("*", F.explode(found).alias("needle"))
