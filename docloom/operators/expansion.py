"""Widening hits to the chunks around them.

Neighbours are found by equality joins on (document, position) and (document,
section), never by comparing all chunks of a document with each other.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_ANCHOR = ("query_id", "anchor_rnk", "anchor_id")


def locate(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Hits (query_id, id, rnk) as anchors with document, position and section."""
    places = chunks.select(F.col("chunk_id").alias("id"), "doc_id", "chunk_idx", "section_no")
    return hits.select("query_id", "id", "rnk").join(places, "id").select(
        "query_id", F.col("rnk").alias("anchor_rnk"), F.col("id").alias("anchor_id"), "doc_id", "chunk_idx", "section_no"
    )


def sequential(anchors: DataFrame, chunks: DataFrame, window: int = 2) -> DataFrame:
    """The anchor and up to ``window`` chunks before and after it."""
    wanted = anchors.select(
        *_ANCHOR, "doc_id",
        F.explode(F.sequence(F.col("chunk_idx") - window, F.col("chunk_idx") + window)).alias("chunk_idx"),
    )
    return wanted.join(chunks.select("doc_id", "chunk_idx", "chunk_id"), ["doc_id", "chunk_idx"]).select(
        *_ANCHOR, "chunk_id", "chunk_idx"
    )


def siblings(anchors: DataFrame, chunks: DataFrame, max_chunks: int = 20) -> DataFrame:
    """The first chunks of the anchor's section."""
    w = Window.partitionBy("doc_id", "section_no").orderBy("chunk_idx")
    head = chunks.select(
        "doc_id", "section_no", "chunk_id", "chunk_idx", F.row_number().over(w).alias("_rn")
    ).filter(F.col("_rn") <= max_chunks)
    wanted = anchors.select(*_ANCHOR, "doc_id", "section_no")
    return wanted.join(head, ["doc_id", "section_no"]).select(*_ANCHOR, "chunk_id", "chunk_idx")


def expand(hits: DataFrame, chunks: DataFrame, anchors: int = 3, window: int = 2, max_chunks: int = 20) -> DataFrame:
    """Chunks around the best hits, each once per query under its first anchor.

    Anchors are taken in rank order. One that an earlier anchor already brought in
    is not expanded again; an anchor never lists itself or an earlier anchor.
    """
    found = locate(hits.filter(F.col("rnk") < anchors), chunks)
    around = sequential(found, chunks, window).unionByName(siblings(found, chunks, max_chunks)).distinct()

    # Which anchors lie in the surroundings of which earlier anchors.
    tops = found.select("query_id", F.col("anchor_rnk").alias("_r"), F.col("anchor_id").alias("chunk_id"))
    meets = around.join(tops, ["query_id", "chunk_id"]).filter("_r > anchor_rnk")
    pairs = list(combinations(range(anchors), 2))
    flags = meets.groupBy("query_id").agg(
        *[
            F.max(((F.col("anchor_rnk") == i) & (F.col("_r") == j)).cast("int")).alias(f"m{i}_{j}")
            for i, j in pairs
        ]
    )
    live = {0: F.lit(True)}
    for j in range(1, anchors):
        covered = F.lit(False)
        for i in range(j):
            covered = covered | (live[i] & (F.coalesce(F.col(f"m{i}_{j}"), F.lit(0)) == 1))
        live[j] = ~covered
    active = (
        tops.join(flags, "query_id", "left")
        .withColumn(
            "_live", F.coalesce(*[F.when(F.col("_r") == j, cond) for j, cond in live.items()])
        )
        .filter("_live")
        .select("query_id", "_r", "chunk_id")
    )
    from_active = around.join(active.select("query_id", F.col("_r").alias("anchor_rnk")), ["query_id", "anchor_rnk"])
    as_anchor = active.select("query_id", "chunk_id", F.col("_r").alias("_own"))
    fresh = from_active.join(as_anchor, ["query_id", "chunk_id"], "left").filter(
        "_own IS NULL OR _own > anchor_rnk"
    )
    return fresh.groupBy("query_id", "chunk_id").agg(
        F.min("anchor_rnk").alias("anchor_rnk"), F.min("chunk_idx").alias("chunk_idx")
    )
