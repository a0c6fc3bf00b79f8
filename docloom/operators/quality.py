"""Chunk quality rules, duplicates and document scores."""

from __future__ import annotations

from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.functions import text as tx
from docloom.operators.chunking import chunk_key
from docloom.session import materialize, once

# Rule thresholds and names, in the order the rules are applied.
MIN_LENGTH = 20
CONTENT_RATIO_MIN = 0.60
DIGIT_RATIO_MAX = 0.80
PUNCT_RATIO_MAX = 0.70
SIMILARITY_MAX = 0.95
LANGUAGE_DEVIATION_MAX = 0.20
FILTER_RATE_WARN = 0.30
REASONS = (
    "MIN_LENGTH", "CONTENT_RATIO", "DIGIT_RATIO", "PUNCT_RATIO", "DEDUP", "LANGUAGE_CONSISTENCY",
)
HASH_BITS = 32
# Stands for the hash of a chunk that failed an earlier rule.
ABSENT = -1


def measures(content: Column) -> Column:
    """STRUCT of a chunk and its ratios."""
    size = F.greatest(F.length(content), F.lit(1))
    return tx.bind(
        tx.beside_words(content),
        lambda rest: F.struct(
            content.alias("content"),
            # Outer whitespace only.
            (F.length(tx.strip(content)) / size).alias("content_ratio"),
            (F.regexp_count(rest, F.lit(r"\p{Nd}")) / size).alias("digit_ratio"),
            (F.regexp_count(rest, F.lit(tx.PUNCTUATION)) / size).alias("punct_ratio"),
            (F.regexp_count(rest, F.lit(tx.CJK)) / size).alias("zh_ratio"),
        ),
    )


def text_reason(m: Column, min_length: int = MIN_LENGTH) -> Column:
    """First failing rule that looks at the chunk alone, before deduplication."""
    return (
        F.when(F.length(m["content"]) < min_length, "MIN_LENGTH")
        .when(m["content_ratio"] < CONTENT_RATIO_MIN, "CONTENT_RATIO")
        .when(m["digit_ratio"] > DIGIT_RATIO_MAX, "DIGIT_RATIO")
        .when(m["punct_ratio"] > PUNCT_RATIO_MAX, "PUNCT_RATIO")
    )


def flips(threshold: float = SIMILARITY_MAX) -> list[int]:
    """Bit masks by which two similar 32-bit hashes can differ: with ``d`` bits
    apart the similarity is at most (32 - d) / 32."""
    most = max(d for d in range(HASH_BITS) if d == 0 or (HASH_BITS - d) / HASH_BITS > threshold)
    return [
        sum(1 << b for b in bits) for d in range(1, most + 1) for bits in combinations(range(HASH_BITS), d)
    ]


def _earlier_similar(threshold: float):
    masks = flips(threshold)

    def flags(hashes) -> list[bool]:
        seen: set[int] = set()
        out = []
        for h in hashes:
            h = int(h)
            if h == ABSENT:
                out.append(False)
                continue
            hit = h in seen or any(
                (h ^ m) in seen and (h & (h ^ m)).bit_count() > threshold * (h | m).bit_count() for m in masks
            )
            if not hit:
                seen.add(h)
            out.append(hit)
        return out

    @F.pandas_udf(T.ArrayType(T.BooleanType()))
    def mark(hashes: pd.Series) -> pd.Series:
        return hashes.map(lambda hs: None if hs is None else flags(hs))

    return mark


def judge_chunks(docs: DataFrame, pieces: str = "pieces", profile: str | None = "profile",
                 min_length: int = MIN_LENGTH, threshold: float = SIMILARITY_MAX) -> DataFrame:
    """One row per chunk with ``reject_reason`` (NULL = passed).

    Works on the array of a document's chunks, so the ordered deduplication needs
    no shuffle: hashes are taken from Arrow batches of the pieces, and a
    set answers each chunk in constant time. A chunk enters the set only if it
    passed all rules up to and including this one.
    """
    judged = F.transform(
        F.transform(pieces, measures), lambda m: F.struct(m.alias("of"), text_reason(m, min_length).alias("early"))
    )
    language = F.col(f"{profile}.primary_language") if profile else F.lit("en")
    zh = F.col(f"{profile}.zh_ratio") if profile else F.lit(0.0)
    rated = once(docs, "doc_id", language.alias("_lang"), zh.alias("_zh"), judged.alias("_j"))
    hashed = rated.withColumn("_h", tx.char_hashes(F.transform("_j", lambda s: s["of"]["content"])))
    alive = F.zip_with("_h", "_j", lambda h, s: F.when(s["early"].isNull(), h).otherwise(ABSENT))
    staged = hashed.withColumn("_dup", _earlier_similar(threshold)(alive))
    rows = staged.select("doc_id", "_lang", "_zh", F.posexplode(F.arrays_zip("_j", "_h", "_dup")).alias("chunk_idx", "_c"))
    content = F.col("_c._j.of.content")
    foreign = (F.col("_lang") != "mixed") & (F.abs(F.col("_c._j.of.zh_ratio") - F.col("_zh")) > LANGUAGE_DEVIATION_MAX)
    reason = (
        F.when(F.col("_c._j.early").isNotNull(), F.col("_c._j.early"))
        .when(F.col("_c._dup"), "DEDUP")
        .when(foreign, "LANGUAGE_CONSISTENCY")
    )
    return rows.select(
        chunk_key("doc_id", "chunk_idx").alias("chunk_id"), "doc_id", "chunk_idx", content.alias("content"),
        F.length(content).alias("char_count"), *[F.col(f"_c._j.of.{k}").alias(k) for k in ("content_ratio", "digit_ratio", "punct_ratio")],
        F.col("_c._h").alias("char_hash"), reason.alias("reject_reason"),
    )


def filter_report(judged: DataFrame) -> DataFrame:
    """Passed and rejected chunks per document with the reasons."""
    counts = [F.count_if(F.col("reject_reason") == r).alias(r) for r in REASONS]
    rejected = F.count("reject_reason")
    grouped = judged.groupBy("doc_id").agg(
        F.count("*").alias("total"), rejected.alias("rejected"), *counts
    )
    shown = F.array_compact(
        F.array(*[F.when(F.col(r) > 0, F.concat(F.lit(f"{r}="), F.col(r))) for r in REASONS])
    )
    return grouped.select(
        "doc_id", "total", (F.col("total") - F.col("rejected")).alias("passed"), "rejected",
        F.round(F.col("rejected") / F.col("total"), 6).alias("filter_rate"),
        F.array_join(shown, ",").alias("reasons"),
        (F.col("rejected") / F.col("total") > FILTER_RATE_WARN).alias("warning"),
    )


def anomaly_events(report: DataFrame, threshold: float = FILTER_RATE_WARN) -> DataFrame:
    return report.filter(F.col("rejected") / F.col("total") > threshold).select(
        F.lit("filter_rate_high").alias("type"), "doc_id", "filter_rate", F.lit("warning").alias("severity")
    )


def _level(score: Column) -> Column:
    return (
        F.when(score >= 0.80, "excellent").when(score >= 0.65, "good").when(score >= 0.40, "fair").otherwise("poor")
    )


def _clamp(col: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), col))


def _half_up(col: Column, digits: int) -> Column:
    """Round half up, whatever the noise in the last bits of a sum."""
    scale = 10**digits
    return F.floor(col * scale + 0.5 + 1e-9) / scale


def document_scores(judged: DataFrame, structure_type: Column | None = None, chunk_size: int = 500) -> DataFrame:
    """Weighted score per document from its passed chunks."""
    passed = F.col("reject_reason").isNull()
    kind = F.lit("narrative") if structure_type is None else structure_type

    def mean(name: str, default: float) -> Column:
        value = F.when(F.col(name) == 0, F.lit(default)).otherwise(F.col(name))
        return F.avg(F.when(passed, value))

    per_doc = judged.groupBy("doc_id").agg(
        F.count("*").alias("total"),
        F.count_if(passed).alias("passed"),
        F.avg(F.when(passed, F.col("char_count"))).alias("avg_chars"),
        mean("content_ratio", 0.85).alias("c"),
        mean("digit_ratio", 0.10).alias("d"),
        mean("punct_ratio", 0.05).alias("p"),
        F.count_if(passed & (kind == "narrative")).alias("narrative"),
    )
    filter_score = F.col("passed") / F.col("total")
    length_score = F.least(F.lit(1.0), F.col("avg_chars") / max(int(chunk_size * 0.8), 1))
    content_score = _clamp(F.col("c") * 0.5 + (1 - F.col("d")) * 0.25 + (1 - F.col("p")) * 0.25)
    structure_score = F.least(F.lit(1.0), 0.6 + (1 - F.col("narrative") / F.col("passed")) * 0.4)
    score = F.round(
        _clamp(filter_score * 0.4 + length_score * 0.3 + content_score * 0.2 + structure_score * 0.1), 4
    )
    final = F.when(F.col("passed") == 0, F.lit(0.0)).otherwise(score)
    return per_doc.select("doc_id", final.alias("parse_score")).withColumn("quality_level", _level(F.col("parse_score")))


def simple_scores(judged: DataFrame, structure_type: Column | None = None, chunk_size: int = 500) -> DataFrame:
    """The short form used during ingestion: content counts as a fixed 0.75."""
    passed = F.col("reject_reason").isNull()
    kind = F.lit("text") if structure_type is None else structure_type
    per_doc = judged.groupBy("doc_id").agg(
        F.count("*").alias("total"), F.count_if(passed).alias("passed"),
        F.avg(F.when(passed, F.col("char_count"))).alias("avg_chars"),
        F.count_if(passed & (kind == "text")).alias("plain"),
    )
    score = (
        F.col("passed") / F.col("total") * 0.4
        + F.least(F.lit(1.0), F.col("avg_chars") / (chunk_size * 0.8)) * 0.3
        + 0.75 * 0.2
        + F.least(F.lit(1.0), 0.6 + (1 - F.col("plain") / F.col("passed")) * 0.4) * 0.1
    )
    return per_doc.select(
        "doc_id", F.when(F.col("passed") == 0, F.lit(0.0)).otherwise(_half_up(_clamp(score), 3)).alias("score")
    )


def legacy_scores(chunks: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    valid = F.count_if(F.length(tx.strip("content")) >= min_length) / F.count("*")
    return chunks.groupBy("doc_id").agg(
        F.round(valid, 6).alias("valid_ratio"),
        F.round(0.7 * valid + 0.3 * F.least(F.avg(F.length("content")) / 100, F.lit(1.0)), 6).alias("score"),
    )


def near_duplicates(judged: DataFrame, threshold: float = SIMILARITY_MAX) -> DataFrame:
    """The chunk similarity rule across the whole corpus.

    Copies are counted per hash first, so a group of copies is one row. Similar
    hashes differ in so few bits that each hash can name all its possible
    neighbours: an equality join on distinct keys finds them, never all pairs.
    """
    hashes = judged.filter("reject_reason IS NULL OR reject_reason IN ('DEDUP', 'LANGUAGE_CONSISTENCY')").groupBy(
        "char_hash"
    ).agg(F.count("*").alias("copies"), F.min(F.struct("doc_id", "chunk_idx")).alias("first"))
    hashes = materialize(hashes, "hashes")
    masks = F.array(*[F.lit(m).cast("long") for m in flips(threshold)])
    probes = hashes.select(
        F.col("char_hash").alias("origin"), F.col("first").alias("origin_first"),
        F.explode(F.transform(masks, lambda m: F.col("char_hash").bitwiseXOR(m))).alias("char_hash"),
    )
    close = (
        probes.join(hashes.select("char_hash", "first"), "char_hash")
        .filter(tx.bit_jaccard("origin", "char_hash") > threshold)
        .groupBy(F.col("origin").alias("char_hash"))
        .agg(
            F.count("*").alias("neighbours"),
            F.coalesce(F.max(F.col("first") < F.col("origin_first")), F.lit(False)).alias("has_earlier"),
        )
    )
    return hashes.join(close, "char_hash", "left").select(
        "char_hash", "copies", chunk_key("first.doc_id", "first.chunk_idx").alias("first_chunk_id"),
        F.coalesce("neighbours", F.lit(0)).alias("neighbours"),
        F.coalesce("has_earlier", F.lit(False)).alias("has_earlier_neighbour"),
    )


def duplicate_documents(docs: DataFrame, text: str = "text") -> DataFrame:
    """Content hashes held by several documents."""
    return (
        docs.groupBy(F.sha2(text, 256).alias("content_hash"))
        .agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc_id"), F.max("doc_id").alias("last_doc_id"))
        .filter("copies > 1")
    )


def unique_documents(docs: DataFrame, text: str = "text", overwrite: bool = False) -> DataFrame:
    """The first document per content, or the last where uploads overwrite.

    The survivor is chosen by a combined aggregate and rows are matched back on
    the unique document id, so a heap of copies never gathers in one task. Documents
    without a text (null) are one content: the first of them stays.
    """
    pick = F.max if overwrite else F.min
    kept = docs.groupBy(F.sha2(text, 256).alias("_h")).agg(pick("doc_id").alias("doc_id")).drop("_h")
    return docs.join(kept, "doc_id", "left_semi")
