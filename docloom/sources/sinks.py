"""Rows as they are stored, and idempotent writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import text as tx

# Fixed value: longest stored chunk text in bytes.
MAX_TEXT_BYTES = 8000


def vector_rows(chunks: DataFrame, vectors: DataFrame | None = None) -> DataFrame:
    """Chunk rows of the vector table: missing fields defaulted, text cut to 8000
    bytes on a character. ``vectors`` is (chunk_id, vec)."""
    present = set(chunks.columns)

    def field(name: str, default, as_type: str = "string") -> Column:
        value = F.col(name).cast(as_type) if name in present else F.lit(None).cast(as_type)
        return F.coalesce(value, F.lit(default)).alias(name)

    rows = chunks.select(
        "chunk_id", field("doc_id", ""), field("chunk_idx", 0, "int"),
        tx.safe_truncate("content", MAX_TEXT_BYTES).alias("text"), field("parent_id", ""),
        field("heading", ""), field("chunk_type", "text"), field("page", 0, "int"), field("section", ""),
    )
    return rows if vectors is None else rows.join(vectors, "chunk_id")


def query_log_rows(answers: DataFrame, preview: int = 200) -> DataFrame:
    """Log rows: the answer's sources reduced to (idx, text preview, score, doc)."""
    short = F.transform(
        "sources",
        lambda s: F.struct(
            s["idx"].alias("idx"), F.substring(s["text"], 1, preview).alias("text"),
            s["score"].alias("score"), s["doc_id"].alias("doc_id"),
        ),
    )
    return answers.withColumn("sources", short)


def append_new(df: DataFrame, path: str, key: str, partition_by: str | None = None) -> None:
    """Append only the keys the table does not hold yet, so a repeated run adds
    nothing. The first run creates the table."""
    spark = df.sparkSession
    try:
        stored = spark.read.parquet(path).select(key).distinct()
    except Exception as exc:  # AnalysisException: no table yet
        if "PATH_NOT_FOUND" not in str(exc) and "UNABLE_TO_INFER_SCHEMA" not in str(exc):
            raise
        fresh = df
    else:
        fresh = df.join(stored, key, "left_anti")
    writer = fresh.write.mode("append")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)


def replace_partition(df: DataFrame, path: str, **partition) -> None:
    """Overwrite one partition folder; retrying a batch replaces its own output."""
    folder = path + "".join(f"/{k}={v}" for k, v in partition.items())
    df.write.mode("overwrite").parquet(folder)


def save_bucketed(df: DataFrame, table: str, key: str, buckets: int) -> None:
    """Table co-located on ``key``: joins and windows on it need no exchange."""
    df.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).saveAsTable(table)
