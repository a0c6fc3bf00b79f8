"""From raw documents to token ids: rules, line and document deduplication, mixing, encoding.

Each stage takes (spark, docs, sf_dir). All but the last return the columns of ``docs``,
whatever their names and number; ``doc_id``, ``text``, ``source`` and ``n_chars`` are used.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import bpe, lines, mixing, near_duplicates, repetition
from docloom.llm.tables import read
from docloom.session import materialize

TOKENS = "byte_bpe_50k.tiktoken"
ROLES = ("doc_id", "text", "source", "n_chars")


def _plain(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The same rows under names that no operator uses, and the new names of the roles."""
    names = [f"_c{i}" for i in range(len(docs.columns))]
    return docs.toDF(*names), {old: new for old, new in zip(docs.columns, names) if old in ROLES}


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are not repetitive; null texts have no words and go."""
    rows, at = _plain(docs)
    judged = repetition.quality(rows, text=at["text"], carry=tuple(rows.columns))
    return judged.filter("kept").select(*rows.columns).toDF(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that come later than a similar one. A document goes when
    none of its lines with words is left; others keep their other columns, with the new length."""
    rows, at = _plain(docs)
    rest = tuple(c for c in rows.columns if c not in (at["doc_id"], at["text"]))
    out = lines.dedup_lines(rows, text=at["text"], key=at["doc_id"], carry=rest)
    has_words = F.coalesce(F.col("kept_text").rlike("[^\\x20\\x09-\\x0D]"), F.lit(False))
    out = out.filter((F.col("n_removed") == 0) | has_words).withColumnRenamed("kept_text", at["text"])
    if "n_chars" in at:
        kind = rows.schema[at["n_chars"]].dataType
        length = F.when(F.col("n_removed") > 0, F.length(at["text"]).cast(kind)).otherwise(F.col(at["n_chars"]))
        out = out.withColumn(at["n_chars"], length)
    return out.select(*rows.columns).toDF(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    rows, at = _plain(docs)
    return near_duplicates.deduplicated(rows, text=at["text"], key=at["doc_id"]).toDF(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the mixture of their sources."""
    rows, at = _plain(docs)
    return mixing.mixed(rows, source=at["source"], key=at["doc_id"]).toDF(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and the digest of their decoding."""
    return bpe.encode(docs, public_tokenizers.path(TOKENS), public_tokenizers.PATTERN)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("encode", encode),
]

#: Hash-based stages and merges have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
