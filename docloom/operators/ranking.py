"""Top-k per query, rank fusion, reranking, gates and context assembly.

Hits are rows ``(query_id, <unit id>, score, ...)``. Texts are joined only after
ranking has cut each query to its k best, so no text is shuffled for scoring.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom import lexicon as lx
from docloom.functions import text as tx

RRF_K = 60
RERANK_TOP_N = 5


def ranked(hits: DataFrame, score: str = "score", key: str = "query_id", tie: Sequence[str] = ("id",)) -> DataFrame:
    """Adds a 0-based ``rnk`` by falling score; ties by the given columns."""
    w = Window.partitionBy(key).orderBy(F.desc(score), *tie)
    return hits.withColumn("rnk", F.row_number().over(w) - 1)


def top_k(hits: DataFrame, k: int | Column, score: str = "score", key: str = "query_id",
          tie: Sequence[str] = ("id",)) -> DataFrame:
    """The k best rows per key with their rank. A constant k lets Spark cut each
    partition before the shuffle, so a key with most of the rows stays small; for
    a k that varies by row, a constant cut at the largest k goes first."""
    w = Window.partitionBy(key).orderBy(F.desc(score), *tie)
    numbered = hits.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= k)
    return numbered.withColumn("rnk", F.col("_rn") - 1).drop("_rn")


def rrf(lists: dict[str, DataFrame], k: int = RRF_K, weights: dict[str, float] | None = None,
        digits: int | None = 6) -> DataFrame:
    """Reciprocal-rank fusion of ranked hit lists.

    ``lists`` maps a source name to ``(query_id, id, score, rnk)`` rows; the score of
    each source is kept as ``<source>_score``. A union and one aggregate replace the
    full outer join. Ties: best single rank, then the earlier source, then id.
    """
    weights = weights or {}
    parts = [
        df.select(
            "query_id", "id", F.lit(name).alias("src"), F.lit(i).alias("src_no"), "score", "rnk",
            (F.lit(float(weights.get(name, 1.0))) / (F.lit(k) + F.col("rnk") + 1)).alias("part"),
        )
        for i, (name, df) in enumerate(lists.items())
    ]
    # Summed in source order: floating-point sums must not depend on the plan.
    by_source = [F.sum(F.when(F.col("src_no") == i, F.col("part"))) for i in range(len(parts))]
    total = reduce(lambda a, b: a + b, [F.coalesce(s, F.lit(0.0)) for s in by_source])
    fused = (
        reduce(DataFrame.unionByName, parts)
        .groupBy("query_id", "id")
        .agg(
            (total if digits is None else F.round(total, digits)).alias("rrf_score"),
            *[F.max(F.when(F.col("src") == n, F.col("score"))).alias(f"{n}_score") for n in lists],
            F.min(F.struct("rnk", "src_no")).alias("_best"),
        )
    )
    return ranked(fused, "rrf_score", tie=("_best", "id")).drop("_best")


def multi_query_rrf(hits: DataFrame, k: int = RRF_K, digits: int = 9) -> DataFrame:
    """Cumulative fusion over the sub-queries of a parent query: every list of
    every sub-query adds its reciprocal ranks. Input rows carry ``parent_id``."""
    pooled = hits.groupBy("parent_id", "id").agg(
        F.round(F.sum(1.0 / (F.lit(k) + F.col("rnk") + 1)), digits).alias("rrf_score"),
        F.count("*").alias("lists"),
    )
    return ranked(pooled, "rrf_score", key="parent_id")


def in_scope(hits: DataFrame, scope: DataFrame, on: Sequence[str] | str = "doc_id") -> DataFrame:
    """Hits whose document lies in the scope."""
    return hits.join(scope, on, "left_semi")


def keyword_coverage(keywords: Column, text: Column) -> Column:
    return F.size(F.filter(keywords, lambda k: F.contains(text, k))) / F.size(keywords)


def rerank(hits: DataFrame, queries: DataFrame, texts: DataFrame, top_n: int = RERANK_TOP_N,
           rrf_weight: float = 0.6, keyword_weight: float = 0.4) -> DataFrame:
    """Blend the fused score with keyword coverage; a query without keywords
    keeps its fused order. ``texts`` is ``(id, text)``."""
    words = queries.select("query_id", tx.keywords("query").alias("_kw"))
    joined = hits.join(words, "query_id").join(texts.select("id", "text"), "id")
    blended = F.round(
        F.col("rrf_score") * rrf_weight + keyword_coverage(F.col("_kw"), F.col("text")) * keyword_weight, 6
    )
    scored = joined.withColumn("rerank_score", F.when(F.size("_kw") > 0, blended).otherwise(F.col("rrf_score")))
    return top_k(scored.withColumnRenamed("rnk", "rrf_rank"), top_n, "rerank_score", tie=("rrf_rank", "id")).drop("_kw")


def rerank_with(hits: DataFrame, scorer, max_chars: int = 512, top_n: int = RERANK_TOP_N) -> DataFrame:
    """Rerank by a user-supplied scorer, a pandas UDF ``(query, text) -> double``.
    Pairs without a score get 0.0; hits must carry ``query`` and ``text``."""
    score = F.coalesce(scorer(F.col("query"), F.substring("text", 1, max_chars)), F.lit(0.0))
    scored = hits.withColumn("rerank_score", F.round(score, 6))
    return top_k(scored.withColumnRenamed("rnk", "rrf_rank"), top_n, "rerank_score", tie=("rrf_rank", "id"))


# --- filters and gates ---------------------------------------------------------
def _longest_share(chars: Column) -> Column:
    """Count of the most frequent element, by run lengths of the sorted array."""

    def runs(ordered: Column) -> Column:
        n = F.size(ordered)
        starts = F.filter(
            F.sequence(F.lit(0), n - 1),
            lambda i: (i == 0) | (F.get(ordered, i) != F.get(ordered, F.greatest(i - 1, F.lit(0)))),
        )
        return tx.bind(
            starts, lambda s: F.array_max(F.transform(s, lambda at, k: F.coalesce(F.get(s, k + 1), n) - at))
        )

    return tx.bind(F.sort_array(chars), lambda o: F.when(F.size(o) > 0, runs(o)).otherwise(F.lit(0)))


def is_garbage(col) -> Column:
    """Blank, one character over 40 %, digits over 50 %, or a run of nine."""

    def judge(text: Column) -> Column:
        size = F.greatest(F.length(text), F.lit(1))
        chars = F.split(F.translate(text, " \n\t", ""), "")
        return (
            (text == "")
            | (_longest_share(F.filter(chars, lambda c: c != "")) / size > 0.4)
            | (F.regexp_count(text, F.lit(r"(?U)\d")) / size > 0.5)
            | text.rlike(r"(.)\1{8,}")
        )

    return tx.bind(tx.strip(F.coalesce(tx._c(col), F.lit(""))), judge)


def drop_garbage(hits: DataFrame, text: str = "text") -> DataFrame:
    return hits.filter(~is_garbage(text))


def relevance_gate(queries: DataFrame, hits: DataFrame, contexts: DataFrame, min_score: float = 0.02,
                   min_overlap: float = 0.3) -> DataFrame:
    """query_id, relevant: good enough best hit, a context, and enough of the
    query's words in it."""
    best = hits.groupBy("query_id").agg(F.max("rerank_score").alias("_best"))
    q = F.lower(tx.strip("query"))
    words = F.regexp_extract_all(q, F.lit(r"[\x{4e00}-\x{9fff}]{2,}|[a-z]{2,}"), F.lit(0))
    rows = (
        queries.select("query_id", words.alias("_w"))
        .join(contexts.select("query_id", F.lower("context").alias("_c")), "query_id", "left")
        .join(best, "query_id", "left")
    )
    enough = (F.size("_w") == 0) | (keyword_coverage(F.col("_w"), F.col("_c")) >= min_overlap)
    ok = (
        (F.col("_best").isNull() | (F.col("_best") >= min_score))
        & (F.coalesce("_c", F.lit("")) != "")
        & enough
    )
    return rows.select("query_id", F.coalesce(ok, F.lit(False)).alias("relevant"))


def retrieval_gate(hits: DataFrame, score: str = "dense_score", threshold: float = 0.3) -> DataFrame:
    """query_id, good: best similarity reaches the threshold."""
    return hits.groupBy("query_id").agg(
        (F.coalesce(F.max(score), F.lit(0.0)) >= threshold).alias("good")
    )


def confidence(hits: DataFrame, self_score: float = 0.0, similarity: str = "dense_score") -> DataFrame:
    """Weighted confidence per query from rerank scores and best similarity."""
    mean = F.avg("rerank_score")
    scaled = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(mean > 1, mean / 10).otherwise(mean * 20)))
    best = F.greatest(F.coalesce(F.max(similarity), F.lit(0.0)), F.lit(0.0))
    total = 0.5 * scaled + 0.3 * best + 0.2 * self_score
    return hits.groupBy("query_id").agg(
        F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)), 4).alias("confidence")
    )


# --- context --------------------------------------------------------------------
def expand_parents(hits: DataFrame, max_parents: int = 2) -> DataFrame:
    """The first hit of each of the first two distinct parents shows the parent's
    text. Hits carry ``parent_id`` and ``parent_text`` (empty if none)."""
    has = (F.coalesce("parent_id", F.lit("")) != "") & (F.coalesce("parent_text", F.lit("")) != "")
    by_parent = Window.partitionBy("query_id", "parent_id").orderBy("rnk")
    by_rank = Window.partitionBy("query_id").orderBy("rnk").rowsBetween(Window.unboundedPreceding, 0)
    marked = hits.withColumn("_first", has & (F.row_number().over(by_parent) == 1))
    counted = marked.withColumn("_nth", F.sum(F.col("_first").cast("int")).over(by_rank))
    expanded = F.col("_first") & (F.col("_nth") <= max_parents)
    return counted.withColumns(
        {"expanded": expanded, "text": F.when(expanded, F.col("parent_text")).otherwise(F.col("text"))}
    ).drop("_first", "_nth")


def build_context(hits: DataFrame, max_chars: int = 3000, graph: str | None = None) -> DataFrame:
    """Numbered source blocks per query up to a character budget.

    Blocks are kept while their running length fits; of the first block that does
    not fit, the part that still does is added if more than 100 characters are
    left. Blank texts are skipped but keep their number. Hits are top-k lists, so
    the rows collected per query are few.
    """
    before, after = lx.CONTEXT_HEADER.split("{n}")
    body = tx.strip("text")
    number = (F.col("rnk") + 1).cast("string")
    header = F.concat(F.lit(before), number, F.lit(after))
    used = F.length(F.coalesce(F.col(graph), F.lit(""))) if graph else F.lit(0)
    w = Window.partitionBy("query_id").orderBy("rnk").rowsBetween(Window.unboundedPreceding, 0)
    rows = hits.select(
        "query_id", "rnk", body.alias("_t"), header.alias("_h"), used.alias("_used"),
        (F.coalesce(F.col(graph), F.lit("")) if graph else F.lit("")).alias("_g"),
    )
    size = F.when(F.col("_t") == "", 0).otherwise(F.length("_h") + F.length("_t"))
    sized = rows.withColumn("_size", size).withColumn("_sum", F.col("_used") + F.sum("_size").over(w))
    overflow = F.sum((F.col("_sum") > max_chars).cast("int")).over(w)
    left = max_chars - (F.col("_sum") - F.col("_size"))
    block = (
        F.when(F.col("_t") == "", None)
        .when(F.col("_sum") <= max_chars, F.concat("_h", "_t"))
        .when((F.col("_over") == 1) & (left > 100), F.concat("_h", F.substring(F.col("_t"), F.lit(1), left.cast("int"))))
    )
    blocks = sized.withColumn("_over", overflow).withColumn("_block", block)
    parts = F.transform(
        F.array_sort(F.collect_list(F.when(F.col("_block").isNotNull(), F.struct("rnk", "_block")))),
        lambda s: s["_block"],
    )
    lead = F.first(F.when(F.col("_g") != "", F.array("_g")).otherwise(F.array().cast("array<string>")))
    return blocks.groupBy("query_id").agg(
        F.array_join(F.concat(lead, parts), lx.CONTEXT_SEPARATOR).alias("context")
    )


def sources(hits: DataFrame, preview: int = 200, score: str = "rerank_score") -> DataFrame:
    """Response sources per query: ordered (idx, text, score, doc) structs."""
    entry = F.struct(
        (F.col("rnk") + 1).cast("int").alias("idx"),
        F.substring(F.coalesce("text", F.lit("")), 1, preview).alias("text"),
        F.round(score, 4).alias("score"),
        F.col("id").cast("string").alias("doc_id"),
    )
    return hits.groupBy("query_id").agg(F.array_sort(F.collect_list(entry)).alias("sources"))


def degraded_answer(contexts: DataFrame, gate: DataFrame, chars: int = 400) -> DataFrame:
    """Answer without a model: a notice, or an extract of the context."""
    joined = contexts.join(gate, "query_id", "left")
    empty = F.coalesce("context", F.lit("")) == ""
    low = ~F.coalesce("relevant", F.lit(False))
    return joined.select(
        "query_id",
        F.when(empty, lx.NO_CONTEXT_ANSWER)
        .when(low, lx.LOW_RELEVANCE_ANSWER)
        .otherwise(F.concat(F.lit(lx.EXTRACT_PREFIX), F.substring("context", 1, chars), F.lit("…")))
        .alias("answer"),
        F.when(empty, "NO_CONTEXT").when(low, "LOW_RELEVANCE").otherwise("LLM_TIMEOUT").alias("degrade_reason"),
    )


# Labels inside prompts.
CONTEXT_LABEL = "【参考资料】\n"
QUESTION_LABEL = "【问题】\n"
USER_LABEL, ASSISTANT_LABEL = "用户", "助手"


def prompt_messages(rows: DataFrame, system_prompt: str, turns: int = 6, cut: int = 300) -> DataFrame:
    """Message arrays for offline batch inference. ``rows`` carries ``query``,
    ``context`` and ``history``, an ordered array of (role, content)."""

    def message(role, content) -> Column:
        return F.struct(role.alias("role"), content.alias("content"))

    recent = F.slice("history", -F.least(F.size("history"), F.lit(turns)), F.lit(turns))
    past = F.transform(
        F.when(F.size("history") > 0, recent).otherwise(F.col("history")),
        lambda m: message(m["role"], F.substring(F.coalesce(m["content"], F.lit("")), 1, cut)),
    )
    question = F.concat(
        F.lit(CONTEXT_LABEL), F.coalesce("context", F.lit("")), F.lit("\n\n" + QUESTION_LABEL), tx.sanitize_input("query")
    )
    messages = F.concat(
        F.array(message(F.lit("system"), F.lit(system_prompt))), past, F.array(message(F.lit("user"), question))
    )
    return rows.withColumn("messages", messages)


def transcript(history, turns: int = 6, cut: int = 200) -> Column:
    """The last turns as labelled lines."""
    h = tx._c(history)
    recent = F.when(F.size(h) > 0, F.slice(h, -F.least(F.size(h), F.lit(turns)), F.lit(turns))).otherwise(h)
    lines = F.transform(
        recent,
        lambda m: F.concat(
            F.when(m["role"] == "user", USER_LABEL).otherwise(ASSISTANT_LABEL), F.lit("："),
            F.substring(F.coalesce(m["content"], F.lit("")), 1, cut),
        ),
    )
    return F.array_join(lines, "\n")
