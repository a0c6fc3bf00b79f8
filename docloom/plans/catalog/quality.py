"""Chunk rules, duplicates and scores over all documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions import text as tx
from docloom.operators import chunking as ch
from docloom.operators import quality as ql
from docloom.plans import views as v
from docloom.plans.catalog.text import sql_char_hash
from docloom.plans.registry import cte, query, quote, sql_strip
from docloom.plans.tables import Tables


def judged(t: Tables):
    """Fixed chunks of each document plus one repeat of its first chunk."""
    docs = t.documents.select(
        "doc_id",
        ch.fixed_pieces("text").alias("p"),
        tx.language_profile("text").alias("profile"),
    ).select("doc_id", "profile", F.concat("p", F.slice("p", 1, 1)).alias("pieces"))
    return ql.judge_chunks(docs)


_PUNCT = tx.PUNCTUATION.replace("'", "''")
cte(
    "all_chunks",
    """SELECT doc_id, chunk_idx, content FROM chunks
       UNION ALL
       SELECT c.doc_id, n, content FROM chunks c JOIN (SELECT doc_id, CAST(count(*) AS INT) AS n FROM chunks GROUP BY 1) k
         ON k.doc_id = c.doc_id WHERE chunk_idx = 0""",
    ("chunks",),
)
cte(
    "rated",
    f"""SELECT *, CASE WHEN length(content) < 20 THEN 'MIN_LENGTH' WHEN content_ratio < 0.6 THEN 'CONTENT_RATIO'
                  WHEN digit_ratio > 0.8 THEN 'DIGIT_RATIO' WHEN punct_ratio > 0.7 THEN 'PUNCT_RATIO' END AS early
        FROM (SELECT doc_id, chunk_idx, content, CAST(length(content) AS INT) AS char_count,
                     length({sql_strip('content')}) / greatest(length(content), 1)::DOUBLE AS content_ratio,
                     len(regexp_extract_all(content, '\\d')) / greatest(length(content), 1)::DOUBLE AS digit_ratio,
                     len(regexp_extract_all(content, '{_PUNCT}')) / greatest(length(content), 1)::DOUBLE AS punct_ratio,
                     len(regexp_extract_all(content, '{tx.CJK}')) / greatest(length(content), 1)::DOUBLE AS zh,
                     CAST({sql_char_hash('content')} AS BIGINT) AS char_hash FROM all_chunks)""",
    ("all_chunks",),
)
# Ordered walk per document; ``seen`` is a JSON-free list of surviving hashes.
cte(
    "walk",
    """SELECT doc_id, -1 AS chunk_idx, []::BIGINT[] AS seen, false AS dup FROM documents
       UNION ALL
       SELECT w.doc_id, r.chunk_idx,
              CASE WHEN r.early IS NULL AND len(list_filter(w.seen, lambda s: s = r.char_hash OR (s | r.char_hash) = 0
                        OR bit_count(s & r.char_hash) / bit_count(s | r.char_hash)::DOUBLE > 0.95)) = 0
                   THEN list_append(w.seen, r.char_hash) ELSE w.seen END,
              r.early IS NULL AND len(list_filter(w.seen, lambda s: s = r.char_hash OR (s | r.char_hash) = 0
                        OR bit_count(s & r.char_hash) / bit_count(s | r.char_hash)::DOUBLE > 0.95)) > 0
       FROM walk w JOIN rated r ON r.doc_id = w.doc_id AND r.chunk_idx = w.chunk_idx + 1""",
    ("rated",),
)
cte(
    "judged",
    """SELECT concat(r.doc_id, ':', r.chunk_idx) AS chunk_id, r.*,
              CASE WHEN early IS NOT NULL THEN early WHEN dup THEN 'DEDUP'
                   WHEN primary_language <> 'mixed' AND abs(zh - zh_ratio) > 0.2 THEN 'LANGUAGE_CONSISTENCY' END AS reject_reason
       FROM rated r JOIN walk w ON w.doc_id = r.doc_id AND w.chunk_idx = r.chunk_idx
       JOIN profile p ON p.doc_id = r.doc_id""",
    ("rated", "walk", "profile"),
)


@query(
    "judge_chunks",
    """SELECT chunk_id, char_count, round(content_ratio, 6) AS content_ratio, round(digit_ratio, 6) AS digit_ratio,
              round(punct_ratio, 6) AS punct_ratio, char_hash, reject_reason FROM judged""",
    ("judged",),
)
def _(t: Tables):
    return judged(t).select(
        "chunk_id", "char_count", F.round("content_ratio", 6).alias("content_ratio"),
        F.round("digit_ratio", 6).alias("digit_ratio"), F.round("punct_ratio", 6).alias("punct_ratio"),
        "char_hash", "reject_reason",
    )


@query(
    "similar_chunks_in_document",
    "SELECT doc_id, count(*) AS repeated FROM judged WHERE reject_reason = 'DEDUP' GROUP BY 1",
    ("judged",),
)
def _(t: Tables):
    return judged(t).filter("reject_reason = 'DEDUP'").groupBy("doc_id").agg(F.count("*").alias("repeated"))


cte(
    "filter_report",
    """SELECT doc_id, total, total - rejected AS passed, rejected, round(rejected / total::DOUBLE, 6) AS filter_rate,
              concat_ws(',', CASE WHEN a > 0 THEN concat('MIN_LENGTH=', a) END, CASE WHEN b > 0 THEN concat('CONTENT_RATIO=', b) END,
                             CASE WHEN c > 0 THEN concat('DIGIT_RATIO=', c) END, CASE WHEN d > 0 THEN concat('PUNCT_RATIO=', d) END,
                             CASE WHEN e > 0 THEN concat('DEDUP=', e) END, CASE WHEN f > 0 THEN concat('LANGUAGE_CONSISTENCY=', f) END) AS reasons,
              rejected / total::DOUBLE > 0.3 AS warning
       FROM (SELECT doc_id, count(*) AS total, count(reject_reason) AS rejected,
                    count(*) FILTER (reject_reason = 'MIN_LENGTH') AS a, count(*) FILTER (reject_reason = 'CONTENT_RATIO') AS b,
                    count(*) FILTER (reject_reason = 'DIGIT_RATIO') AS c, count(*) FILTER (reject_reason = 'PUNCT_RATIO') AS d,
                    count(*) FILTER (reject_reason = 'DEDUP') AS e, count(*) FILTER (reject_reason = 'LANGUAGE_CONSISTENCY') AS f
             FROM judged GROUP BY 1)""",
    ("judged",),
)


@query("filter_report", "SELECT * FROM filter_report", ("filter_report",))
def _(t: Tables):
    return ql.filter_report(judged(t))


@query(
    "anomaly_events",
    "SELECT 'filter_rate_high' AS type, doc_id, filter_rate, 'warning' AS severity FROM filter_report WHERE warning",
    ("filter_report",),
)
def _(t: Tables):
    return ql.anomaly_events(ql.filter_report(judged(t)))


@query(
    "document_scores",
    """SELECT doc_id, score AS parse_score, CASE WHEN score >= 0.8 THEN 'excellent' WHEN score >= 0.65 THEN 'good'
              WHEN score >= 0.4 THEN 'fair' ELSE 'poor' END AS quality_level
       FROM (SELECT doc_id, CASE WHEN passed = 0 THEN 0.0::DOUBLE ELSE round(greatest(0, least(1,
                 passed / total::DOUBLE * 0.4 + least(1, avg_chars / 400) * 0.3
                 + greatest(0, least(1, c * 0.5 + (1 - d) * 0.25 + (1 - p) * 0.25)) * 0.2
                 + least(1, 0.6 + (1 - narrative / passed::DOUBLE) * 0.4) * 0.1)), 4) END AS score
             FROM (SELECT doc_id, count(*) AS total, count(*) FILTER (ok) AS passed, avg(char_count) FILTER (ok) AS avg_chars,
                          avg(CASE WHEN content_ratio = 0 THEN 0.85 ELSE content_ratio END) FILTER (ok) AS c,
                          avg(CASE WHEN digit_ratio = 0 THEN 0.10 ELSE digit_ratio END) FILTER (ok) AS d,
                          avg(CASE WHEN punct_ratio = 0 THEN 0.05 ELSE punct_ratio END) FILTER (ok) AS p,
                          count(*) FILTER (ok AND chunk_idx % 2 = 0) AS narrative
                   FROM (SELECT *, reject_reason IS NULL AS ok FROM judged) GROUP BY 1))""",
    ("judged",),
)
def _(t: Tables):
    kind = F.when(F.col("chunk_idx") % 2 == 0, "narrative").otherwise("code")
    return ql.document_scores(judged(t), kind)


@query(
    "simple_scores",
    """SELECT doc_id, CASE WHEN passed = 0 THEN 0.0::DOUBLE ELSE floor(greatest(0, least(1, passed / total::DOUBLE * 0.4
                 + least(1, avg_chars / 400) * 0.3 + 0.75::DOUBLE * 0.2 + 0.6::DOUBLE * 0.1)) * 1000 + 0.5 + 1e-9) / 1000 END AS score
       FROM (SELECT doc_id, count(*) AS total, count(*) FILTER (reject_reason IS NULL) AS passed,
                    avg(char_count) FILTER (reject_reason IS NULL) AS avg_chars FROM judged GROUP BY 1)""",
    ("judged",),
)
def _(t: Tables):
    return ql.simple_scores(judged(t))


@query(
    "legacy_scores",
    f"""SELECT doc_id, round(valid, 6) AS valid_ratio, round(0.7::DOUBLE * valid + 0.3::DOUBLE * least(a / 100, 1), 6) AS score
        FROM (SELECT doc_id, count(*) FILTER (length({sql_strip('content')}) >= 20) / count(*)::DOUBLE AS valid, avg(length(content)) AS a
              FROM chunks GROUP BY 1)""",
    ("chunks",),
)
def _(t: Tables):
    return ql.legacy_scores(v.chunks(t))


@query(
    "near_duplicates",
    """SELECT h.char_hash, copies, concat(fd, ':', fc) AS first_chunk_id, coalesce(n, 0) AS neighbours,
              coalesce(earlier, false) AS has_earlier_neighbour
       FROM hashes h LEFT JOIN
        (SELECT a.char_hash, count(*) AS n, bool_or((b.fd, b.fc) < (a.fd, a.fc)) AS earlier
         FROM (SELECT *, unnest(range(32)) AS bit FROM hashes) a JOIN hashes b ON b.char_hash = xor(a.char_hash, 1::BIGINT << bit)
         WHERE bit_count(a.char_hash & b.char_hash) / bit_count(a.char_hash | b.char_hash)::DOUBLE > 0.95 GROUP BY 1) c
       ON c.char_hash = h.char_hash""",
    ("hashes",),
)
def _(t: Tables):
    return ql.near_duplicates(judged(t))


cte(
    "hashes",
    """SELECT char_hash, count(*) AS copies, arg_min(doc_id, (doc_id, chunk_idx)) AS fd, arg_min(chunk_idx, (doc_id, chunk_idx)) AS fc
       FROM judged WHERE reject_reason IS NULL OR reject_reason IN ('DEDUP', 'LANGUAGE_CONSISTENCY') GROUP BY 1""",
    ("judged",),
)


@query(
    "duplicate_documents",
    """SELECT sha256(text) AS content_hash, count(*) AS copies, min(doc_id) AS first_doc_id, max(doc_id) AS last_doc_id
       FROM documents GROUP BY 1 HAVING count(*) > 1""",
)
def _(t: Tables):
    return ql.duplicate_documents(t.documents)


@query(
    "unique_documents",
    "SELECT min(doc_id) AS doc_id, 'first' AS kept FROM documents GROUP BY text UNION ALL SELECT max(doc_id), 'last' FROM documents GROUP BY text",
)
def _(t: Tables):
    first = ql.unique_documents(t.documents).select("doc_id", F.lit("first").alias("kept"))
    last = ql.unique_documents(t.documents, overwrite=True).select("doc_id", F.lit("last").alias("kept"))
    return first.unionByName(last)
