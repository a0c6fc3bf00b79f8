"""Views derived from the input tables, in Spark and as SQL twins.

The inputs hold plain prose; the views give them the shapes the operators work
on (chunks, queries, logs, feedback, tags, structured documents, a graph).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions import text as tx
from docloom.operators import chunking
from docloom.plans.registry import cte, sql_strip
from docloom.plans.tables import Tables

AS_OF = "2024-01-31 00:00:00"


# --- chunks ------------------------------------------------------------------
def chunks(t: Tables, *keep: str) -> DataFrame:
    return chunking.fixed_chunks(t.documents, keep=keep)


cte(
    "chunks",
    f"""SELECT concat(doc_id, ':', chunk_idx) AS chunk_id, doc_id, chunk_idx, content,
               CAST(length(content) AS INT) AS char_count, lang, source
        FROM (SELECT doc_id, lang, source, content,
                     CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INT) AS chunk_idx
              FROM (SELECT doc_id, lang, source, i,
                           {sql_strip("substr(text, CAST(i * 500 + 1 AS BIGINT), 500)")} AS content
                    FROM (SELECT *, unnest(range(0, (length(text) + 499) // 500)) AS i
                          FROM documents))
              WHERE content <> '')""",
)


# --- queries -----------------------------------------------------------------
def queries(t: Tables) -> DataFrame:
    """Benchmark items and the user turns of conversations."""
    items = t.benchmark.select(
        F.concat(F.lit("b"), F.col("item_id")).alias("query_id"), F.col("text").alias("query")
    )
    turns = t.conversations.filter("role = 'user'").select(
        F.concat(F.lit("c"), F.col("conv_id"), F.lit("-"), F.col("turn")).alias("query_id"),
        F.col("text").alias("query"),
    )
    return items.unionByName(turns)


cte(
    "queries",
    """SELECT concat('b', item_id) AS query_id, text AS query FROM benchmark
       UNION ALL
       SELECT concat('c', conv_id, '-', turn), text FROM conversations WHERE role = 'user'""",
)


# --- logs and feedback ---------------------------------------------------------
def query_log(t: Tables) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return t.events.select(
        F.col("event_id").alias("log_id"),
        "user_id",
        F.col("ts").alias("created_at"),
        F.concat_ws(" ", "event_type", k).alias("question"),
        F.col("value").alias("latency_ms"),
        (k / 100).alias("confidence"),
        (F.col("event_type") == "view").alias("cache_hit"),
        F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status_code"),
        F.concat(F.lit("/api/"), "event_type").alias("endpoint"),
        F.concat(F.lit("t"), F.col("user_id") % 7).alias("tenant_id"),
        k.alias("k"),
    )


cte(
    "query_log",
    """SELECT event_id AS log_id, user_id, ts AS created_at,
              concat(event_type, ' ', k) AS question, value AS latency_ms,
              k / 100.0::DOUBLE AS confidence, event_type = 'view' AS cache_hit,
              CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status_code,
              concat('/api/', event_type) AS endpoint,
              concat('t', user_id % 7) AS tenant_id, k
       FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)""",
)


def feedback(t: Tables) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return t.events.filter(F.col("event_type").isin("purchase", "error")).select(
        F.col("event_id").alias("log_id"),
        "user_id",
        F.when(F.col("event_type") == "purchase", "like").otherwise("dislike").alias("feedback"),
        F.concat(F.lit("reason "), F.pmod(k, F.lit(5))).alias("reason"),
        F.col("ts").alias("created_at"),
    )


cte(
    "feedback",
    """SELECT log_id, user_id, CASE WHEN status_code = 500 THEN 'dislike' ELSE 'like' END AS feedback,
              concat('reason ', k % 5) AS reason, created_at
       FROM query_log WHERE endpoint IN ('/api/purchase', '/api/error')""",
    ("query_log",),
)


# --- documents as files, tags -------------------------------------------------
def files(t: Tables) -> DataFrame:
    """Documents seen as stored files: tenant = source, department = language."""
    return t.documents.select(
        "doc_id",
        F.concat(F.lit("doc"), "doc_id", F.lit("."),
                 F.element_at(F.array(*[F.lit(x) for x in ("txt", "md", "HTM", "pdf", "exe")]),
                              (F.col("doc_id") % 5 + 1).cast("int"))).alias("filename"),
        F.col("source").alias("tenant_id"),
        F.col("lang").alias("dept_id"),
        "n_chars",
        "text",
    )


cte(
    "files",
    """SELECT doc_id, concat('doc', doc_id, '.', ['txt','md','HTM','pdf','exe'][doc_id % 5 + 1]) AS filename,
              source AS tenant_id, lang AS dept_id, n_chars, text FROM documents""",
)


def doc_tags(t: Tables) -> DataFrame:
    """Language and source of each document as its tags."""
    return t.documents.select(
        "doc_id", F.explode(F.array(F.concat(F.lit("lang:"), "lang"), F.concat(F.lit("source:"), "source"))).alias("tag")
    )


def tags(t: Tables) -> DataFrame:
    """Tags of the documents, plus one per region that no document carries."""
    used = doc_tags(t).select("tag").distinct()
    return used.unionByName(t.region.select(F.concat(F.lit("region:"), "r_name").alias("tag")))


cte(
    "doc_tags",
    """SELECT doc_id, unnest([concat('lang:', lang), concat('source:', source)]) AS tag FROM documents""",
)
cte(
    "tags",
    """SELECT DISTINCT tag FROM doc_tags UNION ALL SELECT concat('region:', r_name) FROM region""",
    ("doc_tags",),
)


# --- structured documents -----------------------------------------------------
# Each line of a document takes one of sixteen roles by its position. Lines stay whole;
# blanks, fences and rules are lines of their own beside them.
def _role_line(line, i):
    r = i % 16
    level = (F.floor(i / 16) % 3 + 1).cast("int")
    lit = F.lit
    cell = F.replace(line, lit("|"), lit("/"))
    return (
        F.when(r == 0, F.concat(F.repeat(lit("#"), level), lit(" "), line))
        .when(r == 2, F.concat(lit("\n"), line))
        .when(r == 3, F.concat(lit("## "), line))
        .when(r.isin(4, 5, 6), F.concat(lit("- "), line))
        .when(r == 7, F.concat(lit("| "), cell, lit(" | v |")))
        .when(r == 8, F.concat(lit("|---|---|\n| s | "), cell, lit(" |")))
        .when(r == 9, F.concat(lit("| "), i, lit(" | "), cell, lit(" |")))
        .when(r == 10, F.concat(lit("```python\n"), line))
        .when(r == 11, F.concat(lit("def f"), i, lit("(x):\n"), line))
        .when(r == 12, F.concat(line, lit("\n```")))
        .when(r == 13, F.concat(lit("Step "), i, lit(": "), line))
        .when(r == 14, F.concat(lit("GET /v1/"), i, lit("\n"), line))
        .otherwise(line)
    )


def markup(t: Tables) -> DataFrame:
    lines = F.split("text", "\n")
    body = F.array_join(F.transform(lines, _role_line), "\n")
    head = F.concat(F.lit("# "), "source", F.lit("\n## "), "lang", F.lit("\n"))
    return t.documents.select("doc_id", "lang", "source", F.concat(head, body).alias("text"))


_ROLE_SQL = """CASE (i - 1) % 16
  WHEN 0 THEN concat(repeat('#', CAST(((i - 1) // 16) % 3 + 1 AS BIGINT)), ' ', line)
  WHEN 2 THEN concat(chr(10), line)
  WHEN 3 THEN concat('## ', line)
  WHEN 4 THEN concat('- ', line) WHEN 5 THEN concat('- ', line) WHEN 6 THEN concat('- ', line)
  WHEN 7 THEN concat('| ', replace(line, '|', '/'), ' | v |')
  WHEN 8 THEN concat('|---|---|', chr(10), '| s | ', replace(line, '|', '/'), ' |')
  WHEN 9 THEN concat('| ', i - 1, ' | ', replace(line, '|', '/'), ' |')
  WHEN 10 THEN concat('```python', chr(10), line)
  WHEN 11 THEN concat('def f', i - 1, '(x):', chr(10), line)
  WHEN 12 THEN concat(line, chr(10), '```')
  WHEN 13 THEN concat('Step ', i - 1, ': ', line)
  WHEN 14 THEN concat('GET /v1/', i - 1, chr(10), line)
  ELSE line END"""

cte(
    "markup",
    f"""SELECT doc_id, lang, source,
               concat('# ', source, chr(10), '## ', lang, chr(10),
                      array_to_string(list_transform(string_split(text, chr(10)), lambda line, i: {_ROLE_SQL}), chr(10))) AS text
        FROM documents""",
)
# Lines of the structured documents: number, character offset, text.
cte(
    "md_lines",
    """SELECT doc_id, line_no, line,
              CAST(coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no
                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
       FROM (SELECT doc_id, unnest(range(0, len(parts))) AS line_no, unnest(parts) AS line
             FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM markup))""",
    ("markup",),
)
