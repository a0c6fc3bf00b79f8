"""Lookups, tags, permissions, sessions, paging and set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from docloom import lexicon as lx
from docloom.functions import classify as cl
from docloom.functions import text as tx
from docloom.functions import vectors as vx
from docloom.operators import containment as cn
from docloom.operators import ranking as rk
from docloom.operators import relations as rl
from docloom.operators import retrieval as rt
from docloom.plans import views as v
from docloom.plans.catalog.chunks import section_chunks, sql_cosine, sql_embed
from docloom.plans.catalog.reports import doc_status
from docloom.plans.registry import cte, query, quote
from docloom.plans.tables import Tables


@query("find_by_ids", "SELECT doc_id, lang, source FROM documents WHERE doc_id IN (3, 5, 8, 13, 144)")
def _(t: Tables):
    return rl.find(t.documents, [3, 5, 8, 13, 144], "doc_id").select("doc_id", "lang", "source")


@query("find_by_table", "SELECT doc_id, lang, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def _(t: Tables):
    return rl.find(t.documents, t.labels.select("doc_id"), "doc_id").select("doc_id", "lang", "source")


@query(
    "scoped_documents",
    "SELECT doc_id, status FROM doc_status WHERE source = 'src3' AND lang = 'en' AND status = 'done'",
    ("doc_status",),
)
def _(t: Tables):
    return rl.scoped(doc_status(t), source="src3", lang="en", status="done", owner=None).select("doc_id", "status")


@query(
    "browse_chunks",
    """SELECT doc_id FROM structure_types s JOIN markup USING (doc_id) WHERE structure_type = 'api_spec' AND contains(lower(text), 'the th')""",
    ("structure_types", "markup"),
)
def _(t: Tables):
    chunks = v.markup(t).select("doc_id", F.col("text").alias("content"), cl.structure_type("text").alias("structure_type"))
    return rl.browse_chunks(chunks, "api_spec", "The Th").select("doc_id")


@query(
    "tag_counts",
    "SELECT t.tag, count(d.doc_id) AS documents FROM tags t LEFT JOIN doc_tags d ON d.tag = t.tag GROUP BY 1",
    ("tags", "doc_tags"),
)
def _(t: Tables):
    return rl.tag_counts(v.tags(t), v.doc_tags(t))


@query(
    "document_tags",
    "SELECT d.doc_id, t.tag FROM tags t JOIN doc_tags d ON d.tag = t.tag",
    ("tags", "doc_tags"),
)
def _(t: Tables):
    return v.doc_tags(t).join(v.tags(t), "tag").select("doc_id", "tag")


@query(
    "with_any_tag",
    "SELECT doc_id FROM documents WHERE lang = 'fr' OR source = 'src1'",
)
def _(t: Tables):
    return rl.with_any_tag(t.documents, v.doc_tags(t), ["lang:fr", "source:src1"]).select("doc_id")


@query(
    "feedback_with_queries",
    "SELECT f.log_id, f.feedback, question, latency_ms FROM feedback f LEFT JOIN query_log q ON q.log_id = f.log_id",
    ("feedback", "query_log"),
)
def _(t: Tables):
    log = v.query_log(t).select("log_id", "question", "latency_ms")
    return v.feedback(t).select("log_id", "feedback").join(log, "log_id", "left")


def permissions(t: Tables):
    kind = F.element_at(F.array(*[F.lit(x) for x in ("public", "tenant", "dept", "user")]), (F.col("doc_id") % 4 + 1).cast("int"))
    value = (
        F.when(kind == "public", "").when(kind == "tenant", F.col("source")).when(kind == "dept", F.col("lang"))
        .otherwise((F.col("doc_id") % 150).cast("string"))
    )
    return t.documents.select("doc_id", kind.alias("scope_type"), value.alias("scope_value"))


@query(
    "visible_requests",
    """SELECT log_id, user_id, doc_id FROM
        (SELECT event_id AS log_id, user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS doc_id FROM events) r JOIN documents d USING (doc_id)
       WHERE doc_id % 4 = 0 OR (doc_id % 4 = 1 AND source = concat('src', user_id % 20))
          OR (doc_id % 4 = 2 AND lang = ['en', 'fr', 'de', 'es'][user_id % 4 + 1]) OR (doc_id % 4 = 3 AND doc_id % 150 = user_id)""",
)
def _(t: Tables):
    dept = F.element_at(F.array(*[F.lit(x) for x in ("en", "fr", "de", "es")]), (F.col("user_id") % 4 + 1).cast("int"))
    requests = v.query_log(t).select(
        "log_id", "user_id", F.col("k").cast("long").alias("doc_id"),
        F.concat(F.lit("src"), F.col("user_id") % 20).alias("tenant_id"), dept.alias("dept_id"),
    )
    return rl.visible(requests, permissions(t)).select("log_id", "user_id", "doc_id")


_DOOMED = "SELECT doc_id FROM labels WHERE toxic = 1"


@query(
    "cascade_delete",
    f"""SELECT 'documents' AS tab, count(*) AS n FROM documents WHERE doc_id NOT IN ({_DOOMED})
       UNION ALL SELECT 'chunks', count(*) FROM chunks WHERE doc_id NOT IN ({_DOOMED})
       UNION ALL SELECT 'vectors', count(*) FROM chunks WHERE doc_id NOT IN ({_DOOMED})
       UNION ALL SELECT 'postings', count(DISTINCT concat(chunk_id, ' ', term)) FROM
           (SELECT doc_id, chunk_id, unnest(regexp_extract_all(content, '{tx.INDEX_TOKEN}')) AS term FROM chunks) WHERE doc_id NOT IN ({_DOOMED})
       UNION ALL SELECT 'sections', count(DISTINCT concat(doc_id, ' ', section_no)) FROM sec_chunks WHERE doc_id NOT IN ({_DOOMED})
       UNION ALL SELECT 'tags', count(*) FROM doc_tags WHERE doc_id NOT IN ({_DOOMED})""",
    ("chunks", "doc_tags", "sec_chunks"),
)
def _(t: Tables):
    chunks = v.chunks(t)
    of_unit = F.substring_index("id", ":", 1).cast("long").alias("doc_id")
    kept = rl.cascade_delete(
        {
            "documents": t.documents.select("doc_id"),
            "chunks": chunks,
            "vectors": chunks.select("doc_id", "chunk_id", vx.hash_embed("content").alias("vec")),
            "postings": rt.postings(chunks).select(of_unit, "id", "term"),
            "sections": section_chunks(t).select("doc_id", "section_no").distinct(),
            "tags": v.doc_tags(t),
        },
        t.labels.filter("toxic = 1"),
    )
    parts = [df.agg(F.count("*").alias("n")).withColumn("tab", F.lit(name)) for name, df in kept.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)


def small_needles(t: Tables):
    return reduce(
        lambda a, b: a.unionByName(b),
        [
            t.nation.select(F.col("n_name").alias("needle")), t.region.select(F.col("r_name").alias("needle")),
            t.customer.select(F.col("c_mktsegment").alias("needle")), t.supplier.select(F.right("s_name", F.lit(4)).alias("needle")),
        ],
    )


@query(
    "customer_terms",
    """SELECT DISTINCT c_custkey, lower(needle) AS needle FROM customer,
         (SELECT n_name AS needle FROM nation UNION ALL SELECT r_name FROM region UNION ALL SELECT c_mktsegment FROM customer
          UNION ALL SELECT substr(s_name, length(s_name) - 3) FROM supplier)
       WHERE needle <> '' AND contains(lower(concat(c_name, ' ', c_mktsegment)), lower(needle))""",
)
def _(t: Tables):
    texts = t.customer.select("c_custkey", F.concat_ws(" ", "c_name", "c_mktsegment").alias("said"))
    return cn.contains_terms(texts, "said", small_needles(t)).select("c_custkey", "needle")


#: Short lines of the benchmark and all its words of eight letters or more.
WORD_NEEDLES = """SELECT DISTINCT lower(unnest(regexp_extract_all(text, '[^ .,;:!?]{8,}'))) AS needle FROM benchmark
    UNION SELECT lower(substr(text, 1, 60)) FROM benchmark"""
CONTAINED = f"SELECT doc_id, needle FROM documents, ({WORD_NEEDLES}) WHERE contains(lower(text), needle)"


def word_needles(t: Tables):
    words = F.explode(F.regexp_extract_all("text", F.lit("[^ .,;:!?]{8,}"), F.lit(0)))
    return t.benchmark.select(words.alias("needle")).union(t.benchmark.select(F.substring("text", 1, 60)))


@query("contained_terms", CONTAINED)
def _(t: Tables):
    """Words and openings of the benchmark in whole documents, by an automaton."""
    return cn.contains_terms(t.documents.select("doc_id", "text"), "text", word_needles(t)).select("doc_id", "needle")


@query("contained_terms_indexed", CONTAINED)
def _(t: Tables):
    """The same as for a needle set of any size, by its rarest grams."""
    found = cn.contains_terms(t.documents.select("doc_id", "text"), "text", word_needles(t), automaton_needles=0)
    return found.select("doc_id", "needle")


# --- sessions ---------------------------------------------------------------------
@query(
    "recent_messages",
    """SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) WHERE rn <= 4""",
)
def _(t: Tables):
    return rl.recent_messages(t.conversations, 4).select("conv_id", "turn", "role")


cte(
    "history",
    """SELECT conv_id, string_agg(concat(CASE WHEN role = 'user' THEN '用户' ELSE '助手' END, '：', substr(text, 1, 200)), chr(10) ORDER BY turn) AS transcript
       FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) WHERE rn <= 6 GROUP BY 1""",
)


@query("transcripts", "SELECT * FROM history", ("history",))
def _(t: Tables):
    return rl.histories(t.conversations, 20).select("conv_id", rk.transcript("history").alias("transcript"))


SYSTEM_PROMPT = "Answer from the sources given."


@query(
    "prompt_messages",
    f"""SELECT conv_id, concat('system:', {quote(SYSTEM_PROMPT)}, '#', coalesce(past, ''), 'user:', {quote(rk.CONTEXT_LABEL)}, 'ctx ', conv_id, chr(10), chr(10), {quote(rk.QUESTION_LABEL)}, 'question ', conv_id) AS prompt
        FROM (SELECT conv_id, concat(string_agg(concat(role, ':', substr(text, 1, 300)), '#' ORDER BY turn), '#') AS past
              FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) WHERE rn <= 6 GROUP BY 1)""",
)
def _(t: Tables):
    rows = rl.histories(t.conversations, 40).withColumns(
        {
            "query": F.concat(F.lit("question "), F.col("conv_id")),
            "context": F.concat(F.lit("ctx "), F.col("conv_id")),
        }
    )
    built = rk.prompt_messages(rows, SYSTEM_PROMPT)
    flat = F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["content"]))
    return built.select("conv_id", F.array_join(flat, "#").alias("prompt"))


@query(
    "topic_switches",
    f"""SELECT conv_id, turn, round(sim, 6) AS similarity, sim < 0.35 AS switched FROM
        (SELECT a.conv_id, a.turn, {sql_cosine('a.vec', 'b.vec', '0.0')} AS sim
         FROM (SELECT conv_id, turn, {sql_embed('text')} AS vec FROM conversations) a
         JOIN (SELECT conv_id, turn + 1 AS turn, {sql_embed('text')} AS vec FROM conversations) b
           ON b.conv_id = a.conv_id AND b.turn = a.turn)""",
)
def _(t: Tables):
    return rl.topic_switches(t.conversations)


@query(
    "conversation_markdown",
    """SELECT conv_id, string_agg(concat('## ', role, chr(10), chr(10), text), chr(10) || chr(10) ORDER BY turn) AS markdown
       FROM conversations GROUP BY 1""",
)
def _(t: Tables):
    return rl.conversation_markdown(t.conversations)


# --- paging -----------------------------------------------------------------------------
@query(
    "page",
    "SELECT log_id, created_at, latency_ms FROM query_log ORDER BY created_at DESC, log_id DESC LIMIT 21 OFFSET 40",
    ("query_log",),
)
def _(t: Tables):
    log = v.query_log(t).select("log_id", "created_at", "latency_ms")
    return rl.page(log, F.desc("created_at"), F.desc("log_id"), limit=20, offset=40)


@query(
    "keyset_page",
    """SELECT log_id, created_at FROM query_log WHERE (created_at, log_id) < (TIMESTAMP '2024-01-20 12:00:00', 5000)
       ORDER BY created_at DESC, log_id DESC LIMIT 20""",
    ("query_log",),
)
def _(t: Tables):
    log = v.query_log(t).select("log_id", "created_at")
    return rl.keyset_page(log, ("2024-01-20 12:00:00", 5000), key="log_id")


@query(
    "recent_feedback",
    "SELECT log_id, feedback, reason, created_at FROM feedback ORDER BY created_at DESC, log_id DESC LIMIT 20",
    ("feedback",),
)
def _(t: Tables):
    return (
        v.feedback(t).orderBy(F.desc("created_at"), F.desc("log_id")).limit(20)
        .select("log_id", "feedback", "reason", "created_at")
    )


@query(
    "audit_page",
    """SELECT event_id, ts, event_type, total FROM (SELECT *, count(*) OVER () AS total FROM events WHERE event_type = 'signup')
       ORDER BY ts DESC, event_id DESC LIMIT 10 OFFSET 10""",
)
def _(t: Tables):
    signups = t.events.filter("event_type = 'signup'")
    total = signups.agg(F.count("*").alias("total")).scalar()
    return (
        signups.orderBy(F.desc("ts"), F.desc("event_id")).offset(10).limit(10)
        .select("event_id", "ts", "event_type", total.alias("total"))
    )


# --- sets ---------------------------------------------------------------------------------
@query(
    "hash_sets",
    """SELECT coalesce(o.h, n.h) AS content_hash, CASE WHEN o.h IS NULL THEN 'created' WHEN n.h IS NULL THEN 'deleted' ELSE 'shared' END AS side
       FROM (SELECT DISTINCT substr(sha256(text), 1, 16) AS h FROM documents WHERE lang IN ('en', 'fr')) o
       FULL JOIN (SELECT DISTINCT substr(sha256(text), 1, 16) AS h FROM documents WHERE lang IN ('fr', 'de')) n ON o.h = n.h""",
)
def _(t: Tables):
    def hashes(*langs: str):
        return t.documents.filter(F.col("lang").isin(*langs)).select(tx.content_hash16("text").alias("content_hash"))

    return rl.hash_sets(hashes("en", "fr"), hashes("fr", "de"))


@query(
    "union_distinct",
    """SELECT doc_id FROM documents WHERE lang = 'de' UNION SELECT doc_id FROM labels WHERE toxic = 1""",
)
def _(t: Tables):
    german = t.documents.filter("lang = 'de'").select("doc_id")
    return german.unionByName(t.labels.filter("toxic = 1").select("doc_id")).dropDuplicates()


@query(
    "keyword_containment",
    f"""SELECT doc_id, needle FROM documents, (VALUES ('the'), ('ouen'), ('secret'), ('license')) AS n(needle) WHERE contains(lower(text), needle)""",
)
def _(t: Tables):
    return rl.contains_any(t.documents, "text", ["the", "ouen", "Secret", "license"]).select("doc_id", "needle")
