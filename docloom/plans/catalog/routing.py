"""Query classification, admission and document classification."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom import lexicon as lx
from docloom.functions import classify as cl
from docloom.functions import text as tx
from docloom.plans import views as v
from docloom.plans.catalog.text import WS
from docloom.plans.registry import cte, query, quote, sql_list, sql_strip
from docloom.plans.tables import Tables


def sql_any(expr: str, words) -> str:
    return f"len(list_filter({sql_list(words)}, lambda w: contains({expr}, w))) > 0"


cte(
    "tiers",
    f"""SELECT query_id, query,
          CASE WHEN length(s) < 15 AND ({sql_any('lower(s)', lx.TIER0_TERMS)}
                 OR (len(regexp_extract_all(s, '[^{WS}]+')) <= 2 AND length(s) < 10)) THEN 'C0'
               WHEN length(s) >= 40 OR {sql_any('lower(s)', lx.TIER2_TERMS)} THEN 'C2' ELSE 'C1' END AS tier
        FROM (SELECT *, {sql_strip('query')} AS s FROM queries)""",
    ("queries",),
)


def _argmax_sql(tables: dict, label: str) -> str:
    rows = ", ".join(
        f"({i}, {quote(name)}, {sql_list(words)})" for i, (name, words) in enumerate(tables.items())
    )
    return f"""SELECT query_id, query, name AS {label}, score, chars FROM (
        SELECT query_id, query, name, len(found) AS score,
               coalesce(list_sum(list_transform(found, lambda w: length(w))), 0) AS chars,
               row_number() OVER (PARTITION BY query_id ORDER BY len(found) DESC, rk) AS pos
        FROM (SELECT query_id, query, rk, name, list_filter(words, lambda w: contains(lower(query), w)) AS found
              FROM queries, (VALUES {rows}) AS p(rk, name, words))) WHERE pos = 1"""


cte("intents", _argmax_sql(cl.DEFAULT_INTENTS, "best"), ("queries",))
cte(
    "intent_of",
    """SELECT query_id, CASE WHEN score > 0 THEN best ELSE 'UNKNOWN' END AS intent, CAST(score AS INT) AS score,
              CASE WHEN score = 0 THEN 0.3::DOUBLE
                   ELSE round(least(1.0, 0.5 + chars / greatest(length(query), 1)::DOUBLE * 0.4), 4) END AS confidence
       FROM intents""",
    ("intents",),
)
cte("structures", _argmax_sql(lx.STRUCTURE_TERMS, "best_structure"), ("queries",))


@query("complexity_tier", "SELECT query_id, tier FROM tiers", ("tiers",))
def _(t: Tables):
    return v.queries(t).select("query_id", cl.complexity_tier("query").alias("tier"))


@query("semantic_intent", "SELECT query_id, intent, score FROM intent_of", ("intent_of",))
def _(t: Tables):
    return v.queries(t).select("query_id", cl.semantic_intent("query").alias("s")).select(
        "query_id", "s.intent", "s.score"
    )


@query("intent_confidence", "SELECT query_id, confidence FROM intent_of", ("intent_of",))
def _(t: Tables):
    return v.queries(t).select("query_id", cl.semantic_intent("query")["confidence"].alias("confidence"))


@query(
    "answer_structure",
    """SELECT query_id, CASE WHEN score > 0 THEN best_structure ELSE 'unknown' END AS structure FROM structures""",
    ("structures",),
)
def _(t: Tables):
    return v.queries(t).select("query_id", cl.answer_structure("query").alias("structure"))


_ROUTE_ROWS = ", ".join(
    f"({quote(c)}, {quote(i)}, {quote(r)})" for c, row in lx.ROUTES.items() for i, r in row.items()
)
cte(
    "routed",
    f"""SELECT q.query_id, tier, intent,
               coalesce(r.route, CASE tier WHEN 'C0' THEN 'direct_answer' WHEN 'C1' THEN 'rag' ELSE 'agentic_rag' END) AS route
        FROM tiers q JOIN intent_of i USING (query_id)
        LEFT JOIN (VALUES {_ROUTE_ROWS}) AS r(c, i, route) ON r.c = tier AND r.i = intent""",
    ("tiers", "intent_of"),
)


@query("route", "SELECT query_id, tier, intent, route FROM routed", ("routed",))
def _(t: Tables):
    return cl.classify(v.queries(t)).select("query_id", "tier", "intent", "route")


@query(
    "retrieval_breadth",
    """SELECT query_id, CAST(greatest(1, floor(10 * CASE route WHEN 'direct_retrieve' THEN 0.5 WHEN 'agentic_rag' THEN 1.5
              WHEN 'aggregate_retrieve' THEN 2.0 ELSE 1.0 END)) AS INT) AS breadth FROM routed""",
    ("routed",),
)
def _(t: Tables):
    return cl.classify(v.queries(t)).select("query_id", "breadth")


@query(
    "quick_action",
    f"""SELECT query_id, CASE
          WHEN regexp_full_match(d, '[\\d+\\-*/().^%×÷√]+') AND length(d) > 2 THEN 'calculator'
          WHEN length(q) < 10 AND {sql_any('q', lx.QUICK_GREETINGS)} THEN 'direct_answer'
          WHEN {sql_any('q', lx.QUICK_DATE_TERMS)} AND regexp_matches(q, '\\d{{4}}[年\\-/]\\d{{1,2}}|\\d+\\s*[天日](?:后|前)') THEN 'date_parser'
          WHEN {sql_any('q', lx.QUICK_REFUSE_TERMS)} THEN 'refuse' ELSE 'none' END AS action
        FROM (SELECT query_id, q, regexp_replace(q, '[计算等于多少求\\s?？=]', '', 'g') AS d
              FROM (SELECT query_id, lower({sql_strip('query')}) AS q FROM queries
                    UNION ALL SELECT concat('e', event_id), concat(value, '+', user_id) FROM events))""",
    ("queries",),
)
def _(t: Tables):
    sums = t.events.select(
        F.concat(F.lit("e"), "event_id").alias("query_id"),
        F.concat("value", F.lit("+"), "user_id").alias("query"),
    )
    return v.queries(t).unionByName(sums).select("query_id", cl.quick_action("query").alias("action"))


@query(
    "is_knowledge_query",
    f"""SELECT query_id, length({sql_strip('query')}) >= 8 AND {sql_any(f"lower({sql_strip('query')})", lx.KNOWLEDGE_TERMS)} AS knowledge
        FROM queries""",
    ("queries",),
)
def _(t: Tables):
    return v.queries(t).select("query_id", cl.is_knowledge_query("query").alias("knowledge"))


cte(
    "admitted",
    f"""SELECT query_id, query, CASE WHEN {sql_any('q', lx.REFUSE_TERMS)} THEN 'refuse_unsafe_content'
            WHEN length(q) < 3 THEN 'clarify_too_short'
            WHEN len(list_filter({sql_list(lx.VAGUE_PREFIXES)}, lambda w: starts_with(q, w))) > 0 THEN 'clarify_vague_query'
            ELSE '' END AS reason
        FROM (SELECT query_id, query, lower({sql_strip('query')}) AS q FROM queries)""",
    ("queries",),
)


@query(
    "query_admission",
    """SELECT query_id, CASE WHEN reason = '' THEN 'pass' ELSE split_part(reason, '_', 1) END AS decision, reason
       FROM admitted""",
    ("admitted",),
)
def _(t: Tables):
    return v.queries(t).select("query_id", cl.admission("query").alias("a")).select(
        "query_id", "a.decision", "a.reason"
    )


@query(
    "question_validation",
    f"""SELECT doc_id, CASE WHEN {sql_strip('text')} = '' THEN 'blank' WHEN length(text) > 2000 THEN 'too_long' END AS problem
        FROM documents""",
)
def _(t: Tables):
    return t.documents.select("doc_id", cl.question_problem("text").alias("problem"))


_STEP = r"^(?:(?:Step|步骤)\s+\d+[.:\s]|\d+[.、]\s+|第[一二三四五六七八九十\d]+步[:\s]|[（(]\d+[)）]\s+)"
cte(
    "structure_types",
    f"""SELECT doc_id, lang, CASE
          WHEN regexp_matches(text, '(?im)^(?:GET|POST|PUT|DELETE|PATCH|HEAD|OPTIONS)\\s+/[\\w/{{}}.\\-?_&=]*') THEN 'api_spec'
          WHEN len(list_filter(lines[1:50], lambda l: regexp_matches(l, '{_STEP}'))) >= 3 THEN 'procedural'
          WHEN len(list_filter(range(2, len(lines) + 1), lambda i: regexp_matches({sql_strip('lines[i]')}, '^\\|[\\s:\\-|]+\\|$')
                 AND regexp_matches({sql_strip('lines[i - 1]')}, '^\\|.+\\|$'))) > 0 THEN 'table'
          WHEN len(regexp_extract_all(text, '(?m)^\\s*(?:async\\s+)?(?:def|function|fn)\\s+\\w+'))
             + len(regexp_extract_all(text, '(?m)^\\s*(?:class|interface|struct|enum)\\s+\\w+')) >= 2 THEN 'code'
          ELSE 'narrative' END AS structure_type
        FROM (SELECT *, string_split(text, chr(10)) AS lines FROM markup)""",
    ("markup",),
)


@query("structure_type", "SELECT doc_id, structure_type FROM structure_types", ("structure_types",))
def _(t: Tables):
    return v.markup(t).select("doc_id", cl.structure_type("text").alias("structure_type"))


@query(
    "chunking_params",
    """SELECT doc_id, CAST(size AS INT) AS chunk_size, CAST(least(floor(size * 0.2), 200) AS INT) AS chunk_overlap,
              CAST(greatest(floor(size * 0.1), 20) AS INT) AS min_chunk_size, CAST(floor(size * 1.5) AS INT) AS max_chunk_size,
              primary_language AS language, true AS semantic_boundary,
              CASE WHEN ext IN ('txt', 'md', 'htm', 'pdf') THEN 'semantic' ELSE 'sliding' END AS strategy
       FROM (SELECT doc_id, primary_language, lower(split_part(filename, '.', 2)) AS ext,
                    greatest(CASE primary_language WHEN 'zh' THEN 400 WHEN 'en' THEN 300
                      ELSE greatest(floor((zh_ratio / greatest(zh_ratio + en_ratio, 0.01)) * 400
                           + (en_ratio / greatest(zh_ratio + en_ratio, 0.01)) * 300), 64) END, 64) AS size
             FROM profile JOIN files USING (doc_id))""",
    ("profile", "files"),
)
def _(t: Tables):
    f = v.files(t).withColumn("p", tx.language_profile("text"))
    params = cl.chunking_params(tx.file_extension("filename"), F.col("p"))
    return f.select("doc_id", params.alias("c")).select("doc_id", "c.*")


@query(
    "doc_type_size",
    """SELECT doc_id, CASE structure_type WHEN 'code' THEN 1200 ELSE 800 END AS chunk_size,
              CASE structure_type WHEN 'code' THEN 150 WHEN 'api_spec' THEN 50 ELSE 100 END AS chunk_overlap
       FROM structure_types""",
    ("structure_types",),
)
def _(t: Tables):
    kinds = v.markup(t).select("doc_id", cl.structure_type("text").alias("kind"))
    return kinds.select("doc_id", cl.doc_type_size("kind").alias("s")).select("doc_id", "s.*")
