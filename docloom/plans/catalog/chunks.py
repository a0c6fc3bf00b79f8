"""Chunking, links between chunks, incremental updates."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions import text as tx
from docloom.functions import vectors as vx
from docloom.operators import chunking as ch
from docloom.operators import structure as st
from docloom.plans import views as v
from docloom.plans.catalog.text import _SENT, _SENT_DOT
from docloom.plans.registry import cte, query, quote, sql_strip
from docloom.plans.tables import Tables

MARK = "chr(1)"


@query(
    "fixed_chunks",
    """SELECT chunk_id, doc_id, chunk_idx, content, char_count,
              CASE WHEN chunk_idx > 0 THEN concat(doc_id, ':', chunk_idx - 1) END AS prev_chunk_id,
              lead(chunk_id) OVER (PARTITION BY doc_id ORDER BY chunk_idx) AS next_chunk_id FROM chunks""",
    ("chunks",),
)
def _(t: Tables):
    return v.chunks(t)


cte(
    "sentence_lists",
    f"""SELECT doc_id, s, list_transform(range(0, len(s) + 1), lambda i: coalesce(list_sum(list_transform(s[1:i], lambda x: length(x))), 0)) AS cum
        FROM (SELECT doc_id, list_filter(list_transform({_SENT}, lambda x: {sql_strip('x')}), lambda x: x <> '') AS s
              FROM (SELECT doc_id, {sql_strip('text')} AS text FROM documents))""",
)
cte(
    "sliding",
    """SELECT doc_id, s, cum, -1::BIGINT AS idx, 0::BIGINT AS lo, 0::BIGINT AS hi, 0::BIGINT AS nxt FROM sentence_lists WHERE len(s) > 0
       UNION ALL
       SELECT doc_id, s, cum, idx + 1, nxt, e,
              greatest(list_min(list_filter(range(0, e + 1), lambda b: cum[e + 1] - cum[b + 1] <= 100)), nxt + 1)
       FROM (SELECT *, greatest(coalesce(list_max(list_filter(range(nxt + 1, len(s) + 1), lambda e: cum[e + 1] - cum[nxt + 1] <= 500)), 0), nxt + 1) AS e
             FROM sliding WHERE nxt < len(s))""",
    ("sentence_lists",),
)


@query(
    "sliding_chunks",
    """SELECT doc_id, CAST(idx AS INT) AS chunk_idx, array_to_string(s[lo + 1:hi], '') AS content FROM sliding WHERE idx >= 0""",
    ("sliding",),
)
def _(t: Tables):
    return ch.sliding_chunks(t.documents).select("doc_id", "chunk_idx", "content")


@query(
    "endpoint_pieces",
    f"""SELECT doc_id, array_to_string(list_filter(p, lambda x, i: length(x) > 50 OR i = len(p)), '|') AS pieces
        FROM (SELECT doc_id, string_split(regexp_replace(text, '\\n((?i:GET|POST|PUT|DELETE|PATCH|HEAD|OPTIONS)\\s+/)', {MARK} || '\\1', 'g'), {MARK}) AS p
              FROM markup)""",
    ("markup",),
)
def _(t: Tables):
    return v.markup(t).select("doc_id", F.array_join(ch.endpoint_pieces("text"), "|").alias("pieces"))


@query(
    "code_pieces",
    f"""SELECT doc_id, array_to_string(list_filter(p, lambda x, i: i > 1 OR len(p) = 1 OR length({sql_strip('x')}) > 20), '|') AS pieces
        FROM (SELECT doc_id, string_split(regexp_replace(text,
                '\\n([\\t\\x0b\\f\\r ]*(?:async\\s+)?(?:def|function|fn)\\s+\\w+|[\\t\\x0b\\f\\r ]*(?:class|interface|struct|enum)\\s+\\w+)', {MARK} || '\\1', 'g'), {MARK}) AS p
              FROM markup)""",
    ("markup",),
)
def _(t: Tables):
    return v.markup(t).select("doc_id", F.array_join(ch.code_pieces("text"), "|").alias("pieces"))


@query("procedure_pieces")
def _(t: Tables):
    return v.markup(t).select("doc_id", F.posexplode(ch.procedure_pieces("text")).alias("piece_no", "piece"))


def csv_files(t: Tables):
    """Each document read as a CSV file: lines are rows, commas separate cells."""
    return t.documents.select("doc_id", F.regexp_replace("text", r'["\r]', "").alias("content"))


cte(
    "csv_tables",
    f"""SELECT doc_id, array_to_string(list_concat([concat('| ', array_to_string(rs[1], ' | '), ' |'),
                 concat('| ', array_to_string(list_transform(range(n), lambda i: '---'), ' | '), ' |')],
                 list_transform(rs[2:], lambda r: concat('| ', array_to_string(list_concat(r, list_transform(range(n - len(r)), lambda i: '')), ' | '), ' |'))), chr(10)) AS md
        FROM (SELECT doc_id, rs, list_max(list_transform(rs, lambda r: len(r))) AS n FROM
              (SELECT doc_id, list_transform(string_split(regexp_replace(content, '\n\\z', ''), chr(10)),
                        lambda l: list_transform(string_split(l, ','), lambda c: {sql_strip('c')})) AS rs
               FROM (SELECT doc_id, regexp_replace(text, '["\\r]', '', 'g') AS content FROM documents) WHERE content <> ''))""",
)


@query(
    "table_pieces",
    """SELECT doc_id, CASE WHEN hdr IS NULL OR len(data) = 0 THEN md
              WHEN len(data) <= 15 THEN array_to_string(list_concat([hdr, sep], data), chr(10))
              ELSE array_to_string(list_transform(range((len(data) + 9) // 10), lambda g: array_to_string(list_concat([hdr, sep], data[g * 10 + 1:g * 10 + 10]), chr(10))), '#') END AS pieces
       FROM (SELECT doc_id, md, CASE WHEN regexp_matches(ls[1], '^\\|.+\\|$') AND regexp_matches(ls[2], '^\\|[\\s:\\-|]+\\|$') THEN ls[1] END AS hdr, ls[2] AS sep,
                    list_filter(ls[3:], lambda l: regexp_matches(l, '^\\|.+\\|$')) AS data
             FROM (SELECT doc_id, md, string_split(md, chr(10)) AS ls FROM csv_tables))""",
    ("csv_tables",),
)
def _(t: Tables):
    from docloom.sources.files import csv_markdown

    tables = csv_files(t).select("doc_id", csv_markdown("content").alias("md")).filter("md <> ''")
    return tables.select("doc_id", F.array_join(ch.table_pieces("md"), "#").alias("pieces"))


@query("recursive_chunks")
def _(t: Tables):
    return ch.link_leaves(ch.recursive_chunks(v.markup(t)))


_VEC = """list_transform(range(0, 32), lambda d: len(list_filter(cells, lambda c: c = d))::DOUBLE)"""


def sql_embed(expr: str) -> str:
    """32-dimensional token-count vector of a text."""
    cells = (
        f"list_transform(regexp_extract_all(lower({expr}), '{tx.INDEX_TOKEN}'), "
        "lambda w: CAST(concat('0x', substr(md5(w), 1, 4)) AS INT) % 32)"
    )
    return f"list_transform(range(0, 32), lambda d: len(list_filter({cells}, lambda c: c = d))::DOUBLE)"


def sql_cosine(a: str, b: str, empty: str) -> str:
    na, nb = f"list_inner_product({a}, {a})", f"list_inner_product({b}, {b})"
    return f"CASE WHEN {na} = 0 OR {nb} = 0 THEN {empty} ELSE list_inner_product({a}, {b}) / (sqrt({na}) * sqrt({nb})) END"


@query(
    "topic_pieces",
    f"""SELECT doc_id, CAST(piece_no AS BIGINT) AS piece_no, string_agg(sentence, '' ORDER BY i) AS content
        FROM (SELECT *, sum(CASE WHEN n >= 3 AND sim < 0.5 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS piece_no
              FROM (SELECT *, CASE WHEN prev IS NOT NULL THEN {sql_cosine('vec', 'prev', '1.0')} END AS sim
                    FROM (SELECT *, lag(vec) OVER (PARTITION BY doc_id ORDER BY i) AS prev, count(*) OVER (PARTITION BY doc_id) AS n
                          FROM (SELECT doc_id, i, sentence, {_VEC} AS vec
                                FROM (SELECT doc_id, i, sentence, list_transform(regexp_extract_all(lower(sentence), '{tx.INDEX_TOKEN}'),
                                             lambda w: CAST(concat('0x', substr(md5(w), 1, 4)) AS INT) % 32) AS cells
                                      FROM (SELECT doc_id, unnest(range(len(s))) AS i, unnest(s) AS sentence
                                            FROM (SELECT doc_id, list_filter(list_transform({_SENT_DOT},
                                                     lambda x, i: CASE WHEN i = 1 THEN x ELSE ltrim(x, {quote(v.tx.lx.WHITESPACE)}) END),
                                                     lambda x: {sql_strip('x')} <> '') AS s
                                                  FROM (SELECT doc_id, {sql_strip('text')} AS text FROM documents))))))))
        GROUP BY doc_id, piece_no""",
)
def _(t: Tables):
    return ch.topic_pieces(t.documents)


_OPENS = (
    r"[\t\x0b\f\r ]*(?:export\s+)?(?:abstract\s+)?class\s+\w+|"
    r"[\t\x0b\f\r ]*(?:pub(?:\s*\(\s*crate\s*\))?\s+)?(?:async\s+|unsafe\s+)?(?:def|fn|func|function)\s+\w+|"
    r"[\t\x0b\f\r ]*(?:import|from|use|package|require)\s"
)


@query(
    "code_units",
    f"""SELECT doc_id, unit_type, CASE WHEN unit_type = 'class' THEN rtrim(w, '{{:') WHEN unit_type = 'function' THEN split_part(w, '(', 1) ELSE '' END AS name,
               start_line, end_line, content FROM
        (SELECT doc_id, content, end_line, end_line - h + 1 AS start_line, regexp_extract({sql_strip("split_part(content, chr(10), 1)")}, '(\\S+)$', 1) AS w,
                CASE WHEN regexp_matches(content, '^[ \\t]*(?:export\\s+)?(?:abstract\\s+)?class\\s+\\w+') THEN 'class'
                     WHEN regexp_matches(content, '^[ \\t]*(?:pub(?:\\s*\\(\\s*crate\\s*\\))?\\s+)?(?:async\\s+|unsafe\\s+)?(?:def|fn|func|function)\\s+\\w+') THEN 'function'
                     WHEN regexp_matches(content, '^[ \\t]*(?:import|from|use|package|require)\\s') THEN 'import' END AS unit_type
         FROM (SELECT doc_id, content, h, CAST(sum(h) OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) AS end_line
               FROM (SELECT doc_id, i, content, len(string_split(content, chr(10))) AS h
                     FROM (SELECT doc_id, unnest(range(len(p))) AS i, unnest(p) AS content
                           FROM (SELECT doc_id, string_split(regexp_replace(text, '\\n({_OPENS})', {MARK} || '\\1', 'g'), {MARK}) AS p FROM markup)))))
        WHERE unit_type IS NOT NULL
        UNION ALL
        SELECT doc_id, 'module', '', 1, len(string_split(text, chr(10))), text FROM markup
        WHERE NOT regexp_matches(text, '(?m)^(?:{_OPENS})') OR NOT contains(text, chr(10))""",
    ("markup",),
)
def _(t: Tables):
    return ch.code_units(v.markup(t))


# --- chunks of sections ---------------------------------------------------------
def section_chunks(t: Tables):
    """Sections of the structured documents cut into 300-character chunks."""
    sections = st.split_sections(v.markup(t))
    rows = sections.select(
        "doc_id", "section_no", "heading", F.posexplode(ch.fixed_pieces("content", 300)).alias("piece", "content")
    )
    order = st.by_doc("section_no", "piece")
    return rows.withColumn("chunk_idx", F.row_number().over(order) - 1).select(
        ch.chunk_key("doc_id", "chunk_idx").alias("chunk_id"), "doc_id", "chunk_idx", "section_no",
        "heading", "content", F.when(F.col("piece") == 0, "text").otherwise("list").alias("chunk_type"),
    )


cte(
    "sec_chunks",
    f"""SELECT concat(doc_id, ':', chunk_idx) AS chunk_id, * FROM
        (SELECT doc_id, section_no, heading, content, CASE WHEN piece = 0 THEN 'text' ELSE 'list' END AS chunk_type,
                CAST(row_number() OVER (PARTITION BY doc_id ORDER BY section_no, piece) - 1 AS INT) AS chunk_idx
         FROM (SELECT doc_id, section_no, heading, content,
                      row_number() OVER (PARTITION BY doc_id, section_no ORDER BY i) - 1 AS piece
               FROM (SELECT doc_id, section_no, heading, i, {sql_strip("substr(content, CAST(i * 300 + 1 AS BIGINT), 300)")} AS content
                     FROM (SELECT *, unnest(range(0, (length(content) + 299) // 300)) AS i FROM sections)) WHERE content <> ''))""",
    ("sections",),
)


def page_map(t: Tables):
    """A page starts every 1000 characters."""
    size = F.length("text")
    return v.markup(t).select(
        "doc_id", F.explode(F.sequence(F.lit(0), F.floor(size / 1000))).alias("p")
    ).select("doc_id", (F.col("p") * 1000).alias("offset"), (F.col("p") + 1).cast("int").alias("page"))


@query(
    "chunk_positions",
    """SELECT chunk_id, char_start, char_start + length(content) AS char_end, substr(sha256(content), 1, 16) AS chunk_hash,
              CAST(least(char_start // 1000, total // 1000) + 1 AS INT) AS page
       FROM (SELECT c.*, length(m.text) AS total, CAST(coalesce(sum(length(content)) OVER (PARTITION BY c.doc_id ORDER BY chunk_idx
                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS char_start
             FROM sec_chunks c JOIN markup m USING (doc_id))""",
    ("sec_chunks", "markup"),
)
def _(t: Tables):
    return ch.inject_positions(section_chunks(t), page_map(t)).select(
        "chunk_id", "char_start", "char_end", "chunk_hash", "page"
    )


@query(
    "section_runs",
    """SELECT chunk_id, CAST(section_run AS BIGINT) AS section_run, first(chunk_id) OVER w AS parent_chunk_id,
              lag(chunk_id) OVER w AS prev_chunk_id, lead(chunk_id) OVER w AS next_chunk_id
       FROM (SELECT *, sum(CASE WHEN heading <> '' AND before <> heading THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY chunk_idx) AS section_run
             FROM (SELECT *, last_value(nullif(heading, '') IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY chunk_idx
                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM sec_chunks))
       WINDOW w AS (PARTITION BY doc_id, section_run ORDER BY chunk_idx)""",
    ("sec_chunks",),
)
def _(t: Tables):
    return ch.group_sections(section_chunks(t)).select(
        "chunk_id", "section_run", "parent_chunk_id", "prev_chunk_id", "next_chunk_id"
    )


@query(
    "chunk_relations",
    """SELECT c.chunk_id, coalesce(last_value(s.section_id IGNORE NULLS) OVER w, '') AS parent_section_id,
              coalesce(last_value(s.root_title IGNORE NULLS) OVER w, '') AS root_section,
              CASE WHEN chunk_type <> 'heading' THEN lag(chunk_id) OVER o END AS prev_chunk_id,
              CASE WHEN chunk_type <> 'heading' THEN lead(chunk_id) OVER o END AS next_chunk_id
       FROM (SELECT *, CASE WHEN chunk_type = 'list' THEN '' ELSE heading END AS h FROM sec_chunks) c
       LEFT JOIN (SELECT doc_id, title, arg_max(section_id, order_index) AS section_id, arg_max(root_title, order_index) AS root_title
                  FROM tree GROUP BY 1, 2) s ON s.doc_id = c.doc_id AND s.title = c.h
       WINDOW w AS (PARTITION BY c.doc_id ORDER BY chunk_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
              o AS (PARTITION BY c.doc_id ORDER BY chunk_idx)""",
    ("sec_chunks", "tree"),
)
def _(t: Tables):
    tree = st.section_tree(st.headings(st.line_rows(v.markup(t))))
    bare = section_chunks(t).withColumn("heading", F.when(F.col("chunk_type") == "list", "").otherwise(F.col("heading")))
    return ch.relate_sections(bare, tree).select(
        "chunk_id", "parent_section_id", "root_section", "prev_chunk_id", "next_chunk_id"
    )


@query(
    "section_texts",
    """SELECT doc_id, section_no, string_agg(content, chr(10) || chr(10) ORDER BY chunk_idx) AS section_text
       FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, section_no ORDER BY chunk_idx) AS rn FROM sec_chunks)
       WHERE rn <= 5 GROUP BY 1, 2""",
    ("sec_chunks",),
)
def _(t: Tables):
    return ch.section_texts(section_chunks(t))


cte(
    "new_chunks",
    f"""SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INT) AS chunk_idx, content
        FROM (SELECT doc_id, i, {sql_strip("substr(text, CAST(i * 500 + 1 AS BIGINT), 500)")} AS content
              FROM (SELECT doc_id, text, unnest(range(0, (length(text) + 499) // 500)) AS i
                    FROM (SELECT doc_id, CASE lang WHEN 'de' THEN concat('neu ', text) WHEN 'fr' THEN concat(text, ' fin') ELSE text END AS text FROM documents)))
        WHERE content <> ''""",
)


@query(
    "incremental_diff",
    """SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, coalesce(o.h, n.h) AS chunk_hash,
              CASE WHEN o.h IS NULL THEN 'create' WHEN n.h IS NULL THEN 'delete' ELSE 'keep' END AS action,
              coalesce(o.chunk_id, n.chunk_id) AS chunk_id
       FROM (SELECT doc_id, substr(sha256(content), 1, 16) AS h, arg_min(chunk_id, chunk_idx) AS chunk_id FROM chunks GROUP BY 1, 2) o
       FULL JOIN (SELECT doc_id, substr(sha256(content), 1, 16) AS h, arg_min(concat(doc_id, ':', chunk_idx), chunk_idx) AS chunk_id
                  FROM new_chunks GROUP BY 1, 2) n ON n.doc_id = o.doc_id AND n.h = o.h""",
    ("chunks", "new_chunks"),
)
def _(t: Tables):
    changed = (
        F.when(F.col("lang") == "de", F.concat(F.lit("neu "), "text"))
        .when(F.col("lang") == "fr", F.concat("text", F.lit(" fin")))
        .otherwise(F.col("text"))
    )
    return ch.diff_chunks(v.chunks(t), ch.fixed_chunks(t.documents.withColumn("text", changed)))
