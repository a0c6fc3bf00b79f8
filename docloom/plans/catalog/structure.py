"""Structure of documents rendered as Markdown."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions import classify as cl
from docloom.operators import structure as st
from docloom.operators.asof import asof_join
from docloom.plans import views as v
from docloom.plans.registry import cte, query, sql_strip
from docloom.plans.tables import Tables

_CN_SECTION = r"^(?:第[一二三四五六七八九十百千\d]+[章节篇条款]|[一二三四五六七八九十]+[、.．]|\d+[、.．]\s*\S)"
# RE2 has no look-ahead; a following digit or stop is checked separately.
_CN_OUTLINE = (
    r"^(第[一二三四五六七八九十百千\d]+[章节篇部]|[一二三四五六七八九十]+[、．.]|\d+(?:\.\d+)*[\s　]+|"
    r"[A-Z]\.\d+(?:\.\d+)*|第[一二三四五六七八九十百千\d]+[条]|附[则条]|[（(][一二三四五六七八九十]+[)）])"
)

cte(
    "outline",
    f"""SELECT doc_id, line_no, start, start + CASE WHEN md THEN length(line) ELSE length(prefix) END AS "end",
               CAST(CASE WHEN md THEN length(regexp_extract(line, '^(#{{1,6}})\\s+(.+)$', 1))
                 WHEN contains(prefix, '第') AND contains(prefix, '章') THEN 1
                 WHEN contains(prefix, '第') AND contains(prefix, '节') THEN 2
                 WHEN regexp_matches(prefix, '^\\d') THEN 3 ELSE 2 END AS INT) AS level,
               CASE WHEN md THEN {sql_strip("regexp_extract(line, '^(#{1,6})\\s+(.+)$', 2)")} ELSE {sql_strip('prefix')} END AS title
        FROM (SELECT *, regexp_matches(line, '^#{{1,6}}\\s+.+$') AS md,
                     CASE WHEN regexp_matches(line, '^\\d+(?:\\.\\d+)*[\\s　]+[\\d.]') THEN '' ELSE regexp_extract(line, '{_CN_OUTLINE}', 1) END AS prefix
              FROM md_lines) WHERE md OR prefix <> ''""",
    ("md_lines",),
)
cte(
    "section_heads",
    f"""SELECT doc_id, line_no, start,
               CAST(CASE WHEN md THEN length(regexp_extract(line, '^(#{{1,6}})\\s+(.+)$', 1)) ELSE 2 END AS INT) AS level,
               CASE WHEN md THEN {sql_strip("regexp_extract(line, '^(#{1,6})\\s+(.+)$', 2)")} ELSE s END AS title
        FROM (SELECT *, regexp_matches(line, '^#{{1,6}}\\s+.+$') AS md, {sql_strip('line')} AS s FROM md_lines)
        WHERE md OR (regexp_matches(line, '{_CN_SECTION}') AND length(s) < 50)""",
    ("md_lines",),
)


@query("section_headings", "SELECT doc_id, start, level, title FROM section_heads", ("section_heads",))
def _(t: Tables):
    return st.headings(st.line_rows(v.markup(t)), "sections").select("doc_id", "start", "level", "title")


@query("outline_headings", 'SELECT doc_id, start, "end", level, title FROM outline', ("outline",))
def _(t: Tables):
    return st.headings(st.line_rows(v.markup(t))).select("doc_id", "start", "end", "level", "title")


cte(
    "elements",
    f"""SELECT doc_id, 'heading' AS type, start, "end", level, title, '' AS detail FROM outline
        UNION ALL
        SELECT doc_id, 'code_block', eol, nxt, 0, '', lang FROM (
           SELECT doc_id, start + length(line) AS eol, regexp_extract(line, '^```(\\w*)\\s*$', 1) AS lang,
                  lead(start) OVER w AS nxt, row_number() OVER w AS n
           FROM md_lines WHERE regexp_matches(line, '^```(\\w*)\\s*$') WINDOW w AS (PARTITION BY doc_id ORDER BY line_no))
        WHERE n % 2 = 1 AND nxt IS NOT NULL
        UNION ALL
        SELECT doc_id, 'table', min(start), max(start + length(line) + 1), 0, '',
               concat(array_to_string(list_transform(string_split(regexp_extract(arg_min(line, line_no), '^\\|(.+)\\|\\s*$', 1), '|'),
                      lambda c: {sql_strip('c')}), ','), ' rows=', count(*) - 2)
        FROM (SELECT *, max(hd) OVER (PARTITION BY doc_id, island ORDER BY line_no) AS seen FROM
              (SELECT *, CASE WHEN NOT sep AND coalesce(lead(sep) OVER (PARTITION BY doc_id, island ORDER BY line_no), false) THEN 1 ELSE 0 END AS hd FROM
               (SELECT *, line_no - row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS island,
                       regexp_matches(line, '^\\|[\\s\\-:|]+\\|\\s*$') AS sep
                FROM md_lines WHERE regexp_matches(line, '^\\|(.+)\\|\\s*$'))))
        WHERE seen = 1 GROUP BY doc_id, island
        UNION ALL
        SELECT doc_id, 'list', min(start), max(start + length(line) + 1), 0, '', '' FROM
          (SELECT *, sum(CASE WHEN item AND (low IS NULL OR indent < low) THEN 1 ELSE 0 END)
                     OVER (PARTITION BY doc_id, run ORDER BY line_no) AS n FROM
           (SELECT *, min(indent) OVER (PARTITION BY doc_id, run ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS low FROM
            (SELECT * FROM (SELECT *, sum(CASE WHEN member THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS run FROM
              (SELECT *, CASE WHEN item THEN length(regexp_extract(line, '^(\\s*)([-*+]|\\d+[.)])\\s+', 1)) END AS indent,
                      item OR {sql_strip('line')} = '' OR starts_with(line, '  ') AS member
               FROM (SELECT *, regexp_matches(line, '^(\\s*)([-*+]|\\d+[.)])\\s+') AS item FROM md_lines))) WHERE member)))
        WHERE n > 0 GROUP BY doc_id, run, n HAVING count(*) >= 3
        UNION ALL
        SELECT doc_id, 'procedure', start, start + length(mark), 0, {sql_strip('mark')}, ''
        FROM (SELECT doc_id, start, regexp_extract(concat(line, chr(10)), '^(?:Step|步骤|STEP)\\s*\\d+[：:.\\s]') AS mark FROM md_lines)
        WHERE mark <> ''""",
    ("outline", "md_lines"),
)


@query("structure_elements", "SELECT * FROM elements", ("elements",))
def _(t: Tables):
    return st.structure_elements(v.markup(t))


@query(
    "document_type",
    """SELECT d.doc_id, CASE WHEN coalesce(code_block, 0) >= 3 THEN 'code' WHEN coalesce(procedure, 0) >= 3 THEN 'tutorial'
              WHEN coalesce(tab, 0) >= 3 THEN 'table_doc'
              WHEN regexp_matches(text, '(?i)\\b(GET|POST|PUT|DELETE|PATCH)\\s+/\\S+') THEN 'api_spec'
              WHEN coalesce(heading, 0) >= 10 THEN 'faq' ELSE 'narrative' END AS document_type
       FROM markup d LEFT JOIN
         (SELECT doc_id, count(*) FILTER (type = 'code_block') AS code_block, count(*) FILTER (type = 'procedure') AS procedure,
                 count(*) FILTER (type = 'table') AS tab, count(*) FILTER (type = 'heading') AS heading
          FROM elements GROUP BY 1) e ON e.doc_id = d.doc_id""",
    ("elements", "markup"),
)
def _(t: Tables):
    counts = st.element_counts(v.markup(t))
    kinds = {k: F.col(k) for k in ("heading", "code_block", "table", "list", "procedure", "api")}
    return counts.select("doc_id", cl.document_type(kinds).alias("document_type"))


# Recursive walk from each heading to its nearest earlier heading of lower level.
cte(
    "numbered_heads",
    """SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1 AS INT) AS order_index FROM outline""",
    ("outline",),
)
cte(
    "parents",
    """SELECT c.*, substr(sha256(concat(c.doc_id, ':', c.title, ':', c.order_index)), 1, 16) AS section_id,
              (SELECT max(p.order_index) FROM numbered_heads p
               WHERE p.doc_id = c.doc_id AND p.order_index < c.order_index AND p.level < c.level) AS parent_idx
       FROM numbered_heads c""",
    ("numbered_heads",),
)
cte(
    "tree",
    """SELECT doc_id, order_index, section_id, title, level, start, parent_idx, title AS path, title AS root_title, '' AS parent_id
       FROM parents WHERE parent_idx IS NULL
       UNION ALL
       SELECT c.doc_id, c.order_index, c.section_id, c.title, c.level, c.start, c.parent_idx,
              concat(p.path, ' > ', c.title), p.root_title, p.section_id
       FROM parents c JOIN tree p ON p.doc_id = c.doc_id AND p.order_index = c.parent_idx""",
    ("parents",),
)


@query(
    "section_tree",
    "SELECT doc_id, section_id, title, level, order_index, parent_id, path, root_title FROM tree",
    ("tree",),
)
def _(t: Tables):
    tree = st.section_tree(st.headings(st.line_rows(v.markup(t))))
    return tree.select(
        "doc_id", "section_id", "title", "level", "order_index", "parent_id",
        F.array_join("path", " > ").alias("path"), "root_title",
    )


@query(
    "section_children",
    """SELECT doc_id, parent_id, count(*) AS children, count(*) FILTER (level = 2) AS level2 FROM tree GROUP BY 1, 2""",
    ("tree",),
)
def _(t: Tables):
    tree = st.section_tree(st.headings(st.line_rows(v.markup(t))))
    return tree.groupBy("doc_id", "parent_id").agg(
        F.count("*").alias("children"), F.count_if(F.col("level") == 2).alias("level2")
    )


cte(
    "md_chunks",
    f"""SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INT) AS chunk_idx, i * 500 AS char_start, content
        FROM (SELECT doc_id, i, {sql_strip("substr(text, CAST(i * 500 + 1 AS BIGINT), 500)")} AS content
              FROM (SELECT *, unnest(range(0, (length(text) + 499) // 500)) AS i FROM markup)) WHERE content <> ''""",
    ("markup",),
)


def md_chunks(t: Tables):
    """Fixed slices of the structured documents with their offset."""
    pieces = F.regexp_extract_all("text", F.lit("(?s).{1,500}"), F.lit(0))
    rows = v.markup(t).select("doc_id", F.posexplode(pieces).alias("i", "raw"))
    return rows.select("doc_id", (F.col("i") * 500).alias("char_start"), v.tx.strip("raw").alias("content")).filter("content <> ''")


@query(
    "chunk_sections",
    """SELECT doc_id, char_start, coalesce((SELECT arg_max(title, o.start) FROM outline o
               WHERE o.doc_id = c.doc_id AND o.start <= c.char_start), '') AS section FROM md_chunks c""",
    ("md_chunks", "outline"),
)
def _(t: Tables):
    heads = st.headings(st.line_rows(v.markup(t)))
    placed = asof_join(
        md_chunks(t).select("doc_id", "char_start"), heads, ["doc_id"], "char_start", "start", ["title"]
    )
    return placed.select("doc_id", "char_start", F.coalesce("title", F.lit("")).alias("section"))


# Sections between headings, or blank-line paragraphs where there is no heading.
cte(
    "sections",
    f"""SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY raw_no) - 1 AS INT) AS section_no, heading, content
        FROM (SELECT doc_id, raw_no, coalesce(max(heading), '') AS heading,
                     {sql_strip("string_agg(line, chr(10) ORDER BY line_no) FILTER (NOT is_head)")} AS content
              FROM (SELECT l.doc_id, l.line_no, line, h.title IS NOT NULL AS is_head, h.title AS heading,
                           sum(CASE WHEN h.title IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY l.doc_id ORDER BY l.line_no) AS raw_no
                    FROM md_lines l LEFT JOIN section_heads h ON h.doc_id = l.doc_id AND h.line_no = l.line_no)
              GROUP BY doc_id, raw_no) WHERE content <> ''""",
    ("md_lines", "section_heads"),
)


@query("split_sections", "SELECT * FROM sections", ("sections",))
def _(t: Tables):
    return st.split_sections(v.markup(t))
