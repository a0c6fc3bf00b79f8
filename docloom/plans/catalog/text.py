"""Text functions over whole documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom import lexicon as lx
from docloom.functions import text as tx
from docloom.functions import vectors as vx
from docloom.plans import views as v
from docloom.plans.registry import cte, query, quote, sql_strip
from docloom.plans.tables import Tables

# RE2 has no Unicode-aware \s; spell the class out.
WS = r"\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
DOT_STOP = "。！？.!?\n"


def _sql_clean(expr: str) -> str:
    s = f"nfc_normalize({expr})"
    s = f"regexp_replace({s}, '\\r\\n?', chr(10), 'g')"
    s = f"regexp_replace({s}, '\\n{{3,}}', chr(10) || chr(10), 'g')"
    s = f"regexp_replace({s}, '[ \\t]{{3,}}', ' ', 'g')"
    s = f"regexp_replace({s}, '[^{tx.KEEP_RANGES}]', '', 'g')"
    return sql_strip(s)


@query("clean_text", f"SELECT doc_id, {_sql_clean('text')} AS cleaned FROM documents")
def _(t: Tables):
    return t.documents.select("doc_id", tx.clean_text("text").alias("cleaned"))


_PROFILE = f"""
SELECT doc_id,
       CASE WHEN length(text) = 0 THEN 'en' WHEN zh > 0.7 THEN 'zh' WHEN en > 0.7 THEN 'en' ELSE 'mixed' END AS primary_language,
       zh AS zh_ratio, en AS en_ratio,
       CASE WHEN length(text) = 0 THEN 5.0::DOUBLE WHEN words > 0 THEN letters / words::DOUBLE ELSE 1.0::DOUBLE END AS avg_word_length
FROM (SELECT doc_id, text,
             len(regexp_extract_all(text, '{tx.CJK}')) / greatest(length({sql_strip('text')}), 1)::DOUBLE AS zh,
             len(regexp_extract_all(text, '[a-zA-Z]')) / greatest(length({sql_strip('text')}), 1)::DOUBLE AS en,
             len(regexp_extract_all(text, '[^{WS}]+')) AS words,
             length(regexp_replace(text, '[{WS}]+', '', 'g')) AS letters
      FROM documents)"""
cte("profile", _PROFILE)


@query(
    "language_profile",
    """SELECT doc_id, primary_language, round(zh_ratio, 6) AS zh_ratio, round(en_ratio, 6) AS en_ratio,
              round(avg_word_length, 6) AS avg_word_length FROM profile""",
    ("profile",),
)
def _(t: Tables):
    p = tx.language_profile("text")
    return t.documents.select("doc_id", p.alias("p")).select(
        "doc_id",
        "p.primary_language",
        F.round("p.zh_ratio", 6).alias("zh_ratio"),
        F.round("p.en_ratio", 6).alias("en_ratio"),
        F.round("p.avg_word_length", 6).alias("avg_word_length"),
    )


@query(
    "dynamic_chunk_size",
    """SELECT doc_id, CAST(CASE primary_language WHEN 'zh' THEN 400 WHEN 'en' THEN 300
         ELSE greatest(floor((zh_ratio / greatest(zh_ratio + en_ratio, 0.01)) * 400
                           + (en_ratio / greatest(zh_ratio + en_ratio, 0.01)) * 300), 64) END AS INT) AS chunk_size
       FROM profile""",
    ("profile",),
)
def _(t: Tables):
    return t.documents.select("doc_id", tx.language_profile("text").alias("p")).select(
        "doc_id", tx.dynamic_chunk_size(F.col("p")).alias("chunk_size")
    )


@query(
    "doc_language",
    f"""SELECT doc_id, CASE WHEN length(text) = 0 THEN 'unknown'
          WHEN len(regexp_extract_all(text, '{tx.CJK}')) / length(text)::DOUBLE > 0.15 THEN 'zh' ELSE 'en' END AS language
        FROM documents""",
)
def _(t: Tables):
    return t.documents.select("doc_id", tx.doc_language("text").alias("language"))


@query(
    "tokenize",
    f"""SELECT doc_id, CAST(len(toks) AS INT) AS n_tokens, array_to_string(toks, ' ') AS tokens
        FROM (SELECT doc_id, regexp_extract_all(text, '{tx.INDEX_TOKEN}') AS toks FROM documents)""",
)
def _(t: Tables):
    return t.documents.select("doc_id", tx.tokenize("text").alias("toks")).select(
        "doc_id", F.size("toks").alias("n_tokens"), F.array_join("toks", " ").alias("tokens")
    )


@query(
    "keywords",
    f"""SELECT query_id, array_to_string(list_sort(list_distinct(regexp_extract_all(query, '{tx.KEYWORD}'))), ' ') AS keywords
        FROM queries""",
    ("queries",),
)
def _(t: Tables):
    return v.queries(t).select(
        "query_id", F.array_join(F.array_sort(tx.keywords("query")), " ").alias("keywords")
    )


_SENT = "regexp_extract_all(text, '[^。！？!?\\n]*[。！？!?\\n]|[^。！？!?\\n]+')"


@query(
    "split_sentences",
    f"""SELECT doc_id, CAST(len(s) AS INT) AS n_sentences, array_to_string(s, '|') AS sentences
        FROM (SELECT doc_id, list_filter(list_transform({_SENT}, lambda x: {sql_strip('x')}), lambda x: x <> '') AS s
              FROM documents)""",
)
def _(t: Tables):
    return t.documents.select("doc_id", tx.split_sentences("text").alias("s")).select(
        "doc_id", F.size("s").alias("n_sentences"), F.array_join("s", "|").alias("sentences")
    )


_SENT_DOT = f"regexp_extract_all(text, '[^{DOT_STOP}]*[{DOT_STOP}]|[^{DOT_STOP}]+')"


@query(
    "split_sentences_dot",
    f"""SELECT doc_id, CAST(len(s) AS INT) AS n_sentences, array_to_string(s, '|') AS sentences
        FROM (SELECT doc_id, list_filter(list_transform({_SENT_DOT},
                lambda x, i: CASE WHEN i = 1 THEN x ELSE ltrim(x, {quote(lx.WHITESPACE)}) END),
                lambda x: {sql_strip('x')} <> '') AS s FROM documents)""",
)
def _(t: Tables):
    return t.documents.select("doc_id", tx.split_sentences_dot("text").alias("s")).select(
        "doc_id", F.size("s").alias("n_sentences"), F.array_join("s", "|").alias("sentences")
    )


@query("content_hash16", "SELECT doc_id, substr(sha256(text), 1, 16) AS hash16 FROM documents")
def _(t: Tables):
    return t.documents.select("doc_id", tx.content_hash16("text").alias("hash16"))


def sql_char_hash(expr: str) -> str:
    return (
        f"coalesce(list_bit_xor(list_transform(regexp_extract_all({expr}, '(?s).'), "
        "lambda c: ((unicode(c)::BIGINT << 5) + (unicode(c)::BIGINT >> 2) + 2654435769) & 4294967295)), 0)"
    )


@query("char_hash", f"SELECT doc_id, CAST({sql_char_hash('text')} AS BIGINT) AS h FROM documents")
def _(t: Tables):
    return t.documents.select("doc_id", tx.char_hash("text").alias("h"))


@query(
    "bit_jaccard",
    """SELECT chunk_id, round(CASE WHEN h = p OR (h | p) = 0 THEN 1.0::DOUBLE
                              ELSE bit_count(h & p) / bit_count(h | p)::DOUBLE END, 6) AS sim
       FROM (SELECT chunk_id, h, lag(h) OVER (PARTITION BY doc_id ORDER BY chunk_idx) AS p FROM
             (SELECT chunk_id, doc_id, chunk_idx, CAST(%s AS BIGINT) AS h FROM chunks)) WHERE p IS NOT NULL"""
    % sql_char_hash("content"),
    ("chunks",),
)
def _(t: Tables):
    # Neighbouring chunks of a document, compared inside the document's row.
    rows = t.documents.select("doc_id", tx.char_hashes(v.chunking.fixed_pieces("text")).alias("hs"))
    both = F.arrays_zip(F.col("hs").alias("h"), F.concat(F.array(F.lit(None).cast("long")), "hs").alias("p"))
    pairs = rows.select("doc_id", F.posexplode(both).alias("i", "b")).filter("b.h IS NOT NULL AND b.p IS NOT NULL")
    return pairs.select(
        v.chunking.chunk_key("doc_id", "i").alias("chunk_id"), F.round(tx.bit_jaccard("b.h", "b.p"), 6).alias("sim")
    )


@query(
    "safe_truncate",
    """SELECT doc_id, CASE WHEN strlen(text) <= 2000 THEN text
         ELSE substr(text, 1, list_max(list_filter(range(500, 2001), lambda n: strlen(substr(text, 1, n)) <= 2000))) END AS cut
       FROM documents""",
)
def _(t: Tables):
    return t.documents.select("doc_id", tx.safe_truncate("text", 2000).alias("cut"))


@query("truncate", "SELECT doc_id, coalesce(substr(text, 1, 200), '') AS preview FROM documents")
def _(t: Tables):
    return t.documents.select("doc_id", tx.truncate("text", 200).alias("preview"))


@query(
    "estimate_tokens",
    """SELECT doc_id, CAST(CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, length(text) // 3) END AS INT) AS tokens,
              CAST(CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, length(text) // 4) END AS INT) AS code_tokens
       FROM documents""",
)
def _(t: Tables):
    return t.documents.select(
        "doc_id", tx.estimate_tokens("text").alias("tokens"),
        tx.estimate_tokens("text", 4).alias("code_tokens"),
    )


def _sql_rfind(s: str, needle: str) -> str:
    return (
        f"CASE WHEN contains({s}, {needle}) THEN length({s}) - length({needle}) "
        f"- length(list_last(string_split({s}, {needle}))) ELSE -1 END"
    )


@query(
    "truncate_to_budget",
    f"""SELECT doc_id, CASE WHEN tokens <= 200 THEN text
              WHEN last > size // 2 THEN substr(cut, 1, last + 1) ELSE cut END AS cut
        FROM (SELECT *, greatest({_sql_rfind('cut', "'. '")}, {_sql_rfind('cut', "'。'")}, {_sql_rfind('cut', 'chr(10)')}) AS last
              FROM (SELECT doc_id, text, tokens, size, substr(text, 1, size) AS cut
                    FROM (SELECT doc_id, text, tokens,
                                 CAST(greatest(1, floor(length(text) * 200 / tokens::DOUBLE)) AS BIGINT) AS size
                          FROM (SELECT doc_id, text, greatest(1, length(text) // 3) AS tokens FROM documents))))""",
)
def _(t: Tables):
    return t.documents.select("doc_id", tx.truncate_to_budget("text", 200).alias("cut"))


_NORM = f"regexp_replace(lower({sql_strip('query')}), '[{WS}]+', ' ', 'g')"


@query("normalize_query", f"SELECT query_id, {_NORM} AS normalized FROM queries", ("queries",))
def _(t: Tables):
    return v.queries(t).select("query_id", tx.normalize_query("query").alias("normalized"))


@query(
    "query_fingerprint",
    f"""SELECT sha256(concat_ws(':', {_NORM}, '1', 'v1')) AS fingerprint, count(*) AS n FROM queries GROUP BY 1""",
    ("queries",),
)
def _(t: Tables):
    fp = tx.query_fingerprint("query", F.lit("1"), F.lit("v1"))
    return v.queries(t).groupBy(fp.alias("fingerprint")).agg(F.count("*").alias("n"))


@query(
    "semantic_fingerprint",
    """SELECT doc_id, sha256(concat(substr(source, 1, 100), '||', substr(text, 1, 200))) AS fingerprint FROM documents""",
)
def _(t: Tables):
    return t.documents.select("doc_id", tx.semantic_fingerprint("source", "text").alias("fingerprint"))


@query(
    "embedding_bucket",
    """SELECT vec_id, substr(sha256(array_to_string(list_transform(range(1, 65, 8),
           lambda i: printf('%.2f', round_even(embedding[i]::DOUBLE * 4, 0) / 4 + 0.0)), ',')), 1, 16) AS bucket
       FROM embeddings""",
)
def _(t: Tables):
    return t.embeddings.select("vec_id", vx.embedding_bucket("embedding").alias("bucket"))


@query(
    "cosine",
    """SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS sim
       FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""",
)
def _(t: Tables):
    a = t.embeddings
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return a.join(b, "vec_id").select("vec_id", F.round(vx.cosine("embedding", "other"), 6).alias("sim"))


@query(
    "overlap_suffix",
    f"""SELECT chunk_id, CASE WHEN length(s) <= 100 THEN s
             WHEN regexp_matches(tail, '[{DOT_STOP}]') THEN {sql_strip(f"regexp_extract(tail, '^[^{DOT_STOP}]*[{DOT_STOP}]')")}
             WHEN last_s <> '' THEN last_s ELSE {sql_strip('tail')} END AS overlap
        FROM (SELECT chunk_id, s, substr(s, -100) AS tail,
                     {sql_strip(f"regexp_extract(s, '[^{DOT_STOP}]*(?:[{DOT_STOP}][^{DOT_STOP}]*)?$')")} AS last_s
              FROM (SELECT chunk_id, rtrim(content, {quote(lx.WHITESPACE)}) AS s FROM chunks))""",
    ("chunks",),
)
def _(t: Tables):
    return v.chunks(t).select("chunk_id", tx.overlap_suffix("content", 100).alias("overlap"))


@query(
    "sanitize_input",
    f"""SELECT query_id, {sql_strip("substr(regexp_replace(regexp_replace(regexp_replace(nfc_normalize(query), '"
        + tx.ZERO_WIDTH + "', '', 'g'), '" + tx.ROLE_MARKER + "', '', 'g'), '-{5,}', '---', 'g'), 1, 4000)")} AS sanitized
        FROM queries""",
    ("queries",),
)
def _(t: Tables):
    return v.queries(t).select("query_id", tx.sanitize_input("query").alias("sanitized"))


@query(
    "sanitize_output",
    f"""WITH squeezed AS (SELECT doc_id, text, regexp_replace(text, '\\s+', '', 'g') AS s FROM documents),
        runs AS (SELECT doc_id, arg_min(spot, place) AS cut FROM
                 (SELECT doc_id, instr(text, repeat(c, 5)) - 1 AS spot, instr(s, repeat(c, 21)) AS place FROM
                  (SELECT *, unnest(list_distinct(string_split(s, ''))) AS c FROM squeezed)) WHERE place > 0 AND spot > 30 GROUP BY 1),
        lines AS (SELECT doc_id, line, count(*) AS n, min(i) AS first_idx FROM
                  (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents) WHERE len(ls) > 6)
                  GROUP BY 1, 2),
        loops AS (SELECT doc_id, arg_min(first_idx, pos) AS cut FROM
                  (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first_idx, line) AS pos FROM lines)
                  WHERE pos <= 5 AND n > 6 AND length({sql_strip('line')}) > 2 AND first_idx > 1 GROUP BY 1)
        SELECT d.doc_id, CASE WHEN d.text IS NULL OR length(d.text) < 10 THEN d.text
               WHEN r.cut IS NOT NULL THEN concat(substr(d.text, 1, r.cut), {quote(lx.LOOP_CUT_NOTE)})
               WHEN regexp_matches(d.text, '(【[^】]{{0,3}}】\\s*){{10,}}') THEN concat(substr(d.text, 1, 100), {quote(lx.LOOP_CUT_NOTE)})
               WHEN l.cut IS NOT NULL THEN concat(array_to_string(string_split(d.text, chr(10))[1:l.cut], chr(10)), {quote(lx.REPEAT_CUT_NOTE)})
               ELSE d.text END AS sanitized
        FROM documents d LEFT JOIN runs r ON r.doc_id = d.doc_id LEFT JOIN loops l ON l.doc_id = d.doc_id""",
)
def _(t: Tables):
    return t.documents.select("doc_id", tx.sanitize_output("text").alias("sanitized"))


@query(
    "post_enhance",
    f"""SELECT log_id, CASE WHEN confidence < 0.3 THEN concat({quote(lx.LOW_CONFIDENCE_NOTE)}, question)
              WHEN confidence < 0.6 THEN concat(question, {quote(lx.MEDIUM_CONFIDENCE_NOTE)}) ELSE question END AS answer
        FROM query_log""",
    ("query_log",),
)
def _(t: Tables):
    return v.query_log(t).select("log_id", tx.post_enhance("question", "confidence").alias("answer"))


@query(
    "file_and_chunk_types",
    """SELECT doc_id, CASE WHEN ext = 'htm' THEN 'html' ELSE ext END AS file_type,
              CASE WHEN ext IN ('exe') THEN 'code' WHEN ext = 'pdf' THEN 'table' ELSE 'text' END AS chunk_type
       FROM (SELECT doc_id, lower(regexp_extract(filename, '\\.([^.]*)$', 1)) AS ext FROM files)""",
    ("files",),
)
def _(t: Tables):
    raw = F.when(F.lower("filename").endswith(".exe"), "class").when(
        F.col("filename").endswith(".pdf"), "table"
    ).otherwise("paragraph")
    return v.files(t).select(
        "doc_id", tx.infer_file_type("filename").alias("file_type"), tx.map_chunk_type(raw).alias("chunk_type")
    )


@query(
    "section_path",
    """SELECT doc_id, concat_ws(' > ', CASE WHEN source <> '' AND source <> lang THEN source END,
                                     CASE WHEN lang <> '' THEN lang END) AS section FROM documents""",
)
def _(t: Tables):
    return t.documents.select("doc_id", tx.join_path(tx.section_path("source", "lang")).alias("section"))


@query(
    "valid_doc_id",
    """SELECT page_id, regexp_full_match(replace(url, '.example', ''), '[a-zA-Z0-9_\\-]+') AS url_ok,
              regexp_full_match(concat('page-', page_id), '[a-zA-Z0-9_\\-]+') AS id_ok FROM pages""",
)
def _(t: Tables):
    return t.pages.select(
        "page_id",
        tx.valid_doc_id(F.replace("url", F.lit(".example"), F.lit(""))).alias("url_ok"),
        tx.valid_doc_id(F.concat(F.lit("page-"), "page_id")).alias("id_ok"),
    )


@query(
    "minute_bucket",
    "SELECT date_trunc('minute', ts) AS minute, count(*) AS n FROM events GROUP BY 1",
)
def _(t: Tables):
    return t.events.groupBy(tx.minute_bucket("ts").cast("timestamp_ntz").alias("minute")).agg(
        F.count("*").alias("n")
    )


@query(
    "code_language",
    """SELECT doc_id, CASE WHEN ext = 'py' THEN 'python' WHEN ext = 'rs' THEN 'rust'
             WHEN contains(text, 'def ') AND contains(text, 'import ') THEN 'python'
             WHEN contains(text, 'func ') AND contains(text, 'package ') THEN 'go'
             WHEN contains(text, 'fn ') AND contains(text, 'let ') THEN 'rust' ELSE 'unknown' END AS language
       FROM (SELECT doc_id, text, ['py', 'rs', 'txt', 'md'][doc_id % 4 + 1] AS ext FROM markup)""",
    ("markup",),
)
def _(t: Tables):
    ext = F.element_at(F.array(*[F.lit(x) for x in ("py", "rs", "txt", "md")]), (F.col("doc_id") % 4 + 1).cast("int"))
    return v.markup(t).select(
        "doc_id", tx.code_language("text", F.concat(F.lit("a/b."), ext)).alias("language")
    )
