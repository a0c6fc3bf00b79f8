"""Sparse, dense and hybrid retrieval, reranking, context and answers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom import lexicon as lx
from docloom.functions import text as tx
from docloom.operators import ann
from docloom.operators import expansion as ex
from docloom.operators import ranking as rk
from docloom.operators import retrieval as rt
from docloom.plans import views as v
from docloom.plans.catalog.chunks import section_chunks
from docloom.plans.registry import cte, query, quote, sql_strip
from docloom.plans.tables import Tables
from docloom.scale import one_row
from docloom.session import materialize, scratch
from docloom.sources.segments import Change, SegmentStore

K = 10


# --- inputs --------------------------------------------------------------------
def items(t: Tables):
    return t.benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def item_vectors(t: Tables):
    """The vector of the same number stands for the vector of an item."""
    vectors = t.embeddings.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vec"))
    return vectors.join(items(t).select("query_id"), "query_id", "left_semi")


def unit_vectors(t: Tables):
    return t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))


def documents(t: Tables):
    return t.documents.select(F.col("doc_id").alias("id"), "text")


def sparse_hits(t: Tables):
    index = t.stored("document index", lambda: rt.build_index(t.documents, "doc_id", "text"))
    return t.stored("sparse hits", lambda: materialize(rt.search_units(items(t), index, K), "hits"))


def dense_hits(t: Tables):
    return rt.exact_knn(item_vectors(t), unit_vectors(t), K)


def fused_hits(t: Tables):
    return rk.rrf({"dense": dense_hits(t), "sparse": sparse_hits(t)})


def reranked_hits(t: Tables):
    return rk.rerank(fused_hits(t), items(t), documents(t))


def clean_hits(t: Tables):
    """The hit table: gate, context, confidence and answer read it after it is written once."""
    return t.stored("clean hits", lambda: materialize(rk.drop_garbage(reranked_hits(t)), "hits"))


# --- SQL twins ------------------------------------------------------------------
def sql_bm25(units: str, unit_id: str, text: str, k: int = K) -> str:
    return f"""SELECT query_id, id, score, CAST(pos - 1 AS INT) AS rnk FROM
      (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS pos FROM
       (SELECT query_id, id, round(sum(qf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
        FROM (SELECT item_id AS query_id, term, count(*) AS qf
              FROM (SELECT item_id, unnest(regexp_extract_all(text, '{tx.INDEX_TOKEN}')) AS term FROM benchmark) GROUP BY 1, 2) q
        JOIN (SELECT term, CASE WHEN raw < 0 THEN 0.25 * avg(raw) OVER () ELSE raw END AS idf
              FROM (SELECT term, ln(n - df + 0.5::DOUBLE) - ln(df + 0.5::DOUBLE) AS raw
                    FROM (SELECT term, count(DISTINCT id) AS df
                          FROM (SELECT {unit_id} AS id, unnest(regexp_extract_all({text}, '{tx.INDEX_TOKEN}')) AS term FROM {units}) GROUP BY 1),
                         (SELECT count(*) AS n FROM {units}))) i USING (term)
        JOIN (SELECT id, term, count(*) AS tf
              FROM (SELECT {unit_id} AS id, unnest(regexp_extract_all({text}, '{tx.INDEX_TOKEN}')) AS term FROM {units}) GROUP BY 1, 2) p USING (term)
        JOIN (SELECT {unit_id} AS id, len(regexp_extract_all({text}, '{tx.INDEX_TOKEN}')) AS dl FROM {units}) l USING (id),
             (SELECT avg(len(regexp_extract_all({text}, '{tx.INDEX_TOKEN}'))) AS avgdl FROM {units}) a
        GROUP BY 1, 2) WHERE score > 0) WHERE pos <= {k}"""


def sql_knn(queries: str, k: int = K) -> str:
    """``queries`` yields (query_id, vec)."""
    return f"""SELECT query_id, id, score, CAST(pos - 1 AS INT) AS rnk FROM
      (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS pos FROM
       (SELECT query_id, e.vec_id AS id, round(list_cosine_similarity(q.vec::DOUBLE[], e.embedding::DOUBLE[]), 6) + 0.0 AS score
        FROM ({queries}) q, embeddings e)) WHERE pos <= {k}"""


ITEM_VECTORS = "SELECT vec_id AS query_id, embedding AS vec FROM embeddings WHERE vec_id IN (SELECT item_id FROM benchmark)"

cte("sparse_hits", sql_bm25("documents", "doc_id", "text"))
cte("dense_hits", sql_knn(ITEM_VECTORS))


def sql_rrf(dense_w: str = "1.0", sparse_w: str = "1.0") -> str:
    return f"""SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, best, src, id) - 1 AS INT) AS rnk FROM
      (SELECT query_id, id,
              round(coalesce(sum({dense_w}::DOUBLE / (60 + rnk + 1)) FILTER (src = 0), 0) + coalesce(sum({sparse_w}::DOUBLE / (60 + rnk + 1)) FILTER (src = 1), 0), 6) AS rrf_score,
              max(score) FILTER (src = 0) AS dense_score, max(score) FILTER (src = 1) AS sparse_score,
              min(rnk) AS best, arg_min(src, rnk * 2 + src) AS src
       FROM (SELECT *, 0 AS src FROM dense_hits UNION ALL SELECT *, 1 FROM sparse_hits) GROUP BY 1, 2)"""


cte("fused", sql_rrf(), ("dense_hits", "sparse_hits"))
cte(
    "reranked",
    f"""SELECT * EXCLUDE (pos), CAST(pos - 1 AS INT) AS rnk FROM
        (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, rrf_rank, id) AS pos FROM
         (SELECT query_id, id, rrf_score, dense_score, sparse_score, rnk AS rrf_rank, d.text,
                 CASE WHEN len(kw) = 0 THEN rrf_score
                      ELSE round(rrf_score * 0.6 + len(list_filter(kw, lambda k: contains(d.text, k))) / len(kw)::DOUBLE * 0.4, 6) END AS rerank_score
          FROM fused f JOIN documents d ON d.doc_id = f.id
          JOIN (SELECT item_id, list_distinct(regexp_extract_all(text, '{tx.KEYWORD}')) AS kw FROM benchmark) q ON q.item_id = f.query_id)) WHERE pos <= 5""",
    ("fused",),
)


def sql_garbage(text: str) -> str:
    s = sql_strip(text)
    chars = f"string_split(translate({s}, concat(' ', chr(10), chr(9)), ''), '')"
    return (
        f"({s} = '' OR coalesce(list_max(list_transform(list_distinct({chars}), lambda c: length({s}) - length(replace({s}, c, '')))), 0) / length({s})::DOUBLE > 0.4"
        f" OR len(regexp_extract_all({s}, '\\d')) / length({s})::DOUBLE > 0.5"
        f" OR len(list_filter(list_distinct({chars}), lambda c: contains({s}, repeat(c, 9)))) > 0"
        f" OR contains({s}, repeat(' ', 9)) OR contains({s}, repeat(chr(9), 9)))"
    )


cte("clean_hits", f"SELECT * FROM reranked WHERE NOT {sql_garbage('text')}", ("reranked",))


# --- queries ---------------------------------------------------------------------
@query("bm25", sql_bm25("chunks", "chunk_id", "content"), ("chunks",))
def _(t: Tables):
    return rt.bm25(items(t), v.chunks(t), K)


@query(
    "bm25_sources",
    f"""SELECT query_id, rnk, h.score, c.doc_id, filename, substr(content, 1, 200) AS preview
        FROM ({sql_bm25("chunks", "chunk_id", "content")}) h JOIN chunks c ON c.chunk_id = h.id LEFT JOIN files f ON f.doc_id = c.doc_id""",
    ("chunks", "files"),
)
def flagship(t: Tables):
    """Documents, cleaned into chunks, searched by every benchmark item, with the
    file of each hit: the whole path from raw text to answers with sources."""
    chunks = v.chunks(t)
    hits = rt.bm25(items(t), chunks, K)
    places = chunks.select(F.col("chunk_id").alias("id"), "doc_id", F.substring("content", 1, 200).alias("preview"))
    names = v.files(t).select("doc_id", "filename")
    return hits.join(places, "id").join(names, "doc_id", "left").select(
        "query_id", "rnk", "score", "doc_id", "filename", "preview"
    )


@query(
    "sparse_index",
    f"""SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM
        (SELECT chunk_id, term, count(*) AS tf FROM (SELECT chunk_id, unnest(regexp_extract_all(content, '{tx.INDEX_TOKEN}')) AS term FROM chunks) GROUP BY 1, 2)
        GROUP BY 1""",
    ("chunks",),
)
def _(t: Tables):
    return rt.term_statistics(rt.postings(v.chunks(t)))


@query(
    "sparse_index_update",
    f"""SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM
        (SELECT id, term, count(*) AS tf FROM
         (SELECT chunk_id AS id, unnest(regexp_extract_all(content, '{tx.INDEX_TOKEN}')) AS term FROM chunks WHERE lang <> 'de'
          UNION ALL SELECT concat('p', page_id), unnest(regexp_extract_all(html, '{tx.INDEX_TOKEN}')) FROM pages) GROUP BY 1, 2)
        GROUP BY 1""",
    ("chunks",),
)
def _(t: Tables):
    index = rt.postings(v.chunks(t, "lang"))
    pages = t.pages.select(F.concat(F.lit("p"), "page_id").alias("chunk_id"), F.col("html").alias("content"))
    doomed = v.chunks(t, "lang").filter("lang = 'de'").select(F.col("chunk_id").alias("id"))
    return rt.term_statistics(rt.remove_units(rt.add_units(index, pages), doomed))


UPDATED_UNITS = """SELECT chunk_id, content FROM chunks WHERE lang <> 'de'
    UNION ALL SELECT concat('p', page_id), regexp_replace(html, '<[^>]*>', ' ', 'g') FROM pages"""


@query("bm25_after_update", sql_bm25(f"({UPDATED_UNITS})", "chunk_id", "content"), ("chunks",))
def _(t: Tables):
    """An index that loses the German chunks and gains the texts of the pages, then is searched."""
    chunks = v.chunks(t, "lang")
    pages = t.pages.select(
        F.concat(F.lit("p"), "page_id").alias("chunk_id"), F.regexp_replace("html", "<[^>]*>", " ").alias("content")
    )
    doomed = chunks.filter("lang = 'de'").select(F.col("chunk_id").alias("id"))
    return rt.search_units(items(t), rt.build_index(chunks).add(pages).remove(doomed), K)


def changed_store(t: Tables):
    """Chunks and their index in a store: all chunks, then without the German ones and with
    the texts of the pages, then compacted. The snapshots' versions."""
    chunks = v.chunks(t, "lang").select("chunk_id", "content", "lang")
    pages = t.pages.select(
        F.concat(F.lit("p"), "page_id").alias("chunk_id"), F.regexp_replace("html", "<[^>]*>", " ").alias("content"), F.lit("page").alias("lang")
    )
    store = SegmentStore(t.spark, scratch(t.spark, "store"), "chunk_id")

    def changes(units, doomed=None):
        parts = {"chunks": units, "index": rt.build_index(units).units.withColumnRenamed("id", "chunk_id")}
        return {name: Change(rows, doomed) for name, rows in parts.items()}

    first = store.commit(changes(chunks))
    second = store.commit(changes(pages, chunks.filter("lang = 'de'").select("chunk_id")), base=first)
    store.compact("chunks", 0.0)
    last = store.compact("index", 0.0)
    return store, {"before": first, "after": second, "compacted": last}


STORED_CHUNKS = f"""SELECT 'before' AS snapshot, chunk_id, md5(content) AS digest FROM chunks
    UNION ALL SELECT s, chunk_id, md5(content) FROM ({UPDATED_UNITS}), (VALUES ('after'), ('compacted')) v(s)"""


@query("store_snapshots", STORED_CHUNKS, ("chunks",))
def _(t: Tables):
    """What each snapshot of the store holds, chunk by chunk."""
    store, versions = changed_store(t)
    parts = [store.read("chunks", n).select(F.lit(s).alias("snapshot"), "chunk_id", F.md5("content").alias("digest")) for s, n in versions.items()]
    return reduce(DataFrame.unionAll, parts)


@query(
    "search_snapshots",
    f"""SELECT 'before' AS snapshot, * FROM ({sql_bm25("chunks", "chunk_id", "content")})
        UNION ALL SELECT s, b.* FROM ({sql_bm25(f"({UPDATED_UNITS})", "chunk_id", "content")}) b, (VALUES ('after'), ('compacted')) v(s)""",
    ("chunks",),
)
def _(t: Tables):
    """The stored index of each snapshot, searched."""
    store, versions = changed_store(t)
    parts = []
    for name, number in versions.items():
        index = rt.SparseIndex(store.read("index", number).withColumnRenamed("chunk_id", "id"))
        parts.append(rt.search_units(items(t), index, K).select(F.lit(name).alias("snapshot"), "query_id", "id", "score", "rnk"))
    return reduce(DataFrame.unionAll, parts)


@query("bm25_postings", sql_bm25("documents", "doc_id", "text"))
def _(t: Tables):
    """The same search by joins over postings with bounds of blocks."""
    index = rt.build_index(t.documents, "doc_id", "text")
    return rt.search_index(items(t), index.postings, index.lengths, K)


@query("exact_knn", sql_knn("SELECT vec_id AS query_id, embedding AS vec FROM embeddings", 5))
def _(t: Tables):
    every = unit_vectors(t).withColumnRenamed("id", "query_id")
    return rt.exact_knn(every, unit_vectors(t), 5)


@query(
    "scoped_knn",
    f"""SELECT query_id, id, score, CAST(pos - 1 AS INT) AS rnk FROM
        (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS pos FROM
         (SELECT query_id, e.vec_id AS id, round(list_cosine_similarity(q.vec::DOUBLE[], e.embedding::DOUBLE[]), 6) + 0.0 AS score
          FROM ({ITEM_VECTORS}) q, embeddings e WHERE e.vec_id IN (SELECT doc_id FROM documents WHERE lang <> 'en'))) WHERE pos <= 10""",
)
def _(t: Tables):
    scope = t.documents.filter("lang <> 'en'").select(F.col("doc_id").alias("id"))
    return rt.exact_knn(item_vectors(t), unit_vectors(t), K, scope)


def approximate_hits(t: Tables):
    units = unit_vectors(t)
    return ann.pq_knn(item_vectors(t), units, ann.build_index(units), K)


@query("approximate_knn")
def _(t: Tables):
    return approximate_hits(t)


@query(
    "approximate_knn_recall",
    f"""SELECT count(*) AS queries, count(*) * {K} AS found, count(*) * {ann.SHORT} AS rescored, true AS recall_reached FROM ({ITEM_VECTORS})""",
)
def _(t: Tables):
    """Approximate against exact neighbours: at least 95 in 100 are found, and the vectors
    that a query meets are as many as its short list, however many there are."""
    units = unit_vectors(t)
    index = ann.build_index(units)
    near = ann.pq_knn(item_vectors(t), units, index, K).select("query_id", "id", F.lit(1).alias("near"))
    both = dense_hits(t).select("query_id", "id").join(near, ["query_id", "id"], "left").agg(
        F.countDistinct("query_id").alias("queries"), (F.count("near") >= 0.95 * F.count("*")).alias("recall_reached")
    )
    met = ann.shortlist(item_vectors(t), index).agg(F.count("*").alias("rescored"))
    return one_row(both, near.agg(F.count("*").alias("found")), met)


@query(
    "section_search",
    """SELECT query_id, id, score, CAST(pos - 1 AS INT) AS rnk FROM
       (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS pos FROM
        (SELECT e.vec_id AS query_id, s.id, round(list_cosine_similarity(e.embedding::DOUBLE[], s.vec), 6) + 0.0 AS score
         FROM embeddings e, (SELECT label AS id, list(m ORDER BY d) AS vec FROM
               (SELECT label, d, avg(embedding[d]::DOUBLE) AS m FROM embeddings, range(1, 65) r(d) GROUP BY 1, 2) GROUP BY 1) s)) WHERE pos <= 3""",
)
def _(t: Tables):
    sections = rt.section_vectors(
        t.embeddings.select("label", F.col("embedding").alias("vec")), "label", 64
    )
    every = unit_vectors(t).withColumnRenamed("id", "query_id")
    return rt.exact_knn(every, sections, 3)


@query(
    "rrf",
    "SELECT query_id, id, rrf_score, dense_score, sparse_score, rnk FROM fused",
    ("fused",),
)
def _(t: Tables):
    return fused_hits(t)


@query(
    "weighted_rrf",
    f"SELECT query_id, id, rrf_score, rnk FROM ({sql_rrf('0.7', '0.3')})",
    ("dense_hits", "sparse_hits"),
)
def _(t: Tables):
    fused = rk.rrf({"dense": dense_hits(t), "sparse": sparse_hits(t)}, weights={"dense": 0.7, "sparse": 0.3})
    return fused.select("query_id", "id", "rrf_score", "rnk")


@query(
    "multi_query_rrf",
    """SELECT parent_id, id, rrf_score, lists, CAST(row_number() OVER (PARTITION BY parent_id ORDER BY rrf_score DESC, id) - 1 AS INT) AS rnk FROM
       (SELECT query_id % 8 AS parent_id, id, round(sum(1.0::DOUBLE / (60 + rnk + 1)), 9) AS rrf_score, count(*) AS lists
        FROM (SELECT * FROM dense_hits UNION ALL SELECT * FROM sparse_hits) GROUP BY 1, 2)""",
    ("dense_hits", "sparse_hits"),
)
def _(t: Tables):
    both = dense_hits(t).unionByName(sparse_hits(t)).withColumn("parent_id", F.col("query_id") % 8)
    return rk.multi_query_rrf(both)


@query("variable_breadth",
    f"""SELECT query_id, id, score FROM ({sql_knn(ITEM_VECTORS, 20)}) WHERE rnk < CASE query_id % 4 WHEN 0 THEN 5 WHEN 1 THEN 10 WHEN 2 THEN 15 ELSE 20 END""",
)
def _(t: Tables):
    hits = rt.exact_knn(item_vectors(t), unit_vectors(t), 20).drop("rnk")
    breadth = F.element_at(F.array(*[F.lit(x) for x in (5, 10, 15, 20)]), (F.col("query_id") % 4 + 1).cast("int"))
    return rk.top_k(hits, breadth).select("query_id", "id", "score")


@query(
    "rerank",
    "SELECT query_id, id, rrf_score, rerank_score, rnk FROM reranked",
    ("reranked",),
)
def _(t: Tables):
    return reranked_hits(t).select("query_id", "id", "rrf_score", "rerank_score", "rnk")


@query("garbage_filter", f"SELECT chunk_id FROM chunks WHERE NOT {sql_garbage('content')}", ("chunks",))
def _(t: Tables):
    return rk.drop_garbage(v.chunks(t), "content").select("chunk_id")


@query("garbage_flags", f"SELECT doc_id, {sql_garbage('text')} AS garbage FROM documents")
def _(t: Tables):
    return t.documents.select("doc_id", rk.is_garbage("text").alias("garbage"))


@query(
    "padded_garbage_flags",
    f"SELECT doc_id, {sql_garbage('repeat(substr(text, 1, 1), CAST(doc_id % 40 AS BIGINT)) || text')} AS garbage FROM documents",
)
def _(t: Tables):
    """The same for whole texts behind a run of their first character."""
    padded = F.concat(F.repeat(F.substring("text", 1, 1), (F.col("doc_id") % 40).cast("int")), "text")
    return t.documents.select("doc_id", rk.is_garbage(padded).alias("garbage"))


cte(
    "contexts",
    f"""SELECT query_id, coalesce(string_agg(block, concat(chr(10), chr(10), '---', chr(10), chr(10)) ORDER BY rnk), '') AS context
        FROM (SELECT query_id, rnk, CASE WHEN t = '' THEN NULL WHEN cum <= 3000 THEN concat(h, t)
                     WHEN over_n = 1 AND 3000 - (cum - size) > 100 THEN concat(h, substr(t, 1, 3000 - (cum - size))) END AS block
              FROM (SELECT *, sum(CASE WHEN cum > 3000 THEN 1 ELSE 0 END) OVER (PARTITION BY query_id ORDER BY rnk) AS over_n
                    FROM (SELECT *, CAST(sum(size) OVER (PARTITION BY query_id ORDER BY rnk) AS BIGINT) AS cum
                          FROM (SELECT *, CASE WHEN t = '' THEN 0 ELSE length(h) + length(t) END AS size
                                FROM (SELECT query_id, rnk, {sql_strip('text')} AS t, concat('[来源', rnk + 1, ']', chr(10)) AS h FROM clean_hits)))))
        GROUP BY 1""",
    ("clean_hits",),
)


def contexts(t: Tables):
    return rk.build_context(clean_hits(t))


@query("build_context", "SELECT * FROM contexts", ("contexts",))
def _(t: Tables):
    return contexts(t)


cte(
    "gate",
    f"""SELECT item_id AS query_id, coalesce((best IS NULL OR best >= 0.02) AND coalesce(context, '') <> ''
                 AND (len(w) = 0 OR len(list_filter(w, lambda k: contains(lower(context), k))) / len(w)::DOUBLE >= 0.3), false) AS relevant
        FROM (SELECT item_id, regexp_extract_all(lower({sql_strip('text')}), '[\\x{{4e00}}-\\x{{9fff}}]{{2,}}|[a-z]{{2,}}') AS w FROM benchmark) q
        LEFT JOIN contexts c ON c.query_id = item_id
        LEFT JOIN (SELECT query_id, max(rerank_score) AS best FROM clean_hits GROUP BY 1) b ON b.query_id = item_id""",
    ("contexts", "clean_hits"),
)


def gate(t: Tables):
    return rk.relevance_gate(items(t), clean_hits(t), contexts(t))


@query("relevance_gate", "SELECT * FROM gate", ("gate",))
def _(t: Tables):
    return gate(t)


@query(
    "retrieval_gate",
    "SELECT query_id, coalesce(max(dense_score), 0) >= 0.3 AS good FROM fused GROUP BY 1",
    ("fused",),
)
def _(t: Tables):
    return rk.retrieval_gate(fused_hits(t))


@query(
    "answer_confidence",
    """SELECT query_id, round(greatest(0, least(1, 0.5 * greatest(0, least(1, CASE WHEN m > 1 THEN m / 10 ELSE m * 20 END))
              + 0.3 * greatest(coalesce(s, 0), 0) + 0.2 * 0.5)), 4) AS confidence
       FROM (SELECT query_id, avg(rerank_score) AS m, max(dense_score) AS s FROM clean_hits GROUP BY 1)""",
    ("clean_hits",),
)
def _(t: Tables):
    return rk.confidence(clean_hits(t), self_score=0.5)


@query(
    "degraded_answer",
    f"""SELECT c.query_id, CASE WHEN context = '' THEN {quote(lx.NO_CONTEXT_ANSWER)} WHEN NOT relevant THEN {quote(lx.LOW_RELEVANCE_ANSWER)}
               ELSE concat({quote(lx.EXTRACT_PREFIX)}, substr(context, 1, 400), '…') END AS answer,
               CASE WHEN context = '' THEN 'NO_CONTEXT' WHEN NOT relevant THEN 'LOW_RELEVANCE' ELSE 'LLM_TIMEOUT' END AS degrade_reason
        FROM contexts c JOIN gate g ON g.query_id = c.query_id""",
    ("contexts", "gate"),
)
def _(t: Tables):
    return rk.degraded_answer(contexts(t), gate(t))


@query(
    "response_sources",
    """SELECT query_id, string_agg(concat(rnk + 1, '|', id, '|', substr(text, 1, 200)), '#' ORDER BY rnk) AS sources,
              count(*) AS n, count(DISTINCT id) AS documents, round(max(rerank_score), 4) AS best FROM clean_hits GROUP BY 1""",
    ("clean_hits",),
)
def _(t: Tables):
    built = rk.sources(clean_hits(t))
    flat = F.transform("sources", lambda s: F.concat_ws("|", s["idx"], s["doc_id"], s["text"]))
    return built.select(
        "query_id", F.array_join(flat, "#").alias("sources"), F.size("sources").cast("long").alias("n"),
        F.size(F.array_distinct(F.transform("sources", lambda s: s["doc_id"]))).cast("long").alias("documents"),
        F.array_max(F.transform("sources", lambda s: s["score"])).alias("best"),
    )


@query(
    "top_sources",
    "SELECT query_id, string_agg(id, ',' ORDER BY score DESC, id) AS top3 FROM dense_hits WHERE rnk < 3 GROUP BY 1",
    ("dense_hits",),
)
def _(t: Tables):
    entry = F.struct((-F.col("score")).alias("neg"), F.col("id"))
    return dense_hits(t).groupBy("query_id").agg(
        F.array_join(F.transform(F.slice(F.array_sort(F.collect_list(entry)), 1, 3), lambda s: s["id"].cast("string")), ",").alias("top3")
    )


@query(
    "parent_expansion",
    """SELECT query_id, id, rnk, first_of_parent AND nth <= 2 AS expanded,
              CASE WHEN first_of_parent AND nth <= 2 THEN parent_text ELSE text END AS text
       FROM (SELECT *, sum(CASE WHEN first_of_parent THEN 1 ELSE 0 END) OVER (PARTITION BY query_id ORDER BY rnk) AS nth
             FROM (SELECT r.*, concat('parent ', l.lang) AS parent_text,
                          row_number() OVER (PARTITION BY query_id, l.lang ORDER BY rnk) = 1 AS first_of_parent
                   FROM reranked r JOIN documents l ON l.doc_id = r.id))""",
    ("reranked",),
)
def _(t: Tables):
    parents = t.documents.select(
        F.col("doc_id").alias("id"), F.col("lang").alias("parent_id"), F.concat(F.lit("parent "), "lang").alias("parent_text")
    )
    return rk.expand_parents(reranked_hits(t).join(parents, "id")).select("query_id", "id", "rnk", "expanded", "text")


# --- expansion around hits ---------------------------------------------------------
cte("section_hits", sql_bm25("sec_chunks", "chunk_id", "content"), ("sec_chunks",))
cte(
    "anchors",
    """SELECT query_id, h.rnk AS anchor_rnk, h.id AS anchor_id, doc_id, chunk_idx, section_no
       FROM section_hits h JOIN sec_chunks c ON c.chunk_id = h.id WHERE h.rnk < 3""",
    ("section_hits", "sec_chunks"),
)
cte(
    "around",
    """SELECT DISTINCT query_id, anchor_rnk, chunk_id, chunk_idx FROM
       (SELECT a.query_id, a.anchor_rnk, c.chunk_id, c.chunk_idx FROM anchors a JOIN sec_chunks c
          ON c.doc_id = a.doc_id AND abs(c.chunk_idx - a.chunk_idx) <= 2
        UNION ALL
        SELECT a.query_id, a.anchor_rnk, c.chunk_id, c.chunk_idx FROM anchors a JOIN
          (SELECT *, row_number() OVER (PARTITION BY doc_id, section_no ORDER BY chunk_idx) AS rn FROM sec_chunks) c
          ON c.doc_id = a.doc_id AND c.section_no = a.section_no AND rn <= 20)""",
    ("anchors", "sec_chunks"),
)


def section_hits(t: Tables, chunks=None):
    return rt.bm25(items(t), chunks if chunks is not None else stored_chunks(t), K)


def stored_chunks(t: Tables):
    """The chunk table, written once: search, location and expansion all read it."""
    return t.stored("chunks", lambda: materialize(section_chunks(t), "chunks"))


@query(
    "sequential_expansion",
    """SELECT a.query_id, a.anchor_id, c.chunk_id, c.chunk_idx FROM anchors a JOIN sec_chunks c
       ON c.doc_id = a.doc_id AND abs(c.chunk_idx - a.chunk_idx) <= 2""",
    ("anchors", "sec_chunks"),
)
def _(t: Tables):
    chunks = stored_chunks(t)
    anchors = ex.locate(section_hits(t, chunks).filter("rnk < 3"), chunks)
    return ex.sequential(anchors, chunks).select("query_id", "anchor_id", "chunk_id", "chunk_idx")


@query(
    "section_siblings",
    """SELECT a.query_id, a.anchor_id, c.chunk_id FROM anchors a JOIN
       (SELECT *, row_number() OVER (PARTITION BY doc_id, section_no ORDER BY chunk_idx) AS rn FROM sec_chunks) c
       ON c.doc_id = a.doc_id AND c.section_no = a.section_no AND rn <= 10""",
    ("anchors", "sec_chunks"),
)
def _(t: Tables):
    chunks = stored_chunks(t)
    anchors = ex.locate(section_hits(t, chunks).filter("rnk < 3"), chunks)
    return ex.siblings(anchors, chunks, 10).select("query_id", "anchor_id", "chunk_id")


@query(
    "context_expansion",
    """SELECT query_id, chunk_id, CAST(min(anchor_rnk) AS INT) AS anchor_rnk, min(chunk_idx) AS chunk_idx
       FROM (SELECT r.*, own.anchor_rnk AS own FROM around r
             JOIN live l ON l.query_id = r.query_id AND l.anchor_rnk = r.anchor_rnk AND l.alive
             LEFT JOIN (SELECT a.query_id, a.anchor_rnk, a.anchor_id FROM anchors a JOIN live l2
                          ON l2.query_id = a.query_id AND l2.anchor_rnk = a.anchor_rnk AND l2.alive) own
               ON own.query_id = r.query_id AND own.anchor_id = r.chunk_id)
       WHERE own IS NULL OR own > anchor_rnk GROUP BY 1, 2""",
    ("around", "anchors", "live"),
)
def _(t: Tables):
    chunks = stored_chunks(t)
    return ex.expand(materialize(section_hits(t, chunks), "hits"), chunks)


cte(
    "live",
    """SELECT query_id, anchor_rnk, CASE anchor_rnk WHEN 0 THEN true WHEN 1 THEN NOT m01
              ELSE NOT (m02 OR (NOT m01 AND m12)) END AS alive
       FROM (SELECT a.query_id, a.anchor_rnk, coalesce(m.m01, false) AS m01, coalesce(m.m02, false) AS m02, coalesce(m.m12, false) AS m12
             FROM anchors a LEFT JOIN
               (SELECT r.query_id, bool_or(r.anchor_rnk = 0 AND b.anchor_rnk = 1) AS m01, bool_or(r.anchor_rnk = 0 AND b.anchor_rnk = 2) AS m02,
                       bool_or(r.anchor_rnk = 1 AND b.anchor_rnk = 2) AS m12
                FROM around r JOIN anchors b ON b.query_id = r.query_id AND b.anchor_id = r.chunk_id GROUP BY 1) m ON m.query_id = a.query_id)""",
    ("around", "anchors"),
)
