"""The registered queries of the training-data operators and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import (
    bpe, collocations, context_mixing, hilbert, lines, mixing, near_duplicates, order_minhash, periodic_runs, pii, repetition,
    site_quality, substrings,
)
from docloom.llm.tables import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_WORD = "[^\\x20\\x09-\\x0D]+"
WORDS_SQL = f"SELECT doc_id, text, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS words FROM documents"

REPEATS_SQL = f"""
WITH w AS (SELECT doc_id, words, len(words) AS n FROM ({WORDS_SQL})),
win AS (SELECT doc_id, i, md5(array_to_string(words[i:i + 49], ' ')) AS k FROM (SELECT *, unnest(range(1, n - 48)) AS i FROM w WHERE n >= 50)),
gone AS (SELECT doc_id, i FROM win JOIN (SELECT k, min(doc_id) AS f FROM win GROUP BY k) USING (k) WHERE f < doc_id),
pos AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, n + 1)) AS p FROM w),
marked AS (SELECT doc_id, p, word, max(CASE WHEN i IS NULL THEN 0 ELSE 1 END)
             OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS r
           FROM (SELECT pos.*, g.i FROM pos LEFT JOIN gone g ON g.doc_id = pos.doc_id AND g.i = pos.p))
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(coalesce(sum(r), 0) AS BIGINT) AS n_removed,
       sha256(coalesce(string_agg(word, ' ' ORDER BY p) FILTER (r = 0), '')) AS kept_sha256
FROM (SELECT w.doc_id, w.n, m.p, m.word, m.r FROM w LEFT JOIN marked m ON m.doc_id = w.doc_id) GROUP BY doc_id, n"""

LINES_SQL = f"""
WITH l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS line_no FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)),
s AS (SELECT doc_id, line_no, ws, row_number() OVER (PARTITION BY ws ORDER BY doc_id, line_no) AS copy FROM
      (SELECT doc_id, line_no, list_sort(list_distinct(regexp_extract_all(line, '{_WORD}'))) AS ws FROM l) WHERE len(ws) > 0),
r AS (SELECT row_number() OVER (ORDER BY doc_id, line_no) AS id, doc_id, line_no, ws, len(ws) AS n FROM s WHERE copy = 1),
t AS (SELECT id, n, unnest(ws) AS w FROM r),
p AS (SELECT id, n, w FROM t JOIN (SELECT w, count(*) AS c FROM t GROUP BY w) USING (w)
      QUALIFY row_number() OVER (PARTITION BY id ORDER BY c, w) <= n - (4 * n + 4) // 5 + 1),
cand AS (SELECT DISTINCT a.id AS x, b.id AS y FROM p a JOIN p b ON a.w = b.w AND b.id < a.id AND b.n * 5 >= a.n * 4 AND a.n * 5 >= b.n * 4),
alike AS (SELECT DISTINCT x FROM (SELECT x, a.n AS n, b.n AS m, len(list_intersect(a.ws, b.ws)) AS c FROM cand JOIN r a ON a.id = x JOIN r b ON b.id = y)
            WHERE c * 5 >= (n + m - c) * 4),
gone AS (SELECT doc_id, line_no FROM s WHERE copy > 1 UNION ALL SELECT doc_id, line_no FROM r JOIN alike ON x = id)
SELECT d.doc_id, CAST(coalesce(len(string_split(text, chr(10))), 0) AS BIGINT) AS n_lines, coalesce(k, 0) AS n_removed, coalesce(removed, '') AS removed
FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS k, string_agg(CAST(line_no AS VARCHAR), ',' ORDER BY line_no) AS removed FROM gone GROUP BY 1) g ON g.doc_id = d.doc_id"""


def _repetition_sql() -> str:
    def inside(size: int, rule: str) -> str:
        """Words in windows for which the rule holds."""
        return f"""(SELECT doc_id, p, max(hit) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN {size - 1} PRECEDING AND CURRENT ROW) AS r FROM
            (SELECT doc_id, p, CASE WHEN g IS NOT NULL AND {rule} THEN 1 ELSE 0 END AS hit FROM
             (SELECT doc_id, p, CASE WHEN p + {size - 1} <= n THEN md5(array_to_string(words[p:p + {size - 1}], ' ')) END AS g FROM ats)))"""

    sizes = repetition.DUPLICATE_NGRAMS
    again, seen = "count(*) OVER (PARTITION BY doc_id, g) > 1", "row_number() OVER (PARTITION BY doc_id, g ORDER BY p) > 1"
    joins = " ".join(f"JOIN {inside(n, seen)} r{n} USING (doc_id, p)" for n in sizes)
    sums = ", ".join(f"CAST(sum(CASE WHEN r{n}.r = 1 THEN length(word) ELSE 0 END) AS BIGINT) AS d{n}" for n in sizes)
    shares = ", ".join(f"coalesce(d{n}, 0) / greatest(word_chars, 1) AS dup_share_{n}" for n in sizes)
    over = " OR ".join(f"coalesce(d{n}, 0) > {most} * word_chars" for n, most in sizes.items())
    return f"""
WITH w AS (SELECT doc_id, text, words, len(words) AS n FROM ({WORDS_SQL})),
ats AS (SELECT doc_id, n, words, unnest(words) AS word, unnest(range(1, n + 1)) AS p FROM w),
covered AS (SELECT doc_id, CAST(sum(r3.r) AS BIGINT) AS n_repeat_words, {sums}
            FROM ats JOIN {inside(3, again)} r3 USING (doc_id, p) {joins} GROUP BY doc_id),
l AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id, line) AS copy FROM
      (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM w) WHERE regexp_matches(line, '{_WORD}')),
lines AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (copy > 1) AS n_dup_lines, CAST(sum(length(line)) AS BIGINT) AS line_chars,
                 CAST(coalesce(sum(length(line)) FILTER (copy > 1), 0) AS BIGINT) AS dup_line_chars FROM l GROUP BY doc_id),
m AS (SELECT w.doc_id, CAST(n AS BIGINT) AS n_words, length(array_to_string(words, '')) AS word_chars,
             length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '[#*$%&|<>]', '', 'g')) AS n_symbols,
             coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_lines, 0) AS n_lines, coalesce(line_chars, 0) AS line_chars,
             coalesce(dup_line_chars, 0) AS dup_line_chars, coalesce(n_repeat_words, 0) AS n_repeat_words, c.* EXCLUDE (doc_id, n_repeat_words)
      FROM w LEFT JOIN covered c ON c.doc_id = w.doc_id LEFT JOIN lines ON lines.doc_id = w.doc_id),
f AS (SELECT *, n_words < {repetition.MIN_WORDS} OR n_repeat_words > {repetition.MAX_REPEATED_WORDS} * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, dup_line_chars / greatest(line_chars, 1) AS dup_line_share, {shares}, base_failed,
       NOT (base_failed OR dup_line_chars > {repetition.DUPLICATE_LINE_CHARS} * line_chars OR n_dup_lines > {repetition.DUPLICATE_LINES} * n_lines OR {over}) AS kept
FROM f"""


PHRASES_SQL = """
WITH w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws FROM
           (SELECT coalesce(lang, 'und') AS lang,
                   unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
            FROM documents)),
f AS (SELECT lang, k, phrase, count(*) AS f FROM
      (SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase FROM
       (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, range(1, 6) t(k) WHERE len(ws) >= k)) GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY 1),
c AS (SELECT *, string_split(phrase, ' ') AS ws FROM f WHERE k >= 2 AND f >= 100),
cut AS (SELECT lang, phrase, f AS a, k, j, array_to_string(ws[1:j], ' ') AS lp, array_to_string(ws[j + 1:k], ' ') AS rp FROM (SELECT *, unnest(range(1, k)) AS j FROM c)),
s AS (SELECT cut.*, l.f AS l, r.f AS r, n, CAST(1000::HUGEINT * a * n // (l.f::HUGEINT * r.f) AS BIGINT) AS score
      FROM cut JOIN f l ON l.lang = cut.lang AND l.phrase = lp AND l.k = j JOIN f r ON r.lang = cut.lang AND r.phrase = rp AND r.k = cut.k - j JOIN n ON n.lang = cut.lang),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM b
WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.lang = b.lang AND c.k > b.k AND contains(concat(' ', c.phrase, ' '), concat(' ', b.phrase, ' ')) AND 100 * c.f >= 100 * b.a)
QUALIFY rank <= 2000"""


def query(name: str, oracle: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


@query("op1_bootstrapped_pii")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.find(read(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base_spans", 256).alias("base_sha256"), "spans"
    )


@query("op2_hilbert_shards")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    dimensions = {"source": docs["source"], "lang": docs["lang"], "n_chars": docs["n_chars"]}
    return hilbert.shard(docs, dimensions, shards=16, law="rows").select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "curve",
    )


@query("op3_byte_bpe")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.encode(read(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, with_ids=False)


@query("op4_block_anchors", REPEATS_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(read(spark, sf_dir, "documents"), with_text=False)


@query("op5_line_similarity", LINES_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.dedup_lines(read(spark, sf_dir, "documents"), with_text=False)
    return out.withColumn("removed", F.array_join("removed", ","))


@query("op6_repetition_rules", _repetition_sql())
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.quality(read(spark, sf_dir, "documents"))


@query("op7_site_bayes")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    path = F.concat_ws("/", "source", "lang")
    return site_quality.quality(docs, read(spark, sf_dir, "labels"), docs["source"], path)


@query("op8_weighted_minhash")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.classes(read(spark, sf_dir, "documents"))


@query("op9_pfair_mixing")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.interleave(read(spark, sf_dir, "documents"))


@query("op10_order_minhash")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.fingerprint_pairs(read(spark, sf_dir, "documents"))


@query("op11_context_mixing")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_mixing.score_texts(read(spark, sf_dir, "documents"))


@query("op12_maximal_pair_runs")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.periodic_runs(read(spark, sf_dir, "documents"), repeats=True)


@query("op13_count_streams", PHRASES_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read(spark, sf_dir, "documents"))
