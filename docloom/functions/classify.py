"""Rule-based query routing: Column in, Column out.

The word lists are literals inside the expression, so a whole query table is
classified in one pass with no join and no shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom import lexicon as lx
from docloom.functions import text as tx


def _terms(words: Sequence[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def _occurs(text: Column, word: Column, whole_word: bool) -> Column:
    if not whole_word:
        return F.contains(text, word)
    quoted = F.concat(F.lit(r"(?U)\b\Q"), word, F.lit(r"\E\b"))
    return F.regexp_like(text, quoted)


def matches(text: Column, words: Sequence[str], whole_word: bool = False) -> Column:
    """The list entries found in ``text``; duplicated entries count twice."""
    return tx.bind(text, lambda t: F.filter(_terms(words), lambda w: _occurs(t, w, whole_word)))


def any_match(text: Column, words: Sequence[str], whole_word: bool = False) -> Column:
    return tx.bind(text, lambda t: F.exists(_terms(words), lambda w: _occurs(t, w, whole_word)))


def complexity_tier(col, whole_word: bool = False) -> Column:
    q = tx.strip(col)
    lower = F.lower(q)
    size = F.length(q)
    short = (size < 15) & (
        any_match(lower, lx.TIER0_TERMS, whole_word) | ((tx.word_count(q) <= 2) & (size < 10))
    )
    complex_ = (size >= 40) | any_match(lower, lx.TIER2_TERMS, whole_word)
    return F.when(short, "C0").when(complex_, "C2").otherwise("C1")


#: Ties between intents go to the earliest entry.
DEFAULT_INTENTS = {name: lx.INTENT_TERMS[name] for name in lx.INTENT_PRIORITY}


def semantic_intent(col, intents: Mapping[str, Sequence[str]] | None = None,
                    whole_word: bool = False) -> Column:
    """STRUCT<intent, score, confidence>: most hits wins, ties by priority."""
    intents = intents or DEFAULT_INTENTS
    query = tx._c(col)
    lower = F.lower(query)

    def entry(rank: int, name: str, words: Sequence[str]) -> Column:
        return tx.bind(
            matches(lower, words, whole_word),
            lambda found: F.struct(
                F.size(found).alias("score"), F.lit(-rank).alias("priority"), F.lit(name).alias("intent"),
                F.aggregate(found, F.lit(0), lambda acc, w: acc + F.length(w)).alias("chars"),
            ),
        )

    def verdict(best: Column) -> Column:
        hit = best["score"] > 0
        coverage = best["chars"] / F.greatest(F.length(query), F.lit(1))
        confidence = F.round(F.least(F.lit(1.0), 0.5 + coverage * 0.4), 4)
        return F.struct(
            F.when(hit, best["intent"]).otherwise("UNKNOWN").alias("intent"),
            best["score"].alias("score"),
            F.when(hit, confidence).otherwise(F.lit(0.3)).alias("confidence"),
        )

    scored = F.array(*[entry(i, name, words) for i, (name, words) in enumerate(intents.items())])
    return tx.bind(F.array_max(scored), verdict)


def answer_structure(col, whole_word: bool = False) -> Column:
    lower = F.lower(tx._c(col))
    scored = [
        F.struct(
            F.size(matches(lower, words, whole_word)).alias("score"),
            F.lit(-rank).alias("priority"),
            F.lit(name).alias("structure"),
        )
        for rank, (name, words) in enumerate(lx.STRUCTURE_TERMS.items())
    ]
    return tx.bind(
        F.array_max(F.array(*scored)),
        lambda best: F.when(best["score"] > 0, best["structure"]).otherwise("unknown"),
    )


def route(tier, intent) -> Column:
    tier, intent = tx._c(tier), tx._c(intent)
    known = {f"{c}/{i}": r for c, row in lx.ROUTES.items() for i, r in row.items()}
    exact = F.element_at(
        F.create_map(*[F.lit(x) for kv in known.items() for x in kv]), F.concat_ws("/", tier, intent)
    )
    return F.coalesce(exact, tx.lookup(tier, lx.ROUTE_DEFAULTS, lx.ROUTE_DEFAULTS["C2"]))


def breadth(route_col, top_k: int = 10) -> Column:
    """Hits to fetch for a route."""
    factor = tx.lookup(route_col, lx.ROUTE_BREADTH, 1.0)
    return F.greatest(F.floor(factor * top_k), F.lit(1)).cast("int")


def quick_action(col) -> Column:
    q = F.lower(tx.strip(col))
    digits = F.regexp_replace(q, r"(?U)[计算等于多少求\s?？=]", "")
    arithmetic = digits.rlike(r"(?U)^[\d+\-*/()\.\^%×÷√]+$") & (F.length(digits) > 2)
    dated = any_match(q, lx.QUICK_DATE_TERMS) & q.rlike(
        r"(?U)\d{4}[年\-/]\d{1,2}|\d+\s*[天日](?:后|前)"
    )
    return (
        F.when(arithmetic, "calculator")
        .when((F.length(q) < 10) & any_match(q, lx.QUICK_GREETINGS), "direct_answer")
        .when(dated, "date_parser")
        .when(any_match(q, lx.QUICK_REFUSE_TERMS), "refuse")
        .otherwise("none")
    )


def is_knowledge_query(col) -> Column:
    q = F.lower(tx.strip(col))
    return F.coalesce((F.length(q) >= 8) & any_match(q, lx.KNOWLEDGE_TERMS), F.lit(False))


def admission(col, whole_word: bool = False) -> Column:
    """STRUCT<decision, reason>: refuse, clarify or pass."""
    q = tx.strip(col)
    lower = F.lower(q)
    refused = any_match(lower, lx.REFUSE_TERMS, whole_word)
    vague = tx.bind(lower, lambda t: F.exists(_terms(lx.VAGUE_PREFIXES), lambda w: F.startswith(t, w)))
    reason = (
        F.when(refused, "refuse_unsafe_content")
        .when(F.length(q) < lx.MIN_QUERY_CHARS, "clarify_too_short")
        .when(vague, "clarify_vague_query")
        .otherwise("")
    )
    decision = F.when(reason == "", "pass").otherwise(F.substring_index(reason, "_", 1))
    return F.struct(decision.alias("decision"), reason.alias("reason"))


def question_problem(col, max_chars: int = lx.MAX_QUESTION_CHARS) -> Column:
    """NULL for a valid question."""
    q = F.coalesce(tx._c(col), F.lit(""))
    return F.when(tx.strip(q) == "", "blank").when(F.length(q) > max_chars, "too_long")


def classify(queries, col: str = "query"):
    """Adds tier, intent, structure, route, breadth and confidence columns."""
    return (
        queries.withColumn("tier", complexity_tier(col))
        .withColumn("_s", semantic_intent(col))
        .withColumn("intent", F.col("_s.intent"))
        .withColumn("structure", answer_structure(col))
        .withColumn("route", route("tier", "intent"))
        .withColumn("breadth", breadth("route"))
        .withColumn("intent_confidence", F.col("_s.confidence"))
        .drop("_s")
    )


# --- document-side classification -------------------------------------------
# Line patterns that mark procedures, endpoints, tables and code.
STEP_LINE = (
    r"^(?:(?:Step|步骤)\s+\d+[.:\s]|\d+[.、]\s+|第[一二三四五六七八九十\d]+步[:\s]|[（(]\d+[)）]\s+)"
)
API_LINE = r"(?i)^(?:GET|POST|PUT|DELETE|PATCH|HEAD|OPTIONS)\s+/[\w/{}.\-?_&=]*"
TABLE_ROW = r"^\|.+\|$"
TABLE_RULE = r"^\|[\s:\-|]+\|$"
DEFINITION = r"^\s*(?:async\s+)?(?:def|function|fn)\s+\w+"
TYPE_DEFINITION = r"^\s*(?:class|interface|struct|enum)\s+\w+"


def structure_type(col) -> Column:
    """api_spec > procedural > table > code > narrative."""
    text = tx._c(col)
    lines = F.split(text, "\n")
    trimmed = F.transform(lines, tx.strip)
    steps = F.size(F.filter(F.slice(lines, 1, 50), lambda ln: ln.rlike(STEP_LINE)))
    rule_after_row = F.exists(
        F.zip_with(trimmed, F.slice(trimmed, F.lit(2), F.size(trimmed)), lambda a, b: F.struct(a.alias("a"), b.alias("b"))),
        lambda p: p["b"].rlike(TABLE_RULE) & p["a"].rlike(TABLE_ROW),
    )
    definitions = F.regexp_count(text, F.lit(f"(?m){DEFINITION}")) + F.regexp_count(
        text, F.lit(f"(?m){TYPE_DEFINITION}")
    )
    return (
        F.when(text.rlike(API_LINE.replace("(?i)", "(?im)")), "api_spec")
        .when(steps >= 3, "procedural")
        .when(F.coalesce(rule_after_row, F.lit(False)), "table")
        .when(definitions >= 2, "code")
        .otherwise("narrative")
    )


def document_type(counts: dict[str, Column]) -> Column:
    """Document type from counts of structure elements per kind."""
    n = {k: F.coalesce(c, F.lit(0)) for k, c in counts.items()}
    return (
        F.when(n["code_block"] >= 3, "code")
        .when(n["procedure"] >= 3, "tutorial")
        .when(n["table"] >= 3, "table_doc")
        .when(n["api"] > 0, "api_spec")
        .when(n["heading"] >= 10, "faq")
        .otherwise("narrative")
    )


# Extensions chunked semantically / by fixed size.
SEMANTIC_EXTENSIONS = ["pdf", "docx", "pptx", "html", "htm", "txt", "md"]
FIXED_EXTENSIONS = ["xlsx", "csv"]


def chunking_params(ext, profile: Column | None = None, doc_type=None, size_by: str = "language",
                    chunk_size: int = 500, chunk_overlap: int = 100,
                    semantic: bool = True) -> Column:
    """STRUCT of chunk sizes, language and strategy for a document.

    ``size_by`` says which of the two size sources wins when both are given.
    """
    ext = F.lower(tx._c(ext))
    size, overlap = F.lit(chunk_size), F.lit(chunk_overlap)
    if doc_type is not None:
        kind = tx._c(doc_type)
        size = tx.lookup(kind, {k: s for k, (s, _) in lx.DOC_TYPE_SIZES.items()}, chunk_size)
        overlap = tx.lookup(kind, {k: o for k, (_, o) in lx.DOC_TYPE_SIZES.items()}, chunk_overlap)
    language = F.lit("en")
    if profile is not None:
        language = profile["primary_language"]
        if size_by == "language":
            size = F.greatest(tx.dynamic_chunk_size(profile), F.lit(64))
            overlap = F.least(F.floor(size * 0.20), F.lit(200))
    strategy = (
        F.when(F.lit(semantic) & ext.isin(SEMANTIC_EXTENSIONS), "semantic")
        .when(ext.isin(FIXED_EXTENSIONS), "fixed")
        .otherwise("sliding")
    )
    return F.struct(
        size.cast("int").alias("chunk_size"),
        overlap.cast("int").alias("chunk_overlap"),
        F.greatest(F.floor(size * 0.10), F.lit(20)).cast("int").alias("min_chunk_size"),
        F.floor(size * 1.50).cast("int").alias("max_chunk_size"),
        language.alias("language"),
        ((language != "en") | F.lit(semantic)).alias("semantic_boundary"),
        strategy.alias("strategy"),
    )


def doc_type_size(doc_type) -> Column:
    size, overlap = lx.DEFAULT_DOC_TYPE_SIZE
    kind = tx._c(doc_type)
    return F.struct(
        tx.lookup(kind, {k: s for k, (s, _) in lx.DOC_TYPE_SIZES.items()}, size).alias("chunk_size"),
        tx.lookup(kind, {k: o for k, (_, o) in lx.DOC_TYPE_SIZES.items()}, overlap).alias("chunk_overlap"),
    )
