"""Splitting documents into chunks.

A document is one row, so everything that depends only on the document's own
text is computed inside that row (no shuffle): the splitters return an
``ARRAY<STRING>`` column which ``emit_chunks`` turns into rows whose ids and
prev/next links follow from the position alone.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from docloom.functions import classify as cl
from docloom.functions import text as tx
from docloom.functions import vectors as vx
from docloom.operators import structure
from docloom.operators.asof import asof_join


# --- splitters: text column -> array of pieces ------------------------------
def fixed_pieces(col, size: int = 500) -> Column:
    """Non-blank stripped slices of ``size`` characters, in one pass."""
    slices = F.regexp_extract_all(tx._c(col), F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    return F.filter(F.transform(slices, tx.strip), lambda s: s != "")


def _window_bounds(sizes: np.ndarray, size: int, overlap: int) -> list[tuple[int, int]]:
    """Windows over items of the given sizes: a window ends before the item that would
    pass ``size``, and the next one begins with as many whole items as ``overlap`` holds.
    Both ends of every possible window are looked up in the running total at once."""
    n = len(sizes)
    total = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    ends = np.maximum(np.searchsorted(total, total[:-1] + size, side="right") - 1, np.arange(n) + 1)
    nexts = np.maximum(np.searchsorted(total, total[ends] - overlap), np.arange(n) + 1)
    bounds, start = [], 0
    while start < n:
        bounds.append((start, int(ends[start])))
        start = int(nexts[start])
    return bounds


def sliding_bounds(size: int, overlap: int):
    """UDF: sentence lengths -> packed [start, end) windows.

    The packing is a sequential recurrence over a document's sentences; only
    their lengths travel to Python, the text is assembled in the JVM.
    """
    schema = T.ArrayType(
        T.StructType([T.StructField("lo", T.IntegerType()), T.StructField("hi", T.IntegerType())])
    )

    @F.pandas_udf(schema)
    def bounds(lengths: pd.Series) -> pd.Series:
        return lengths.map(
            lambda ls: None
            if ls is None
            else [{"lo": a, "hi": b} for a, b in _window_bounds(np.asarray(ls, dtype=np.int64), size, overlap)]
        )

    return bounds


def sliding_pieces(docs: DataFrame, text: str = "text", size: int = 500, overlap: int = 100,
                   out: str = "pieces") -> DataFrame:
    """Sentence-packed windows with whole-sentence overlap."""
    sentences = tx.split_sentences(tx.strip(text))
    bounds = sliding_bounds(size, overlap)
    return (
        docs.withColumn("_sent", sentences)
        .withColumn("_win", bounds(F.transform("_sent", lambda s: F.length(s))))
        .withColumn(
            out,
            F.filter(
                F.transform(
                    "_win",
                    lambda w: tx.strip(
                        F.array_join(F.slice("_sent", w["lo"] + 1, w["hi"] - w["lo"]), "")
                    ),
                ),
                lambda s: s != "",
            ),
        )
        .drop("_sent", "_win")
    )


# --- pieces -> chunk rows ---------------------------------------------------
def chunk_key(doc_id, idx) -> Column:
    """Chunk ids follow from document and position, so re-runs are idempotent."""
    return F.concat_ws(":", tx._c(doc_id), tx._c(idx))


def emit_chunks(docs: DataFrame, pieces: Column | str, doc_id: str = "doc_id",
                keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per piece, with sibling links taken from the position."""
    # The count is taken before the explode; next to it, the whole array would
    # travel with every one of its rows.
    counted = docs.select(doc_id, *keep, tx._c(pieces).alias("_p")).select(
        doc_id, *keep, F.size("_p").alias("_n"), "_p"
    )
    rows = counted.select(doc_id, *keep, "_n", F.posexplode("_p").alias("chunk_idx", "content"))
    idx = F.col("chunk_idx")
    return rows.select(
        chunk_key(doc_id, idx).alias("chunk_id"),
        doc_id,
        *keep,
        "chunk_idx",
        "content",
        F.length("content").alias("char_count"),
        F.when(idx > 0, chunk_key(doc_id, idx - 1)).alias("prev_chunk_id"),
        F.when(idx + 1 < F.col("_n"), chunk_key(doc_id, idx + 1)).alias("next_chunk_id"),
    )


def fixed_chunks(docs: DataFrame, text: str = "text", size: int = 500,
                 keep: tuple[str, ...] = ()) -> DataFrame:
    return emit_chunks(docs, fixed_pieces(text, size), keep=keep)


def sliding_chunks(docs: DataFrame, text: str = "text", size: int = 500, overlap: int = 100,
                   keep: tuple[str, ...] = ()) -> DataFrame:
    return emit_chunks(sliding_pieces(docs, text, size, overlap), "pieces", keep=keep)


# --- splitters for structured passages ---------------------------------------
# Passages shorter than these are dropped by the splitters.
MIN_ENDPOINT_CHARS = 50
MIN_PREAMBLE_CHARS = 20
SMALL_TABLE_ROWS = 15
TABLE_GROUP_ROWS = 10

_ENDPOINT_START = r"\n(?=(?i:GET|POST|PUT|DELETE|PATCH|HEAD|OPTIONS)\s+/)"
_STEP_START = (
    r"\n(?=(?:Step|步骤)\s+\d+[.:\s]|\d+[.、]\s+|第[一二三四五六七八九十\d]+步[:\s]|[（(]\d+[)）]\s+)"
)
_CODE_START = (
    r"\n(?=[^\S\n]*(?:async\s+)?(?:def|function|fn)\s+\w+|[^\S\n]*(?:class|interface|struct|enum)\s+\w+)"
)


def endpoint_pieces(col) -> Column:
    """One piece per endpoint line; short pieces before the last are dropped."""
    return tx.bind(
        F.split(tx._c(col), _ENDPOINT_START),
        lambda ps: F.filter(
            ps, lambda p, i: (F.length(p) > MIN_ENDPOINT_CHARS) | (i == F.size(ps) - 1)
        ),
    )


def code_pieces(col) -> Column:
    """One piece per definition; a short preamble is dropped."""
    return tx.bind(
        F.split(tx._c(col), _CODE_START),
        lambda ps: F.filter(
            ps,
            lambda p, i: (i > 0) | (F.size(ps) == 1) | (F.length(tx.strip(p)) > MIN_PREAMBLE_CHARS),
        ),
    )


def table_pieces(col) -> Column:
    """Small tables whole, larger ones in groups that repeat the header."""
    text = tx._c(col)
    row, rule = r"^\|.+\|$", r"^\|[\s:\-|]+\|$"

    def grouped(header: Column, rule_line: Column, data: Column) -> Column:
        def piece(rows: Column) -> Column:
            return F.array_join(F.concat(F.array(header, rule_line), rows), "\n")

        groups = F.transform(
            F.sequence(F.lit(0), F.floor((F.size(data) - 1) / TABLE_GROUP_ROWS)),
            lambda g: piece(F.slice(data, (g * TABLE_GROUP_ROWS + 1).cast("int"), F.lit(TABLE_GROUP_ROWS))),
        )
        return (
            F.when(F.size(data) == 0, F.array(text))
            .when(F.size(data) <= SMALL_TABLE_ROWS, F.array(piece(data)))
            .otherwise(groups)
        )

    def from_header(lines: Column, at: Column) -> Column:
        """``at``: 1-based line of the header."""

        def data_rows(rest: Column) -> Column:
            flags = F.transform(rest, lambda ln: ln.rlike(row))
            first = F.array_position(flags, F.lit(True))
            blanks = F.filter(
                F.transform(rest, lambda ln, i: F.when((ln == "") & (i + 1 > first), i)),
                lambda i: i.isNotNull(),
            )
            stop = F.coalesce(F.get(blanks, 0), F.size(rest))
            return tx.bind(
                F.when(first > 0, stop).otherwise(F.lit(0)),
                lambda end: F.filter(F.slice(rest, F.lit(1), end.cast("int")), lambda ln: ln.rlike(row)),
            )

        rest = F.slice(lines, at + 2, F.size(lines))
        return tx.bind(
            tx.bind(rest, data_rows),
            lambda data: grouped(F.get(lines, at - 1), F.get(lines, at), data),
        )

    def split_lines(lines: Column) -> Column:
        header = F.array_position(
            F.zip_with(
                lines,
                F.slice(lines, F.lit(2), F.size(lines)),
                lambda a, b: F.coalesce(a.rlike(row) & b.rlike(rule), F.lit(False)),
            ),
            F.lit(True),
        )
        return tx.bind(
            header.cast("int"),
            lambda at: F.when(at > 0, from_header(lines, at)).otherwise(F.array(text)),
        )

    return tx.bind(F.transform(F.split(text, "\n"), tx.strip), split_lines)


def procedure_pieces(col, size: int = 500) -> Column:
    """Whole steps packed greedily; a step opens a new piece when its first line
    would overflow the current one."""
    steps = F.split(tx._c(col), _STEP_START)

    def add(state: Column, step: Column) -> Column:
        first_line = F.substring_index(step, "\n", 1)
        overflow = F.length(state["buf"]) + 1 + F.length(first_line) > size
        return F.struct(
            F.when(overflow, F.array_append(state["out"], state["buf"])).otherwise(state["out"]).alias("out"),
            F.when(overflow, step).otherwise(F.concat(state["buf"], F.lit("\n"), step)).alias("buf"),
        )

    def pack(parts: Column) -> Column:
        start = F.struct(F.array().cast("array<string>").alias("out"), F.get(parts, 0).alias("buf"))
        return F.aggregate(
            F.slice(parts, F.lit(2), F.size(parts)), start, add, lambda s: F.array_append(s["out"], s["buf"])
        )

    return tx.bind(steps, pack)


def leading_steps(col) -> Column:
    """Length of the first run of consecutive step lines."""
    step_line = cl.STEP_LINE

    def first_run(lines: Column) -> Column:
        flags = F.transform(lines, lambda ln: ln.rlike(step_line))
        begin = F.array_position(flags, F.lit(True))
        tail = F.slice(flags, F.greatest(begin, F.lit(1)).cast("int"), F.size(flags))
        stop = F.array_position(tail, F.lit(False))
        return F.when(begin == 0, F.lit(0)).when(stop == 0, F.size(tail)).otherwise(stop - 1)

    return tx.bind(F.split(tx._c(col), "\n"), first_run)


#: Rows of an Arrow batch whose values are Python objects at once.
SLICE_ROWS = 64


def _by_slices(rows: pa.Array, one: Callable[[list], list[str]]) -> pa.Array:
    """``one`` of every row, so many rows at a time; null rows stay null."""
    kind = pa.list_(pa.string())
    parts = [
        pa.array([None if x is None else one(x) for x in rows.slice(at, SLICE_ROWS).to_pylist()], kind)
        for at in range(0, len(rows), SLICE_ROWS)
    ]
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


def _pack_sentences(size: int):
    def one(parts: list[str]) -> list[str]:
        return ["".join(parts[a:b]) for a, b in _window_bounds(np.array([len(p) for p in parts], dtype=np.int64), size, 0)]

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def pack(sentences: pa.Array) -> pa.Array:
        return _by_slices(sentences, one)

    return pack


def oversize_pieces(col, size: int = 500) -> Column:
    """Split a passage longer than a chunk by what it looks like."""
    text = tx._c(col)
    kind = cl.structure_type(text)
    plain = _pack_sentences(size)(
        F.when(F.length(text) > size, F.transform(tx.split_sentences_dot(text), tx.strip))
    )
    return (
        F.when(kind == "api_spec", endpoint_pieces(text))
        .when(leading_steps(text) >= 3, procedure_pieces(text, size))
        .when(kind == "table", table_pieces(text))
        .when(kind == "code", code_pieces(text))
        .otherwise(plain)
    )


def _joined_runs(texts: list[str], size: int, overlap: int) -> list[str]:
    """Chunks of consecutive paragraphs. Each takes the paragraphs that still fit by the
    running total, one at least, after the end of the chunk before."""
    gap = "\n\n"
    total = np.concatenate([[0], np.cumsum([len(t) + len(gap) for t in texts], dtype=np.int64)])
    chunks, tail, at = [], "", 0
    while at < len(texts):
        room = size + len(gap) - (len(tail) + len(gap) if tail else 0)
        upto = max(at + 1, int(np.searchsorted(total, total[at] + room, side="right")) - 1)
        chunks.append(gap.join([tail, *texts[at:upto]] if tail else texts[at:upto]).strip())
        tail = chunks[-1][-overlap:].lstrip() if overlap else ""
        at = upto
    return chunks


def _pack_paragraphs(size: int, overlap: int):
    """UDF: paragraphs of a section (whole, or already split) -> chunk texts. A split
    paragraph stands alone; those between two of them are joined."""

    def pack(paragraphs) -> list[str]:
        out: list[str] = []
        for whole, group in groupby(paragraphs, key=lambda p: p["pieces"] is None):
            if whole:
                out += _joined_runs([p["text"] for p in group], size, overlap)
            else:
                out += [piece.strip() for p in group for piece in p["pieces"] if piece.strip()]
        return out

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def packed(sections: pa.Array) -> pa.Array:
        return _by_slices(sections, pack)

    return packed


def recursive_chunks(docs: DataFrame, text: str = "text", size: int = 500, overlap: int = 100) -> DataFrame:
    """Sections, then paragraphs, then sentences or structured pieces.

    Short documents and short sections stay whole; a long section yields a parent
    row with the section's opening and leaf rows that point to it.
    """
    trimmed = docs.select("doc_id", tx.strip(text).alias("_t")).filter("_t <> ''")
    short = trimmed.filter(F.length("_t") <= size).select(
        "doc_id", F.lit(0).alias("section_no"), F.lit("").alias("heading"), F.col("_t").alias("content")
    )
    sections = structure.split_sections(trimmed.filter(F.length("_t") > size), "_t").unionByName(short)
    whole = sections.filter(F.length("content") <= size).select(
        "doc_id", "section_no", "heading", F.lit(0).alias("pos"), F.lit("section").alias("chunk_type"),
        "content", F.length("content").alias("char_count"),
    )
    large = sections.filter(F.length("content") > size)
    parents = large.select(
        "doc_id", "section_no", "heading", F.lit(0).alias("pos"), F.lit("parent").alias("chunk_type"),
        F.substring("content", 1, size).alias("content"), F.length("content").alias("char_count"),
    )
    paragraphs = large.select(
        "doc_id", "section_no", "heading", F.posexplode(F.split("content", r"\n{2,}")).alias("p", "_p")
    ).select("doc_id", "section_no", "heading", "p", tx.strip("_p").alias("para")).filter("para <> ''")
    split = paragraphs.withColumn(
        "pieces", F.when(F.length("para") > size, oversize_pieces("para", size))
    )
    regrouped = split.groupBy("doc_id", "section_no", "heading").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("p", F.col("para").alias("text"), "pieces"))),
            lambda s: F.struct(s["text"].alias("text"), s["pieces"].alias("pieces")),
        ).alias("paras")
    )
    leaves = (
        regrouped.withColumn("_c", _pack_paragraphs(size, overlap)("paras"))
        .select("doc_id", "section_no", "heading", F.posexplode("_c").alias("pos", "content"))
        .select(
            "doc_id", "section_no", "heading", (F.col("pos") + 1).alias("pos"),
            F.lit("leaf").alias("chunk_type"), "content", F.length("content").alias("char_count"),
        )
    )
    rows = whole.unionByName(parents).unionByName(leaves)
    order = structure.by_doc("section_no", "pos")
    numbered = rows.withColumn("chunk_idx", F.row_number().over(order) - 1)
    key = chunk_key("doc_id", "chunk_idx")
    parent = F.last(F.when(F.col("chunk_type") == "parent", key), ignorenulls=True).over(
        structure.upto(Window.partitionBy("doc_id", "section_no").orderBy("pos"))
    )
    return numbered.select(
        key.alias("chunk_id"), "doc_id", "chunk_idx", "section_no", "heading", "chunk_type", "content",
        "char_count", F.when(F.col("chunk_type") == "leaf", parent).alias("parent_id"),
    )


def link_leaves(chunks: DataFrame) -> DataFrame:
    """prev/next among the leaves of a document, skipping parent rows."""
    order = Window.partitionBy("doc_id", "chunk_type").orderBy("chunk_idx")
    leaf = F.col("chunk_type") == "leaf"
    return chunks.withColumn(
        "prev_chunk_id", F.when(leaf, F.lag("chunk_id").over(order))
    ).withColumn("next_chunk_id", F.when(leaf, F.lead("chunk_id").over(order)))


def topic_pieces(docs: DataFrame, text: str = "text", threshold: float = 0.5, embed=vx.hash_embed) -> DataFrame:
    """doc_id, piece_no, content: sentences grouped until the similarity of two
    neighbours drops below the threshold."""
    sentences = docs.select(
        "doc_id", F.posexplode(tx.split_sentences_dot(tx.strip(text))).alias("i", "sentence")
    ).withColumn("vec", embed("sentence"))
    w = structure.by_doc("i")
    sim = vx.cosine("vec", "prev_vec", empty=1.0)
    near = sentences.withColumn("prev_vec", F.lag("vec").over(w)).select(
        "doc_id", "i", "sentence", F.when(sim < threshold, 1).otherwise(0).alias("cut"),
        F.count("*").over(Window.partitionBy("doc_id")).alias("n"),
    )
    numbered = near.withColumn(
        "piece_no", F.sum(F.when(F.col("n") >= 3, F.col("cut")).otherwise(0)).over(structure.upto(w))
    )
    return numbered.groupBy("doc_id", "piece_no").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("i", "sentence"))), lambda s: s["sentence"]), ""
        ).alias("content")
    )


# --- source code ----------------------------------------------------------------
# Lines that open a unit of source code.
_CLASS_LINE = r"[^\S\n]*(?:export\s+)?(?:abstract\s+)?class\s+\w+"
_FUNC_LINE = (
    r"[^\S\n]*(?:pub(?:\s*\(\s*crate\s*\))?\s+)?(?:async\s+|unsafe\s+)?(?:def|fn|func|function)\s+\w+"
)
_IMPORT_LINE = r"[^\S\n]*(?:import|from|use|package|require)\s"


def code_units(files: DataFrame, code: str = "text") -> DataFrame:
    """Units of source code by their opening lines; the text before the first
    one is dropped, and a file without any stays whole."""
    opens = f"{_CLASS_LINE}|{_FUNC_LINE}|{_IMPORT_LINE}"
    parts = F.split(code, rf"\n(?={opens})")
    rows = files.select("doc_id", F.posexplode(parts).alias("i", "content"))
    first_line = F.substring_index("content", "\n", 1)
    kind = (
        F.when(first_line.rlike(f"^{_CLASS_LINE}"), "class")
        .when(first_line.rlike(f"^{_FUNC_LINE}"), "function")
        .when(F.concat(first_line, F.lit("\n")).rlike(f"^{_IMPORT_LINE}"), "import")
    )
    order = Window.partitionBy("doc_id").orderBy("i")
    height = F.size(F.split("content", "\n"))
    every = Window.partitionBy("doc_id")
    placed = rows.select(
        "doc_id", "content", kind.alias("unit_type"), tx.strip(first_line).alias("head"),
        F.sum(height).over(structure.upto(order)).alias("end_line"), height.alias("height"),
        F.count(kind).over(every).alias("units"), F.sum(height).over(every).alias("n_lines"), "i",
    )
    last_word = F.regexp_extract("head", r"(\S+)\z", 1)
    name = (
        F.when(F.col("unit_type") == "class", F.rtrim(last_word, F.lit("{:")))
        .when(F.col("unit_type") == "function", F.substring_index(last_word, "(", 1))
        .otherwise("")
    )
    whole = (F.col("units") == 0) | (F.col("n_lines") <= 1)
    units = placed.filter(~whole & F.col("unit_type").isNotNull()).select(
        "doc_id", "unit_type", name.alias("name"), (F.col("end_line") - F.col("height") + 1).alias("start_line"),
        "end_line", "content",
    )
    modules = placed.filter(whole & (F.col("i") == 0)).select(
        "doc_id", F.lit("module").alias("unit_type"), F.lit("").alias("name"),
        F.lit(1).cast("long").alias("start_line"), F.col("n_lines").cast("long").alias("end_line"), "content",
    )
    return units.unionByName(modules)


# --- relations between chunks ---------------------------------------------------
def inject_positions(chunks: DataFrame, page_map: DataFrame | None = None) -> DataFrame:
    """Running character span, content hash and, given (doc_id, offset, page),
    the page each chunk starts on."""
    w = structure.by_doc("chunk_idx")
    size = F.length("content")
    placed = chunks.withColumn(
        "char_start", F.coalesce(F.sum(size).over(structure.upto(w, -1)), F.lit(0))
    ).withColumns({"char_end": F.col("char_start") + size, "chunk_hash": tx.content_hash16("content")})
    if page_map is None:
        return placed.withColumn("page", F.lit(None).cast("int"))
    return asof_join(placed, page_map, ["doc_id"], "char_start", "offset", ["page"])


def group_sections(chunks: DataFrame) -> DataFrame:
    """Runs of chunks under one heading; chunks without a heading stay in the
    current run. Links stay inside a run, whose first chunk is the parent."""
    w = structure.by_doc("chunk_idx")
    heading = F.when(F.col("heading") != "", F.col("heading"))
    before = F.last(heading, ignorenulls=True).over(structure.upto(w, -1))
    opens = heading.isNotNull() & before.isNotNull() & (heading != before)
    runs = chunks.withColumn("_opens", opens.cast("int")).withColumn(
        "section_run", F.sum("_opens").over(structure.upto(w))
    )
    inside = Window.partitionBy("doc_id", "section_run").orderBy("chunk_idx")
    return runs.drop("_opens").withColumns(
        {
            "parent_chunk_id": F.first("chunk_id").over(inside),
            "prev_chunk_id": F.lag("chunk_id").over(inside),
            "next_chunk_id": F.lead("chunk_id").over(inside),
        }
    )


def relate_sections(chunks: DataFrame, sections: DataFrame) -> DataFrame:
    """Section of each chunk by its heading, carried forward over chunks without
    one; neighbours skip heading chunks; root title of the section."""
    w = structure.by_doc("chunk_idx")
    by_title = sections.groupBy("doc_id", F.col("title").alias("heading")).agg(
        F.max_by(F.struct("section_id", "root_title"), "order_index").alias("_s")
    )
    joined = chunks.join(by_title, ["doc_id", "heading"], "left").withColumn(
        "_s", F.last("_s", ignorenulls=True).over(structure.upto(w))
    )
    leaf = F.col("chunk_type") != "heading"
    among = Window.partitionBy("doc_id", leaf).orderBy("chunk_idx")
    return joined.select(
        *chunks.columns,
        F.coalesce(F.col("_s.section_id"), F.lit("")).alias("parent_section_id"),
        F.coalesce(F.col("_s.root_title"), F.lit("")).alias("root_section"),
        F.when(leaf, F.lag("chunk_id").over(among)).alias("prev_chunk_id"),
        F.when(leaf, F.lead("chunk_id").over(among)).alias("next_chunk_id"),
    )


def section_texts(chunks: DataFrame, section: str = "section_no", first: int = 5) -> DataFrame:
    """Opening chunks of every section joined by blank lines, for embedding."""
    w = Window.partitionBy("doc_id", section).orderBy("chunk_idx")
    head = chunks.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= first)
    return head.groupBy("doc_id", section).agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("_rn", "content"))), lambda s: s["content"]), "\n\n"
        ).alias("section_text")
    )


def diff_chunks(old: DataFrame, new: DataFrame) -> DataFrame:
    """keep (under the old id), delete or create, by content hash per document.

    Each side is reduced to the first chunk per hash before the join, so equal
    copies never meet each other.
    """

    def first_per_hash(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("doc_id", tx.content_hash16("content").alias("chunk_hash")).agg(
            F.min_by("chunk_id", "chunk_idx").alias(name)
        )

    joined = first_per_hash(old, "_old").join(first_per_hash(new, "_new"), ["doc_id", "chunk_hash"], "full")
    action = (
        F.when(F.col("_old").isNull(), "create").when(F.col("_new").isNull(), "delete").otherwise("keep")
    )
    return joined.select("doc_id", "chunk_hash", action.alias("action"), F.coalesce("_old", "_new").alias("chunk_id"))
