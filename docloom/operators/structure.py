"""Structure of documents: headings, tables, code, lists, steps, section trees.

A document becomes one row per line. All windows are partitioned by document, so
after the first exchange on ``doc_id`` the later ones reuse it; a document is one
input row, which bounds every such partition.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.functions import text as tx

# Line patterns.
MD_HEADING = r"^(#{1,6})\s+(.+)$"
CN_SECTION = (
    r"^(?:第[一二三四五六七八九十百千\d]+[章节篇条款]|[一二三四五六七八九十]+[、.．]|\d+[、.．]\s*\S)"
)
CN_OUTLINE = (
    r"^((?:第[一二三四五六七八九十百千\d]+[章节篇部]|[一二三四五六七八九十]+[、．.]|"
    r"\d+(?:\.\d+)*[\s　]+(?![\d.])|[A-Z]\.\d+(?:\.\d+)*|第[一二三四五六七八九十百千\d]+[条]|"
    r"附[则条]|[（(][一二三四五六七八九十]+[)）]))"
)
FENCE = r"^```(\w*)\s*$"
ROW = r"^\|(.+)\|\s*$"
# Separators of tables with several columns contain pipes too.
RULE = r"^\|[\s\-:|]+\|\s*$"
LIST_ITEM = r"^(\s*)([-*+]|\d+[.)])\s+"
STEP = r"(?:Step|步骤|STEP)\s*\d+[：:.\s]|^\d+[.)]\s+(?=[A-Z\x{4e00}-\x{9fff}])"
ENDPOINT = r"(?i)\b(GET|POST|PUT|DELETE|PATCH)\s+/\S+"
MAX_LEVEL = 6
ALL = (Window.unboundedPreceding, Window.unboundedFollowing)


def by_doc(*order: str):
    return Window.partitionBy("doc_id").orderBy(*order)


def upto(w, last: int = 0):
    return w.rowsBetween(Window.unboundedPreceding, last)


def line_rows(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, line_no, line, start: character offset of each line."""
    rows = docs.select("doc_id", F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    before = F.sum(F.length("line") + 1).over(upto(by_doc("line_no"), -1))
    return rows.withColumn("start", F.coalesce(before, F.lit(0)))


def cn_heading_level(prefix: Column | str) -> Column:
    p = tx._c(prefix)
    first = F.substring(p, 1, 1)
    return (
        F.when(p.contains("第") & p.contains("章"), 1)
        .when(p.contains("第") & p.contains("节"), 2)
        .when(first.between("一", "九") & p.contains("、"), 2)
        .when(first.rlike(r"(?U)\d"), 3)
        .otherwise(2)
    )


def headings(lines: DataFrame, style: str = "outline") -> DataFrame:
    """Heading lines with level and title.

    ``outline`` grades numbered headings and titles them by their number;
    ``sections`` takes every short numbered line as a level-2 heading.
    """
    md = F.col("line").rlike(MD_HEADING)
    md_level = F.length(F.regexp_extract("line", MD_HEADING, 1))
    md_title = tx.strip(F.regexp_extract("line", MD_HEADING, 2))
    if style == "outline":
        prefix = F.regexp_extract("line", CN_OUTLINE, 1)
        numbered, level, title = prefix != "", cn_heading_level(prefix), tx.strip(prefix)
        end = F.length(prefix)
    else:
        title = tx.strip("line")
        numbered, level = F.col("line").rlike(CN_SECTION) & (F.length(title) < 50), F.lit(2)
        end = F.length("line")
    return lines.filter(md | numbered).select(
        "doc_id", "line_no", "start",
        (F.col("start") + F.when(md, F.length("line")).otherwise(end)).alias("end"),
        F.when(md, md_level).otherwise(level).cast("int").alias("level"),
        F.when(md, md_title).otherwise(title).alias("title"),
    )


def _element(kind: str, start, end, level=None, title=None, detail=None) -> list[Column]:
    return [
        F.col("doc_id"),
        F.lit(kind).alias("type"),
        start.cast("long").alias("start"),
        end.cast("long").alias("end"),
        (F.lit(0) if level is None else level).cast("int").alias("level"),
        (F.lit("") if title is None else title).alias("title"),
        (F.lit("") if detail is None else detail).alias("detail"),
    ]


def code_blocks(lines: DataFrame) -> DataFrame:
    """Fences paired in order: every odd one opens, the next one closes."""
    fences = lines.filter(F.col("line").rlike(FENCE)).select(
        "doc_id",
        "start",
        (F.col("start") + F.length("line")).alias("end_of_line"),
        F.regexp_extract("line", FENCE, 1).alias("language"),
        F.row_number().over(by_doc("line_no")).alias("n"),
        F.lead("start").over(by_doc("line_no")).alias("close"),
    )
    return fences.filter("n % 2 = 1 AND close IS NOT NULL").select(
        *_element("code_block", F.col("end_of_line"), F.col("close"), detail=F.col("language"))
    )


def tables(lines: DataFrame) -> DataFrame:
    """Runs of pipe rows from the first row that a separator follows."""
    rows = lines.filter(F.col("line").rlike(ROW)).select(
        "doc_id", "line_no", "line", "start",
        (F.col("line_no") - F.row_number().over(by_doc("line_no"))).alias("island"),
    )
    w = Window.partitionBy("doc_id", "island").orderBy("line_no")
    is_header = F.coalesce(F.lead("line").over(w).rlike(RULE), F.lit(False)) & ~F.col("line").rlike(RULE)
    marked = rows.withColumn("header", is_header).withColumn(
        "seen", F.max(F.col("header").cast("int")).over(upto(w))
    )
    spans = (
        marked.filter("seen = 1")
        .groupBy("doc_id", "island")
        .agg(
            F.min("start").alias("start"),
            F.max(F.col("start") + F.length("line") + 1).alias("end"),
            F.count("*").alias("n"),
            F.min_by("line", "line_no").alias("head"),
        )
    )
    cells = F.transform(F.split(F.regexp_extract("head", ROW, 1), r"\|"), tx.strip)
    detail = F.concat(F.array_join(cells, ","), F.lit(" rows="), F.col("n") - 2)
    return spans.select(*_element("table", F.col("start"), F.col("end"), detail=detail))


def lists(lines: DataFrame, min_lines: int = 3) -> DataFrame:
    """Items with their blank and indented continuation lines. A run restarts at
    an item less indented than all items of the run so far."""
    indent = F.length(F.regexp_extract("line", LIST_ITEM, 1))
    item = F.col("line").rlike(LIST_ITEM)
    member = item | (tx.strip("line") == "") | F.startswith("line", F.lit("  "))
    w = by_doc("line_no")
    flagged = lines.select("doc_id", "line_no", "line", "start", item.alias("item"), member.alias("member"),
                           F.when(item, indent).alias("indent"))
    runs = flagged.withColumn("run", F.sum((~F.col("member")).cast("int")).over(upto(w))).filter("member")
    in_run = Window.partitionBy("doc_id", "run").orderBy("line_no")
    lowest = F.min("indent").over(upto(in_run, -1))
    opens = F.col("item") & (lowest.isNull() | (F.col("indent") < lowest))
    grouped = runs.withColumn("opens", opens).withColumn(
        "n", F.sum(F.col("opens").cast("int")).over(upto(in_run))
    )
    spans = grouped.filter("n > 0").groupBy("doc_id", "run", "n").agg(
        F.min("start").alias("start"), F.max(F.col("start") + F.length("line") + 1).alias("end"),
        F.count("*").alias("len"),
    )
    return spans.filter(F.col("len") >= min_lines).select(
        *_element("list", F.col("start"), F.col("end"))
    )


def procedure_steps(lines: DataFrame) -> DataFrame:
    """Every step marker; its place in the line follows from the text between."""
    padded = F.concat("line", F.lit("\n"))
    hits = lines.filter(padded.rlike(STEP)).select(
        "doc_id", "start",
        F.split(padded, STEP).alias("gaps"),
        F.regexp_extract_all(padded, F.lit(STEP), F.lit(0)).alias("found"),
    )
    each = hits.select("doc_id", "start", "gaps", "found", F.posexplode("found").alias("k", "mark"))

    def total(parts: Column) -> Column:
        return F.aggregate(parts, F.lit(0), lambda acc, s: acc + F.length(s))

    at = (
        F.col("start")
        + total(F.slice("gaps", F.lit(1), F.col("k") + 1))
        + total(F.slice("found", F.lit(1), F.col("k")))
    )
    return each.select(
        *_element("procedure", at, at + F.length("mark"), title=tx.strip("mark"))
    )


def structure_elements(docs: DataFrame, text: str = "text") -> DataFrame:
    lines = line_rows(docs, text)
    outline = headings(lines).select(
        *_element("heading", F.col("start"), F.col("end"), F.col("level"), F.col("title"))
    )
    parts = [outline, code_blocks(lines), tables(lines), lists(lines), procedure_steps(lines)]
    return reduce(DataFrame.unionByName, parts)


def element_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Elements per document and kind, with zero for absent kinds."""
    counted = structure_elements(docs, text).groupBy("doc_id").agg(
        *[
            F.count_if(F.col("type") == k).alias(k)
            for k in ("heading", "code_block", "table", "list", "procedure")
        ]
    )
    api = docs.select("doc_id", F.regexp_count(text, F.lit(ENDPOINT)).cast("long").alias("api"))
    return api.join(counted, "doc_id", "left").na.fill(0)


# --- section tree -------------------------------------------------------------
def section_tree(heads: DataFrame) -> DataFrame:
    """Parent, path and order of every heading.

    The parent is the nearest earlier heading of a smaller level. Instead of a
    stack, the last heading of each level so far is carried forward; a level is
    still open if no smaller level has been seen after it.
    """
    w = by_doc("start")
    numbered = heads.withColumn("order_index", F.row_number().over(w) - 1).withColumn(
        "section_id",
        F.substring(F.sha2(F.concat_ws(":", "doc_id", "title", "order_index"), 256), 1, 16),
    )
    node = F.struct("order_index", "section_id", "title")
    carried = numbered.withColumns(
        {
            f"_l{k}": F.last(F.when(F.col("level") == k, node), ignorenulls=True).over(upto(w, -1))
            for k in range(1, MAX_LEVEL + 1)
        }
    )
    chain = []
    newest = F.lit(-1)
    for k in range(1, MAX_LEVEL + 1):
        entry = F.col(f"_l{k}")
        at = F.coalesce(entry["order_index"], F.lit(-1))
        chain.append(F.when((F.col("level") > k) & (at > newest), entry))
        newest = F.greatest(newest, at)
    ancestors = F.array_compact(F.array(*chain))
    return carried.withColumn("_chain", ancestors).select(
        "doc_id",
        "section_id",
        "title",
        "level",
        "start",
        "order_index",
        F.coalesce(F.try_element_at("_chain", F.lit(-1))["section_id"], F.lit("")).alias("parent_id"),
        F.concat(F.transform("_chain", lambda a: a["title"]), F.array("title")).alias("path"),
        F.coalesce(F.get("_chain", 0)["title"], F.col("title")).alias("root_title"),
    )


def split_sections(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, section_no, heading, content: text between headings, else the
    blank-line paragraphs of documents without any heading."""
    trimmed = docs.select("doc_id", tx.strip(text).alias("_t"))
    lines = line_rows(trimmed, "_t")
    heads = headings(lines, "sections").select(
        "doc_id", "line_no", F.col("title").alias("heading"), F.lit(True).alias("_is")
    )
    marked = lines.join(heads, ["doc_id", "line_no"], "left")
    w = by_doc("line_no")
    placed = marked.select(
        "doc_id", "line_no", "line", "_is",
        F.sum(F.when(F.col("_is"), 1).otherwise(0)).over(upto(w)).alias("raw_no"),
        F.last("heading", ignorenulls=True).over(upto(w)).alias("heading"),
        F.max(F.coalesce("_is", F.lit(False))).over(Window.partitionBy("doc_id")).alias("has_heads"),
    )
    body = (
        placed.filter("has_heads")
        .groupBy("doc_id", "raw_no")
        .agg(
            F.first("heading", ignorenulls=True).alias("heading"),
            F.array_sort(F.collect_list(F.when(F.col("_is").isNull(), F.struct("line_no", "line")))).alias("_ls"),
        )
        .select(
            "doc_id", "raw_no", F.coalesce("heading", F.lit("")).alias("heading"),
            tx.strip(F.array_join(F.transform("_ls", lambda s: s["line"]), "\n")).alias("content"),
        )
        .filter("content <> ''")
    )
    plain = trimmed.join(heads.select("doc_id").distinct(), "doc_id", "left_anti")
    paragraphs = plain.select("doc_id", F.posexplode(F.split("_t", r"\n{2,}")).alias("raw_no", "_p")).select(
        "doc_id", "raw_no", F.lit("").alias("heading"), tx.strip("_p").alias("content")
    ).filter("content <> ''")
    return body.unionByName(paragraphs).select(
        "doc_id", (F.row_number().over(by_doc("raw_no")) - 1).alias("section_no"), "heading", "content"
    )
