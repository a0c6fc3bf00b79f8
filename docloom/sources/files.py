"""Reading files: text with encoding fallback, CSV, manifests, links, parser registry.

Files arrive as rows of the ``binaryFile`` source; each parser is a function of
one file's content, so any number of files spreads over the cluster.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom import lexicon as lx
from docloom.functions import text as tx

# Accepted extensions.
ALLOWED_EXTENSIONS = [
    "pdf", "docx", "pptx", "xlsx", "csv", "txt", "md", "html", "json", "xml", "zip",
]


def read_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(path)


# --- text ------------------------------------------------------------------------
@F.pandas_udf(T.StringType())
def _decode_legacy(contents: pd.Series) -> pd.Series:
    def one(raw):
        if raw is None:
            return None
        try:
            return bytes(raw).decode("gbk")
        except UnicodeDecodeError:
            return bytes(raw).decode("latin-1")

    return contents.map(one)


def decode_text(content) -> Column:
    """UTF-8 in the JVM; only other files go to Python, as GBK, then Latin-1."""
    raw = tx._c(content)
    utf8 = F.is_valid_utf8(raw.cast("string"))
    legacy = _decode_legacy(F.when(~utf8, raw))
    return F.when(utf8, F.regexp_replace(raw.cast("string"), "^\\x{feff}", "")).otherwise(legacy)


def text_corpus(files: DataFrame) -> DataFrame:
    return files.filter(tx.file_extension("path").isin(lx.TEXT_EXTENSIONS)).select(
        "path", decode_text("content").alias("text")
    )


# --- CSV ---------------------------------------------------------------------------
# A field in quotes may hold commas, line ends and doubled quotes. Repetition is
# possessive, so long fields neither backtrack nor use the stack.
_QUOTED = r'"[^"]*+(?:""[^"]*+)*+"?+'
_FIELD = rf"(?:{_QUOTED}[^,\r\n]*+|[^,\r\n]*+)"
_RECORD = rf"({_FIELD}(?:,{_FIELD})*+)(?:\r\n|\n|\r|$)"


def csv_rows(col) -> Column:
    """The records of a CSV file as arrays of stripped cells; a blank line is a record
    of one empty cell, the end of the last line is none."""
    text = tx._c(col)
    records = F.regexp_extract_all(text, F.lit(_RECORD), F.lit(1))

    def cell(field: Column) -> Column:
        inner = F.regexp_replace(F.regexp_extract(field, rf"^({_QUOTED})", 1), r'^"|"$', "")
        rest = F.regexp_replace(field, rf"^{_QUOTED}", "")
        return tx.strip(F.when(field.startswith('"'), F.concat(F.replace(inner, F.lit('""'), F.lit('"')), rest)).otherwise(field))

    def cells(record: Column) -> Column:
        return F.transform(F.regexp_extract_all(record, F.lit(rf"(?:^|,)({_FIELD})"), F.lit(1)), cell)

    # At the end of the text the pattern also matches the empty string.
    return F.transform(tx.bind(records, lambda r: F.slice(r, F.lit(1), F.size(r) - 1)), cells)


def csv_markdown(col, max_rows: int | None = None) -> Column:
    """A CSV file as a Markdown table: the first record is its head, the others are
    filled up to the widest. ``max_rows`` cuts after so many records, head included."""

    def table(rows: Column) -> Column:
        width = F.array_max(F.transform(rows, lambda r: F.size(r)))
        line = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))

        def drawn(width: Column) -> Column:
            body = F.slice(rows, F.lit(2), F.size(rows))
            full = F.transform(body, lambda r: line(F.concat(r, F.array_repeat(F.lit(""), width - F.size(r)))))
            rule = line(F.array_repeat(F.lit("---"), width))
            return F.array_join(F.concat(F.array(line(rows[0]), rule), full), "\n")

        return F.when(F.size(rows) == 0, F.lit("")).otherwise(tx.bind(width, drawn))

    rows = csv_rows(col)
    return tx.bind(rows if max_rows is None else F.slice(rows, 1, max_rows), table)


# --- manifests and links -------------------------------------------------------
def manifest(files: DataFrame, name: str = "path", content: str = "content") -> DataFrame:
    """One pending document per file."""
    filename = F.substring_index(name, "/", -1)
    return files.select(
        filename.alias("filename"),
        tx.infer_file_type(filename).alias("file_type"),
        F.octet_length(content).cast("long").alias("file_size"),
        F.sha2(content, 256).alias("content_hash"),
        F.lit("pending").alias("status"),
    )


def allowed(name) -> Column:
    return tx.file_extension(name).isin(ALLOWED_EXTENSIONS)


def pending(documents: DataFrame, batch: int | None = None) -> DataFrame:
    """Documents to (re)process next: all, or the first ``batch`` by id."""
    waiting = documents.filter("status = 'pending'")
    return waiting if batch is None else waiting.orderBy("doc_id").limit(batch)


def url_admission(url) -> Column:
    """STRUCT<admitted, reason>: http(s) only, no private literal address."""
    url = tx._c(url)
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))
    host = F.lower(F.regexp_extract(url, r"^[^:/?#]+://(?:[^@/?#]*@)?(\[[^\]]*\]|[^:/?#]*)", 1))
    v4 = host.rlike(r"^(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)$")
    parts = F.transform(F.split(host, r"\."), lambda p: p.try_cast("int"))

    def local(o: Column) -> Column:
        a, b, c = o[0], o[1], o[2]
        # Blocks reserved for private, loopback or link-local use.
        return (
            a.isin(0, 10, 127)
            | ((a == 172) & b.between(16, 31))
            | ((a == 192) & (b == 168))
            | ((a == 169) & (b == 254))
            | ((a == 192) & (b == 0) & c.isin(0, 2))
            | ((a == 198) & b.isin(18, 19))
            | ((a == 198) & (b == 51) & (c == 100))
            | ((a == 203) & (b == 0) & (c == 113))
            | (a >= 240)
        )

    v6_local = host.rlike(r"^\[(?:::1?|f[cd][0-9a-f]{2}:.*|fe[89ab][0-9a-f]:.*)\]$")
    private = (v4 & tx.bind(parts, local)) | v6_local
    reason = F.when(~scheme.isin("http", "https"), "bad_scheme").when(private, "private_address").otherwise("")
    return F.struct((reason == "").alias("admitted"), reason.alias("reason"))


# --- parser registry --------------------------------------------------------------------
_PARSERS: dict[str, Callable[[Column], Column]] = {}


def register_parser(*extensions: str):
    """Decorator: a function of the binary content column for these extensions."""

    def add(fn: Callable[[Column], Column]):
        for ext in extensions:
            _PARSERS[ext.lower().lstrip(".")] = fn
        return fn

    return add


register_parser(*lx.TEXT_EXTENSIONS)(decode_text)
register_parser("csv")(lambda content: csv_markdown(decode_text(content)))


def parse_files(files: DataFrame, name: str = "path", content: str = "content") -> DataFrame:
    """Text of every file with a registered parser; NULL text for the others.
    Each parser sees NULL for the files of the others, so nothing is parsed twice."""
    ext = tx.file_extension(name)
    by_parser: dict[Callable, list[str]] = {}
    for key, fn in _PARSERS.items():
        by_parser.setdefault(fn, []).append(key)
    texts = [fn(F.when(ext.isin(keys), F.col(content))) for fn, keys in by_parser.items()]
    return files.select(F.col(name).alias("path"), ext.alias("file_type"), F.coalesce(*texts).alias("text"))
