"""Text functions: Column in, Column out.

Everything here stays inside the JVM except Unicode composition, which Spark
has no built-in for and which is only sent to Python for the rows that can
change.
"""

from __future__ import annotations

import string
import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom import lexicon as lx

# Character classes (Java regex syntax).
KEEP_RANGES = (
    r"\x09\x0a\x0d\x20-\x7e\x{a0}-\x{24f}\x{2190}-\x{22ff}\x{2500}-\x{26ff}\x{2e80}-\x{33ff}"
    r"\x{4e00}-\x{9fff}\x{f900}-\x{faff}\x{fe10}-\x{fe4f}\x{ff00}-\x{ffef}"
)
CJK = r"[\x{4e00}-\x{9fff}\x{3400}-\x{4dbf}]"
INDEX_TOKEN = r"[\x{4e00}-\x{9fa5}]+|[a-zA-Z0-9]+"
KEYWORD = r"[\x{4e00}-\x{9fff}]{2,}|[a-zA-Z0-9]{2,}"
SENTENCE_STOP = "。！？!?\n"
SENTENCE_STOP_DOT = "。！？.!?\n"
PUNCTUATION = r"""[。！？，、；："'（）【】《》「」『』〔〕…—·,.;:!?()\[\]{}<>\-–]"""
# Listed, they are one look-up for a character; ranges are tested one after the other.
_LETTERS = string.ascii_letters
ZERO_WIDTH = r"[\x{200b}-\x{200f}\x{2028}-\x{202f}\x{205f}\x{2060}\x{feff}]"
ROLE_MARKER = r"(?i)(system|assistant|<\|im_start\|>|<\|im_end\|>)\s*[:\x{ff1a}]"
MAX_INPUT_CHARS = 4000
TOKEN_BUDGETS = {"C0": 1500, "C1": 3000, "C2": 5000}
DOC_ID_PATTERN = r"^[a-zA-Z0-9_\-]+$"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def bind(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body``. An expression written
    inside a lambda is evaluated per element; a lambda variable is not."""
    return F.transform(F.array(value), body)[0]


def strip(col) -> Column:
    return F.btrim(_c(col), F.lit(lx.WHITESPACE))


@F.pandas_udf(T.StringType())
def _compose(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def nfc(col) -> Column:
    """Unicode composition. Code points below U+0300 never change, so texts made
    of those alone are handed to Python as NULL and keep their JVM value."""
    col = _c(col)
    return F.coalesce(_compose(F.when(col.rlike(r"[^\x{0}-\x{2ff}]"), col)), col)


def clean_text(col, extra_keep: str = "", compose: bool = True) -> Column:
    text = F.coalesce(_c(col), F.lit(""))
    if compose:
        text = nfc(text)
    for end in ("\r\n", "\r"):
        text = F.replace(text, F.lit(end), F.lit("\n"))
    text = bind(text, lambda t: F.when(t.contains("\n\n\n"), F.regexp_replace(t, r"\n{3,}", "\n\n")).otherwise(t))
    text = bind(
        text, lambda t: F.when(t.contains("   ") | t.contains("\t"), F.regexp_replace(t, r"[ \t]{3,}", " ")).otherwise(t)
    )
    # The commonest of the kept characters are tested first.
    text = F.regexp_replace(
        text, rf"[[^{_LETTERS} ]&&[^\x{{20}}-\x{{7e}}]&&[^\x{{a0}}-\x{{24f}}]&&[^{KEEP_RANGES}{extra_keep}]]", ""
    )
    return strip(text)


def surely_kept(col) -> Column:
    """Whether a look at the text tells that ``clean_text`` leaves something: a visible ASCII
    character that no mark follows stays as it is. Otherwise only cleaning can tell."""
    return F.coalesce(_c(col), F.lit("")).rlike(r"[\x21-\x7e](?:[\x{0}-\x{2ff}]|\z)")


def beside_words(col) -> Column:
    """The text without ASCII letters and spaces: the little that classes of many parts, which
    are tested part by part for each character, have to look at."""
    return F.regexp_replace(_c(col), f"[{_LETTERS} ]+", "")


# Whitespace beyond ASCII; texts without any take the cheaper ASCII classes.
_WIDE_SPACE = r"[[^\x{20}-\x{7e}]&&[^\x{a1}-\x{24f}]&&[\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]]"


def ascii_spaces(col) -> Column:
    """The text with every wide space turned into a plain one."""
    col = _c(col)
    return F.when(col.rlike(_WIDE_SPACE), F.regexp_replace(col, _WIDE_SPACE, " ")).otherwise(col)


def word_count(col) -> Column:
    return F.regexp_count(ascii_spaces(col), F.lit(r"\S+"))


def _shares(n: Column) -> list[Column]:
    zh, en = n["zh"] / n["total"], n["en"] / n["total"]
    return [
        F.when(n["size"] == 0, "en").when(zh > 0.7, "zh").when(en > 0.7, "en").otherwise("mixed").alias("primary_language"),
        zh.alias("zh_ratio"),
        en.alias("en_ratio"),
    ]


def _letter_counts(text: Column, rest: Column) -> list[Column]:
    """``rest`` is the text without ASCII letters."""
    return [
        F.length(text).alias("size"),
        F.greatest(F.length(strip(text)), F.lit(1)).alias("total"),
        F.regexp_count(rest, F.lit(CJK)).alias("zh"),
        (F.length(text) - F.length(rest)).alias("en"),
    ]


def _besides_letters(text: Column) -> Column:
    return F.regexp_replace(text, f"[{_LETTERS}]+", "")


def language_shares(col) -> Column:
    """STRUCT<primary_language, zh_ratio, en_ratio>: the profile without its words."""

    def counts(text: Column) -> Column:
        return bind(_besides_letters(text), lambda rest: F.struct(*_letter_counts(text, rest)))

    return bind(bind(F.coalesce(_c(col), F.lit("")), counts), lambda n: F.struct(*_shares(n)))


def language_profile(col) -> Column:
    """STRUCT<primary_language, zh_ratio, en_ratio, avg_word_length>."""

    def counts(text: Column) -> Column:
        spaced = ascii_spaces(text)
        words = [
            F.regexp_count(spaced, F.lit(r"\S+")).alias("words"),
            F.length(F.regexp_replace(spaced, r"\s+", "")).alias("letters"),
        ]
        return bind(_besides_letters(text), lambda rest: F.struct(*_letter_counts(text, rest), *words))

    def profile(n: Column) -> Column:
        return F.struct(
            *_shares(n),
            F.when(n["size"] == 0, F.lit(5.0)).when(n["words"] > 0, n["letters"] / n["words"]).otherwise(F.lit(1.0)).alias("avg_word_length"),
        )

    return bind(bind(F.coalesce(_c(col), F.lit("")), counts), profile)


def dynamic_chunk_size(profile: Column, target_tokens: int = 400) -> Column:
    en_size = int(target_tokens * 0.75)
    zh, en = profile["zh_ratio"], profile["en_ratio"]
    total = F.greatest(zh + en, F.lit(0.01))
    weighted = F.floor((zh / total) * target_tokens + (en / total) * en_size)
    return (
        F.when(profile["primary_language"] == "zh", F.lit(target_tokens))
        .when(profile["primary_language"] == "en", F.lit(en_size))
        .otherwise(F.greatest(weighted, F.lit(64)))
        .cast("int")
    )


def doc_language(col) -> Column:
    text = _c(col)
    share = F.regexp_count(text, F.lit(CJK)) / F.length(text)
    return F.when(F.length(text) == 0, "unknown").when(share > 0.15, "zh").otherwise("en")


def tokenize(col) -> Column:
    """Index tokens: case-sensitive CJK runs or ASCII alphanumeric runs."""
    return F.regexp_extract_all(_c(col), F.lit(INDEX_TOKEN), F.lit(0))


def keywords(col) -> Column:
    """Distinct CJK or alphanumeric runs of at least two characters."""
    return F.array_distinct(F.regexp_extract_all(_c(col), F.lit(KEYWORD), F.lit(0)))


def split_sentences(col) -> Column:
    parts = F.split(_c(col), f"(?<=[{SENTENCE_STOP}])")
    return F.filter(F.transform(parts, strip), lambda s: s != "")


def split_sentences_dot(col) -> Column:
    """As above, but an ASCII full stop also ends a sentence and the whitespace
    after a stop is swallowed; the last piece keeps its tail."""
    parts = F.split(_c(col), rf"(?<=[{SENTENCE_STOP_DOT}])(?U)\s*")
    return F.filter(parts, lambda s: strip(s) != "")


def content_hash16(col) -> Column:
    return F.substring(F.sha2(_c(col), 256), 1, 16)


def hash_characters(text: str) -> int:
    """32-bit XOR over mixed code points; equal character multisets collide."""
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    mixed = ((cp << np.uint64(5)) + (cp >> np.uint64(2)) + np.uint64(0x9E3779B9)) & np.uint64(0xFFFFFFFF)
    return int(np.bitwise_xor.reduce(mixed)) if len(mixed) else 0


#: Bytes of text whose code points are hashed at once.
HASH_BYTES = 1 << 20


def _hash_all(texts: pa.Array) -> pa.Array:
    """The character hashes of a string column, over its buffer block by block: a block
    may end inside a text, whose parts are combined."""
    texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.empty(0, np.uint8)
    at, out = at - at[0], np.zeros(len(texts), np.int64)
    for lo in range(0, len(raw), HASH_BYTES):
        # A code point belongs to the block that holds its first byte.
        hi = min(lo + HASH_BYTES, len(raw))
        padded = np.append(raw[lo : hi + 3], np.zeros(3, np.uint8))
        lead = np.flatnonzero(raw[lo:hi] & 0xC0 != 0x80)
        first = padded[lead]
        point = first.astype(np.uint32)
        # Few characters have several bytes; the sums below are taken modulo 2^32.
        wide = np.flatnonzero(first >= 0xC0)
        size = 2 + (first[wide] >= 0xE0) + (first[wide] >= 0xF0)
        point[wide] &= np.array([0, 0, 0x1F, 0x0F, 0x07], np.uint32)[size]
        for more in range(1, 4):
            has = wide[size > more]
            point[has] = point[has] << np.uint32(6) | padded[lead[has] + more] & np.uint32(0x3F)
        mixed = (point << np.uint32(5)) + (point >> np.uint32(2)) + np.uint32(0x9E3779B9)
        part = slice(np.searchsorted(at, lo, side="right") - 1, np.searchsorted(at, hi))
        bounds = np.searchsorted(lead, np.clip(at[part.start : part.stop + 1] - lo, 0, hi - lo))
        filled = np.flatnonzero(np.diff(bounds))
        if len(filled):
            out[part.start + filled] ^= np.bitwise_xor.reduceat(mixed, bounds[filled]).astype(np.int64)
    return pa.array(out, mask=texts.is_null().to_numpy(zero_copy_only=False))


@F.arrow_udf(T.LongType())
def _char_hash(texts: pa.Array) -> pa.Array:
    return _hash_all(texts)


@F.arrow_udf(T.ArrayType(T.LongType()))
def _char_hashes(arrays: pa.Array) -> pa.Array:
    sizes = pc.fill_null(pc.list_value_length(arrays), 0).to_numpy(zero_copy_only=False)
    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
    return pa.ListArray.from_arrays(offsets, _hash_all(arrays.flatten()), mask=arrays.is_null())


def char_hash(col) -> Column:
    """Character hash of a text, over the code points of whole Arrow batches."""
    return _char_hash(_c(col))


def char_hashes(col) -> Column:
    """Character hashes of an array of texts."""
    return _char_hashes(_c(col))


def bit_jaccard(a, b) -> Column:
    a, b = _c(a), _c(b)
    union = F.bit_count(a.bitwiseOR(b))
    return (
        F.when((a == b) | (union == 0), F.lit(1.0))
        .otherwise(F.bit_count(a.bitwiseAND(b)) / union)
        .cast("double")
    )


def safe_truncate(col, max_bytes: int) -> Column:
    """Longest prefix of at most ``max_bytes`` UTF-8 bytes that ends on a
    character: step back over continuation bytes, at most three."""
    text = F.coalesce(_c(col), F.lit(""))
    raw = F.encode(text, "UTF-8")

    def continues(pos: int) -> Column:
        return F.hex(F.substring(raw, pos, 1)).between("80", "BF")

    back = F.lit(0)
    for step in (2, 1, 0):
        back = F.when(continues(max_bytes + 1 - step), 1 + back).otherwise(F.lit(0))
    cut = F.decode(F.substring(raw, F.lit(1), F.lit(max_bytes) - back), "UTF-8")
    return F.when(F.octet_length(text) <= max_bytes, text).otherwise(cut)


def truncate(col, n: int) -> Column:
    return F.coalesce(F.substring(_c(col), 1, n), F.lit(""))


def estimate_tokens(col, chars_per_token: int = 3) -> Column:
    size = F.length(F.coalesce(_c(col), F.lit("")))
    tokens = F.floor(size / chars_per_token)
    return F.when(size == 0, F.lit(0)).otherwise(F.greatest(tokens, F.lit(1))).cast("int")


def _rfind(text: Column, needle: str) -> Column:
    """0-based start of the last occurrence, -1 if none."""
    hit = F.locate(needle[::-1], F.reverse(text))
    return F.when(hit == 0, F.lit(-1)).otherwise(F.length(text) - hit + 1 - len(needle))


def truncate_to_budget(col, budget) -> Column:
    """Cut to a token budget, then back to the last sentence end past half."""
    text = F.coalesce(_c(col), F.lit(""))
    budget = F.lit(budget) if isinstance(budget, int) else budget
    tokens = estimate_tokens(text)
    size = F.greatest(F.floor(F.length(text) * budget / tokens), F.lit(1)).cast("int")
    cut = F.substring(text, F.lit(1), size)
    last = F.greatest(_rfind(cut, ". "), _rfind(cut, "。"), _rfind(cut, "\n"))
    shorter = F.when(last > F.floor(size / 2), F.substring(cut, F.lit(1), last + 1)).otherwise(cut)
    return F.when(tokens <= budget, text).otherwise(shorter)


def token_budget(tier) -> Column:
    tier = F.upper(_c(tier))
    return F.coalesce(
        *[F.when(tier == name, F.lit(size)) for name, size in TOKEN_BUDGETS.items()],
        F.lit(TOKEN_BUDGETS["C1"]),
    )


def normalize_query(col) -> Column:
    return F.regexp_replace(F.lower(strip(col)), r"(?U)\s+", " ")


def query_fingerprint(query, doc_version, embedding_version) -> Column:
    raw = F.concat_ws(":", normalize_query(query), _c(doc_version), _c(embedding_version))
    return F.sha2(raw, 256)


def semantic_fingerprint(query, context) -> Column:
    raw = F.concat(F.substring(_c(query), 1, 100), F.lit("||"), F.substring(_c(context), 1, 200))
    return F.sha2(raw, 256)


def overlap_suffix(col, n: int) -> Column:
    """Tail of a text to repeat in the next chunk, cut at a sentence end."""
    text = F.rtrim(F.coalesce(_c(col), F.lit("")), F.lit(lx.WHITESPACE))
    if n <= 0:
        return F.lit("")
    stop = f"[{SENTENCE_STOP_DOT}]"
    other = f"[^{SENTENCE_STOP_DOT}]"
    tail = F.substring(text, -n, n)
    first_stop = F.regexp_instr(tail, F.lit(stop))
    to_first_stop = F.regexp_extract(tail, f"^{other}*{stop}", 0)
    # What follows the last stop but one, counted on a copy whose stops are all alike.
    alike = F.translate(text, SENTENCE_STOP_DOT, "\n" * len(SENTENCE_STOP_DOT))
    last_sentence = strip(F.right(text, F.length(F.substring_index(alike, "\n", -2))))
    return (
        F.when(F.length(text) <= n, text)
        .when(first_stop > 0, strip(to_first_stop))
        .when(last_sentence != "", last_sentence)
        .otherwise(strip(tail))
    )


def sanitize_input(col, compose: bool = True, max_chars: int = MAX_INPUT_CHARS) -> Column:
    """A query without hidden characters and role markers, cut to ``max_chars``."""
    text = nfc(col) if compose else _c(col)
    text = F.regexp_replace(text, ZERO_WIDTH, "")
    text = F.regexp_replace(text, ROLE_MARKER, "")
    text = F.regexp_replace(text, "-{5,}", "---")
    return strip(F.substring(text, 1, max_chars))


def sanitize_output(col) -> Column:
    """Cut an answer where it starts to loop: a character run over 20, ten empty
    bracket pairs in a row, or a line repeated more than six times."""
    text = _c(col)
    squeezed = F.regexp_replace(text, r"(?U)\s+", "")
    runs = F.regexp_extract_all(squeezed, F.lit(r"(.)\1{20,}"), F.lit(1))
    starts = F.filter(
        F.transform(runs, lambda ch: F.instr(text, F.repeat(ch, F.lit(5))) - 1), lambda at: at > 30
    )
    brackets = text.rlike(r"(【[^】]{0,3}】\s*){10,}")

    def cut_repeats(lines: Column) -> Column:
        # Equal lines stand together once sorted; a run's length is the line's count.
        placed = F.array_sort(F.transform(lines, lambda ln, i: F.struct(ln.alias("line"), i.alias("at"))))

        def counts(ordered: Column) -> Column:
            n = F.size(ordered)
            firsts = F.filter(
                F.sequence(F.lit(0), n - 1),
                lambda i: (i == 0) | (F.get(ordered, i)["line"] != F.get(ordered, F.greatest(i - 1, F.lit(0)))["line"]),
            )
            return bind(
                firsts,
                lambda f: F.transform(
                    f,
                    lambda at, k: F.struct(
                        (at - F.coalesce(F.get(f, k + 1), n)).alias("neg_count"), F.get(ordered, at)["at"].alias("first_idx"),
                        F.get(ordered, at)["line"].alias("line"),
                    ),
                ),
            )

        counted = bind(placed, counts)
        looping = F.filter(
            F.slice(F.array_sort(counted), 1, 5),
            lambda e: (e["neg_count"] < -6) & (F.length(strip(e["line"])) > 2) & (e["first_idx"] > 1),
        )
        kept = bind(
            looping,
            lambda found: F.when(
                F.size(found) > 0,
                F.concat(
                    F.array_join(F.slice(lines, F.lit(1), found[0]["first_idx"].cast("int")), "\n"),
                    F.lit(lx.REPEAT_CUT_NOTE),
                ),
            ),
        )
        return F.when(F.size(lines) > 6, kept)

    return (
        F.when(text.isNull() | (F.length(text) < 10), text)
        .when(
            F.size(starts) > 0,
            F.concat(F.substring(text, F.lit(1), starts[0].cast("int")), F.lit(lx.LOOP_CUT_NOTE)),
        )
        .when(brackets, F.concat(F.substring(text, 1, 100), F.lit(lx.LOOP_CUT_NOTE)))
        .otherwise(F.coalesce(bind(F.split(text, "\n"), cut_repeats), text))
    )


def post_enhance(answer, confidence) -> Column:
    answer, confidence = _c(answer), _c(confidence)
    return (
        F.when(confidence < 0.3, F.concat(F.lit(lx.LOW_CONFIDENCE_NOTE), answer))
        .when(confidence < 0.6, F.concat(answer, F.lit(lx.MEDIUM_CONFIDENCE_NOTE)))
        .otherwise(answer)
    )


def file_extension(name) -> Column:
    return F.lower(F.regexp_extract(_c(name), r"\.([^.]*)\z", 1))


# Extensions whose stored type differs from the extension.
_TYPE_ALIASES = {"htm": "html"}


def infer_file_type(name) -> Column:
    ext = file_extension(name)
    aliased = F.coalesce(*[F.when(ext == k, F.lit(v)) for k, v in _TYPE_ALIASES.items()], ext)
    return F.when(ext == "", "unknown").otherwise(aliased)


# Structure element -> stored chunk type; the rest is text.
CHUNK_TYPES = {
    "heading": "heading", "code": "code", "code_block": "code", "table": "table", "list": "list",
    "image": "image", "procedure": "procedure", "api_spec": "api_spec", "class": "code",
    "function": "code", "method": "code", "module": "code", "import_block": "code",
}


def lookup(col, table: dict, default) -> Column:
    """Small constant map as one literal expression."""
    entries = [F.lit(x) for pair in table.items() for x in pair]
    return F.coalesce(F.element_at(F.create_map(*entries), _c(col)), F.lit(default))


def map_chunk_type(col) -> Column:
    return lookup(col, CHUNK_TYPES, "text")


def section_path(section, heading) -> Column:
    section, heading = F.coalesce(_c(section), F.lit("")), F.coalesce(_c(heading), F.lit(""))
    return F.array_compact(
        F.array(
            F.when((section != "") & (section != heading), section), F.when(heading != "", heading)
        )
    )


def join_path(path) -> Column:
    return F.array_join(_c(path), " > ")


def valid_doc_id(col) -> Column:
    return F.coalesce(_c(col).rlike(DOC_ID_PATTERN), F.lit(False))


def minute_bucket(ts) -> Column:
    return F.date_trunc("minute", _c(ts))


def code_language(code, path) -> Column:
    code = _c(code)
    ext = file_extension(path)
    by_content = (
        F.when(code.contains("def ") & code.contains("import "), "python")
        .when(code.contains("func ") & code.contains("package "), "go")
        .when(code.contains("fn ") & code.contains("let "), "rust")
        .otherwise("unknown")
    )
    by_extension = F.element_at(
        F.create_map(*[F.lit(x) for kv in lx.SOURCE_LANGUAGES.items() for x in kv]), ext
    )
    return F.coalesce(by_extension, by_content)


def tier_truncated_context(context, tier) -> Column:
    return truncate_to_budget(context, token_budget(tier))
