"""Phrase collocations by streams of counts, each merged with the next in order.

Counts grow by one word a pass. A phrase that is frequent has frequent parts, so a pass
counts only the windows whose two parts of one word less may be frequent; what may be is
told by a bit table of fixed size, in which a frequent phrase is never missing. The
counts of each pass are exact, and nothing frequent is left out however full the table is.

The frequent phrases are then streams of counts: one in the order of their first parts,
one in the order of what follows them. Left, right and extension counts come from merging
a stream of parts with the stream of phrases, both sorted (sort-merge joins).
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.llm.words import Texts, mix, pieces, text_slices, window_hashes
from docloom.session import materialize

#: Bits of the table of phrases that may be frequent (4 MB), and bytes of text counted at once.
FILTER_BITS, SLICE_BYTES = 1 << 25, 2 << 20
MIN_COUNT, MAX_WORDS, TOP = 100, 5, 2000
UNKNOWN = "und"
#: Exact: the products have up to 38 digits.
SCORE = (
    "CAST(CAST(1000 AS DECIMAL(4,0)) * CAST(a AS DECIMAL(19,0)) * CAST(n AS DECIMAL(19,0)) AS DECIMAL(38,0))"
    " div CAST(CAST(l AS DECIMAL(19,0)) * CAST(r AS DECIMAL(19,0)) AS DECIMAL(38,0))"
)

# A-Z become a-z, the ends of pieces become line feeds.
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[ord(c) for c in ".,;:!?\n\v\f\r"]] = 10


class Words:
    """The words of a slice of texts in one buffer with one space after each, ``piece`` and
    a number of the language of each."""

    def __init__(self, texts: pa.Array, langs: pa.Array):
        _, offsets, data = texts.buffers()
        at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.empty(0, np.uint8)
        folded = _FOLD[raw]
        bounds = pa.py_buffer(np.ascontiguousarray(at - at[0]))
        t = Texts(pa.LargeStringArray.from_buffers(len(texts), bounds, pa.py_buffer(folded)))
        sizes = t.ends - t.starts
        self.hashes = t.word_hashes()
        owner = t.word_text()
        # Both parts only grow, so their sum tells pieces and texts apart.
        self.piece = np.cumsum(folded == 10)[t.starts] + owner if len(owner) else owner
        self.starts = np.cumsum(sizes + 1) - sizes - 1
        self.ends = self.starts + sizes
        inside = folded[~np.isin(folded, (9, 10, 32))]
        self.buf = np.full(len(inside) + len(sizes), 32, dtype=np.uint8)
        self.buf[np.arange(len(inside)) + np.repeat(np.arange(len(sizes)), sizes)] = inside
        coded = langs.dictionary_encode()
        self.langs = coded.dictionary
        names = [hashlib.blake2b(x.encode(), digest_size=8).digest() for x in self.langs.to_pylist()]
        self.lang = coded.indices.to_numpy(zero_copy_only=False)[owner] if len(owner) else np.empty(0, np.int32)
        self.salt = np.array([int.from_bytes(x, "little") for x in names], dtype=np.uint64)

    def keys(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """First words and keys of all windows of ``size`` words inside pieces."""
        n = len(self.hashes) - size + 1
        if n <= 0:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        at = np.flatnonzero(self.piece[:n] == self.piece[size - 1 :])
        return at, mix(window_hashes(self.hashes, at, size) ^ self.salt[self.lang[at]])


def _bit(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys >> np.uint64(20)) % np.uint64(bits)


def _may_be_frequent(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    bit = _bit(keys, len(table) * 64)
    return table[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63)) & np.uint64(1) == 1


def count_windows(words: Words, size: int, table: np.ndarray | None) -> tuple[pa.Array, pa.Array, np.ndarray]:
    """Language, phrase and number of the windows of ``size`` words whose parts may be
    frequent. With single words an empty phrase has the number of all words."""
    if size == 1:
        at, keys = words.keys(1)
    else:
        shorter, parts = words.keys(size - 1)
        frequent = np.zeros(len(words.hashes) + 1, dtype=bool)
        frequent[shorter[_may_be_frequent(table, parts)]] = True
        at, keys = words.keys(size)
        both = frequent[at] & frequent[at + 1]
        at, keys = at[both], keys[both]
    _, first, n = np.unique(keys, return_index=True, return_counts=True)
    where = at[first]
    phrases = pieces(words.buf, words.starts[where], words.ends[where + size - 1])
    lang = words.lang[where]
    if size == 1:
        totals = np.bincount(words.lang, minlength=len(words.langs))
        lang = np.concatenate([lang, np.arange(len(totals))])
        phrases, n = pa.concat_arrays([phrases, pa.array([""] * len(totals), pa.large_string())]), np.concatenate([n, totals])
    return words.langs.take(pa.array(lang, pa.int32())), phrases, n


def _counter(size: int, table: np.ndarray | None) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in text_slices(batch.column(1), SLICE_BYTES):
                langs = batch.column(0).slice(start, len(texts))
                lang, phrase, n = count_windows(Words(texts, langs), size, table)
                if len(n):
                    yield pa.RecordBatch.from_arrays([lang, phrase.cast(pa.string()), pa.array(n, pa.int64())], names=["lang", "phrase", "n"])

    return run


def _cells(size: int, bits: int) -> Callable:
    """The cells of the bit table that hold phrases of ``size`` words."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = Words(batch.column(1).cast(pa.large_string()), batch.column(0))
            at, keys = words.keys(size)
            bit = _bit(keys, bits)
            masks = (np.uint64(1) << (bit & np.uint64(63))).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array((bit >> np.uint64(6)).astype(np.int64)), pa.array(masks)], names=["cell", "mask"])

    return run


def _bit_table(phrases: DataFrame, size: int, bits: int) -> np.ndarray:
    """At most so many bits, however many phrases there are."""
    cells = phrases.select("lang", "phrase").mapInArrow(_cells(size, bits), "cell long, mask long")
    found = cells.groupBy("cell").agg(F.bit_or("mask").alias("mask")).toArrow()
    table = np.zeros(bits >> 6, dtype=np.uint64)
    table[found["cell"].to_numpy()] = found["mask"].to_numpy().view(np.uint64)
    return table


def phrase_counts(docs: DataFrame, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, text: str = "text",
                  lang: str = "lang", filter_bits: int = FILTER_BITS) -> tuple[DataFrame, DataFrame]:
    """``lang, phrase, k, f``: all phrases of 1 to ``max_words`` words that occur at least
    ``min_count`` times in a language, and ``lang, n``: the words of each language."""
    rows = docs.select(
        F.coalesce(docs[lang].cast("string"), F.lit(UNKNOWN)).alias("lang"),
        F.coalesce(docs[text].cast("string"), F.lit("")).alias("text"),
    )
    levels, totals, table = [], None, None
    for size in range(1, max_words + 1):
        counted = rows.mapInArrow(_counter(size, table), "lang string, phrase string, n long")
        counted = counted.groupBy("lang", "phrase").agg(F.sum("n").alias("f"))
        stored = materialize(counted.filter((F.col("f") >= min_count) | (F.col("phrase") == "")), f"phrases{size}")
        if size == 1:
            totals = stored.filter("phrase = ''").select("lang", F.col("f").alias("n"))
            stored = stored.filter("phrase <> ''")
        levels.append(stored.withColumn("k", F.lit(size)))
        if size == max_words or stored.isEmpty():
            break
        table = _bit_table(stored, size, filter_bits)
    return reduce(DataFrame.unionByName, levels), totals


def _merged(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Both sides in the order of language and part, read in step."""
    return left.join(right.hint("merge"), ["lang", "part"], how)


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, top: int = TOP,
                 text: str = "text", lang: str = "lang", filter_bits: int = FILTER_BITS) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the ``top`` best phrases of each language.

    A phrase of 2 to ``max_words`` words that occurs ``a >= min_count`` times is cut after
    each of its words: ``l`` and ``r`` are the counts of the two sides, ``score`` is
    ``floor(1000 * a * n / (l * r))`` of the cut where that is least (of equal ones the
    first). A phrase inside a longer one of the same count is left out: any such longer
    phrase holds one of one word more with the same count, so these are looked at. Order:
    score and ``a`` falling, then the phrase by bytes. Null texts are empty, null languages
    ``und``; repeated rows count each time; no frequent phrase gives no rows; other
    columns are not read. ``filter_bits`` (a multiple of 64) only decides how much is counted in vain.
    """
    counts, totals = phrase_counts(docs, min_count, max_words, text, lang, filter_bits)
    words = F.split("phrase", " ")
    parts = counts.select("lang", F.col("phrase").alias("part"), F.col("f").alias("count"))
    longer = counts.filter("k >= 2").withColumn("w", words)

    def joined(begin, size):
        return F.array_join(F.slice("w", begin, size), " ")

    cuts = longer.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
    cuts = cuts.select("lang", "phrase", "k", F.col("f").alias("a"), "cut", "w", joined(F.lit(1), F.col("cut")).alias("part"))
    lefts = _merged(cuts, parts).withColumnRenamed("count", "l")
    rights = _merged(lefts.withColumn("part", joined(F.col("cut") + 1, F.col("k") - F.col("cut"))), parts).withColumnRenamed("count", "r")
    # One row a language.
    scored = rights.join(F.broadcast(totals), "lang").withColumn("score", F.expr(SCORE))
    best = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "cut", "l", "r")).alias("b"))

    bigger = longer.filter("k >= 3").withColumn("part", F.explode(F.array(joined(F.lit(1), F.col("k") - 1), joined(F.lit(2), F.col("k") - 1))))
    extended = bigger.groupBy("lang", "part").agg(F.max("f").alias("longest"))
    alone = _merged(best.withColumn("part", F.col("phrase")), extended, "left").filter("longest IS NULL OR longest < a")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    flat = alone.select("lang", "phrase", "a", F.col("b.l").alias("l"), F.col("b.r").alias("r"), "n", F.col("b.score").alias("score"))
    ranked = flat.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
