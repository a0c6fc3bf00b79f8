"""Quality rules on repetition: how much of a text lies in repeated n-grams and lines."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from docloom.llm.words import _BASE, SLICE_BYTES, Texts, covered, mix, range_hashes, text_slices, window_hashes

#: Largest share of a text's word characters inside n-grams that occur before in it, by n.
DUPLICATE_NGRAMS = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
#: Largest share of characters, and of lines, in lines that equal an earlier one.
DUPLICATE_LINE_CHARS, DUPLICATE_LINES = 0.20, 0.30
SYMBOLS = b"#*$%&|<>"
MIN_WORDS, MAX_REPEATED_WORDS = 50, 0.5

_IS_SYMBOL = np.zeros(256, dtype=bool)
_IS_SYMBOL[list(SYMBOLS)] = True


def _repeats(hashes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ascending positions: whether the same hash occurs elsewhere in its text, and
    whether it occurred before."""
    keys = hashes ^ mix(owner.astype(np.uint64) + np.uint64(1))
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    later = np.zeros(len(keys), dtype=bool)
    some = np.zeros(len(keys), dtype=bool)
    later[order[1:][same]] = True
    some[order[1:][same]] = some[order[:-1][same]] = True
    return some, later


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of the values between consecutive bounds."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[first[1:]] - total[first[:-1]]


def measure(texts: pa.Array, sizes: Iterable[int]) -> dict[str, np.ndarray]:
    """Counts of each text of a slice; ``dup_chars_n`` are word characters inside n-grams
    that occur before in the text."""
    t = Texts(texts)
    is_char = (t.buf & 0xC0) != 0x80
    chars = np.concatenate([[0], np.cumsum(is_char, dtype=np.int64)])
    word_chars = chars[t.ends] - chars[t.starts]
    words, owner = t.word_hashes(), t.word_text()
    out = {
        "n_words": t.counts,
        "word_chars": _sums(word_chars, t.first),
        "n_symbols": _sums(_IS_SYMBOL[t.buf], t.at),
    }
    starts, ends, line_text = t.lines()
    has_word = np.searchsorted(t.starts, ends) > np.searchsorted(t.starts, starts)
    starts, ends, line_text = starts[has_word], ends[has_word], line_text[has_word]
    _, later = _repeats(range_hashes(t.buf, starts, ends, _BASE, SLICE_BYTES), line_text)
    line_chars = chars[ends] - chars[starts]
    bounds = np.searchsorted(line_text, np.arange(t.n + 1))
    out["n_lines"] = np.diff(bounds)
    out["n_dup_lines"] = _sums(later, bounds)
    out["line_chars"] = _sums(line_chars, bounds)
    out["dup_line_chars"] = _sums(np.where(later, line_chars, 0), bounds)
    for size in sorted({3, *sizes}):
        at = t.windows(size)
        some, later = _repeats(window_hashes(words, at, size), owner[at])
        if size == 3:
            out["n_repeat_words"] = _sums(covered(at[some], size, len(words)), t.first)
        if size in sizes:
            inside = covered(at[later], size, len(words))
            out[f"dup_chars_{size}"] = _sums(np.where(inside, word_chars, 0), t.first)
    return out


def verdicts(m: dict[str, np.ndarray], ngrams: Mapping[int, float] = DUPLICATE_NGRAMS,
             line_chars: float = DUPLICATE_LINE_CHARS, lines: float = DUPLICATE_LINES) -> tuple[np.ndarray, np.ndarray]:
    """Whether the base rules fail, and whether the text stays."""
    failed = (m["n_words"] < MIN_WORDS) | (m["n_repeat_words"] > MAX_REPEATED_WORDS * m["n_words"])
    repetitive = (m["dup_line_chars"] > line_chars * m["line_chars"]) | (m["n_dup_lines"] > lines * m["n_lines"])
    for size, most in ngrams.items():
        repetitive |= m[f"dup_chars_{size}"] > most * m["word_chars"]
    return failed, ~failed & ~repetitive


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def quality(docs: DataFrame, ngrams: Mapping[int, float] = DUPLICATE_NGRAMS, text: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Every document's ``carry`` columns, counts, ``dup_line_share`` and ``dup_share_n``
    (shares of characters), ``base_failed`` and ``kept``.

    A text is kept if it passes the base rules (at least 50 words, at most half of them
    in repeated 3-word windows) and no share of duplicated characters is over its limit.
    A null or empty text has no words and fails; shares of nothing are 0. Each row is
    judged by its text alone, so repeated rows get equal verdicts, columns that are not
    carried are not read, and nothing is shuffled. Columns of the result replace carried
    ones of the same name.
    """
    limits = dict(ngrams)
    shares = [f"dup_share_{n}" for n in limits]
    made = [*COUNTS, "dup_line_share", *shares, "base_failed", "kept"]
    carry = tuple(c for c in carry if c not in made)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in text_slices(batch.column(len(carry))):
                m = measure(texts, limits)
                failed, kept = verdicts(m, limits)
                share = lambda part, whole: m[part] / np.maximum(m[whole], 1)
                columns = [batch.column(i).slice(start, len(texts)) for i in range(len(carry))]
                columns += [pa.array(m[c].astype(np.int64)) for c in COUNTS]
                columns += [pa.array(share("dup_line_chars", "line_chars"))]
                columns += [pa.array(share(f"dup_chars_{n}", "word_chars")) for n in limits]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(failed), pa.array(kept)], names=[*carry, *made])

    schema = ", ".join(
        [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry]
        + [f"{c} long" for c in COUNTS]
        + [f"{c} double" for c in ("dup_line_share", *shares)]
        + ["base_failed boolean", "kept boolean"]
    )
    return docs.select(*[docs[c] for c in carry], docs[text].cast("string").alias("__text")).mapInArrow(run, schema)
