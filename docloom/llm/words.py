"""Words, lines and their rolling hashes for many texts at once, in numpy.

Everything works on the byte buffer of an Arrow string column. White space is the
byte 0x20 or 0x09 to 0x0D, so words are whole UTF-8 strings. Hashes are polynomials
modulo 2**64 read off prefix sums, then mixed; equal words give equal hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20
_BASE = 0x9E3779B97F4A7C15
_STEP = 0xD6E8FEB86659FD93
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit numbers whose output bits all depend on all input bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def text_slices(column: pa.Array, max_bytes: int = SLICE_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """Parts of a string column of about ``max_bytes``, with the row each begins at; a
    longer text stands alone. Nulls become empty texts."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    sizes = pc.binary_length(column).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for row, size in enumerate(sizes):
        if row > start and total + size > max_bytes:
            yield start, column.slice(start, row - start)
            start, total = row, 0
        total += size
    if len(column) > start:
        yield start, column.slice(start)


@cache
def _powers(step: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.full(n, step, dtype=np.uint64)
    down = np.full(n, pow(step, -1, 1 << 64), dtype=np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def powers(step: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """``step**i`` and ``step**-i`` modulo 2**64, for i below n."""
    up, down = _powers(step, max(1 << 16, 1 << (n - 1).bit_length()) if n else 1)
    return up[:n], down[:n]


def range_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, step: int, limit: int) -> np.ndarray:
    """Hash of ``values[starts:ends]`` for ascending ranges that need not be disjoint,
    reading about ``limit`` values at a time."""
    out = np.empty(len(starts), dtype=np.uint64)
    done = 0
    while done < len(starts):
        base = int(starts[done])
        upto = int(np.searchsorted(starts, base + limit, side="left"))
        upto = max(upto, done + 1)
        a, b = starts[done:upto] - base, ends[done:upto] - base
        n = int(b.max()) if len(b) else 0
        up, down = powers(step, n + 1)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((values[base : base + n].astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
        out[done:upto] = mix((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64))
        done = upto
    return out


class Texts:
    """A slice of texts as one buffer: ``at`` has the texts' byte bounds, ``starts`` and
    ``ends`` those of the words, ``first`` each text's first word (and the end)."""

    def __init__(self, texts: pa.Array):
        n = len(texts)
        _, offsets, data = texts.buffers()
        at = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + n + 1]
        whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
        self.n, self.at = n, at - at[0]
        self.buf = whole[at[0] : at[-1]]
        inside = ~_SPACE[self.buf]
        before = np.empty(len(inside), dtype=bool)
        after = np.empty(len(inside), dtype=bool)
        if len(inside):
            before[1:], after[:-1] = inside[:-1], inside[1:]
            cuts = self.at[:-1][self.at[:-1] < len(inside)]
            before[cuts] = False
            after[cuts - 1] = False
            after[-1] = False
        self.starts = np.flatnonzero(inside & ~before)
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.starts, self.at)
        self.counts = np.diff(self.first)

    def word_hashes(self) -> np.ndarray:
        return range_hashes(self.buf, self.starts, self.ends, _BASE, SLICE_BYTES)

    def word_text(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(self.n), self.counts)

    def windows(self, size: int) -> np.ndarray:
        """First words of all windows of ``size`` words that stay in one text."""
        room = np.maximum(self.counts - size + 1, 0)
        skipped = np.cumsum(self.counts - room) - (self.counts - room)
        return np.arange(int(room.sum())) + np.repeat(skipped, room)

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Byte bounds of all ``\\n``-split lines and each line's text."""
        breaks = np.flatnonzero(self.buf == 10)
        owner = np.searchsorted(self.at, breaks, side="right") - 1
        starts = np.concatenate([self.at[:-1], breaks + 1])
        ends = np.concatenate([breaks, self.at[1:]])
        texts = np.concatenate([np.arange(self.n), owner])
        ends_of = np.concatenate([owner, np.arange(self.n)])
        by_start, by_end = np.lexsort((starts, texts)), np.lexsort((ends, ends_of))
        return starts[by_start], ends[by_end], texts[by_start]


def window_hashes(words: np.ndarray, at: np.ndarray, size: int, step: int = _STEP) -> np.ndarray:
    """Hashes of the windows of ``size`` word hashes that begin at ``at`` (ascending)."""
    return range_hashes(words, at, at + size, step, 1 << 18)


def covered(at: np.ndarray, size: int, n: int) -> np.ndarray:
    """Which of n words lie in some window of ``size`` words that begins at ``at``."""
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + size, -1)
    return np.cumsum(edge)[:-1] > 0


def pieces(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """``buf[start:end]`` for each pair, as one string column."""
    sizes = ends - starts
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    at = np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], sizes)
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(buf[at])))
