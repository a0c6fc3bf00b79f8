"""Periodic runs of words by maximal pairs.

A run with smallest period q and length L is a pair of equal stretches of L - q >= q words,
q words apart, whose left and right neighbours differ: a maximal pair whose distance is at
most its length. So the suffixes of each text are sorted (prefix doubling, in numpy, for
many texts at once), equal prefixes become the tree of LCP intervals, and going up the tree
the positions of an interval's children are joined, shorter list into longer, each position
with the class of the word on its left. At each join neighbours of different classes and
children are maximal pairs of the interval's depth. Neighbours are enough: were there an
occurrence between the two, the stretch would have a smaller period. A pair that is a
multiple of the smallest period has the same bounds as the smallest one, which stays.

Intervals less deep than half of the least length, and those whose positions all follow
the same word or lie too far apart, cannot hold a run and are not entered.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.words import Texts, mix, powers, text_slices, window_hashes

MIN_LENGTH = 12
_STEP = 0xA0761D6478BD642F


def planted(counts: np.ndarray, h: np.ndarray) -> np.ndarray:
    """For the words of all texts the word that stands in their place: texts whose hash
    ends in 0 repeat a part of themselves from some word on."""
    first = np.cumsum(counts) - counts
    at = np.arange(int(counts.sum()))
    out = at.copy()
    g = h // 10
    for d in np.flatnonzero((h % 10 == 0) & (counts > 0)):
        n, gd = int(counts[d]), int(g[d])
        a = gd % n
        p = 1 + (n - a) // (3 + gd % 8)
        lo, hi = int(first[d]) + a, int(first[d]) + n
        out[lo:hi] = lo + (at[lo:hi] - lo) % p
    return out


def suffix_order(symbols: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Positions in the order of their suffixes, each of which stops at ``end`` of its text.
    Symbols of different texts must differ. Only groups not yet told apart are sorted again."""
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    ordered = symbols[order]
    head = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.repeat(head, np.diff(np.append(head, n)))
    sizes = np.diff(np.append(head, n))
    slots = np.flatnonzero(np.repeat(sizes > 1, sizes))
    width = 1
    while len(slots):
        at = order[slots]
        beyond = at + width
        second = np.where(beyond < end[at], rank[np.minimum(beyond, n - 1)] + 1, 0)
        key = rank[at] * (n + 2) + second
        by = np.argsort(key, kind="stable")
        at, key = at[by], key[by]
        order[slots] = at
        new = np.concatenate([[True], key[1:] != key[:-1]])
        heads = np.flatnonzero(new)
        sizes = np.diff(np.append(heads, len(key)))
        rank[at] = np.repeat(slots[heads], sizes)
        slots = slots[np.repeat(sizes > 1, sizes)]
        width *= 2
    return order


def common_lengths(symbols: np.ndarray, end: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of the suffixes at a and b, by doubling and halving."""
    n = len(symbols)
    up, down = powers(_STEP, n + 1)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((symbols + np.uint64(1)) * up[:n], out=sums[1:])
    length = np.zeros(len(a), dtype=np.int64)
    room = np.minimum(end[a] - a, end[b] - b)
    step = 1 << max(int(room.max(initial=1)).bit_length() - 1, 0)
    while step:
        i = np.flatnonzero(length + step <= room)
        x, y = a[i] + length[i], b[i] + length[i]
        same = (sums[x + step] - sums[x]) * down[x] == (sums[y + step] - sums[y]) * down[y]
        length[i[same]] += step
        step >>= 1
    return length


def interval_pairs(positions: list[int], depths: list[int], left: dict[int, int], least: int) -> Iterator[tuple[int, int, int]]:
    """start, length, distance of maximal pairs no further apart than they are long, from
    the positions of an interval in suffix order and the depths between neighbours."""
    open_: list[list] = []
    for k, position in enumerate(positions):
        members, depth = [position], depths[k + 1] if k + 1 < len(positions) else 0
        while open_ and open_[-1][0] >= depth and open_[-1][0]:
            deep, older = open_[-1]
            small, large = (members, older) if len(members) <= len(older) else (older, members)
            places = [bisect_left(large, p) for p in small]
            for p, i in zip(small, places):
                for x, y in ((large[i - 1] if i else p, p), (p, large[i] if i < len(large) else p)):
                    if 0 < y - x <= deep and y - x + deep >= least and left[x] != left[y]:
                        yield x, y - x + deep, y - x
            if len(small) > 8:
                large.extend(small)
                large.sort()
            else:
                for shift, (p, i) in enumerate(zip(small, places)):
                    large.insert(i + shift, p)
            if deep == depth:
                open_[-1][1] = large
                break
            open_.pop()
            members = large
        else:
            if depth:
                open_.append([depth, members])


def find_runs(hashes: np.ndarray, counts: np.ndarray, least: int = MIN_LENGTH) -> np.ndarray:
    """Rows (text, start, length, period) of all runs of ``least`` words or more, in this order."""
    empty = np.empty((0, 4), dtype=np.int64)
    seed = (least + 1) // 2
    owner = np.repeat(np.arange(len(counts)), counts)
    if len(owner) < seed:
        return empty
    ends = np.cumsum(counts)
    # Texts without a repeated window of the seed's size hold no run.
    symbols = mix(hashes ^ mix(owner.astype(np.uint64)))
    at = np.flatnonzero(owner[: len(owner) - seed + 1] == owner[seed - 1 :])
    windows = np.sort(window_hashes(symbols, at, seed))
    if not (windows[1:] == windows[:-1]).any():
        return empty
    end = ends[owner]
    order = suffix_order(symbols, end)
    # Pairs of neighbours with a common prefix that is long enough.
    a, b = order[:-1], order[1:]
    near = (symbols[a] == symbols[b]) & (end[a] - a >= seed) & (end[b] - b >= seed)
    where = np.flatnonzero(near)
    depth = np.zeros(len(order) + 1, dtype=np.int64)
    depth[where + 1] = common_lengths(symbols, end, a[where], b[where])
    depth[depth < seed] = 0
    left = np.where(np.arange(len(owner)) == (ends - counts)[owner], np.uint64(0), np.concatenate([[np.uint64(0)], symbols[:-1]]))
    # Blocks of neighbours; a text's first word follows no word and differs from all.
    inner = depth[1:-1] > 0
    edge = np.diff(np.concatenate([[False], inner, [False]]).astype(np.int8))
    found = []
    for lo, hi in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) + 1):
        block = order[lo:hi]
        lefts = left[block]
        if (lefts == lefts[0]).all():
            continue
        if np.diff(np.sort(block)).min() > depth[lo + 1 : hi].max():
            continue
        positions = block.tolist()
        pairs = interval_pairs(positions, depth[lo:hi].tolist(), dict(zip(positions, lefts.tolist())), least)
        found += pairs
    if not found:
        return empty
    runs = np.array(found, dtype=np.int64)
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    first = np.concatenate([[True], (np.diff(runs[:, :2], axis=0) != 0).any(axis=1)])
    runs = runs[first]
    texts = owner[runs[:, 0]]
    runs = np.column_stack([texts, runs[:, 0] - (ends - counts)[texts], runs[:, 1], runs[:, 2]])
    return runs[np.lexsort((runs[:, 3], runs[:, 1], runs[:, 0]))]


def _digests(t: Texts, source: np.ndarray, kept: np.ndarray) -> list[str]:
    """Digest of each text's kept words with one space between them."""
    counts = np.bincount(t.word_text()[kept], minlength=t.n) if len(kept) else np.zeros(t.n, np.int64)
    words = source[kept]
    sizes = t.ends[words] - t.starts[words]
    stops = np.cumsum(sizes + 1)
    out = np.full(int(stops[-1]) if len(stops) else 0, 32, dtype=np.uint8)
    begin = stops - sizes - 1
    offset = np.repeat(np.arange(len(sizes)), sizes)
    inside = np.arange(len(offset)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[begin[offset] + inside] = t.buf[t.starts[words][offset] + inside]
    raw = out.tobytes()
    last = np.cumsum(counts)
    bounds = np.concatenate([[0], stops])[np.concatenate([[0], last])]
    return [hashlib.sha256(raw[x : max(x, y - 1)]).hexdigest() for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist())]


_COLUMNS = ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def runs_of_slice(texts: pa.Array, h: np.ndarray, least: int) -> list[pa.Array]:
    t = Texts(texts)
    source = planted(t.counts, h)
    runs = find_runs(t.word_hashes()[source], t.counts, least)
    text, start, length, period = runs.T
    n_runs = np.bincount(text, minlength=t.n)
    edge = np.zeros(len(source) + 1, dtype=np.int64)
    begins = t.first[:-1][text] + start
    np.add.at(edge, begins + period, 1)
    np.add.at(edge, begins + length, -1)
    kept = np.flatnonzero(np.cumsum(edge)[:-1] == 0)
    # The greatest length, then the smallest start, then the smallest period.
    by = np.lexsort((period, start, -length, text))
    lead = by[np.flatnonzero(np.concatenate([[True], np.diff(text[by]) != 0]))] if len(by) else by
    has, best = n_runs > 0, np.zeros((4, t.n), dtype=np.int64)
    best[:, text[lead]] = start[lead], length[lead], period[lead], 1000 * length[lead] // np.maximum(period[lead], 1)
    stops = np.cumsum(n_runs)
    digests = [
        hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in runs[b - k : b, 1:].tolist()).encode()).hexdigest()
        for b, k in zip(stops.tolist(), n_runs.tolist())
    ]
    return [
        pa.array(n_runs, pa.int64()), *[pa.array(row, pa.int64(), mask=~has) for row in best],
        pa.array(digests, pa.string()), pa.array(_digests(t, source, kept), pa.string()),
    ]


def periodic_runs(docs: DataFrame, repeats: bool = False, least: int = MIN_LENGTH, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key``, ``n_runs``, ``start, length, period, exponent_milli`` of the longest run (ties:
    smallest start, then period; null without a run), ``runs_sha256`` of all runs and
    ``collapsed_sha256`` of the words outside the repeated part of any run.

    A run is a stretch of at least ``max(least, 2 * period)`` words that no neighbour
    extends. With ``repeats`` a tenth of the texts, chosen by the hash of the key, first
    repeat a part of themselves; a null key has no hash. A null or empty text has no words
    and no runs. Every row is judged alone, so repeated rows get equal results, nothing
    is shuffled, and other columns are not read. A text longer than a slice is one slice:
    memory grows with the longest text. Words are compared by 64 bits of hash.
    """
    kind = docs.schema[key].dataType.simpleString()
    h = F.coalesce(F.crc32(docs[key].cast("string").cast("binary")), F.lit(1)) if repeats else F.lit(1)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in text_slices(batch.column(2)):
                hashes = batch.column(1).slice(start, len(texts)).to_numpy(zero_copy_only=False)
                made = runs_of_slice(texts, hashes, least)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(texts)), *made], names=[key, *_COLUMNS])

    numbers = ", ".join(f"{c} long" for c in _COLUMNS[:5])
    rows = docs.select(docs[key], h.cast("long").alias("__h"), docs[text].cast("string").alias("__text"))
    return rows.mapInArrow(run, f"`{key}` {kind}, {numbers}, runs_sha256 string, collapsed_sha256 string")
