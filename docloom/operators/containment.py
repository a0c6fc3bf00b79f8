"""Which of many needles occur in which texts.

A needle set of bounded size becomes an automaton that every task gets: texts are read once,
byte by byte, many stretches of them in step, whatever the number of needles. Larger sets
are met by an index: each needle is filed under its gram that fewest texts have, texts
send their ids to the grams that some needle is filed under, and only texts and needles
that meet there are compared.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom import scale
from docloom.functions import text as tx
from docloom.session import materialize

#: Needles of an automaton and bytes of them all together: 32 MB of transitions for 64 kinds of bytes.
AUTOMATON_NEEDLES, AUTOMATON_BYTES = 20_000, 128 * 1024
#: Bytes of text scanned at once, and bytes of a stretch.
SLICE_BYTES, STRETCH = 8 << 20, 2048
#: Longest gram; counters of texts by gram; bits of the table of grams that needles are filed under.
GRAM, COUNTERS, FILED_BITS = 4, 1 << 20, 1 << 24
_END = 0xFF  # in no UTF-8 text
_STEP = 0x9E3779B97F4A7C15


class Automaton:
    """Aho-Corasick over UTF-8 bytes with all transitions in a table."""

    def __init__(self, needles: list[str]):
        words = [n.encode() for n in needles]
        kinds = sorted({b for w in words for b in w})
        # Bytes that are in no needle share kind 0, which leads back to the start.
        self.kind = np.zeros(256, dtype=np.int32)
        self.kind[kinds] = np.arange(1, len(kinds) + 1)
        children: list[dict[int, int]] = [{}]
        found = [-1]
        for i, w in enumerate(words):
            state = 0
            for b in w:
                if b not in children[state]:
                    children[state][b] = len(children)
                    children.append({})
                    found.append(-1)
                state = children[state][b]
            found[state] = i
        width = len(kinds) + 1
        table = np.zeros((len(children), width), dtype=np.int32)
        fail, link = [0] * len(children), np.zeros(len(children), dtype=np.int32)
        queue = deque([0])
        while queue:
            state = queue.popleft()
            if state:
                table[state] = table[fail[state]]
                link[state] = fail[state] if found[fail[state]] >= 0 else link[fail[state]]
            for b, child in children[state].items():
                k = self.kind[b]
                fail[child] = int(table[state, k]) if state else 0
                table[state, k] = child
                queue.append(child)
        # States are kept as offsets of their rows.
        self.table, self.width = (table * width).ravel(), width
        self.found, self.link = np.array(found), link
        self.stop = (self.found >= 0) | (link > 0)
        self.longest = max((len(w) for w in words), default=0)

    def scan(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions after the last byte of occurrences, and their needles."""
        before = max(self.longest - 1, 0)
        stretch = max(STRETCH, 4 * before)
        lanes = max(1, -(-len(raw) // stretch))
        # Each stretch starts early enough to see what began before it.
        padded = np.full(before + lanes * stretch, _END, dtype=np.uint8)
        padded[before : before + len(raw)] = raw
        kinds = self.kind[padded]
        begin = np.arange(lanes) * stretch
        state = np.zeros(lanes, dtype=np.int32)
        at, states = [], []
        for step in range(before + stretch):
            state = self.table.take(state + kinds.take(begin + step))
            hit = np.flatnonzero(self.stop.take(state // self.width))
            if len(hit):
                at.append(begin[hit] + (step + 1 - before))
                states.append(state[hit] // self.width)
        if not at:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        position, reached = np.concatenate(at), np.concatenate(states)
        out_at, out = [], []
        while len(reached):
            own = self.found[reached] >= 0
            out_at.append(position[own])
            out.append(self.found[reached[own]])
            reached = self.link[reached]
            position, reached = position[reached > 0], reached[reached > 0]
        return np.concatenate(out_at), np.concatenate(out)


def _slices(texts: pa.Array, max_bytes: int = SLICE_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Buffers with an end after each text, and the places of these ends."""
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    start = 0
    while start < len(texts):
        stop = max(start + 1, int(np.searchsorted(at, at[start] + max_bytes, side="right")) - 1)
        part = at[start : stop + 1] - at[start]
        raw = np.insert(whole[at[start] : at[stop]], part[1:], _END)
        yield raw, part[1:] + np.arange(stop - start)
        start = stop


def _lists(values: np.ndarray, owners: np.ndarray, n: int, kind: pa.DataType) -> pa.Array:
    """One list a text of the distinct values (below 2**32) it owns."""
    if len(values):
        # As one number each: sorting rows of two is many times slower.
        pairs = np.unique(owners.astype(np.uint64) << np.uint64(32) | values.astype(np.uint64))
        owners, values = pairs >> np.uint64(32), (pairs & np.uint64(0xFFFFFFFF)).astype(np.int64)
    offsets = np.concatenate([[0], np.cumsum(np.bincount(owners.astype(np.int64), minlength=n))])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def _numbers(automaton: Automaton) -> Callable:
    @F.arrow_udf("array<int>")
    def numbers(texts: pa.Array) -> pa.Array:
        parts = []
        for raw, ends in _slices(texts):
            at, needle = automaton.scan(raw)
            owner = np.searchsorted(ends, at - 1, side="left")
            parts.append(_lists(needle, owner, len(ends), pa.int32()))
        return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int32()))

    return numbers


def _grams(raw: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and 32-bit keys of all stretches of ``size`` bytes inside texts."""
    n = len(raw) - size + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    key, clean = np.zeros(n, dtype=np.uint64), np.ones(n, dtype=bool)
    for i in range(size):
        key = key << np.uint64(8) | raw[i : i + n]
        clean &= raw[i : i + n] != _END
    at = np.flatnonzero(clean)
    mixed = (key[at] + np.uint64(size << 56)) * np.uint64(_STEP)
    return at, (mixed >> np.uint64(32)).astype(np.int64)


def _text_counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The task's counts of texts by gram, in counters shared by grams."""
    total = np.zeros(COUNTERS, dtype=np.int64)
    for batch in batches:
        for raw, ends in _slices(batch.column(0)):
            for size in range(1, GRAM + 1):
                at, key = _grams(raw, size)
                owner = np.searchsorted(ends, at, side="left")
                total += np.bincount(np.unique(owner * COUNTERS + key % COUNTERS) % COUNTERS, minlength=COUNTERS)
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["counter", "n"])


def _filing(counts: np.ndarray) -> Callable:
    @F.arrow_udf("long")
    def filed(needles: pa.Array) -> pa.Array:
        """The key of the needle's gram that fewest texts have; a needle shorter than a gram is one."""
        keys = []
        for needle in needles.to_pylist():
            raw = np.frombuffer(needle.encode(), np.uint8)
            _, key = _grams(raw, min(GRAM, len(raw)))
            keys.append(int(key[np.lexsort((key, counts[key % COUNTERS]))[0]]))
        return pa.array(keys, pa.int64())

    return filed


def _filed_grams(table: np.ndarray) -> Callable:
    @F.arrow_udf("array<long>")
    def grams(texts: pa.Array) -> pa.Array:
        """The text's grams that needles may be filed under."""
        parts = []
        for raw, ends in _slices(texts):
            owners, keys = [], []
            for size in range(1, GRAM + 1):
                at, key = _grams(raw, size)
                bit = key % FILED_BITS
                may = (table[bit >> 3] >> (bit & 7)) & 1 == 1
                owners.append(np.searchsorted(ends, at[may], side="left"))
                keys.append(key[may])
            parts.append(_lists(np.concatenate(keys), np.concatenate(owners), len(ends), pa.int64()))
        return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int64()))

    return grams


def _by_automaton(df: DataFrame, column: str, wanted: DataFrame) -> DataFrame:
    # At most AUTOMATON_NEEDLES rows, as measured.
    needles = sorted(r["needle"] for r in wanted.collect())
    names = wanted.sparkSession.createDataFrame([(i, n) for i, n in enumerate(needles)], "_n int, needle string")
    found = df.withColumn("_n", F.explode(_numbers(Automaton(needles))(F.lower(column))))
    return found.join(F.broadcast(names), "_n").drop("_n")


def _by_index(df: DataFrame, column: str, wanted: DataFrame) -> DataFrame:
    rows = materialize(df.withColumn("_row", F.monotonically_increasing_id()), "texts")
    low = F.lower(column)
    counted = rows.select(low.alias("t")).mapInArrow(_text_counts, "counter long, n long").groupBy("counter").agg(F.sum("n").alias("n"))
    counts = np.zeros(COUNTERS, dtype=np.int64)
    found = counted.toArrow()  # COUNTERS rows at most
    counts[found["counter"].to_numpy()] = found["n"].to_numpy()
    filed = materialize(wanted.withColumn("_gram", _filing(counts)(F.col("needle"))), "needles")
    bit = F.pmod("_gram", F.lit(FILED_BITS))
    cells = filed.select(F.shiftright(bit, 3).alias("cell"), F.call_function("shiftleft", F.lit(1), (bit % 8).cast("int")).alias("mask"))
    masks = cells.groupBy("cell").agg(F.bit_or("mask").alias("mask")).toArrow()  # FILED_BITS / 8 rows at most
    table = np.zeros(FILED_BITS >> 3, dtype=np.uint8)
    table[masks["cell"].to_numpy()] = masks["mask"].to_numpy()
    sent = rows.select("_row", F.explode(_filed_grams(table)(low)).alias("_gram"))
    met = sent.join(scale.broadcast_if_small(filed), "_gram").select("_row", "needle")
    # Texts come in once more for those ids that met a needle, each once with all its needles.
    asked = met.groupBy("_row").agg(F.collect_set("needle").alias("_asked"))
    inside = tx.bind(low, lambda text: F.filter("_asked", lambda n: F.contains(text, n)))
    return rows.join(asked, "_row").withColumn("needle", F.explode(inside)).drop("_row", "_asked")


def contains_terms(df: DataFrame, column: str, needles: DataFrame, needle: str = "needle",
                   automaton_needles: int = AUTOMATON_NEEDLES, automaton_bytes: int = AUTOMATON_BYTES) -> DataFrame:
    """One row per row of ``df`` and distinct needle (a table's column) found in ``column``,
    ignoring case, with all columns of ``df`` and ``needle``. Time is linear in the length
    of the texts. Null and empty needles find nothing, and nothing is found in null texts.

    Needles are counted first: up to the two limits all tasks get one automaton, beyond them
    needles stay a table and texts meet them by grams. Both ways give the same rows. An
    index adds the columns ``_row`` and ``_gram`` on its way, an automaton ``_n``.
    """
    wanted = needles.select(F.lower(needle).alias("needle")).filter("needle <> ''").distinct()
    n, size = wanted.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("needle")), F.lit(0))).first()
    small = n <= automaton_needles and size <= automaton_bytes
    return (_by_automaton if small else _by_index)(df, column, wanted)
