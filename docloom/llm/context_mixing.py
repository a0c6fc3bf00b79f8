"""Language-model scores by online logistic mixing of hashed-context bit predictors.

A text is its lower-case words and one end. Each is told bit by bit where it stands
(``word_bits``): predictors look up how often 0 and 1 followed in their hashed contexts (the
language, the word before, the two words before, what came after that word earlier in the
text), their logits are combined by weights that a gate selects, learned online by the
gradient of the coding cost and further in each text that is scored, then refined by an
adaptive table. A text's score depends on the model and on the text alone.

The bits say a frequent word, or that it is another one: one of the text up to there, found
by how often it came, or a new one. That has a share by its exact count among the training
tokens, in the language that the words before speak for, and another by its spelling, whose
bits are told in the same way by hashed contexts of bytes.

Texts are turned into places in the dictionary of their slice and dictionaries joined with
the words of the corpus: what is shuffled are counts of words and places, never texts.
Words and their counts grow with the corpus; sent to executors are the predictors' tables
and the frequent words, of fixed size.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm import word_bits
from docloom.llm.word_bits import Code, Tokens, WordMixer
from docloom.llm.words import Texts, mix, pieces, text_slices
from docloom.session import materialize

#: Bytes of a slice of texts, and of its parts that are split into words at once; slots of a predictor's table (2 bytes each) and slots that travel
#: as one row; tokens after which a text's weights are refined.
SLICE_BYTES, PART_BYTES, TABLE_BITS, CHUNK, BLOCK = 16 << 20, 1 << 20, 20, 4096, 16
#: Groups are hashed to so many; slots of the table of words by group.
GROUPS, GROUP_BITS = 8, 19
#: A predictor reads so many bytes of the word back; the first reads none, but its place.
ORDERS = (0, 1, 2, 3, 4, 6)
#: Words whose bits are learned between two changes of the weights.
STEP_WORDS = 1500
CELLS, LIMIT = 32, 1e-6
#: Tokens whose texts are scored at once.
SCORED = 300_000
#: Start of the experts' logits is the share of new words among the training tokens; of the text itself:
RECENT, RATE = 0.05, 4.0
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


# --- texts as places in dictionaries -----------------------------------------------
_SLICES = (
    "batch long, word string, place int, n long, ids {ids}, held array<boolean>, counts array<int>, places binary,"
    " marks binary, sizes binary, by_group binary"
)


def _packed(numbers: np.ndarray) -> bytes:
    """Numbers below 2**32 by their bytes' weight, compressed."""
    planes = np.ascontiguousarray(numbers, "<u4").view(np.uint8).reshape(-1, 4).T
    return len(numbers.reshape(-1)).to_bytes(8, "little") + pa.compress(planes.tobytes(), "zstd", asbytes=True)


def _unpacked(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    planes = np.frombuffer(pa.decompress(data[8:], 4 * n, "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, n).T).view("<u4").reshape(-1)


class _Part(NamedTuple):
    """Words a text, the distinct words as hashes and strings, which one each word is, and
    how often each is a training word by group (``word * GROUPS + group``)."""

    counts: np.ndarray
    hashes: np.ndarray
    words: pa.Array
    places: np.ndarray
    pairs: np.ndarray
    times: np.ndarray


def _part(texts: pa.Array, held: np.ndarray, group: np.ndarray) -> _Part:
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.empty(0, np.uint8)
    folded = pa.py_buffer(_LOWER[raw])
    t = Texts(pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(np.ascontiguousarray(at - at[0])), folded))
    hashes, first, places = np.unique(t.word_hashes(), return_index=True, return_inverse=True)
    text = t.word_text()
    trained = ~held[text]
    pairs, times = np.unique(places[trained] * GROUPS + group[text[trained]], return_counts=True)
    return _Part(t.counts, hashes, pieces(t.buf, t.starts[first], t.ends[first]), places.astype(np.int32), pairs, times)


def _slice_rows(texts: pa.Array, ids: pa.Array, held: np.ndarray, group: np.ndarray, batch: int,
                schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The slice's distinct words with their training tokens, then one row with its texts."""
    parts = [_part(p, held[i : i + len(p)], group[i : i + len(p)]) for i, p in text_slices(texts, PART_BYTES)]
    counts = np.concatenate([p.counts for p in parts])
    # Words of all parts, the most frequent first: small places pack best.
    hashes, first, inverse = np.unique(np.concatenate([p.hashes for p in parts]), return_index=True, return_inverse=True)
    own = np.split(inverse, np.cumsum([len(p.hashes) for p in parts])[:-1])
    often = sum(np.bincount(m[p.places], minlength=len(hashes)) for m, p in zip(own, parts))
    by = np.argsort(-often, kind="stable")
    rank = np.empty(len(by), dtype=np.int32)
    rank[by] = np.arange(len(by), dtype=np.int32)
    hashes = hashes[by]
    places = np.concatenate([rank[m][p.places] for m, p in zip(own, parts)])
    words = pa.concat_arrays([p.words for p in parts]).take(pa.array(first[by]))
    pairs = np.concatenate([rank[m][p.pairs // GROUPS].astype(np.int64) * GROUPS + p.pairs % GROUPS for m, p in zip(own, parts)])
    times = np.concatenate([p.times for p in parts])
    n = np.bincount(pairs // GROUPS, times, len(hashes)).astype(np.int64)
    slots = (hashes >> np.uint64(64 - GROUP_BITS)).astype("<u4")
    by_group = np.column_stack([slots[pairs // GROUPS] * GROUPS + pairs % GROUPS, times])
    # The empty word stands for the end of a text.
    words = pa.concat_arrays([words, pa.array([""], pa.large_string())])
    n = np.append(n, int((~held).sum()))

    def rows(size: int, **columns: pa.Array) -> pa.RecordBatch:
        filled = [columns.get(f.name, pa.nulls(size, f.type)) for f in schema]
        return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(filled, schema)], schema=schema)

    names = pa.array([batch] * len(n))
    yield rows(len(n), batch=names, word=words, place=pa.array(np.arange(len(n), dtype=np.int32)), n=pa.array(n))
    one = pa.array([0, len(texts)], pa.int32())
    yield rows(
        1, batch=names[:1], ids=pa.ListArray.from_arrays(one, ids), held=pa.ListArray.from_arrays(one, pa.array(held)),
        counts=pa.ListArray.from_arrays(one, pa.array(counts, pa.int32())),
        places=pa.array([_packed(places)], pa.binary()), marks=pa.array([_packed(hashes >> np.uint64(32))], pa.binary()),
        sizes=pa.array([_packed(pc.binary_length(words).to_numpy())], pa.binary()), by_group=pa.array([_packed(by_group)], pa.binary()),
    )


def _sliced(rows: DataFrame) -> DataFrame:
    """Dictionaries and texts of all slices (rows are ``__id, __held, __group, __text``)."""
    ids = f"array<{rows.schema['__id'].dataType.simpleString()}>"
    schema = _SLICES.format(ids=ids)
    arrow = rows.sparkSession.createDataFrame([], schema).toArrow().schema

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            held = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            group = batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
            for start, texts in text_slices(batch.column(3), SLICE_BYTES):
                n = len(texts)
                part = slice(start, start + n)
                yield from _slice_rows(texts, batch.column(0).slice(start, n), held[part], group[part], task << 32 | number, arrow)
                number += 1
                pa.default_memory_pool().release_unused()

    # Written once: all later steps see the same slices.
    return materialize(rows.mapInArrow(run, schema), "slices")


# --- bits of words -----------------------------------------------------------------
class Bits:
    """The bytes of words, each with a space at its end, and the contexts of its bytes."""

    def __init__(self, words: pa.Array):
        words = words.cast(pa.large_string())
        _, offsets, data = words.buffers()
        at = np.frombuffer(offsets, np.int64)[words.offset : words.offset + len(words) + 1]
        raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.empty(0, np.uint8)
        sizes = np.diff(at)
        self.word = np.repeat(np.arange(len(words)), sizes + 1)
        self.first = np.concatenate([[0], np.cumsum(sizes + 1)])
        self.bytes = np.full(len(self.word), 32, dtype=np.uint64)
        self.bytes[np.arange(len(raw)) + np.repeat(np.arange(len(words)), sizes)] = raw
        place = np.arange(len(self.word)) - self.first[self.word]
        contexts, read = {0: np.minimum(place, 15).astype(np.uint64)}, np.zeros(len(self.word), dtype=np.uint64)
        for back in range(1, max(ORDERS) + 1):
            earlier = np.zeros_like(read)
            earlier[back:] = self.bytes[:-back]
            read = read << np.uint64(8) | np.where(place >= back, earlier, np.uint64(0))
            contexts[back] = read
        self.hashes = [mix(contexts[o] ^ mix(np.full(1, o + 1, dtype=np.uint64))) for o in ORDERS]

    def of(self, bit: int, part: slice) -> tuple[np.ndarray, list[np.ndarray]]:
        """The bits at this place of the bytes in ``part``, and their slots in each table."""
        byte = self.bytes[part]
        node = np.uint64(1 << bit) | byte >> np.uint64(8 - bit)
        step, shift = node * np.uint64(0x9E3779B97F4A7C15), np.uint64(64 - TABLE_BITS)
        slots = [((h[part] ^ step) * np.uint64(0xD6E8FEB86659FD93) >> shift).astype(np.int64) for h in self.hashes]
        return byte >> np.uint64(7 - bit) & np.uint64(1) == 1, slots


def _by_state() -> tuple[np.ndarray, np.ndarray]:
    """For each pair of counts up to 255 the logit of a 1 and whether there is a count; then
    the same with a 0 taken out of the counts, then with a 1. Counts at the limit stay."""
    n0, n1 = np.arange(65536) >> 8, np.arange(65536) & 255
    exact = n0 + n1 < 255
    pairs = [(n0, n1), (n0 - (exact & (n0 > 0)), n1), (n0, n1 - (exact & (n1 > 0)))]
    logits = np.concatenate([np.log((b + 0.3) / (a + 0.3)) for a, b in pairs])
    return logits.astype(np.float32), np.concatenate([a + b > 0 for a, b in pairs]).astype(np.int8)


class Mixer:
    """Predictors' tables, weights by gate, and the table that refines what they say."""

    GATES = len(ORDERS) + 1

    def __init__(self, tables: np.ndarray):
        self.tables = tables
        self.logits, self.seen = _by_state()
        self.weights = np.full((8, self.GATES, len(ORDERS)), 0.3)
        self.cells = np.zeros((2, 8, self.GATES, CELLS))
        self.steps = 0

    def __getstate__(self) -> dict:
        # Tables that were sent to executors are not sent again.
        left_out = {"logits", "seen"} | ({"tables"} if "sent" in vars(self) else set())
        return {name: value for name, value in vars(self).items() if name not in left_out}

    def __setstate__(self, state: dict) -> None:
        vars(self).update(state)
        self.logits, self.seen = _by_state()
        if "sent" in state:
            self.tables = self.sent.value

    def predict(self, bits: Bits, bit: int, part: slice, without: bool) -> tuple:
        """Bits, inputs, gates and logit of a 1. ``without`` takes the bit itself out of the
        counts, for words that the tables were learned from."""
        ones, slots = bits.of(bit, part)
        inputs = np.empty((len(ORDERS), len(ones)), dtype=np.float32)
        gate = np.zeros(len(ones), dtype=np.int8)
        own = (1 + ones) * 65536 if without else 0
        for k, slot in enumerate(slots):
            state = self.tables[k].take(slot).astype(np.int64) + own
            self.logits.take(state, out=inputs[k], mode="clip")
            np.maximum(gate, self.seen.take(state) * np.int8(k + 1), out=gate)
        gate = gate.astype(np.intp)
        chosen = self.weights[bit].astype(np.float32).T
        logit = chosen[0].take(gate) * inputs[0]
        for k in range(1, len(ORDERS)):
            logit += chosen[k].take(gate) * inputs[k]
        return ones, inputs, gate, np.clip(logit, -13, 13)

    def _cell(self, logit: np.ndarray) -> np.ndarray:
        return np.clip((logit + 8) * (CELLS / 16), 0, CELLS - 1).astype(np.intp)

    def learn(self, bits: Bits, part: slice) -> None:
        """One step down the gradient of the coding cost for each gate, mean over its bits."""
        self.steps += 1
        rate = max(0.5 / math.sqrt(self.steps), 0.02)
        for bit in range(8):
            ones, inputs, gate, logit = self.predict(bits, bit, part, without=True)
            wrong = ones - 1 / (1 + np.exp(-logit))
            by_gate = np.equal.outer(np.arange(self.GATES), gate).astype(np.float32)
            n = by_gate.sum(axis=1, keepdims=True)
            self.weights[bit] += rate * (by_gate @ (wrong * inputs).T) / np.maximum(n, 50)
            at = gate * CELLS + self._cell(logit)
            for i, weights in enumerate((None, ones)):
                self.cells[i, bit] += np.bincount(at, weights, self.GATES * CELLS).reshape(self.GATES, CELLS)

    def cost(self, words: pa.Array) -> np.ndarray:
        """Natural logarithm of each word's probability."""
        bits, out = Bits(words), np.zeros(len(words))
        for lo in range(0, len(words), STEP_WORDS):
            hi = min(len(words), lo + STEP_WORDS)
            part = slice(bits.first[lo], bits.first[hi])
            total = np.zeros(part.stop - part.start)
            for bit in range(8):
                ones, _, gate, logit = self.predict(bits, bit, part, without=False)
                p, at = 1 / (1 + np.exp(-logit)), gate * CELLS + self._cell(logit)
                n, hits = (self.cells[i, bit].ravel().astype(np.float32).take(at) for i in (0, 1))
                p = np.clip((p + (hits + 4 * p) / (n + 4)) / 2, LIMIT, 1 - LIMIT)
                total += np.log(np.where(ones, p, 1 - p))
            out[lo:hi] = np.bincount(bits.word[part] - lo, total, hi - lo)
        return out


def _count_bits(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The task's counts of 0 and 1 in every slot, by chunk of slots."""
    counts = np.zeros((len(ORDERS), 2 << TABLE_BITS), dtype=np.int32)
    for batch in batches:
        bits = Bits(batch.column(0))
        for bit in range(8):
            ones, slots = bits.of(bit, slice(None))
            for k, slot in enumerate(slots):
                np.add.at(counts[k], slot * 2 + ones, np.int32(1))
    yield from _by_chunk(counts)


def _by_chunk(counts: Iterable[np.ndarray]) -> Iterator[pa.RecordBatch]:
    for k, table in enumerate(counts):
        for chunk in range(0, len(table) // 2, CHUNK):
            part = table[2 * chunk : 2 * (chunk + CHUNK)]
            if part.any():
                row = [pa.array([k << 32 | chunk], pa.int64()), pa.array([_packed(part)], pa.binary())]
                yield pa.RecordBatch.from_arrays(row, names=["chunk", "counts"])


def _states(key: tuple, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One chunk's slots with their counts, scaled to one byte each where they are larger."""
    total = np.zeros((CHUNK, 2), dtype=np.int64)
    for part in parts:
        for packed in part.column(1):
            total += _unpacked(packed.as_py()).reshape(-1, 2)
    most = total.max(axis=1, keepdims=True)
    small = np.where(most > 255, np.maximum(total * 255 // np.maximum(most, 1), total > 0), total)
    states = (small[:, 0] << 8 | small[:, 1]).astype("<u2").tobytes()
    yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int64()), pa.array([states], pa.binary())], names=["chunk", "states"])


def _learned(mixer: Mixer) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = 0
        for batch in batches:
            bits = Bits(batch.column(0))
            for lo in range(0, batch.num_rows, STEP_WORDS):
                mixer.learn(bits, slice(bits.first[lo], bits.first[min(batch.num_rows, lo + STEP_WORDS)]))
            seen += batch.num_rows
        if seen:
            row = [pa.array([seen], pa.int64()), *[pa.array([x.tobytes()], pa.binary()) for x in (mixer.weights, mixer.cells)]]
            yield pa.RecordBatch.from_arrays(row, names=["seen", "weights", "cells"])

    return run


def _fill(tables: Iterable[np.ndarray], counted: DataFrame) -> None:
    """The counts of all tasks, summed, as states of the tables' slots."""
    states = counted.groupBy("chunk").applyInArrow(_states, "chunk long, states binary").toArrow()
    for chunk, packed in zip(states["chunk"].to_pylist(), states["states"]):
        at = chunk & 0xFFFFFFFF
        tables[chunk >> 32][at : at + CHUNK] = np.frombuffer(packed.as_py(), "<u2")


def _average(mixer: Mixer | WordMixer, learned: DataFrame) -> None:
    """Weights averaged over tasks by what they have seen, cells summed."""
    learned = learned.toArrow()
    seen = learned["seen"].to_numpy()
    if len(seen):
        weights = [np.frombuffer(x.as_py(), float).reshape(mixer.weights.shape) for x in learned["weights"]]
        mixer.weights = np.average(weights, axis=0, weights=seen)
        mixer.cells = np.sum([np.frombuffer(x.as_py(), float).reshape(mixer.cells.shape) for x in learned["cells"]], axis=0)


def fit_spelling(words: DataFrame) -> Mixer:
    """Bit predictors of the distinct training words (column ``word``): counts are summed
    over all tasks; each task learns weights online, and these are averaged by words."""
    tables = np.zeros((len(ORDERS), 1 << TABLE_BITS), dtype=np.uint16)
    _fill(tables, words.select("word").mapInArrow(_count_bits, "chunk long, counts binary"))
    mixer = Mixer(tables)
    mixer.sent = words.sparkSession.sparkContext.broadcast(tables)
    _average(mixer, words.select("word").mapInArrow(_learned(mixer), "seen long, weights binary, cells binary"))
    return mixer


def _spelled(mixer: Mixer, shared: Broadcast) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, _ = shared.value
        for batch in batches:
            words = batch.column(0)
            symbols = pc.fill_null(pc.index_in(words.cast(pa.large_string()), value_set=code.words), -1)
            columns = [*batch.columns, pa.array(mixer.cost(words)), symbols]
            yield pa.RecordBatch.from_arrays(columns, names=["word", "c", "spelling", "symbol"])

    return run


# --- bits of words in their texts --------------------------------------------------
def fit_code(vocabulary: DataFrame, tokens: int) -> Code:
    """Paths of the words (``word``, ``c``) that are more frequent than all but a fixed number."""
    level = F.floor(8 * F.log2("c"))
    sizes = vocabulary.filter("c > 1").groupBy(level.alias("level")).count().collect()
    least, n = math.inf, 0
    for size in sorted(sizes, reverse=True):
        n += size["count"]
        if n > word_bits.CODED:
            break
        least = size["level"]
    # At most CODED words.
    top = vocabulary.filter((F.col("c") > 1) & (level >= F.lit(float(least)))).select("word", "c").toArrow()
    by = np.argsort(top["word"].to_numpy())
    counts = top["c"].to_numpy()[by].astype(np.int64)
    return Code(top["word"].combine_chunks().take(pa.array(by)), counts, tokens - int(counts.sum()))


def _in_texts(batches: Iterable[pa.RecordBatch], shared: Broadcast) -> Iterator[Tokens]:
    """The training texts of slices (``held, counts, places, marks``)."""
    code, table = shared.value
    for batch in batches:
        for row in range(batch.num_rows):
            held, counts, places, packed = (batch.column(i)[row] for i in range(4))
            trained = ~held.values.to_numpy(zero_copy_only=False).astype(bool)
            every = counts.values.to_numpy().astype(np.int64)
            marks, lifts = _marks(packed.as_py(), table)
            symbols = np.append(code.of_marks(marks[:-1]), code.end)
            whole, stops = _unpacked(places.as_py()), np.cumsum(every)
            for lo, hi in word_bits.groups_of(every, SCORED):
                keep = trained[lo:hi]
                places_of, counts_of = _with_ends(whole[stops[lo] - every[lo] : stops[hi - 1]], every[lo:hi], len(symbols) - 1)
                yield Tokens(code, places_of[np.repeat(keep, counts_of)], counts_of[keep], symbols, marks, lifts)


def _marks(packed: bytes, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """32 bits of the places' hashes and their lifts by group; the end, last, has none."""
    marks = _unpacked(packed).astype(np.uint64)
    slots = (marks >> np.uint64(32 - GROUP_BITS)).astype(np.int64)
    return np.append(marks, np.uint64(0)), np.vstack([table[slots].astype(np.float32), np.zeros((1, GROUPS), np.float32)])


def _with_ends(places: np.ndarray, counts: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    return np.insert(places.astype(np.int64), np.cumsum(counts), end), counts + 1


def _count_words(shared: Broadcast) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [np.zeros(2 << bits, dtype=np.int32) for bits in word_bits.TABLE_BITS]
        for tokens in _in_texts(batches, shared):
            word_bits.count_bits(counts, tokens)
        yield from _by_chunk(counts)

    return run


def _learn_words(mixer: WordMixer, shared: Broadcast) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = 0
        for tokens in _in_texts(batches, shared):
            mixer.learn(tokens)
            seen += tokens.n
        if seen:
            row = [pa.array([seen], pa.int64()), *[pa.array([x.tobytes()], pa.binary()) for x in (mixer.weights, mixer.cells)]]
            yield pa.RecordBatch.from_arrays(row, names=["seen", "weights", "cells"])

    return run


def fit_words(slices: DataFrame, shared: Broadcast) -> WordMixer:
    """Bit predictors of the words in all training texts (``shared``: code and lifts): counts are summed over all tasks;
    each task learns weights online, and these are averaged by tokens."""
    texts = slices.filter("word IS NULL").select("held", "counts", "places", "marks")
    tables = [np.zeros(1 << bits, dtype=np.uint16) for bits in word_bits.TABLE_BITS]
    _fill(tables, texts.mapInArrow(_count_words(shared), "chunk long, counts binary"))
    mixer = WordMixer(tables)
    mixer.sent = slices.sparkSession.sparkContext.broadcast(tables)
    _average(mixer, texts.mapInArrow(_learn_words(mixer, shared), "seen long, weights binary, cells binary"))
    return mixer


# --- words by group ----------------------------------------------------------------
def _group_chunks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The task's counts of words by slot and group, by chunk."""
    total = np.zeros(GROUPS << GROUP_BITS, dtype=np.int64)
    for batch in batches:
        for packed in batch.column(0):
            at, times = _unpacked(packed.as_py()).reshape(-1, 2).T
            total += np.bincount(at, times, len(total)).astype(np.int64)
    for chunk in range(0, len(total), CHUNK):
        part = total[chunk : chunk + CHUNK]
        if part.any():
            yield pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([part.tobytes()], pa.binary())], names=["chunk", "counts"])


def _summed(key: tuple, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(CHUNK, dtype=np.int64)
    for part in parts:
        for packed in part.column(1):
            total += np.frombuffer(packed.as_py(), np.int64)
    yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["chunk", "counts"])


def _group_counts(slices: DataFrame) -> np.ndarray:
    """Training words by slot and group."""
    chunks = slices.filter("word IS NULL").select("by_group").mapInArrow(_group_chunks, "chunk long, counts binary")
    found = chunks.groupBy("chunk").applyInArrow(_summed, "chunk long, counts binary").toArrow()
    total = np.zeros(GROUPS << GROUP_BITS, dtype=np.int64)
    for chunk, packed in zip(found["chunk"].to_pylist(), found["counts"]):
        total[chunk : chunk + CHUNK] = np.frombuffer(packed.as_py(), np.int64)
    return total.reshape(-1, GROUPS)


def group_table(slices: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """For each slot and group the logarithm of how much likelier a word of the slot is
    there than anywhere; and the share of each group."""
    return _lifts(_group_counts(slices))


def _lifts(total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    share = (total.sum(axis=0) + 0.1) / (total.sum() + 0.1 * GROUPS)
    # Shrunk to the shares of the groups, so each slot's chances still add up to 1.
    lift = (total + share * 0.5) / (total.sum(axis=1, keepdims=True) + 0.5) / share
    return np.log(lift).astype(np.float16), share


def other_words(total: np.ndarray, lifts: np.ndarray, code: Code, tokens: int) -> np.ndarray:
    """For each group, and for none, how much the words without a path weigh together."""
    factor = np.exp(lifts.astype(np.float32)).astype(float)
    weight = total.sum(axis=1) @ factor
    named = code.symbols
    weight -= code.counts[named] @ factor[(code.marks >> np.uint64(32 - GROUP_BITS)).astype(np.int64)]
    if code.end < 0:
        weight += tokens - total.sum()
    return np.maximum(np.append(weight, tokens - code.counts.sum()), 1)


# --- scores of texts ---------------------------------------------------------------
class Totals(NamedTuple):
    """Training tokens, distinct ones, and those that occur once."""

    tokens: int
    distinct: int
    once: int


def _earlier(places: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """How often each token's word occurs before it in its text."""
    owner = np.repeat(np.arange(len(counts)), counts)
    order = np.lexsort((places, owner))
    p, o = places[order], owner[order]
    new = np.concatenate([[True], (p[1:] != p[:-1]) | (o[1:] != o[:-1])]) if len(p) else np.empty(0, bool)
    heads = np.flatnonzero(new)
    out = np.empty(len(places), dtype=np.int64)
    out[order] = np.arange(len(places)) - np.repeat(heads, np.diff(np.append(heads, len(places))))
    return out


def text_scores(places: np.ndarray, counts: np.ndarray, c: np.ndarray, spelling: np.ndarray, lifts: np.ndarray,
                share: np.ndarray, totals: Totals) -> np.ndarray:
    """Natural logarithms of the texts' probabilities by a plain mixture of words' probabilities, to
    compare with (``score_texts`` does not use it); ``places`` has each text's words and
    its end, ``c``, ``spelling`` and ``lifts`` what is known of each place."""
    first = np.cumsum(counts) - counts
    with np.errstate(divide="ignore"):
        known = np.log(c) - math.log(max(totals.tokens, 1))
        recent = np.log(_earlier(places, counts) / (np.arange(len(places)) - np.repeat(first, counts) + 1.0))
    by_group = known[:, None] + lifts
    new = (totals.once + 1) / (totals.tokens + 2)
    start = np.log([(1 - RECENT) * new, RECENT, *((1 - RECENT) * (1 - new) / 2 * np.concatenate([[1], share]))])
    logits, out = np.tile(start, (len(counts), 1)), np.zeros(len(counts))
    alive = np.arange(len(counts))
    for lo in range(0, int(counts.max(initial=0)), BLOCK):
        alive = alive[counts[alive] > lo]
        sizes = np.minimum(counts[alive] - lo, BLOCK)
        heads = np.cumsum(sizes) - sizes
        tokens = np.repeat(first[alive] + lo - heads, sizes) + np.arange(int(sizes.sum()))
        trust = np.exp(logits[alive])
        trust /= trust.sum(axis=1, keepdims=True)
        word = places[tokens]
        parts = np.vstack([spelling[word], recent[tokens], known[word], by_group[word].T])
        parts += np.log(np.repeat(trust, sizes, axis=0)).T
        best = parts.max(axis=0)
        weight = np.exp(parts - best)
        total = weight.sum(axis=0)
        out[alive] += np.add.reduceat(best + np.log(total), heads)
        # The gradient of the cost by the logits: what each expert was worth less its share.
        worth = np.add.reduceat(weight / total, heads, axis=1).T / sizes[:, None]
        logits[alive] += RATE * (worth - trust)
    return out


def other_scores(tokens: Tokens, places: np.ndarray, c: np.ndarray, spelling: np.ndarray, lifts: np.ndarray,
                 weight: np.ndarray, totals: Totals) -> np.ndarray:
    """Natural logarithm of the probability of each text's words without a path, given that they have none."""
    out = np.zeros(tokens.n)
    again = np.flatnonzero(tokens.symbol == tokens.code.again)
    out[again] = np.log(tokens.times[again] / tokens.passed[again])
    new = (totals.once + 1) / (weight[-1] + totals.once + 2)
    at = np.flatnonzero(tokens.symbol == tokens.code.other)
    word, group = places[at], tokens.group[at]
    lift = np.where(group < GROUPS, lifts[word, np.minimum(group, GROUPS - 1)], 0)
    with np.errstate(divide="ignore"):
        known = np.log(c[word]) + lift - np.log(weight)[group]
    out[at] = np.logaddexp(math.log(new) + spelling[word], math.log(1 - new) + known)
    return np.add.reduceat(out, tokens.first)


def _scorer(totals: Totals, mixer: WordMixer, shared: Broadcast, weight: np.ndarray, key: str) -> Callable:
    def run(texts: pa.Table, words: pa.Table) -> pa.Table:
        code, table = shared.value
        by = np.argsort(words.column("place").to_numpy())
        c, spelling = words.column("c").to_numpy()[by], words.column("spelling").to_numpy()[by].astype(float)
        symbols = words.column("symbol").to_numpy()[by].astype(np.int64)
        end, base, made = len(c) - 1, np.log10(c + 1.0), []
        for row in range(texts.num_rows):
            whole = _unpacked(texts.column("places")[row].as_py())
            marks, lifts = _marks(texts.column("marks")[row].as_py(), table)
            length = _unpacked(texts.column("sizes")[row].as_py()).astype(np.int64)
            ids, held = texts.column("ids")[row].values, texts.column("held")[row].values
            every = texts.column("counts")[row].values.to_numpy().astype(np.int64)
            stops = np.cumsum(every)
            # So many texts at once as have about SCORED tokens.
            for lo, hi in word_bits.groups_of(every, SCORED):
                # Every text gets its end.
                places, counts = _with_ends(whole[stops[lo] - every[lo] : stops[hi - 1]], every[lo:hi], end)
                heads = np.cumsum(counts) - counts
                tokens = Tokens(code, places, counts, symbols, marks, lifts)
                score = mixer.cost(tokens) + other_scores(tokens, places, c, spelling, lifts, weight, totals)
                score /= math.log(10)
                space = np.add.reduceat(length[places] + 1, heads)
                made.append(pa.table({
                    key: ids.slice(lo, hi - lo), "held_out": held.slice(lo, hi - lo),
                    "n_tokens": counts, "n_known": np.add.reduceat((c[places] > 0).astype(np.int64), heads),
                    "train_tokens": np.full(len(counts), totals.tokens),
                    "base_score": np.add.reduceat(base[places], heads) - counts * math.log10(totals.tokens + totals.distinct + 1),
                    "score": score, "bits_per_byte": -score * math.log2(10) / space,
                }))
        return pa.concat_tables(made)

    return run


def held_out_by_key(key: Column) -> Column:
    """One key of seven, by checksum; never a null key."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def score_texts(docs: DataFrame, held_out: Column | None = None, text: str = "text", key: str = "doc_id",
                group: str | None = "lang") -> DataFrame:
    """``key, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte`` of
    every row; rows where ``held_out`` is not true are learned from.

    ``base_score`` is the sum of ``log10((c + 1) / (N + V + 1))`` with a token's count c among
    the N training tokens, V distinct ones; ``n_known`` counts tokens with c > 0; ``score`` is
    the model's log10 probability, ``bits_per_byte`` the same over the bytes of words, spaces
    and the end. Training texts are told apart by ``group`` (a column, if the table has it; null
    is a group); the group of a text that is scored is not looked at. A null text is empty: its only token is the end. Repeated rows count and
    are scored each time. Without training rows all counts are 0 and bits are even. Other
    columns are not read.

    Counts are exact; weights of the mixture vary slightly with how words are dealt to tasks.
    """
    held = held_out_by_key(docs[key]) if held_out is None else F.coalesce(held_out, F.lit(False))
    named = docs[group].cast("string") if group in docs.columns else F.lit(None).cast("string")
    code = F.pmod(F.xxhash64(named), F.lit(GROUPS)).cast("int").alias("__group")
    rows = docs.select(docs[key].alias("__id"), held.alias("__held"), code, F.coalesce(docs[text].cast("string"), F.lit("")).alias("__text"))
    slices = _sliced(rows)
    entries = slices.filter("word IS NOT NULL").select("batch", "word", "place", "n")
    vocabulary = materialize(entries.groupBy("word").agg(F.sum("n").alias("c")), "vocabulary")
    sums = vocabulary.agg(F.sum("c"), F.count_if(F.col("c") > 0), F.count_if(F.col("c") == 1)).first()
    totals = Totals(*(x or 0 for x in sums))
    mixer = fit_spelling(vocabulary.filter("c > 0 AND word <> ''"))
    by_group = _group_counts(slices)
    lifts, _ = _lifts(by_group)
    code = fit_code(vocabulary, totals.tokens)
    weight = other_words(by_group, lifts, code, totals.tokens)
    shared = docs.sparkSession.sparkContext.broadcast((code, lifts))
    words = fit_words(slices, shared)
    known = vocabulary.mapInArrow(_spelled(mixer, shared), "word string, c long, spelling double, symbol int")
    found = entries.join(known, "word").select(F.col("batch").alias("of"), "place", "c", F.col("spelling").cast("float").alias("spelling"), "symbol")
    texts = slices.filter("word IS NULL").select("batch", "ids", "held", "counts", "places", "marks", "sizes")
    kind = docs.schema[key].dataType.simpleString()
    schema = (
        f"`{key}` {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double,"
        " bits_per_byte double"
    )
    return texts.groupBy("batch").cogroup(found.groupBy("of")).applyInArrow(_scorer(totals, words, shared, weight, key), schema)
