"""Exact substring deduplication: fixed-block anchors, rolling probes, extended hits.

A window of 50 words that begins at any word holds a whole block of 25 words of the
blocks that cut its own document from the first word on. So every document's blocks are
the index, every rolling stretch of 25 words of every document is a probe, and a repeat
of 50 words or more shows up as hits. Around the hits all windows of 50 words are
compared, which extends each hit to the maximal repeat without forming pairs.

Documents are dealt to batches of bounded size by a hash of their key and text. What a batch
finds of a value is told once: a value that fills a third of the corpus is one entry of
each batch. Entries travel as packed arrays, dealt to buckets by their hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.words import Texts, covered, text_slices, window_hashes
from docloom.session import materialize

WINDOW = 50
#: Bytes of text in a batch, and words that one bucket gets, on average.
BATCH_BYTES, BUCKET_WORDS = 8 << 20, 4_000_000
_OTHER_STEP = 0xC2B2AE3D27D4EB4F
#: Null keys are the largest.
_NULL_KEY = (1 << 63) - 1
#: So many equal rows at most come from one row of the result at once.
COPIES = 1_000


class Batch:
    """The words of a batch's documents, in the order of key and text hash."""

    def __init__(self, table: pa.Table):
        keys = table.column("__key").combine_chunks().to_numpy()
        order = np.lexsort((table.column("__tie").combine_chunks().to_numpy(), keys))
        self.keys = keys[order]
        self.texts = table.column("__text").combine_chunks().cast(pa.large_string()).take(pa.array(order))
        self.order = order
        hashes, counts = [], []
        for _, part in text_slices(self.texts):
            t = Texts(part)
            hashes.append(t.word_hashes())
            counts.append(t.counts)
        self.words = np.concatenate([np.empty(0, np.uint64), *hashes])
        self.counts = np.concatenate([np.empty(0, np.int64), *counts])
        self.first = np.concatenate([[0], np.cumsum(self.counts)])

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """First words of all windows inside documents, and their documents."""
        room = np.maximum(self.counts - size + 1, 0)
        owner = np.repeat(np.arange(len(room)), room)
        return np.arange(len(owner)) + np.repeat(self.first[:-1] - (np.cumsum(room) - room), room), owner


def _packed(values: np.ndarray) -> bytes:
    return values.tobytes()


def _joined(column: pa.ChunkedArray, dtype: str) -> np.ndarray:
    return np.concatenate([np.empty(0, dtype), *(np.frombuffer(x.as_py(), dtype) for x in column)])


def _lengths(column: pa.ChunkedArray, width: int) -> np.ndarray:
    return pc.binary_length(column).to_numpy().astype(np.int64) // width


def _stretch_keys(batch: Batch, block: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All rolling stretches: first word, document, bucket in the high half with 32 more
    bits of the hash, and whether it is a block of its document."""
    at, owner = batch.windows(block)
    hashes = window_hashes(batch.words, at, block)
    keys = (hashes >> np.uint64(32)) % np.uint64(buckets) << np.uint64(32) | hashes & np.uint64(0xFFFFFFFF)
    return at, owner, keys, (at - batch.first[owner]) % block == 0


def _by_bucket(keys: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Bounds of each bucket's run in ascending keys."""
    high = (keys >> np.uint64(32)).astype(np.int64)
    cuts = np.flatnonzero(np.diff(high)) + 1
    for a, b in zip([0, *cuts], [*cuts, len(keys)]):
        if b > a:
            yield int(high[a]), a, b


def probes(table: pa.Table, block: int, buckets: int) -> pa.Table:
    """For each bucket the batch's distinct rolling stretches, those found more than once,
    and the distinct blocks."""
    batch_id = table.column("__batch")[0].as_py()
    _, _, keys, is_block = _stretch_keys(Batch(table), block, buckets)
    blocks = np.unique(keys[is_block])
    values, counts = np.unique(keys, return_counts=True)
    rows = []
    for bucket, a, b in _by_bucket(values):
        low, high = np.searchsorted(blocks, [np.uint64(bucket) << np.uint64(32), np.uint64(bucket + 1) << np.uint64(32)])
        rows.append(
            {
                "bucket": bucket, "__batch": batch_id, "probes": _packed(values[a:b].astype(np.uint32)),
                "often": _packed(np.packbits(counts[a:b] > 1)), "blocks": _packed(blocks[low:high].astype(np.uint32)),
            }
        )
    return pa.Table.from_pylist(rows, _PROBES)


_PROBES = pa.schema(
    [("bucket", pa.int32()), ("__batch", pa.int64()), ("probes", pa.binary()), ("often", pa.binary()), ("blocks", pa.binary())]
)
_HITS = pa.schema([("__batch", pa.int64()), ("bucket", pa.int32()), ("hits", pa.binary())])


def hits(table: pa.Table) -> pa.Table:
    """For each batch its stretches that equal a block and occur more than once at all."""
    blocks = np.unique(_joined(table.column("blocks"), "<u4"))
    values = [np.frombuffer(x.as_py(), "<u4") for x in table.column("probes")]
    often = [
        np.unpackbits(np.frombuffer(x.as_py(), np.uint8), count=len(v)) for x, v in zip(table.column("often"), values)
    ]
    found, seen = [], np.zeros(len(blocks), dtype=np.int64)
    for v, more in zip(values, often):
        own = np.flatnonzero(np.isin(v, blocks, assume_unique=True))
        found.append(v[own])
        seen[np.searchsorted(blocks, v[own])] += 1 + more[own]
    repeated = blocks[seen > 1]
    bucket = table.column("bucket")[0].as_py()
    rows = []
    for batch, v in zip(table.column("__batch"), found):
        own = v[np.isin(v, repeated, assume_unique=True)]
        if len(own):
            rows.append({"__batch": batch.as_py(), "bucket": bucket, "hits": _packed(own)})
    return pa.Table.from_pylist(rows, _HITS)


def _window_keys(batch: Batch, at: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """96 bits of each window."""
    return window_hashes(batch.words, at, window), (window_hashes(batch.words, at, window, _OTHER_STEP) >> np.uint64(32)).astype(np.uint32)


def _first_keys(k1: np.ndarray, k2: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order by window, in it the run of each entry, and each run's least key."""
    order = np.lexsort((k2, k1))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (k1[order][1:] != k1[order][:-1]) | (k2[order][1:] != k2[order][:-1])
    run = np.cumsum(new) - 1
    return order, run, np.minimum.reduceat(keys[order], np.flatnonzero(new)) if len(order) else keys[:0]


_WINDOWS = pa.schema(
    [("bucket", pa.int32()), ("__batch", pa.int64()), ("k1", pa.binary()), ("k2", pa.binary()), ("keys", pa.binary())]
)
_REMOVED = pa.schema([("__batch", pa.int64()), ("k1", pa.binary()), ("k2", pa.binary())])


def extended(docs: pa.Table, found: pa.Table, block: int, window: int, buckets: int) -> pa.Table:
    """The distinct windows around a batch's hits, each with the least document key."""
    if not docs.num_rows or not found.num_rows:
        return _WINDOWS.empty_table()
    batch = Batch(docs)
    at, owner, keys, _ = _stretch_keys(batch, block, buckets)
    told = np.concatenate(
        [
            np.frombuffer(h.as_py(), "<u4").astype(np.uint64) | np.uint64(b.as_py()) << np.uint64(32)
            for b, h in zip(found.column("bucket"), found.column("hits"))
        ]
    )
    hit = at[np.isin(keys, told)]
    # A window that holds the stretch from word p on begins at p + block - window ... p.
    near = np.zeros(len(batch.words) + window, dtype=np.int64)
    np.add.at(near, np.maximum(hit + block - window, 0), 1)
    np.add.at(near, hit + 1, -1)
    near = np.cumsum(near) > 0
    starts, owner = batch.windows(window)
    some = near[starts]
    starts, owner = starts[some], owner[some]
    k1, k2 = _window_keys(batch, starts, window)
    order, run, least = _first_keys(k1, k2, batch.keys[owner])
    firsts = order[np.flatnonzero(np.diff(run, prepend=-1))]
    k1, k2 = k1[firsts], k2[firsts]
    bucket = (k1 % np.uint64(buckets)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
    batch_id = docs.column("__batch")[0].as_py()
    rows = [
        {
            "bucket": i, "__batch": batch_id, "k1": _packed(k1[order[a:b]]), "k2": _packed(k2[order[a:b]]),
            "keys": _packed(least[order[a:b]]),
        }
        for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])) if b > a
    ]
    return pa.Table.from_pylist(rows, _WINDOWS)


def earlier(table: pa.Table) -> pa.Table:
    """For each batch its windows that begin in a document with a smaller key elsewhere."""
    k1, k2, keys = (_joined(table.column(c), d) for c, d in (("k1", "<u8"), ("k2", "<u4"), ("keys", "<i8")))
    batch = np.repeat(np.arange(table.num_rows), _lengths(table.column("k1"), 8))
    order, run, least = _first_keys(k1, k2, keys)
    late = np.zeros(len(k1), dtype=bool)
    late[order] = keys[order] > least[run]
    cuts = np.searchsorted(batch, np.arange(table.num_rows + 1))
    rows = [
        {"__batch": table.column("__batch")[i].as_py(), "k1": _packed(k1[a:b][late[a:b]]), "k2": _packed(k2[a:b][late[a:b]])}
        for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])) if late[a:b].any()
    ]
    return pa.Table.from_pylist(rows, _REMOVED)


def cleaned(docs: pa.Table, told: pa.Table, window: int, names: list[str], with_text: bool) -> pa.Table:
    """Each document's counts and what is left of it."""
    batch = Batch(docs)
    starts, owner = batch.windows(window)
    k1, k2 = _window_keys(batch, starts, window)
    remove = np.zeros(len(starts), dtype=bool)
    order, run, least = _first_keys(k1, k2, batch.keys[owner])
    remove[order] = batch.keys[owner][order] > least[run]
    if told.num_rows:
        t1, t2 = _joined(told.column("k1"), "<u8"), _joined(told.column("k2"), "<u4")
        by = np.argsort(t1, kind="stable")
        t1, t2 = t1[by], t2[by]
        low, high = np.searchsorted(t1, k1), np.searchsorted(t1, k1, side="right")
        single = high == low + 1
        remove[single] |= t2[low[single]] == k2[single]
        for i in np.flatnonzero(high > low + 1):  # windows that share 64 bits
            remove[i] |= k2[i] in t2[low[i] : high[i]]
    gone = covered(starts[remove], window, len(batch.words))
    removed = np.diff(np.concatenate([[0], np.cumsum(gone)])[batch.first])
    kept = []
    for i, text in enumerate(batch.texts):
        words = (text.as_py() or "").encode("utf-8", "replace").split()
        if removed[i]:
            inside = gone[batch.first[i] : batch.first[i + 1]]
            words = [words[j] for j in np.flatnonzero(~inside)]
        kept.append(b" ".join(words))
    columns = {n: docs.column(c).combine_chunks().take(pa.array(batch.order)) for n, c in zip(names, ("__id", "__copies"))}
    columns |= {
        "n_words": pa.array(batch.counts, pa.int64()), "n_removed": pa.array(removed, pa.int64()),
        "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string()),
    }
    if with_text:
        columns["kept_text"] = pa.array([x.decode() for x in kept], pa.string())
    return pa.table(columns)


def dealt(docs: DataFrame, batches: int, text: str, key: str) -> DataFrame:
    """The distinct documents with their batch and number of ``__copies``.

    Texts of one key are dealt apart, as they do not meet. Rows equal in key and text have
    the same result: where keys repeat, such rows are one."""
    rows = docs.select(
        docs[key].alias("__id"), F.coalesce(docs[key].cast("long"), F.lit(_NULL_KEY)).alias("__key"),
        F.coalesce(docs[text].cast("string"), F.lit("")).alias("__text"), F.lit(1).cast("long").alias("__copies"),
    )
    if not rows.groupBy("__id").count().filter("count > 1").isEmpty():
        same = rows.withColumn("__tid", F.md5("__text")).groupBy("__id", "__key", "__tid")
        rows = materialize(same.agg(F.first("__text").alias("__text"), F.count(F.lit(1)).alias("__copies")).drop("__tid"), "distinct")
    tied = rows.withColumn("__tie", F.xxhash64("__text"))
    return tied.withColumn("__batch", F.pmod(F.xxhash64("__key", "__tie"), F.lit(batches)))


def remove_repeats(docs: DataFrame, window: int = WINDOW, batch_bytes: int = BATCH_BYTES, bucket_words: int = BUCKET_WORDS,
                   with_text: bool = True, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key``, ``n_words``, ``n_removed``, ``kept_sha256`` and (if asked for) ``kept_text``,
    the words that stay, joined by one space.

    A word goes if a window of ``window`` words covers it whose words also follow one
    another in a document with a smaller key; windows are judged on the input. A null
    text has no words. Rows with equal keys do not remove each other's words; null keys
    are larger than all others. Texts shorter than a window stay. No rows give no rows.
    Windows are compared by 96 bits of hash.
    """
    block = window // 2
    total = docs.agg(F.sum(F.octet_length(docs[text].cast("string")))).first()[0] or 0
    batches, buckets = total // batch_bytes + 1, total // (6 * bucket_words) + 1
    id_kind = docs.schema[key].dataType.simpleString()
    rows = dealt(docs, batches, text, key)
    by_batch = rows.groupBy("__batch")
    probed = by_batch.applyInArrow(
        lambda t: probes(t, block, buckets), "bucket int, __batch long, probes binary, often binary, blocks binary"
    )
    found = probed.groupBy("bucket").applyInArrow(hits, "__batch long, bucket int, hits binary")
    windows = by_batch.cogroup(found.groupBy("__batch")).applyInArrow(
        lambda d, h: extended(d, h, block, window, buckets), "bucket int, __batch long, k1 binary, k2 binary, keys binary"
    )
    told = windows.groupBy("bucket").applyInArrow(earlier, "__batch long, k1 binary, k2 binary")
    names = [key, "__copies"]
    out = by_batch.cogroup(told.groupBy("__batch")).applyInArrow(
        lambda d, t: cleaned(d, t, window, names, with_text),
        f"`{key}` {id_kind}, __copies long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text,
    )
    if not rows.filter("__copies > 1").isEmpty():
        parts = out.withColumn("__from", F.explode(F.sequence(F.lit(1).cast("long"), "__copies", F.lit(COPIES).cast("long"))))
        if not rows.filter(F.col("__copies") > COPIES).isEmpty():
            parts = parts.repartition(batches)
        last = F.least(F.col("__copies"), F.col("__from") + COPIES - 1)
        out = parts.withColumn("__copy", F.explode(F.sequence("__from", last))).drop("__from", "__copy")
    return out.drop("__copies")
