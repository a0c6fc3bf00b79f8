"""Document fingerprints by order MinHash, sensitive to edit distance."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.llm.words import Texts, mix, range_hashes, text_slices, window_hashes, _STEP
from docloom.scale import broadcast_if_small
from docloom.session import materialize

#: Words in a k-mer, k-mers in a tuple, tuples in a signature.
K, PER_TUPLE, TUPLES = 3, 2, 64
_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def _shingles(t: Texts, k: int) -> tuple[np.ndarray, np.ndarray]:
    """k-mer hashes of all texts in text order, and each text's first one. A text of fewer
    than k words has one k-mer, all its words."""
    words = t.word_hashes()
    at = t.windows(k)
    room = np.where(t.counts > 0, np.maximum(t.counts - k + 1, 1), 0)
    first = np.concatenate([[0], np.cumsum(room)])
    out = np.empty(int(first[-1]), dtype=np.uint64)
    short = (t.counts > 0) & (t.counts < k)
    alone = first[:-1][short]
    rest = np.ones(len(out), dtype=bool)
    rest[alone] = False
    out[rest] = window_hashes(words, at, k)
    out[alone] = range_hashes(words, t.first[:-1][short], t.first[1:][short], _STEP, 1 << 18)
    return out, first


def _numbered(kmers: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """k-mers with the number of their occurrence in the text."""
    keys = kmers ^ mix(owner.astype(np.uint64) + np.uint64(1))
    order = np.argsort(keys, kind="stable")
    run = np.ones(len(keys), dtype=bool)
    run[1:] = keys[order][1:] != keys[order][:-1]
    starts = np.flatnonzero(run)
    number = np.empty(len(keys), dtype=np.uint64)
    number[order] = np.arange(len(keys)) - np.repeat(starts, np.diff([*starts, len(keys)]))
    return mix(kmers + number * np.uint64(0xA0761D6478BD642F))


def signatures(texts: pa.Array, k: int = K, tuples: int = TUPLES) -> np.ndarray:
    """One row of ``tuples`` 16-bit numbers for each text of a slice. For each of them a
    hash orders the numbered k-mers; the two least are put in text order and hashed. A
    text without words has zeros, one with a single k-mer takes it twice."""
    t = Texts(texts)
    out = np.zeros((t.n, tuples), dtype="<u2")
    kmers, first = _shingles(t, k)
    some = np.flatnonzero(np.diff(first) > 0)
    if not len(some):
        return out
    starts, lengths = first[some], np.diff(first)[some]
    numbered = _numbered(kmers, np.repeat(some, lengths))
    salts = mix(np.arange(1, 2 * tuples + 1, dtype=np.uint64)) | np.uint64(1)

    def least(x: np.ndarray) -> np.ndarray:
        hits = np.flatnonzero(x == np.repeat(np.minimum.reduceat(x, starts), lengths))
        return hits[np.searchsorted(hits, starts)]

    for i in range(tuples):
        x = (numbered ^ salts[i]) * salts[tuples + i]
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        one = least(x)
        x[one] = _FULL
        two = np.where(lengths > 1, least(x), one)
        pair = mix(kmers[np.minimum(one, two)] * np.uint64(3) + mix(kmers[np.maximum(one, two)]))
        out[some, i] = pair >> np.uint64(48)
    return out


def fingerprints(texts: list[str]) -> np.ndarray:
    if not texts:
        return np.zeros((0, TUPLES), dtype="<u2")
    return np.concatenate([signatures(x) for _, x in text_slices(pa.array(texts, pa.large_string()))])


def edited(text: str, following: str) -> str:
    """The last half of the code points gives way to the first ones of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def chunked(docs: DataFrame, rows_per_chunk: int) -> DataFrame:
    """Adds ``__chunk``, ascending with the key: between rough quantiles of it, equal steps."""
    spread = 64
    low, high, n, cuts = docs.agg(
        F.min("__key"), F.max("__key"), F.count(F.lit(1)),
        F.percentile_approx("__key", F.array(*[F.lit(i / spread) for i in range(1, spread)]), 1000),
    ).first()
    edges = sorted({low or 0, *(cuts or []), high or 0})
    steps = -(-(n or 1) // (rows_per_chunk * spread))
    chunk = F.lit(0).cast("long")
    for i, (a, b) in enumerate(zip(edges, [*edges[1:], edges[-1] + 1])):
        width = max(1, -(-(b - a) // steps))
        chunk = F.when(F.col("__key") >= a, F.lit(i * steps) + F.expr(f"(__key - {a}L) div {width}L")).otherwise(chunk)
    if n and n <= rows_per_chunk * spread:  # fewer chunks than quantiles
        chunk = F.expr("0L") + F.floor(chunk * F.lit(-(-n // rows_per_chunk)) / F.lit(len(edges)))
    return docs.withColumn("__chunk", chunk.cast("long"))


def with_following(docs: DataFrame, rows_per_chunk: int) -> DataFrame:
    """Rows sorted by descending key inside chunks; a chunk ends with a copy of the row
    that follows it, marked ``__head``."""
    rows = chunked(docs, rows_per_chunk)
    order = F.struct("__key", "__tie")
    lasts = rows.groupBy("__chunk").agg(F.max(order).alias("top"))
    # One row a chunk.
    every = Window.orderBy("__chunk")
    lasts = materialize(
        lasts.select(
            F.col("top.__key").alias("__key"), F.col("top.__tie").alias("__tie"),
            F.coalesce(F.lead("__chunk").over(every), F.min("__chunk").over(Window.partitionBy())).alias("to"),
        ),
        "heads",
    )
    heads = rows.join(broadcast_if_small(lasts), ["__key", "__tie"]).select(*docs.columns, F.col("to").alias("__chunk"))
    both = rows.withColumn("__head", F.lit(False)).unionByName(heads.withColumn("__head", F.lit(True)))
    return both.repartition("__chunk").sortWithinPartitions(
        "__chunk", "__head", F.col("__key").desc(), F.col("__tie").desc()
    )


def fingerprint_pairs(docs: DataFrame, text: str = "text", key: str = "doc_id", rows_per_chunk: int = 5_000) -> DataFrame:
    """Fingerprints of every text and of its edited form, in which the last half of its
    code points gives way to the beginning of the next document by descending key (after
    the last one: the first): ``key``, ``n_chars``, ``edited_sha256``, ``fingerprint``,
    ``edited_fingerprint``, ``near_edited``, ``near_next``.

    A likeness is the share of equal numbers in two signatures. A null text is an empty
    one; texts without words have equal fingerprints. Null keys come last; rows with
    equal keys follow one another by a hash of the text. A single document is its own
    next one. Texts are shuffled once, into chunks of neighbouring keys.
    """
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(
        docs[key].alias("__id"), F.coalesce(docs[key].cast("long"), F.lit(-(1 << 62))).alias("__key"),
        F.coalesce(docs[text].cast("string"), F.lit("")).alias("__text"),
    )
    rows = rows.withColumn("__tie", F.xxhash64("__text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*(column.to_pylist() for column in batch.columns)):
                held.append(row)
                size += len(row[3])
                if size > 1 << 20 and len(held) > 1:
                    yield _pairs(held, kind_of_key)
                    held, size = held[-1:], len(row[3])
        if len(held) > 1:
            yield _pairs(held, kind_of_key)

    kind_of_key = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]
    sorted_rows = with_following(rows, rows_per_chunk).select("__chunk", "__head", "__id", "__text")
    out = sorted_rows.mapInArrow(
        run,
        f"key {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double",
    )
    return out.withColumnRenamed("key", key)


def _pairs(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    """Results of all rows but the last one and the copies that end chunks; each row's
    next document stands after it."""
    own = [i for i, row in enumerate(rows[:-1]) if not row[1]]
    texts = [row[3] for row in rows]
    changed = [edited(texts[i], texts[i + 1]) for i in own]
    prints, changed_prints = fingerprints(texts), fingerprints(changed)
    here = np.array(own, dtype=np.int64)
    hexes = [x.tobytes().hex() for x in prints[here]]
    return pa.RecordBatch.from_pydict(
        {
            "key": pa.array([rows[i][2] for i in own], kind),
            "n_chars": pa.array([len(texts[i]) for i in own], pa.int64()),
            "edited_sha256": pa.array([hashlib.sha256(x.encode("utf-8", "replace")).hexdigest() for x in changed], pa.string()),
            "fingerprint": pa.array(hexes, pa.string()),
            "edited_fingerprint": pa.array([x.tobytes().hex() for x in changed_prints], pa.string()),
            "near_edited": pa.array((prints[here] == changed_prints).mean(axis=1), pa.float64()),
            "near_next": pa.array((prints[here] == prints[here + 1]).mean(axis=1), pa.float64()),
        }
    )
