"""Near-duplicate documents by consistent weighted sampling of TF-IDF shingles."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.components import components
from docloom.llm.order_minhash import _shingles
from docloom.llm.words import Texts, mix, text_slices
from docloom.scale import broadcast_if_small
from docloom.session import materialize

SHINGLE, SIMILARITY = 5, 0.8
#: At a similarity of 0.8, a pair shares some band of 3 samples of 10 with probability 0.9992.
BANDS, ROWS = 10, 3
#: Document frequencies are counted for classes of shingles by hash: a table of fixed size.
CLASSES = 1 << 16
#: A shingle's weight lies between 1 (in all documents) and 1 and this. Shingles that many
#: near copies share are frequent only because of the copies; a wide range would let the
#: few words that differ outweigh them.
IDF_RANGE = 0.25
_VARIATES = 1 << 16


class Sampler:
    """Tables for improved consistent weighted sampling: two Gamma(2, 1) variates for each
    16-bit number, and the logarithm of the second."""

    def __init__(self, idf: np.ndarray):
        self.idf = idf
        uniform = lambda salt: (mix(np.arange(_VARIATES, dtype=np.uint64) + np.uint64(salt << 32)) >> np.uint64(11)) / 2.0**53 + 2.0**-54
        self.r = -np.log(uniform(1)) - np.log(uniform(2))
        self.log_c = np.log(-np.log(uniform(3)) - np.log(uniform(4)))
        self.salts = mix(np.arange(1, 2 * BANDS * ROWS + 1, dtype=np.uint64)) | np.uint64(1)

    def weighted(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct shingles of a slice by text, their TF-IDF weights, and each text's first."""
        shingles, first = _shingles(Texts(texts), SHINGLE)
        owner = np.repeat(np.arange(len(texts)), np.diff(first))
        order = np.lexsort((shingles, owner))
        shingles, owner = shingles[order], owner[order]
        new = np.ones(len(order), dtype=bool)
        new[1:] = (shingles[1:] != shingles[:-1]) | (owner[1:] != owner[:-1])
        at = np.flatnonzero(new)
        count = np.diff([*at, len(order)])
        shingles = shingles[at]
        return shingles, count * self.idf[(shingles >> np.uint64(48)).astype(np.int64)], np.searchsorted(owner[at], np.arange(len(texts) + 1))

    def samples(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """A row of sample hashes for each text, and whether it has any shingle.

        Sample k of a text takes the shingle with the least a = c / (y e^r), where
        ln y = r (t - beta) and t = floor(ln weight / r + beta). The value of a tells
        shingle and t, so its bits are the sample.
        """
        shingles, weights, first = self.weighted(texts)
        lengths = np.diff(first)
        some = np.flatnonzero(lengths)
        out = np.zeros((len(texts), BANDS * ROWS), dtype=np.uint64)
        log_weight = np.log(weights)
        for k in range(BANDS * ROWS):
            h = (shingles ^ self.salts[2 * k]) * self.salts[2 * k + 1]
            h ^= h >> np.uint64(32)
            h *= np.uint64(0xD6E8FEB86659FD93)
            r = self.r[(h >> np.uint64(48)).astype(np.intp)]
            beta = (h & np.uint64(0xFFFFFFFF)) / 2.0**32
            t = np.floor(log_weight / r + beta)
            log_a = self.log_c[(h >> np.uint64(32) & np.uint64(0xFFFF)).astype(np.intp)] - r * (t - beta + 1)
            if len(some):
                out[some, k] = np.minimum.reduceat(log_a, first[some]).view(np.uint64)
        return mix(out), lengths > 0


def frequencies(texts: DataFrame) -> np.ndarray:
    """Inverse document frequencies of all shingle classes, over all texts (column ``text``)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, n = np.zeros(CLASSES, dtype=np.int64), 0
        for batch in batches:
            for _, part in text_slices(batch.column(0)):
                shingles, first = _shingles(Texts(part), SHINGLE)
                owner = np.repeat(np.arange(len(part), dtype=np.uint64), np.diff(first))
                seen = np.unique(owner * np.uint64(CLASSES) + (shingles >> np.uint64(48)))
                counts += np.bincount((seen % np.uint64(CLASSES)).astype(np.int64), minlength=CLASSES)
            n += batch.num_rows
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_pydict({"class": pa.array([-1, *some], pa.int32()), "n": pa.array([n, *counts[some]], pa.int64())})

    # One row a class, 65537 at most.
    table = texts.mapInArrow(run, "class int, n long").groupBy("class").agg(F.sum("n").alias("n")).toPandas()
    n = max(int(table.loc[table["class"] < 0, "n"].sum()), 1)
    table = table[table["class"] >= 0]
    df = np.ones(CLASSES)
    df[table["class"].to_numpy()] = table["n"].to_numpy()
    return 1 + IDF_RANGE * np.minimum(np.log(n / np.minimum(df, n)) / np.log(CLASSES), 1)


def classes(docs: DataFrame, similarity: float = SIMILARITY, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key``, ``class_id`` (least key of the class), ``class_size`` (rows), ``kept`` (one row a class).

    See ``classified``; rows with equal keys and texts share their verdict.
    """
    found = classified(docs, similarity, text, key)
    return found.select(F.col("key").alias(key), "class_id", "class_size", "kept")


def deduplicated(docs: DataFrame, similarity: float = SIMILARITY, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row of each class, with all columns of ``docs``: that with the least key, of
    equal ones the one whose text has the least digest, of repeated rows any one. Texts are
    shuffled only if the rows to drop are too many to send to all executors."""
    found = materialize(classified(docs, similarity, text, key), "classified")
    drop = found.filter("NOT kept").select(F.col("key").alias("__key"), F.col("tid").alias("__tid")).distinct()
    again = found.filter("kept").groupBy(F.col("key").alias("__key"), F.col("tid").alias("__tid")).count().filter("count > 1").drop("count")
    rows = docs.withColumn("__t", F.unhex(F.md5(F.coalesce(docs[text].cast("string"), F.lit("")))))
    own = lambda other: rows[key].eqNullSafe(other["__key"]) & (rows["__t"] == other["__tid"])
    drop, again = broadcast_if_small(drop), broadcast_if_small(materialize(again, "again"))
    kept = rows.join(drop, own(drop), "left_anti")
    if again.limit(1).count():
        own = lambda other: kept[key].eqNullSafe(other["__key"]) & (kept["__t"] == other["__tid"])
        once = kept.join(again, own(again), "left_semi").dropDuplicates([key, "__t"])
        kept = kept.join(again, own(again), "left_anti").unionByName(once)
    return kept.select(*docs.columns)


def classified(docs: DataFrame, similarity: float, text: str, key: str) -> DataFrame:
    """Every row's ``key``, ``tid`` (digest of its text), ``class_id``, ``class_size``, ``kept``.

    Two texts are linked if the weighted Jaccard similarity of their five-word shingles
    is ``similarity`` or more; classes are what links join, and equal texts. Weights are
    counts times an inverse document frequency over all rows. Candidates share a band
    of samples. In each band bucket all texts are first compared with two of its
    members, one of them the text with the least weight of shingles that no other has: a
    group of near copies is mostly joined by it. Texts of a bucket that these links leave
    apart are then compared with each other, but for pairs that the comparison with the hub
    and the shingles of their own rule out.

    A null text is an empty one. A text of fewer than five words has one shingle, all its
    words; without words it is like equal texts only. Null keys come last; rows with equal
    keys and texts share their verdict. No rows give no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(docs[key].alias("__key"), F.coalesce(docs[text].cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("tid", F.unhex(F.md5("text")))
    sampler = spark.sparkContext.broadcast(Sampler(frequencies(rows.select("text"))))

    def sign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, part in text_slices(batch.column(2)):
                values, some = sampler.value.samples(part)
                salt = mix(np.arange(BANDS, dtype=np.uint64))
                bands = mix(values.reshape(len(part), BANDS, ROWS).sum(axis=2, dtype=np.uint64) + salt).view(np.int64)
                sketch = (values & np.uint64(3)) << (np.arange(BANDS * ROWS, dtype=np.uint64) * np.uint64(2))
                ends = np.concatenate([[0], np.cumsum(some * BANDS)]).astype(np.int32)
                yield pa.RecordBatch.from_pydict(
                    {
                        "key": batch.column(0).slice(start, len(part)), "tid": batch.column(1).slice(start, len(part)),
                        "bands": pa.ListArray.from_arrays(pa.array(ends), pa.array(bands[some].ravel())),
                        "sketch": pa.array(np.bitwise_or.reduce(sketch, axis=1).view(np.int64)),
                    }
                )

    kind = docs.schema[key].dataType.simpleString()
    signed = rows.select("__key", "tid", "text").mapInArrow(sign, f"key {kind}, tid binary, bands array<long>, sketch long")
    signed = materialize(signed, "signatures")
    texts = signed.groupBy("tid").agg(F.min("key").alias("first"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    members = texts.select(F.explode("bands").alias("band"), "tid", "sketch", "first")
    by_hash = F.struct(F.xxhash64("tid").alias("h"), "tid")
    shared = members.groupBy("band").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("band")
    members = materialize(members.join(shared, "band"), "buckets")
    active = materialize(members.groupBy("tid").agg(F.min("first").alias("first")), "active")
    wanted = broadcast_if_small(active.withColumnRenamed("first", "__first"))
    bodies = rows.join(wanted, "tid").filter("__key <=> __first").select("tid", "text").dropDuplicates(["tid"])
    bodies = materialize(bodies, "bodies")
    members = materialize(members.drop("first").join(own_weights(bodies, sampler), "tid"), "weighed")
    hubs = members.groupBy("band").agg(
        F.min(F.struct((F.col("own") / F.col("total")).alias("share"), "tid"))["tid"].alias("hub"), F.min("tid").alias("hub2")
    )

    stars = members.join(hubs, "band").select("tid", F.explode(F.array("hub", "hub2")).alias("other")).filter("tid <> other")
    stars = stars.select(F.least("tid", "other").alias("a"), F.greatest("tid", "other").alias("b")).distinct()
    tested = materialize(compared(stars, bodies, sampler, with_rest=True), "stars")
    links = tested.filter(F.col("similarity") >= similarity).select("a", "b")
    roots = components(links)
    placed = members.join(roots.withColumnRenamed("node", "tid"), "tid", "left")
    placed = placed.withColumn("root", F.coalesce("root", "tid"))
    parted = placed.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("n"))
    open_ = placed.join(parted.filter("low <> high AND n > 2").select("band"), "band")
    # What each shares with the hub of its bucket is known; the hub shares all it has.
    known = open_.join(hubs, "band").withColumn("a", F.least("tid", "hub")).withColumn("b", F.greatest("tid", "hub"))
    known = known.join(tested.drop("similarity"), ["a", "b"], "left").withColumn("common", F.coalesce("common", "total"))
    known = known.withColumn("apart", F.when(F.col("tid") == F.col("a"), F.col("only_a")).otherwise(F.col("only_b")))
    open_ = known.withColumn("other", F.greatest(F.col("total") - F.col("common") - F.col("own"), F.lit(0.0)))
    open_ = materialize(open_.select("band", "tid", "sketch", "root", "total", "common", "other", "apart"), "open")
    left, right = (open_.select("band", *[F.col(c).alias(c + x) for c in ("tid", "sketch", "root", "total", "common", "other", "apart")]) for x in "ab")
    # Samples agree in two bits by chance in one of four cases; more than 14 of 30 that
    # differ have a probability below 0.0001 at a similarity of 0.8.
    differ = F.col("sketcha").bitwiseXOR(F.col("sketchb"))
    differ = F.bit_count(differ.bitwiseOR(F.shiftrightunsigned(differ, 1)).bitwiseAND(F.lit(0x5555555555555555)))
    # Two texts share at most what both share with the hub, and of the remainder at most
    # what is not either's own; nothing of it, if they have no shingle that the hub lacks.
    need = similarity * (F.col("totala") + F.col("totalb")) / (1 + similarity) - 1e-6
    within = F.least("commona", "commonb")
    meet = F.coalesce(F.arrays_overlap("aparta", "apartb"), F.lit(False))
    close = (within + F.least("othera", "otherb") >= need) & ((within >= need) | meet)
    rest = left.join(right, (left["band"] == right["band"]) & (F.col("tida") < F.col("tidb")) & (F.col("roota") != F.col("rootb")) & (differ <= 14) & close)
    rest = rest.select(F.col("tida").alias("a"), F.col("tidb").alias("b")).distinct().join(stars, ["a", "b"], "left_anti")
    more = compared(rest, bodies, sampler).filter(F.col("similarity") >= similarity).select("a", "b")
    more = materialize(more, "links")
    if more.limit(1).count():
        roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))
    rooted = signed.select("key", "tid").join(roots.withColumnRenamed("node", "tid"), "tid", "left")
    rooted = rooted.withColumn("root", F.coalesce("root", "tid"))
    # Rows are counted before they meet: a class may hold a third of them.
    per_text = rooted.groupBy("root", "tid").agg(F.min("key").alias("low"), F.count(F.lit(1)).alias("n"))
    heads = per_text.groupBy("root").agg(
        F.min("low").alias("class_id"), F.sum("n").alias("class_size"),
        F.min(F.struct(F.col("low").isNull().alias("none"), F.col("low").alias("low"), "tid"))["tid"].alias("head"),
    )
    named = per_text.join(heads, "root").select("tid", "class_id", "class_size", "low", (F.col("tid") == F.col("head")).alias("head"))
    return (
        signed.select("key", "tid").join(named, "tid")
        .select("key", "tid", "class_id", "class_size", (F.col("head") & F.col("key").eqNullSafe(F.col("low"))).alias("kept"))
    )


def own_weights(bodies: DataFrame, sampler) -> DataFrame:
    """``tid``, ``total`` weight of the text's shingles and weight of its ``own``, which
    no other of the texts has."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, part in text_slices(batch.column(1)):
                shingles, weights, first = sampler.value.weighted(part)
                ids = np.repeat(batch.column(0).slice(start, len(part)).to_numpy(), np.diff(first))
                yield pa.RecordBatch.from_pydict(
                    {"id": pa.array(ids), "shingle": pa.array(shingles.view(np.int64)), "weight": pa.array(weights, pa.float64())}
                )

    named = bodies.select(F.xxhash64("tid").alias("id"), "text")
    shingles = materialize(named.mapInArrow(run, "id long, shingle long, weight double"), "shingles")
    single = shingles.groupBy("shingle").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id"), F.min("weight").alias("weight"))
    own = single.filter("n = 1").groupBy("id").agg(F.sum("weight").alias("own"))
    total = shingles.groupBy("id").agg(F.sum("weight").alias("total"))
    both = total.join(own, "id", "left").select("id", "total", F.coalesce("own", F.lit(0.0)).alias("own"))
    return bodies.select("tid", F.xxhash64("tid").alias("id")).join(both, "id").drop("id")


def compared(pairs: DataFrame, bodies: DataFrame, sampler, with_rest: bool = False) -> DataFrame:
    """The pairs (``a``, ``b``) with their ``common`` weight and weighted Jaccard
    ``similarity``, and if asked for the shingles that only one has (``only_a``, ``only_b``)."""
    one = bodies.select(F.col("tid").alias("a"), F.col("text").alias("text_a"))
    two = bodies.select(F.col("tid").alias("b"), F.col("text").alias("text_b"))
    full = pairs.join(one, "a").join(two, "b").select("a", "b", "text_a", "text_b")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                some = batch.slice(start, 256)
                a, b = some.column(0).to_pylist(), some.column(1).to_pylist()
                text = dict(zip(a, some.column(2).to_pylist())) | dict(zip(b, some.column(3).to_pylist()))
                parts = {}
                names = list(text)
                for begin, part in text_slices(pa.array([text[x] for x in names], pa.large_string())):
                    shingles, weights, first = sampler.value.weighted(part)
                    for i, (lo, hi) in enumerate(zip(first[:-1], first[1:])):
                        parts[names[begin + i]] = shingles[lo:hi], weights[lo:hi]
                common = np.array([_common(parts[x], parts[y]) for x, y in zip(a, b)], dtype=np.float64)
                total = np.array([parts[x][1].sum() + parts[y][1].sum() for x, y in zip(a, b)], dtype=np.float64)
                columns = {"a": some.column(0), "b": some.column(1), "common": pa.array(common), "similarity": pa.array(_ratio(common, total))}
                if with_rest:
                    columns["only_a"] = pa.array([_only(parts[x], parts[y]) for x, y in zip(a, b)], pa.list_(pa.int64()))
                    columns["only_b"] = pa.array([_only(parts[y], parts[x]) for x, y in zip(a, b)], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_pydict(columns)

    rest = ", only_a array<long>, only_b array<long>" * with_rest
    return full.mapInArrow(run, "a binary, b binary, common double, similarity double" + rest)


def _ratio(common, total):
    """Weighted Jaccard similarity; rounded, so that 0.8 is reached whatever the order of sums."""
    return np.round(common / np.maximum(total - common, 1e-12), 9)


def _common(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> float:
    """Of two ascending lists of shingles with weights."""
    (xs, xw), (ys, yw) = x, y
    if not len(xs) or not len(ys):
        return 0.0
    at = np.minimum(np.searchsorted(ys, xs), len(ys) - 1)
    same = ys[at] == xs
    return float(np.minimum(xw[same], yw[at[same]]).sum())


def _only(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Shingles of x that y lacks, or has with less weight."""
    (xs, xw), (ys, yw) = x, y
    if not len(ys):
        return xs.view(np.int64)
    at = np.minimum(np.searchsorted(ys, xs), len(ys) - 1)
    return xs[(ys[at] != xs) | (yw[at] < xw)].view(np.int64)


def weighted_jaccard(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> float:
    return float(_ratio(_common(x, y), x[1].sum() + y[1].sum()))
