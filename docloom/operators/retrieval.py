"""Sparse and dense retrieval for whole batches of queries."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from docloom import scale
from docloom.functions import text as tx
from docloom.functions import vectors as vx
from docloom.operators.ranking import top_k
from docloom.session import materialize

# Okapi parameters with a floor for negative idf.
K1, B, EPSILON = 1.5, 0.75, 0.25
SCORE_DIGITS = 6


# --- sparse index ----------------------------------------------------------------
def term_frequencies(tokens) -> Column:
    """ARRAY<STRUCT<term, tf>>: run lengths of the sorted tokens, in the row."""

    def runs(ordered: Column) -> Column:
        n = F.size(ordered)
        starts = F.filter(
            F.sequence(F.lit(0), n - 1),
            lambda i: (i == 0) | (F.get(ordered, i) != F.get(ordered, F.greatest(i - 1, F.lit(0)))),
        )
        return tx.bind(
            starts,
            lambda s: F.transform(
                s,
                lambda at, k: F.struct(
                    F.get(ordered, at).alias("term"), (F.coalesce(F.get(s, k + 1), n) - at).alias("tf")
                ),
            ),
        )

    return tx.bind(F.sort_array(tx._c(tokens)), lambda o: F.when(F.size(o) > 0, runs(o)))


def postings(units: DataFrame, unit_id: str = "chunk_id", text: str = "content") -> DataFrame:
    """term, id, tf, dl: the sparse index. A unit is one row, so counting its
    terms needs no shuffle."""
    tokens = units.select(F.col(unit_id).alias("id"), tx.tokenize(text).alias("_t"))
    counted = tokens.select("id", F.size("_t").alias("dl"), term_frequencies("_t").alias("_p"))
    return counted.select("id", "dl", F.explode("_p").alias("p")).select(
        F.col("p.term").alias("term"), "id", F.col("p.tf").alias("tf"), "dl"
    )


def unit_lengths(units: DataFrame, unit_id: str = "chunk_id", text: str = "content") -> DataFrame:
    return units.select(F.col(unit_id).alias("id"), F.size(tx.tokenize(text)).alias("dl"))


def term_statistics(index: DataFrame) -> DataFrame:
    return index.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def add_units(index: DataFrame, units: DataFrame, **columns: str) -> DataFrame:
    return index.unionByName(postings(units, **columns))


def remove_units(index: DataFrame, doomed: DataFrame) -> DataFrame:
    """Index without the given ids."""
    return index.join(doomed, "id", "left_anti")


#: Units in a block of the index.
BLOCK_UNITS = 128
#: Postings of a query's rarest terms that are scored to find its threshold.
SEED_POSTINGS = 2000
#: Scores are rounded, so bounds this close below a threshold may still reach it.
SLACK = 4e-6


class SparseIndex(NamedTuple):
    """A stored index, a row for each unit: ``units`` (id, dl, block, terms), also those without
    a term. A block is a run of units as they are stored."""

    units: DataFrame

    @property
    def postings(self) -> DataFrame:
        """term, id, tf, dl, block."""
        unfolded = self.units.select("id", "dl", "block", F.explode("terms").alias("p"))
        return unfolded.select(F.col("p.term").alias("term"), "id", F.col("p.tf").alias("tf"), "dl", "block")

    @property
    def lengths(self) -> DataFrame:
        return self.units.select("id", "dl")

    def add(self, units: DataFrame, unit_id: str = "chunk_id", text: str = "content") -> SparseIndex:
        # Blocks of both share numbers; what bounds their union bounds each.
        return SparseIndex(self.units.unionByName(build_index(units, unit_id, text).units))

    def remove(self, doomed: DataFrame) -> SparseIndex:
        """Without the units whose ``id`` is given."""
        return SparseIndex(remove_units(self.units, doomed))


def build_index(units: DataFrame, unit_id: str = "chunk_id", text: str = "content") -> SparseIndex:
    """Reads and splits every text once. A unit's terms and length are stored in its row;
    postings are these rows unfolded, so writing the index shuffles nothing. Blocks are
    numbered while the index is written, so they stay what they are."""
    tokens = units.select(F.col(unit_id).alias("id"), tx.tokenize(text).alias("_t"))
    block = F.shiftright(F.monotonically_increasing_id(), BLOCK_UNITS.bit_length() - 1)
    numbered = tokens.select("id", F.size("_t").alias("dl"), "_t", block.alias("block"))
    kind = units.schema[unit_id].dataType.simpleString()
    counted = numbered.mapInArrow(_count_terms, f"id {kind}, dl int, terms array<struct<term: string, tf: int>>, block long")
    return SparseIndex(materialize(counted, "postings"))


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each unit's tokens as its terms in order with their numbers, like ``term_frequencies``."""
    for batch in batches:
        tokens = batch.column(2)
        unit = np.repeat(np.arange(batch.num_rows), pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False))
        coded = tokens.flatten().dictionary_encode()
        by, n = pc.sort_indices(coded.dictionary), max(len(coded.dictionary), 1)
        rank = np.empty(len(by), dtype=np.int64)
        rank[by.to_numpy()] = np.arange(len(by))
        both, tf = np.unique(unit * n + rank[coded.indices.to_numpy()], return_counts=True)
        held = np.bincount(both // n, minlength=batch.num_rows)
        pairs = pa.StructArray.from_arrays([coded.dictionary.take(by).take(pa.array(both % n)), pa.array(tf, pa.int32())], names=["term", "tf"])
        ends = pa.array(np.concatenate([[0], np.cumsum(held)]), pa.int32())
        terms = pa.ListArray.from_arrays(ends, pairs, mask=pa.array(held == 0))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), terms, batch.column(3)], names=["id", "dl", "terms", "block"])


def bm25(queries: DataFrame, units: DataFrame, k: int | None = 10, unit_id: str = "chunk_id",
         text: str = "content") -> DataFrame:
    """Build the index of the units, then search it."""
    index = build_index(units, unit_id, text)
    return search_index(queries, index.postings, index.lengths, k) if k is None else search_units(queries, index, k)


def query_weights(queries: DataFrame, index: DataFrame, lengths: DataFrame) -> DataFrame:
    """query_id, term, w, df: the weight of each query term that some unit has."""
    n = lengths.agg(F.count("*").alias("n")).select("n").scalar()
    stats = materialize(term_statistics(index).drop("cf"), "terms")
    raw_idf = F.log(n - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    mean_idf = stats.agg(F.avg(raw_idf).alias("m")).scalar()
    asked = queries.select("query_id", F.explode(tx.tokenize("query")).alias("term")).groupBy("query_id", "term").agg(
        F.count("*").alias("qf")
    )
    terms = scale.broadcast_if_small(asked.select("term").distinct())
    idf = stats.join(terms, "term", "left_semi").select(
        "term", "df", F.when(raw_idf < 0, EPSILON * mean_idf).otherwise(raw_idf).alias("idf")
    )
    return asked.join(idf, "term").select("query_id", "term", (F.col("qf") * F.col("idf")).alias("w"), "df")


def impact(tf, dl, avgdl: Column) -> Column:
    """What a posting adds to a score for each unit of weight; grows with tf, falls with dl."""
    tf, dl = tx._c(tf), tx._c(dl)
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))


def _scores(matched: DataFrame, avgdl: Column) -> DataFrame:
    """query_id, id, score from postings with the weights of the queries that ask for them."""
    total = F.sum(F.col("w") * impact("tf", "dl", avgdl))
    return matched.groupBy("query_id", "id").agg(F.round(total, SCORE_DIGITS).alias("score"))


def thresholds(weights: DataFrame, index: DataFrame, avgdl: Column, k: int, seeds: int = SEED_POSTINGS) -> DataFrame:
    """query_id, floor: a score that k units of the query reach for certain.

    The rarest terms of a query, up to ``seeds`` postings in all and one term at least, name
    likely units; the best k of these are scored by all terms, and the least of these
    scores is the floor. Queries with fewer such units have none.
    """
    rarest = Window.partitionBy("query_id").orderBy("df", "term").rowsBetween(Window.unboundedPreceding, 0)
    order = Window.partitionBy("query_id").orderBy("df", "term")
    numbered = weights.withColumns({"_sum": F.sum("df").over(rarest), "_n": F.row_number().over(order)})
    chosen = numbered.filter((F.col("_sum") <= seeds) | (F.col("_n") == 1)).select("query_id", "term", "w")
    likely = top_k(_scores(index.join(scale.broadcast_if_small(chosen), "term"), avgdl), k).select("query_id", "id")
    likely = scale.broadcast_if_small(likely)
    # A likely unit's postings, with the weights of the query that it is likely for.
    whole = index.join(likely, "id").join(weights.select("query_id", "term", "w"), ["query_id", "term"])
    exact = _scores(whole, avgdl).filter("score > 0")
    return exact.groupBy("query_id").agg(F.min("score").alias("floor"), F.count("*").alias("_n")).filter(F.col("_n") >= k).drop("_n")


def search_index(queries: DataFrame, index: DataFrame, lengths: DataFrame, k: int | None = 10) -> DataFrame:
    """query_id, id, score, rnk for every query at once; scores must be positive.

    ``index`` is (term, id, tf, dl, and block if it was built with blocks), ``lengths``
    (id, dl) of all units, also those without a term. With k, most units are never scored:

    1. the rarest terms of each query give a score that k units reach for certain;
    2. each block has its largest tf and least dl of each term, from which the best score
       that any of its units could have for a query follows;
    3. only blocks that could reach the threshold of a query are scored for it.

    The result is exact. Scores of all units (k None) are summed without these steps.
    Small query sets are broadcast after a size check.
    """
    avgdl = lengths.agg(F.avg("dl").alias("avgdl")).scalar()
    weights = query_weights(queries, index, lengths)
    if k is None:
        return _scores(index.join(scale.broadcast_if_small(weights), "term"), avgdl).filter("score > 0")
    weights = materialize(weights, "weights")
    if "block" not in index.columns:
        blocks = F.greatest(F.ceil(lengths.agg(F.count("*").alias("n")).scalar() / BLOCK_UNITS), F.lit(1))
        index = index.withColumn("block", F.pmod(F.xxhash64("id"), blocks))
    terms = scale.broadcast_if_small(weights.select("term").distinct())
    hits = index.join(terms, "term", "left_semi")
    sent = scale.broadcast_if_small(weights.drop("df"))
    largest = hits.groupBy("term", "block").agg(F.max("tf").alias("tf"), F.min("dl").alias("dl"))
    most = F.sum(F.greatest("w", F.lit(0.0)) * impact("tf", "dl", avgdl))
    bounds = largest.join(sent, "term").groupBy("query_id", "block").agg(most.alias("most"))
    floors = thresholds(weights, hits, avgdl, k)
    could = bounds.join(scale.broadcast_if_small(materialize(floors, "floors")), "query_id", "left").filter(
        F.col("floor").isNull() | (F.col("most") >= F.col("floor") - SLACK)
    )
    open_blocks = materialize(could.select("query_id", "block"), "blocks")
    # A query meets a block's postings by its terms there.
    asked = open_blocks.join(sent, "query_id")
    scores = _scores(hits.join(scale.broadcast_if_small(asked), ["term", "block"]), avgdl).filter("score > 0")
    return top_k(scores, k)


# --- sparse search in blocks ---------------------------------------------------------
#: Queries whose weights a pass over the index carries, and queries of a dense block.
PASS_QUERIES, DENSE_QUERIES = 4096, 256


class _Best:
    """The k best units of each query so far, and the score that a unit must reach."""

    def __init__(self, queries: int, k: int, kind: pa.DataType):
        self.k, self.floor = k, np.full(queries, 10.0**-SCORE_DIGITS)
        self.rows = pa.table({"q": pa.array([], pa.int64()), "score": pa.array([], pa.float64()), "id": pa.array([], kind)})

    def offer(self, q: np.ndarray, score: np.ndarray, ids: pa.Array) -> None:
        rows = pa.concat_tables([self.rows, pa.table({"q": pa.array(q, pa.int64()), "score": score, "id": ids})]).combine_chunks()
        rows = rows.take(pc.sort_indices(rows, [("q", "ascending"), ("score", "descending"), ("id", "ascending")]))
        of = rows.column("q").to_numpy()
        heads = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))[: len(of)]
        place = np.arange(len(of)) - np.repeat(heads, np.diff(np.append(heads, len(of))))
        self.rows = rows.filter(pa.array(place < self.k))
        last = place == self.k - 1
        self.floor[of[last]] = rows.column("score").to_numpy()[last]


def _block_scores(q: np.ndarray, term: np.ndarray, w: np.ndarray, names: pa.Array, query_ids: pa.Array, avgdl: float, k: int,
                  kind: pa.DataType):
    """Score stored units (id, dl, terms) for all queries of a pass, a block of units by a block
    of queries at a time. A block of units is left out for the queries for which the sum of
    its best postings cannot reach what k units have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(query_ids)
        best = _Best(n, k, kind)
        dense = []
        for lo in range(0, n, DENSE_QUERIES):
            mine = (q >= lo) & (q < lo + DENSE_QUERIES)
            own, at = np.unique(term[mine], return_inverse=True)
            matrix = np.zeros((len(own) + 1, min(DENSE_QUERIES, n - lo)))
            matrix[at, q[mine] - lo] = w[mine]
            place = np.full(len(names), len(own))
            place[own] = np.arange(len(own))
            dense.append((lo, matrix, place))
        for batch in batches:
            ids, terms = batch.column(0), batch.column(2)
            units = np.repeat(np.arange(batch.num_rows), pc.fill_null(pc.list_value_length(terms), 0).to_numpy(zero_copy_only=False))
            flat = terms.flatten()
            known = pc.index_in(flat.field("term"), names)
            found = np.flatnonzero(known.is_valid().to_numpy(zero_copy_only=False))
            units, which = units[found], known.fill_null(0).to_numpy()[found].astype(np.int64)
            tf, dl = flat.field("tf").to_numpy()[found].astype(float), batch.column(1).to_numpy()[units]
            strength = tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))
            cuts = np.searchsorted(units, np.arange(0, batch.num_rows + BLOCK_UNITS, BLOCK_UNITS))
            for a, b in zip(cuts[:-1], cuts[1:]):
                if a == b:
                    continue
                # A small matrix of the block's units by its terms; a term stands once in a unit.
                rows, unit = np.unique(units[a:b], return_inverse=True)
                own, term_at = np.unique(which[a:b], return_inverse=True)
                held = np.zeros((len(rows), len(own)))
                held[unit, term_at] = strength[a:b]
                largest = held.max(axis=0)
                for lo, matrix, place in dense:
                    floor = best.floor[lo : lo + matrix.shape[1]]
                    part = matrix[place[own]]
                    could = np.flatnonzero(largest @ np.maximum(part, 0) >= floor - SLACK)
                    if not len(could):
                        continue
                    scores = np.round(held @ (part if len(could) == part.shape[1] else part[:, could]), SCORE_DIGITS)
                    at, col = np.nonzero(scores >= floor[could])
                    if len(at):
                        best.offer(lo + could[col], scores[at, col], ids.take(pa.array(rows[at])))
        rows = best.rows
        if rows.num_rows:
            yield pa.RecordBatch.from_arrays(
                [query_ids.take(rows.column("q").combine_chunks()), rows.column("id").combine_chunks(), rows.column("score").combine_chunks()],
                names=["query_id", "id", "score"],
            )

    return run


def search_units(queries: DataFrame, index: SparseIndex, k: int = 10) -> DataFrame:
    """query_id, id, score, rnk for every query at once, exact; scores must be positive.

    A task turns its units into blocks and multiplies them with blocks of queries, so of
    each query only the k best units of a task become rows. Weights are sent for
    ``PASS_QUERIES`` queries at a time: a set of queries beyond that takes several passes.
    """
    weights = materialize(query_weights(queries, *_parts(index)).select("query_id", "term", "w"), "weights")
    avgdl = index.lengths.agg(F.avg("dl")).first()[0] or 1.0
    number = materialize(ranked_ids(weights.select("query_id").distinct()), "queries")
    passes = -(-number.count() // PASS_QUERIES)
    kinds = [f"query_id {queries.schema['query_id'].dataType.simpleString()}", f"id {index.units.schema['id'].dataType.simpleString()}"]
    id_kind = to_arrow_type(index.units.schema["id"].dataType)
    stored = index.units.select("id", "dl", "terms")
    found = [stored.sparkSession.createDataFrame([], ", ".join([*kinds, "score double"]))]
    for p in range(passes):
        mine = number.filter(F.floor(F.col("_q") / PASS_QUERIES) == p)
        held = weights.join(F.broadcast(mine), "query_id").select("query_id", "_q", "term", "w").toArrow()  # of PASS_QUERIES queries
        ids, q = np.unique(held["_q"].to_numpy(), return_index=True)
        names = held["term"].combine_chunks().dictionary_encode()
        run = _block_scores(
            np.searchsorted(ids, held["_q"].to_numpy()), names.indices.to_numpy().astype(np.int64), held["w"].to_numpy(), names.dictionary,
            held["query_id"].combine_chunks().take(pa.array(q)), avgdl, k, id_kind,
        )
        found.append(stored.mapInArrow(run, ", ".join([*kinds, "score double"])))
    return top_k(reduce(DataFrame.unionAll, found), k)


def _parts(index: SparseIndex) -> tuple[DataFrame, DataFrame]:
    return index.postings, index.lengths


def ranked_ids(ids: DataFrame) -> DataFrame:
    """query_id, _q: numbers without gaps; a row each of the queries, which are short."""
    return ids.withColumn("_q", F.row_number().over(Window.orderBy("query_id")) - 1)


# --- dense -------------------------------------------------------------------------
#: Vectors in a block, so that a product of two blocks takes 32 MB; bytes that
#: may be sent to all executors.
BLOCK_ROWS = 2048
SENT_BYTES = 32 * 1024 * 1024


def _unit_rows(matrix: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0)


def _in_blocks(vectors: DataFrame, key: str, name: str) -> tuple[DataFrame, int]:
    """One row of about ``BLOCK_ROWS`` vectors a block, numbers behind each other; the number of bytes."""
    n, dim = vectors.agg(F.count("*"), F.coalesce(F.max(F.size("vec")), F.lit(0))).first()
    blocks = max(1, math.ceil(n / BLOCK_ROWS))
    packed = vectors.groupBy(F.pmod(F.xxhash64(key), F.lit(blocks)).alias(f"{name}_block")).agg(
        F.collect_list(key).alias(f"{name}_ids"), F.flatten(F.collect_list("vec")).alias(f"{name}_vecs")
    )
    return packed, n * dim * 8


def _multiply(k: int, kind: pa.DataType):
    """The k best of each query among all units that the task meets."""

    def block(ids: pa.ListScalar, numbers: pa.ListScalar) -> tuple[pa.Array, np.ndarray]:
        keys = ids.values
        return keys, _unit_rows(numbers.values.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(keys), -1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, tuple[pa.Array, _Best]] = {}
        last, asked = None, np.empty((0, 0))
        for batch in batches:
            for row in range(batch.num_rows):
                number, q_ids, q_vecs, u_ids, u_vecs = (column[row] for column in batch.columns)
                number = number.as_py()
                if number != last:
                    names, asked = block(q_ids, q_vecs)
                    last = number
                    if number not in found:
                        found[number] = names, _Best(len(names), k, kind)
                        found[number][1].floor[:] = -np.inf
                known, best = found[number]
                ids, stored = block(u_ids, u_vecs)
                sims = asked @ stored.T
                cut = best.floor
                if not np.isfinite(cut).all():
                    take = min(k, sims.shape[1])
                    cut = np.maximum(cut, np.partition(sims, sims.shape[1] - take, axis=1)[:, sims.shape[1] - take])
                # Ties at the cut are kept here and settled by id.
                q, c = np.nonzero(sims >= cut[:, None] - 10.0**-SCORE_DIGITS)
                if len(q):
                    best.offer(q, np.round(sims[q, c], SCORE_DIGITS) + 0.0, ids.take(pa.array(c)))
        for names, best in found.values():
            rows = best.rows
            columns = [names.take(rows.column("q").combine_chunks()), *(rows.column(c).combine_chunks() for c in ("id", "score"))]
            yield pa.RecordBatch.from_arrays(columns, names=["query_id", "id", "score"])

    return run


def exact_knn(queries: DataFrame, units: DataFrame, k: int = 10, scope: DataFrame | None = None) -> DataFrame:
    """Exact cosine neighbours. ``queries`` is (query_id, vec), ``units`` (id, vec).

    Both sides are packed into blocks, which is all that is shuffled of them: a small side is
    broadcast, otherwise a task takes a part of each side, so no block is written more than
    once. Blocks are multiplied in the tasks, which return k rows a query at most; pairs
    never become rows. All queries against all units stay quadratic work: for large
    query sets use ``ivf_knn``.
    """
    if scope is not None:
        units = units.join(scope, "id", "left_semi")
    kinds = [f"{c} {df.schema[c].dataType.simpleString()}" for df, c in ((queries, "query_id"), (units, "id"))]
    sides = [_in_blocks(queries, "query_id", "q"), _in_blocks(units, "id", "u")]
    few, size = min(sides, key=lambda side: side[1])
    asked, stored = (F.broadcast(side) if side is few and size <= SENT_BYTES else side for side, _ in sides)
    pairs = asked.crossJoin(stored).select("q_block", "q_ids", "q_vecs", "u_ids", "u_vecs")
    found = pairs.mapInArrow(_multiply(k, to_arrow_type(units.schema["id"].dataType)), ", ".join([*kinds, "score double"]))
    return top_k(found, k)


def ivf_centroids(units: DataFrame, lists: int, seed: int = 7, iterations: int = 10) -> np.ndarray:
    """Cluster centres of the unit vectors, by distributed k-means."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    features = units.select(array_to_vector(vx.unit("vec")).alias("features"))
    model = KMeans(k=lists, seed=seed, maxIter=iterations).fit(features)
    return np.asarray(model.clusterCenters())


def nearest_lists(vectors: DataFrame, centroids: np.ndarray, probes: int, key: str) -> DataFrame:
    """key, vec (unit length), list: one row per probed list."""
    lists = min(probes, len(centroids))
    schema = f"{key} {vectors.schema[key].dataType.simpleString()}, vec array<double>, list int"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if batch.empty:
                continue
            unit = _unit_rows(np.stack(batch["vec"].to_numpy()).astype(np.float64))
            near = np.argsort(-(unit @ centroids.T - (centroids**2).sum(axis=1) / 2), axis=1, kind="stable")[:, :lists]
            yield pd.DataFrame(
                {
                    key: np.repeat(batch[key].to_numpy(), lists),
                    "vec": [v for v in unit for _ in range(lists)],
                    "list": near.ravel().astype("int32"),
                }
            )

    return vectors.select(key, "vec").mapInPandas(run, schema)


def ivf_knn(queries: DataFrame, units: DataFrame, centroids: np.ndarray, k: int = 10, probes: int = 4,
            rows_per_part: int = 50_000) -> DataFrame:
    """Approximate neighbours: score a query only against its nearest lists.

    Long lists are cut into parts of about ``rows_per_part`` vectors and their
    queries repeated per part, so the largest list does not set the pace.
    """
    stored = nearest_lists(units, centroids, 1, "id")
    asked = nearest_lists(queries, centroids, probes, "query_id").withColumnRenamed("vec", "qvec")
    parts = stored.groupBy("list").agg(F.ceil(F.count("*") / rows_per_part).cast("int").alias("parts"))
    placed = stored.join(F.broadcast(parts), "list").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))
    spread = asked.join(F.broadcast(parts), "list").withColumn(
        "part", F.explode(F.sequence(F.lit(0).cast("long"), (F.col("parts") - 1).cast("long")))
    )
    pairs = spread.drop("parts").join(placed.drop("parts"), ["list", "part"])
    scored = pairs.select("query_id", "id", F.round(vx.dot("qvec", "vec"), SCORE_DIGITS).alias("score"))
    return top_k(scored, k)


def section_vectors(units: DataFrame, section: str, dim: int) -> DataFrame:
    """Mean vector per section, for search at section level."""
    return units.groupBy(F.col(section).alias("id")).agg(vx.mean_vector("vec", dim).alias("vec"))
