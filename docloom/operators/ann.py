"""Approximate nearest neighbours by product-quantised codes.

Vectors are dealt to lists around coarse centres. What is left of a vector after its
centre is cut into subspaces, and each piece is replaced by the number of the nearest of
256 code words, so a vector takes as many bytes as there are subspaces. For a query the
inner products with all code words are tabulated once; a code's score is a sum of table
entries. Only a short list of the best codes meets the real vectors.

The number of lists follows the number of vectors, their length and the number probed for a
query do not. A query touches ``probes`` lists of about ``list_rows`` codes and ``short``
vectors, at any size.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom import scale
from docloom.functions import vectors as vx
from docloom.operators.ranking import top_k
from docloom.operators.retrieval import SCORE_DIGITS, ivf_centroids
from docloom.session import materialize

LIST_ROWS, PROBES, SHORT = 4096, 8, 32
#: Vectors that code words are learned from; code words of a subspace; rounds of learning.
SAMPLE_ROWS, CODES, ROUNDS = 16_384, 256, 12
#: Codes of a stored row and queries that meet it at once.
PART_ROWS, QUERY_ROWS = 16_384, 256


class PqIndex(NamedTuple):
    """``centres`` (lists x dim), ``words`` (subspaces x codes x dim of a piece) and the stored
    rows (list, part, ids, codes) of at most about ``PART_ROWS`` vectors each."""

    centres: np.ndarray
    words: np.ndarray
    rows: DataFrame


def _unit(vectors: pd.Series) -> np.ndarray:
    x = np.stack(vectors.to_numpy()).astype(np.float32)
    norms = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norms, out=np.zeros_like(x), where=norms > 0)


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmax(x @ centres.T - (centres**2).sum(axis=1) / 2, axis=1)


def _code_words(pieces: np.ndarray, seed: int) -> np.ndarray:
    """Code words of one subspace by Lloyd's rounds; a word that no piece is nearest to stays."""
    rnd = np.random.default_rng(seed)
    words = pieces[rnd.choice(len(pieces), CODES, replace=len(pieces) < CODES)].astype(np.float64)
    for _ in range(ROUNDS):
        near = _nearest(pieces, words)
        n = np.bincount(near, minlength=CODES)
        sums = np.stack([np.bincount(near, pieces[:, d], CODES) for d in range(pieces.shape[1])], axis=1)
        words[n > 0] = sums[n > 0] / n[n > 0, None]
    return words


def _encode(x: np.ndarray, centres: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    lists = _nearest(x, centres)
    rest = (x - centres[lists]).reshape(len(x), len(words), -1)
    return lists, np.stack([_nearest(rest[:, j], words[j]) for j in range(len(words))], axis=1).astype(np.uint8)


def build_index(units: DataFrame, subspaces: int = 32, list_rows: int = LIST_ROWS, sample_rows: int = SAMPLE_ROWS,
                seed: int = 7) -> PqIndex:
    """Index of ``units`` (id, vec); vectors of all units have one length, a multiple of
    ``subspaces``, and are taken at unit length. Code words are learned from the
    ``sample_rows`` vectors with the least hash of their id, subspace by subspace in
    parallel; every vector is encoded."""
    n, dim = units.agg(F.count("*"), F.coalesce(F.max(F.size("vec")), F.lit(0))).first()
    if dim % subspaces:
        raise ValueError(f"{dim} dimensions cannot be cut into {subspaces} equal pieces")
    lists = max(1, math.ceil(n / list_rows))
    if lists > 1:
        centres = ivf_centroids(units, lists, seed)
    else:
        centres = np.zeros((1, dim))
    sample = units.orderBy(F.xxhash64("id"), "id").limit(sample_rows)

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                x = _unit(batch["vec"])
                rest = (x - centres[_nearest(x, centres)]).reshape(len(x), subspaces, -1)
                yield pd.DataFrame({"sub": np.tile(np.arange(subspaces), len(x)), "piece": list(rest.reshape(-1, rest.shape[2]))})

    def learn(group: pd.DataFrame) -> pd.DataFrame:
        words = _code_words(np.stack(group["piece"].to_numpy()), seed)
        return pd.DataFrame({"sub": [group["sub"].iloc[0]], "words": [words.ravel()]})

    learned = sample.select("vec").mapInPandas(pieces, "sub int, piece array<double>").groupBy("sub").applyInPandas(
        learn, "sub int, words array<double>"
    ).orderBy("sub").toPandas()
    words = np.stack(learned["words"].to_numpy()).reshape(subspaces, CODES, -1) if n else np.zeros((subspaces, CODES, max(1, dim // subspaces)))

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                near, codes = _encode(_unit(batch["vec"]), centres, words)
                yield pd.DataFrame({"id": batch["id"], "list": near.astype(np.int32), "code": [c.tobytes() for c in codes]})

    kind = units.schema["id"].dataType.simpleString()
    encoded = materialize(units.select("id", "vec").mapInPandas(encode, f"id {kind}, list int, code binary"), "codes")
    sizes = encoded.groupBy("list").agg(F.ceil(F.count("*") / PART_ROWS).alias("parts"))
    placed = encoded.join(scale.broadcast_if_small(sizes), "list").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))
    packed = placed.groupBy("list", "part", "parts").agg(F.collect_list("id").alias("ids"), F.collect_list("code").alias("codes"))
    return PqIndex(centres, words, materialize(packed, "pq"))


def _probed(centres: np.ndarray, probes: int) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                x = _unit(batch["vec"])
                score = x @ centres.T - (centres**2).sum(axis=1) / 2
                near = np.argsort(-score, axis=1, kind="stable")[:, :probes]
                yield pd.DataFrame({
                    "query_id": np.repeat(batch["query_id"].to_numpy(), near.shape[1]),
                    "qvec": list(np.repeat(x, near.shape[1], axis=0)), "list": near.ravel().astype(np.int32),
                })

    return run


def _best(score: np.ndarray, take: int) -> np.ndarray:
    """Places of the ``take`` best scores; of equal ones the first, so that among copies of
    a vector those with the least ids are kept, as the exact search does."""
    least = np.partition(score, len(score) - take)[len(score) - take]
    found = np.flatnonzero(score >= least)
    return found[np.argsort(-score[found], kind="stable")[:take]]


def _scored(centres: np.ndarray, words: np.ndarray, short: int) -> Callable:
    """The ``short`` best codes of each query in each stored row, of equal ones those with the least ids."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                asked, ids = np.stack(row.q_vecs), np.asarray(row.ids)
                by_id = np.argsort(ids, kind="stable")
                ids = ids[by_id]
                codes = np.frombuffer(b"".join(row.codes), np.uint8).reshape(len(ids), len(words))[by_id]
                tables = np.einsum("qjd,jcd->jqc", asked.reshape(len(asked), len(words), -1), words)
                score = np.repeat((asked @ centres[row.list])[:, None], len(codes), axis=1)
                for j, table in enumerate(tables):
                    score += table[:, codes[:, j]]
                take = min(short, len(codes))
                best = np.stack([_best(line, take) for line in score])
                yield pd.DataFrame({
                    "query_id": np.repeat(np.asarray(row.q_ids), take), "id": ids[best.ravel()],
                    "score": np.take_along_axis(score, best, axis=1).ravel(),
                })

    return run


def shortlist(queries: DataFrame, index: PqIndex, probes: int = PROBES, short: int = SHORT) -> DataFrame:
    """query_id, id, score, rnk: for each query the ``short`` units with the best codes."""
    kinds = [f"query_id {queries.schema['query_id'].dataType.simpleString()}", f"id {index.rows.schema['ids'].dataType.elementType.simpleString()}"]
    queries = queries.filter("vec IS NOT NULL")
    near = queries.select("query_id", "vec").mapInPandas(_probed(index.centres, probes), f"{kinds[0]}, qvec array<double>, list int")
    parts = index.rows.select("list", "part").distinct()
    blocks = queries.agg(F.greatest(F.ceil(F.count("*") / QUERY_ROWS), F.lit(1))).first()[0]
    spread = near.join(scale.broadcast_if_small(parts), "list").withColumn("_block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)))
    asked = spread.groupBy("list", "part", "_block").agg(F.collect_list("query_id").alias("q_ids"), F.collect_list("qvec").alias("q_vecs"))
    met = index.rows.join(asked, ["list", "part"]).select("list", "ids", "codes", "q_ids", "q_vecs")
    return top_k(met.mapInPandas(_scored(index.centres, index.words, short), ", ".join([*kinds, "score double"])), short)


def pq_knn(queries: DataFrame, units: DataFrame, index: PqIndex, k: int = 10, probes: int = PROBES, short: int = SHORT) -> DataFrame:
    """query_id, id, score, rnk: the k best of each query's short list by exact cosine.

    ``queries`` is (query_id, vec), ``units`` the (id, vec) that the index was built of. A query
    whose lists hold fewer than k units gets fewer. Queries without a vector get none.
    """
    found = shortlist(queries, index, probes, short).select("query_id", "id")
    exact = found.join(queries.select("query_id", F.col("vec").alias("qvec")), "query_id").join(units.select("id", "vec"), "id")
    return top_k(exact.select("query_id", "id", (F.round(vx.cosine("qvec", "vec"), SCORE_DIGITS) + 0.0).alias("score")), k)
