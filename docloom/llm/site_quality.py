"""Document quality by hierarchical empirical Bayes: document, path and host together."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.repetition import _sums, measure
from docloom.llm.words import text_slices
from docloom.scale import broadcast_if_small
from docloom.session import materialize

#: Labelled rows for the document classifier, at most.
SAMPLE_ROWS = 20_000
FEATURES = (
    "log_words", "word_length", "upper", "digits", "symbols", "exclamations", "bars", "sentence_ends", "commas",
    "line_words", "dup_lines", "dup_5grams", "repeat_words",
)


def _class(members: bytes) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[list(members)] = True
    return table


_CLASSES = {
    "upper": _class(bytes(range(65, 91))), "digits": _class(b"0123456789"), "symbols": _class(b"#*$%&<>@^~"),
    "exclamations": _class(b"!"), "bars": _class(b"|"), "sentence_ends": _class(b".?"), "commas": _class(b",;:"),
}


def features(texts: pa.Array) -> np.ndarray:
    """One row of numbers for each text of a slice; shares are per word or per character."""
    m = measure(texts, (5,))
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    buf = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None else np.empty(0, np.uint8)
    words, chars = np.maximum(m["n_words"], 1), np.maximum(m["word_chars"], 1)
    counts = {name: _sums(table[buf], at - at[0]) for name, table in _CLASSES.items()}
    columns = {name: counts[name] / (chars if name in ("upper", "digits") else words) for name in _CLASSES}
    columns |= {
        "log_words": np.log1p(m["n_words"]), "word_length": np.minimum(m["word_chars"] / words, 50),
        "line_words": np.log1p(m["n_words"] / np.maximum(m["n_lines"], 1)),
        "dup_lines": m["dup_line_chars"] / np.maximum(m["line_chars"], 1), "dup_5grams": m["dup_chars_5"] / chars,
        "repeat_words": m["n_repeat_words"] / words,
    }
    return np.column_stack([columns[name] for name in FEATURES])


class Model(NamedTuple):
    """Logistic regression on standardised features, without the base rate of its sample."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    base: float

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        """Evidence: the log likelihood ratio of good against bad."""
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.clip(np.column_stack([np.ones(len(z)), z, z * z]) @ self.weights - self.base, -20, 20)


def fit(x: np.ndarray, y: np.ndarray, steps: int = 30, penalty: float = 1.0) -> Model:
    """Newton steps with a ridge penalty; with labels of one class or none, no evidence."""
    d = x.shape[1]
    if len(y) == 0 or y.min() == y.max():
        return Model(np.zeros(d), np.ones(d), np.zeros(2 * d + 1), 0.0)
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    z = np.clip((x - mean) / scale, -8, 8)
    z = np.column_stack([np.ones(len(z)), z, z * z])
    ridge = penalty * np.eye(z.shape[1])
    ridge[0, 0] = 1e-6
    w = np.zeros(z.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        change = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge, z.T @ (y - p) - ridge @ w)
        w += change
        if np.abs(change).max() < 1e-6:
            break
    return Model(mean, scale, w, float(np.log(y.mean() / (1 - y.mean()))))


def described(docs: DataFrame) -> DataFrame:
    """``__key``, ``host``, ``path`` and ``x`` (features; null without words) of every row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, part in text_slices(batch.column(3)):
                x = features(part)
                flat = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(FEATURES)).cast(pa.list_(pa.float64()))
                blank = pa.array(x[:, 0] == 0)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).slice(start, len(part)) for i in range(3)), pa.compute.if_else(blank, pa.scalar(None, flat.type), flat)],
                    names=["key", "host", "path", "x"],
                )

    kind = docs.schema["__key"].dataType.simpleString()
    return docs.select("__key", "host", "path", "text").mapInArrow(run, f"key {kind}, host string, path string, x array<double>")


def _pull(between: float, within: float, size: float) -> float:
    """How many documents the prior of a level is worth: variance inside groups over the
    variance between them. Groups that differ by chance alone are drawn to it wholly."""
    spread = (between - within) / size if size > 0 else 0.0
    return min(max(within, 1e-9) / spread, 1e9) if spread > 1e-12 else 1e9


def shrunk(scored: DataFrame) -> tuple[DataFrame, DataFrame, float, float, float]:
    """Hosts and paths with their sums, the global rate and the worth of both priors."""
    paths = materialize(
        scored.groupBy("host", "path").agg(
            F.count(F.lit(1)).alias("n"), F.sum("p").alias("s"), F.sum(F.col("p") * F.col("p")).alias("q")
        ),
        "paths",
    )
    hosts = materialize(
        paths.groupBy("host").agg(
            F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.count(F.lit(1)).alias("paths"),
            F.sum(F.col("s") * F.col("s") / F.col("n")).alias("t"), F.sum(F.col("n") * F.col("n") / 1.0).alias("n2"),
        ),
        "hosts",
    )
    row = hosts.agg(
        F.count(F.lit(1)).alias("hosts"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum("paths").alias("paths"),
        F.sum("t").alias("t"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("u"),
        F.sum(F.col("n") * F.col("n") / 1.0).alias("n2"), F.sum(F.col("n2") / F.col("n")).alias("inner"),
    ).first()
    n = row["n"] or 0
    if not n:
        return hosts, paths, 0.5, 1e9, 1e9
    rate = row["s"] / n
    within = lambda total, groups: total / max(n - groups, 1)
    host_pull = _pull(
        (row["u"] - n * rate * rate) / max(row["hosts"] - 1, 1), within(row["q"] - row["u"], row["hosts"]),
        (n - row["n2"] / n) / (row["hosts"] - 1) if row["hosts"] > 1 else 0.0,
    )
    inner = row["paths"] - row["hosts"]
    path_pull = _pull(
        (row["t"] - row["u"]) / max(inner, 1), within(row["q"] - row["t"], row["paths"]), (n - row["inner"]) / inner if inner > 0 else 0.0
    )
    return hosts, paths, rate, host_pull, path_pull


def quality(docs: DataFrame, labels: DataFrame, host: Column, path: Column, threshold: float = 0.5, sample_rows: int = SAMPLE_ROWS,
            text: str = "text", key: str = "doc_id", label: str = "quality") -> DataFrame:
    """``key``, ``host``, ``path``, ``evidence`` (log odds of the text), ``host_rate``,
    ``path_rate``, ``posterior`` and ``kept`` for every document.

    A classifier fitted on at most ``sample_rows`` labelled rows (those with the least
    hash of the key) gives each text its evidence. Rates of good documents are then
    estimated for all documents by host and by path: a host's rate is drawn to the global
    one, a path's to that of its host, the more the fewer documents it has; how much is
    estimated from the spread between groups. A document's posterior combines its
    evidence with the rate of its path without itself.

    A text without words has no evidence and is not kept. Null hosts and paths are groups
    of their own with an empty name. Without labels of both classes all evidence is 0.
    Rows with equal keys are judged alone; labels of a key given several times are
    averaged. No rows give no rows. Hot hosts are added up before they are shuffled.
    """
    rows = docs.select(
        docs[key].alias("__key"), F.coalesce(host.cast("string"), F.lit("")).alias("host"),
        F.coalesce(path.cast("string"), F.lit("")).alias("path"), F.coalesce(docs[text].cast("string"), F.lit("")).alias("text"),
    )
    known = materialize(described(rows), "features")
    marks = labels.filter(labels[key].isNotNull() & labels[label].isNotNull()).groupBy(labels[key].alias("key")).agg(F.avg(label).alias("y"))
    sample = (
        known.filter("x IS NOT NULL").join(marks, "key").select("x", "y", F.xxhash64("key").alias("h"), "key")
        .orderBy("h", "key").limit(sample_rows).select("x", "y").toPandas()
    )
    x = np.stack(sample["x"].to_list()) if len(sample) else np.zeros((0, len(FEATURES)))
    model = fit(x, (sample["y"].to_numpy() >= 0.5).astype(float))

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            there = batch.column(3).is_valid().to_numpy(zero_copy_only=False)
            evidence = np.full(batch.num_rows, np.nan)
            if there.any():
                flat = pa.compute.list_flatten(batch.column(3)).to_numpy()
                evidence[there] = model.log_odds(flat.reshape(-1, len(FEATURES)))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(3)), pa.array(evidence, mask=~there)], names=["key", "host", "path", "evidence"]
            )

    kind = known.schema["key"].dataType.simpleString()
    scored = known.mapInArrow(score, f"key {kind}, host string, path string, evidence double")
    chance = lambda odds: 1 / (1 + F.exp(-odds))
    # A text's own probability under the classifier, at even odds; 0 without words.
    scored = materialize(scored.withColumn("p", F.coalesce(chance(F.col("evidence")), F.lit(0.0))), "scored")
    hosts, paths, rate, host_pull, path_pull = shrunk(scored)
    hosts = hosts.select("host", ((F.col("s") + host_pull * rate) / (F.col("n") + host_pull)).alias("host_rate"))
    sites = paths.select("host", "path", "n", "s").join(broadcast_if_small(hosts), "host")
    joined = scored.join(broadcast_if_small(sites), ["host", "path"])
    others = (F.col("s") - F.col("p") + path_pull * F.col("host_rate")) / (F.col("n") - 1 + path_pull)
    prior = F.greatest(F.lit(1e-4), F.least(F.lit(1 - 1e-4), others))
    posterior = F.coalesce(chance(F.col("evidence") + F.log(prior / (1 - prior))), F.lit(0.0))
    return joined.select(
        F.col("key").alias(key), "host", "path", "evidence", "host_rate",
        ((F.col("s") + path_pull * F.col("host_rate")) / (F.col("n") + path_pull)).alias("path_rate"),
        posterior.alias("posterior"), (posterior >= threshold).alias("kept"),
    )
