"""Helpers that keep plans safe on skewed and very large inputs."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from docloom.session import materialize

BROADCAST_MAX_ROWS = 200_000
BROADCAST_MAX_BYTES = 64 * 1024 * 1024
#: Distinct values that one bucket of ``rank_values`` orders, on average.
BUCKET_VALUES = 100_000


def fits_broadcast(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS,
                   max_bytes: int = BROADCAST_MAX_BYTES) -> bool:
    """Measure a side before hinting it: rows first, bytes of its strings too."""
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    width = reduce(lambda a, b: a + b, [F.coalesce(F.octet_length(c), F.lit(0)) for c in texts], F.lit(16))
    n, size = df.limit(max_rows + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(width), F.lit(0))).first()
    return n <= max_rows and size <= max_bytes


def broadcast_if_small(df: DataFrame, **limits: int) -> DataFrame:
    """A broadcast hint only where the measured size allows one; otherwise the
    join stays a shuffle join, whose hot keys adaptive execution splits."""
    return F.broadcast(df) if fits_broadcast(df, **limits) else df


def one_row(*frames: DataFrame) -> DataFrame:
    """Several one-row results side by side, without a join."""
    merged = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return merged.agg(*[F.max(c).alias(c) for c in merged.columns])


def rank_values(df: DataFrame, keys: Sequence[str], value: str, fractions: dict[str, float],
                bucket_values: int = BUCKET_VALUES) -> DataFrame:
    """Exact order statistics: for each key the value at 0-based position
    ``floor(n * fraction)`` (capped at the last row) of its sorted values.

    No key is ever sorted in one task. Equal values are counted first and stored; rough
    quantiles then cut each key into buckets, as many as its distinct values ask for, whose
    counts locate the bucket that holds the wanted position, and only that bucket is ordered.
    """
    keys = list(keys)
    group = keys or ["_all"]
    source = df if keys else df.withColumn("_all", F.lit(0))
    counts = materialize(source.groupBy(*group, value).agg(F.count(F.lit(1)).alias("_n")), "counts")
    most = counts.groupBy(*group).count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
    buckets = max(2, -(-most // bucket_values))
    steps = F.array(*[F.lit((i + 1) / buckets) for i in range(buckets - 1)])
    cuts = counts.groupBy(*group).agg(
        F.percentile_approx(value, steps, 10 * buckets).alias("_cuts"), F.sum("_n").alias("_total")
    )
    placed = counts.join(cuts, group).withColumn(
        "_b", F.size(F.filter("_cuts", lambda c: c < F.col(value)))
    )
    by_bucket = placed.groupBy(*group, "_b").agg(F.sum("_n").alias("_bn"), F.first("_total").alias("_total"))
    order = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    wanted = F.explode(
        F.array(*[F.struct(F.lit(k).alias("name"), F.lit(q).alias("q")) for k, q in fractions.items()])
    )
    targets = (
        by_bucket.withColumn("_before", F.coalesce(F.sum("_bn").over(order), F.lit(0)))
        .withColumn("_w", wanted)
        .withColumn("_rank", F.least(F.floor(F.col("_total") * F.col("_w.q")), F.col("_total") - 1))
        .filter("_rank >= _before AND _rank < _before + _bn")
        .select(*group, "_b", F.col("_w.name").alias("_name"), (F.col("_rank") - F.col("_before")).alias("_at"))
    )
    inside = Window.partitionBy(*group, "_b", "_name").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    picked = (
        placed.select(*group, "_b", value, "_n")
        .join(targets, [*group, "_b"])
        .withColumn("_cum", F.sum("_n").over(inside))
        .filter("_cum > _at AND _cum - _n <= _at")
    )
    result = picked.groupBy(*group).agg(
        *[F.max(F.when(F.col("_name") == k, F.col(value))).alias(k) for k in fractions]
    )
    return result if keys else result.drop("_all")
