"""Quantiles and distinct counts over any range, from small sketches of slices of time.

A slice of time (a minute, an hour) keeps one sketch per key. Sketches merge, so a range, a
coarser key or a stream's late part is answered from them without the records; what is
stored grows with slices and keys, not with records.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Size of a quantile sketch and the error of its ranks that is exceeded once in a hundred times.
KLL_K, KLL_ERROR = 200, 0.0165
#: Base-2 logarithm of the sizes of sketches of sets.
HLL_LOG, THETA_LOG = 12, 14


def _slice(ts: str, width: str) -> Column:
    return F.window(ts, width)["start"].alias("slice")


def quantile_slices(records: DataFrame, keys: Sequence[str], value: str, ts: str = "ts", width: str = "1 minute", k: int = KLL_K,
                    delay: str | None = None) -> DataFrame:
    """keys, slice, n, sketch: a KLL sketch of the values of each slice. On a stream, ``delay`` is
    how late records may be; a slice is written when it is over. Null values are not counted."""
    source = records.withWatermark(ts, delay) if delay else records
    return source.groupBy(*keys, F.window(ts, width).alias("_w")).agg(
        F.count(value).alias("n"), F.kll_sketch_agg_double(F.col(value).cast("double"), k).alias("sketch")
    ).select(*keys, F.col("_w.start").alias("slice"), "n", "sketch")


def merged_quantiles(slices: DataFrame, keys: Sequence[str], fractions: Mapping[str, float]) -> DataFrame:
    """keys, n and one column per fraction, from all slices given: filter them for a range, leave
    out keys for a total. A rank is off by at most ``KLL_ERROR`` of n, nearly always."""
    merged = slices.filter("n > 0").groupBy(*keys).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch").alias("_s"))
    found = {name: F.kll_sketch_get_quantile_double("_s", F.lit(float(q))) for name, q in fractions.items()}
    return merged.select(*keys, "n", *[c.alias(name) for name, c in found.items()])


def distinct_slices(records: DataFrame, keys: Sequence[str], what: str, ts: str = "ts", width: str = "1 hour") -> DataFrame:
    """keys, slice, hll, theta: sketches of the distinct values of ``what`` in each slice."""
    return records.filter(F.col(what).isNotNull()).groupBy(*keys, _slice(ts, width)).agg(
        F.hll_sketch_agg(F.col(what).cast("string"), HLL_LOG).alias("hll"),
        F.theta_sketch_agg(F.col(what).cast("string"), THETA_LOG).alias("theta"),
    )


def merged_distinct(slices: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, distinct: estimates for the union of all slices given, however time is sliced."""
    return slices.groupBy(*keys).agg(F.hll_sketch_estimate(F.hll_union_agg("hll")).alias("distinct"))


def shared_distinct(slices: DataFrame, key: str, keys: Sequence[str] = ()) -> DataFrame:
    """keys, shared: estimate of how many values occur under every value of ``key``."""
    each = slices.groupBy(*keys, key).agg(F.theta_union_agg("theta").alias("theta"))
    both = each.groupBy(*keys) if keys else each.groupBy()
    return both.agg(F.theta_sketch_estimate(F.theta_intersection_agg("theta")).alias("shared"))
