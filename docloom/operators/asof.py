"""As-of join: each left row takes the values of the latest right row at or
before its position, per key.

Positions are cut into buckets so that no key is ever sorted as a whole: inside
a bucket a window carries values forward, and between buckets only the last
value of each bucket is carried.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def asof_join(left: DataFrame, right: DataFrame, by: Sequence[str], left_on: str, right_on: str,
              values: Sequence[str], width: int = 65_536) -> DataFrame:
    by = list(by)
    carried = F.struct(*[F.col(c) for c in values])
    kept = F.struct(*[F.col(c) for c in left.columns])
    both = (
        left.select(*by, F.col(left_on).cast("long").alias("_pos"), F.lit(1).alias("_side"),
                    kept.alias("_row"))
        .unionByName(
            right.select(*by, F.col(right_on).cast("long").alias("_pos"), F.lit(0).alias("_side"),
                         carried.alias("_val")),
            allowMissingColumns=True,
        )
        .withColumn("_bucket", F.floor(F.col("_pos") / width))
    )
    inside = (
        Window.partitionBy(*by, "_bucket").orderBy("_pos", "_side", "_val")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    across = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        both.groupBy(*by, "_bucket")
        .agg(F.max(F.when(F.col("_side") == 0, F.struct("_pos", "_val"))).alias("_last"))
        .withColumn("_carry", F.last("_last", ignorenulls=True).over(across)["_val"])
        .drop("_last")
    )
    filled = both.withColumn("_in", F.last("_val", ignorenulls=True).over(inside)).filter("_side = 1")
    joined = filled.join(carry, [*by, "_bucket"], "left")
    found = F.coalesce("_in", "_carry")
    return joined.select("_row.*", *[found[c].alias(c) for c in values])
