"""Ranks inside groups of any size, without a group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.scale import broadcast_if_small


def ranked(df: DataFrame, group: str, by: list[str], rows_per_part: int = 5_000) -> DataFrame:
    """Adds ``rank`` (from 0, without gaps) inside each value of ``group``, which must not
    be null, in the order of a hash of the ``by`` columns, then of these columns.

    A group is cut by hash ranges into parts of about ``rows_per_part`` rows; rows are
    numbered inside parts, and parts begin where the ones before them end. Rows that are
    equal in all ``by`` columns meet in one part.
    """
    hashed = df.withColumn("__h", F.xxhash64(*[F.col(c) for c in by]))
    sizes = df.groupBy(group).agg(F.ceil(F.count(F.lit(1)) / rows_per_part).alias("__parts"))
    share = F.shiftrightunsigned("__h", 11) / F.lit(float(1 << 53))
    parts = hashed.join(broadcast_if_small(sizes), group).withColumn("__part", F.floor(share * F.col("__parts"))).drop("__parts")
    before = Window.partitionBy(group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        parts.groupBy(group, "__part").agg(F.count(F.lit(1)).alias("__n"))
        .select(group, "__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    )
    inside = Window.partitionBy(group, "__part").orderBy(F.shiftrightunsigned("__h", 1), "__h", *by)
    # Dealt by part: a join that deals rows by group would leave a hot one in one task.
    numbered = parts.repartition(group, "__part").withColumn("__row", F.row_number().over(inside))
    return (
        numbered.join(starts, [group, "__part"])
        .withColumn("rank", F.col("__before") + F.col("__row") - 1)
        .drop("__h", "__part", "__row", "__before")
    )
