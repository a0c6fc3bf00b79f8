"""Connected components by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.session import materialize


def components(links: DataFrame) -> DataFrame:
    """``node``, ``root`` for every node of the undirected ``links`` (``a``, ``b``); the
    root is the least node of the component.

    Every round hands the least root among a node and its neighbours to the node and to
    its root, then follows roots once, so the rounds grow with the logarithm of the
    longest path. A node with very many links only receives partial minima.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = materialize(both.filter("a <> b").distinct(), "links")
    state = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("root")), "roots")
    while True:
        seen = both.join(state.withColumnRenamed("node", "b"), "b").select(F.col("a").alias("node"), "root")
        best = seen.unionByName(state).groupBy("node").agg(F.min("root").alias("new"))
        offered = state.join(best, "node")
        hooked = offered.select(F.col("root").alias("node"), F.col("new").alias("root"))
        lower = best.select("node", F.col("new").alias("root")).unionByName(hooked).groupBy("node").agg(F.min("root").alias("root"))
        lower = materialize(lower, "roots")
        up = lower.select(F.col("node").alias("root"), F.col("root").alias("top"))
        new = lower.join(up, "root", "left").select("node", F.least("root", "top").alias("root"))
        new = materialize(new, "roots")
        changed = new.join(state.withColumnRenamed("root", "old"), "node").filter("root <> old").limit(1).count()
        state = new
        if not changed:
            return state
