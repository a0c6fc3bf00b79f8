"""Sharding along a Hilbert curve through several metadata dimensions."""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from docloom.llm.ranks import ranked
from docloom.session import materialize


def hilbert_index(levels: np.ndarray, bits: int) -> np.ndarray:
    """Position on the Hilbert curve of each row of integer coordinates (n x dimensions),
    by gray-code reflection and exchange of the axes from the top bit down. Neighbours on
    the curve differ by one step in one dimension."""
    x = np.array(levels, dtype=np.int64, copy=True).T
    dims = len(x)
    for bit in range(bits - 1, 0, -1):
        low = (1 << bit) - 1
        for i in range(dims):
            on = (x[i] >> bit & 1).astype(bool)
            swap = np.where(on, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(on, low, swap)
            x[i] ^= swap
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for bit in range(bits - 1, 0, -1):
        flip ^= np.where(x[-1] >> bit & 1, (1 << bit) - 1, 0)
    x ^= flip
    index = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(dims):
            index = index << 1 | x[i] >> bit & 1
    return index


def ordinal(col: Column, kind: T.DataType) -> Column:
    """A number in the order of the column: strings by their first six bytes."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        head = F.rpad(F.hex(F.substring(col.cast("binary"), 1, 6)), 12, "0")
        return F.conv(head, 16, 10).cast("double")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return col.cast("timestamp").cast("double")
    return col.cast("double")


def levels(df: DataFrame, dimensions: Mapping[str, Column], bits: int, accuracy: int = 1000) -> list[Column]:
    """Each dimension quantised to ``2**bits`` levels of about equally many rows; null is
    the lowest. The bounds, ``2**bits - 1`` a dimension, are the only thing collected."""
    cells = 1 << bits
    at = F.array(*[F.lit(i / cells) for i in range(1, cells)])
    numbers = df.select(*[c.alias(name) for name, c in dimensions.items()])
    numbers = numbers.select(*[ordinal(F.col(f.name), f.dataType).alias(f.name) for f in numbers.schema])
    bounds = numbers.agg(*[F.percentile_approx(c, at, accuracy).alias(c) for c in numbers.columns]).first()
    out = []
    for f in df.select(*[c.alias(name) for name, c in dimensions.items()]).schema:
        value = ordinal(dimensions[f.name], f.dataType)
        cuts = sorted(set(bounds[f.name] or []))
        level = sum((F.when(value > cut, 1).otherwise(0) for cut in cuts), F.lit(0))
        out.append(F.coalesce(level, F.lit(0)).cast("int"))
    return out


def shard(docs: DataFrame, dimensions: Mapping[str, Column], shards: int = 16, bits: int = 4, law: str = "rows",
          text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key``, ``size`` (UTF-8 bytes and 1), ``text_crc32``, ``curve`` (Hilbert index of the
    quantised dimensions), ``position`` in curve order, ``shard`` and ``slot`` in it.

    Rows are sorted by curve index and cut into runs: ``rows`` makes counts at most one
    apart; ``bytes`` cuts where the running size passes equal steps. Inside a cell of the
    curve the order is that of a hash, so a cell of any size is numbered in parts. Null
    texts count one byte and have the checksum of an empty text; null dimensions lie at
    level 0; rows with equal keys are ordered by size and checksum. With no rows the
    result is empty. Only the key, sizes and checksums are shuffled, never texts.
    """
    if law not in ("rows", "bytes"):
        raise ValueError(f"unknown law {law!r}")
    if bits * len(dimensions) > 20:
        raise ValueError("more than 2**20 cells")
    curve = F.pandas_udf(
        lambda *x: pd.Series(hilbert_index(np.column_stack(x), bits)) if len(x[0]) else pd.Series([], dtype="int64"), "long"
    )
    data = F.coalesce(docs[text].cast("string"), F.lit("")).cast("binary")
    marked = materialize(
        docs.select(
            docs[key].alias("__key"),
            (F.octet_length(data) + 1).cast("long").alias("size"),
            F.crc32(data).alias("text_crc32"),
            curve(*levels(docs, dimensions, bits)).alias("curve"),
        ),
        "shards",
    )
    # At most 2**20 cells, so one task can add up their sizes.
    before = Window.orderBy("curve").rowsBetween(Window.unboundedPreceding, -1)
    cells = marked.groupBy("curve").agg(F.count(F.lit(1)).alias("__n"), F.sum("size").alias("__b"))
    cells = cells.select(
        "curve", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c + "before") for c in ("__n", "__b")]
    )
    total, size = marked.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    rows = ranked(marked, "curve", ["__key", "size", "text_crc32"]).join(cells, "curve")
    rows = rows.withColumn("position", F.col("__nbefore") + F.col("rank"))
    if law == "rows":
        number = F.expr(f"position * {shards} div {max(total, 1)}")
        first = F.expr(f"(shard * {max(total, 1)} + {shards - 1}) div {shards}")
        rows = rows.withColumn("shard", number).withColumn("slot", F.col("position") - first)
    else:
        rows = _by_bytes(rows, shards, max(size, 1))
    return rows.select(
        F.col("__key").alias(key), "size", "text_crc32", "curve", "position", F.col("shard").cast("int"), F.col("slot").cast("long")
    )


def _by_bytes(rows: DataFrame, shards: int, size: int, rows_per_part: int = 20_000) -> DataFrame:
    """Cuts the curve order into steps of ``size / shards`` bytes; a row goes where its middle falls."""
    parts = rows.withColumn("__part", F.expr(f"position div {rows_per_part}"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.groupBy("__part").agg(F.sum("size").alias("__s"))
    starts = starts.select("__part", F.coalesce(F.sum("__s").over(before), F.lit(0)).alias("__start"))
    inside = Window.partitionBy("__part").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        parts.withColumn("__in", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .join(starts, "__part")
        .withColumn("shard", F.expr(f"(2 * (__start + __in) + size) * {shards} div {2 * size}"))
    )
    firsts = placed.groupBy("shard").agg(F.min("position").alias("__first"))
    return placed.join(F.broadcast(firsts), "shard").withColumn("slot", F.col("position") - F.col("__first"))
