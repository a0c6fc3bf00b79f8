"""Mixing sources to target weights by proportionate-fair scheduling of their blocks."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from fractions import Fraction
from heapq import heappop, heappush
from itertools import accumulate, islice
from math import gcd, lcm

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from docloom.llm.ranks import ranked
from docloom.session import materialize, scratch

#: Weights are whole numbers of at most this sum.
LARGEST = 1 << 62
#: Slots are written in pieces of so many rows.
SLOTS_PER_WRITE = 1 << 20
_SLOTS = pa.schema([("source", pa.string()), *((c, pa.int64()) for c in ("block", "release", "deadline", "slot", "__start"))])


def source_table(rows: DataFrame, weights: Mapping[str, float] | None, block_rows: int, resolution: int, damping: float) -> DataFrame:
    """Each source's rows, blocks and weight: whole numbers in the ratio of the wished weights.

    Given weights count as the decimals they are written as; a source without one gets 1 for
    every ``resolution`` of their sum. Without weights, a source wishes its number of rows to
    the power ``damping``. Only weights that need a sum above ``LARGEST`` are rounded, to
    parts of it: less than a millionth of a block in 10^11 blocks.
    """
    found = rows.groupBy("source").agg(F.count(F.lit(1)).alias("rows")).withColumn("wish", F.pow(F.col("rows").cast("double"), F.lit(damping))).collect()
    given = {r.source: r.wish for r in found} if weights is None else weights
    wishes = {r.source: max(Fraction(0), Fraction(str(given.get(r.source, 0)))) for r in found}
    least = sum(wishes.values()) / resolution or Fraction(1)
    wishes = {name: w or least for name, w in wishes.items()}
    unit = Fraction(1, lcm(*[w.denominator for w in wishes.values()]))
    unit = max(unit, sum(wishes.values()) / LARGEST)
    whole = {name: max(1, round(w / unit)) for name, w in wishes.items()}
    shared = gcd(*whole.values())
    table = [(r.source, r.rows, -(-r.rows // block_rows), whole[r.source] // shared) for r in found]
    return rows.sparkSession.createDataFrame(table, "source string, rows long, blocks long, weight long")


def windows(sources: list[Row]) -> list[Iterator[tuple[int, int]]]:
    """For each source the ``release`` and ``deadline`` of its blocks, in whole numbers.

    In the ideal mixture each source gets service at the rate of its weight among those
    that still have blocks. Block j may not start before the slot in which the ideal
    service of its source passes j, and must be over when it passes j + 1.
    """
    ends = sorted(sources, key=lambda s: Fraction(s.blocks, s.weight))
    # Blocks of the first k sources to end, and the weights of the others.
    over = [0, *accumulate(s.blocks for s in ends)]
    alive = [*accumulate((-s.weight for s in ends), initial=sum(s.weight for s in ends))]

    def of(source: Row) -> Iterator[tuple[int, int]]:
        release, k = 0, 0
        for block in range(1, source.blocks + 1):
            while block * ends[k].weight > ends[k].blocks * source.weight:
                k += 1
            whole, part = divmod(alive[k] * block, source.weight)
            yield release, over[k] + whole + (part > 0)
            release = over[k] + whole

    return [of(s) for s in sources]


def schedule(sources: list[Row], block_rows: int) -> Iterator[tuple[str, int, int, int, int, int]]:
    """(source, block, release, deadline, slot, rows before it) in the order of slots: each
    slot takes the released block of the earliest deadline. The windows can always be kept."""
    sources = sorted(sources, key=lambda s: s.source)
    coming, ready, start = [], [], 0
    rest = windows(sources)

    def next_block(i: int, block: int) -> None:
        if block < sources[i].blocks:
            release, deadline = next(rest[i])
            heappush(coming, (release, deadline, i, block))

    for i in range(len(sources)):
        next_block(i, 0)
    for slot in range(sum(s.blocks for s in sources)):
        while coming and coming[0][0] <= slot:
            release, deadline, i, block = heappop(coming)
            heappush(ready, (deadline, i, block, release))
        deadline, i, block, release = heappop(ready)
        yield sources[i].source, block, release, deadline, slot, start
        start += min(block_rows, sources[i].rows - block * block_rows)
        next_block(i, block + 1)


def _stored(spark: SparkSession, slots: Iterator[tuple]) -> DataFrame:
    """The slots as a table, written piece by piece."""
    path = scratch(spark, "slots")
    while True:
        piece = list(islice(slots, SLOTS_PER_WRITE))
        columns = zip(*piece) if piece else [[]] * len(_SLOTS)
        table = pa.table([pa.array(c, f.type) for c, f in zip(columns, _SLOTS)], schema=_SLOTS)
        spark.createDataFrame(table).write.mode("append").parquet(path)
        if len(piece) < SLOTS_PER_WRITE:
            return spark.read.schema(from_arrow_schema(_SLOTS)).parquet(path)


def interleave(docs: DataFrame, weights: Mapping[str, float] | None = None, block_rows: int = 32, resolution: int = 64,
               damping: float = 0.5, source: str = "source", key: str = "doc_id") -> DataFrame:
    """Every row's place in the mixture: ``key``, ``source``, ``block``, ``release``,
    ``deadline``, ``slot``, ``position`` (from 0, without gaps).

    A source's rows are shuffled by a hash of the key and cut into blocks. At any slot
    each source has got less than one block more or less than its target share, which is
    that of its weight itself. When a source has no blocks left the others share its part,
    so all rows are placed. A source without a given weight gets one block for every
    ``resolution`` of those with one. A null source counts as the source with the empty
    name. Rows with equal keys take neighbouring places; no rows give no rows. The sources
    are gathered on the driver, which deals the slots: a few microseconds a block, none of
    its rows. Texts are not read.
    """
    rows = docs.select(docs[key].alias("__key"), F.coalesce(docs[source].cast("string"), F.lit("")).alias("source"))
    rows = materialize(ranked(rows, "source", ["__key"]).withColumn("block", F.expr(f"rank div {block_rows}")), "ranked")
    sources = source_table(rows, weights, block_rows, resolution, damping).collect()
    slots = _stored(docs.sparkSession, schedule(sources, block_rows))
    placed = rows.join(slots, ["source", "block"])
    return placed.select(
        F.col("__key").alias(key), F.col("source").alias(source), "block", "release", "deadline", "slot",
        (F.col("__start") + F.col("rank") % block_rows).alias("position"),
    )


def mixed(docs: DataFrame, rows_per_file: int = 20_000, source: str = "source", key: str = "doc_id", **how) -> DataFrame:
    """All rows and columns of ``docs`` in the order of the mixture: each part of about
    ``rows_per_file`` rows is a run of it, in order.

    Texts are shuffled twice, to meet their places and into the runs. Where keys repeat, the
    rows are numbered first, and shuffled by their numbers instead of their keys.
    """
    if not docs.groupBy(docs[key]).count().toDF("__k", "__n").filter("__n > 1").isEmpty():
        numbered = materialize(docs.withColumn("__i", F.monotonically_increasing_id()), "numbered")
        return mixed(numbered, rows_per_file, source, "__i", **how).drop("__i")
    known = lambda c: F.coalesce(c.cast("string"), F.lit("\0null"))
    places = interleave(docs, source=source, key=key, **how).select(known(F.col(key)).alias("__k"), F.col("position").alias("__position"))
    runs = max(1, -(-docs.count() // rows_per_file))
    placed = docs.withColumn("__k", known(docs[key])).join(places, "__k")
    run = F.expr(f"__position div {rows_per_file}")
    return placed.repartition(runs, run).sortWithinPartitions("__position").select(*docs.columns)
