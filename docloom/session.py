"""Session defaults.

Everything that depends on the cluster (executors, memory, shuffle service,
checkpoint folder) is left to the submitter; only semantics-bearing settings
and adaptive execution are fixed here.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_SEMANTIC_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # A union that claims its children's partitioning can meet a side that
    # adaptive execution has coalesced differently ("Can't zip RDDs").
    "spark.sql.unionOutputPartitioning": "false",
    # For every explode this rule adds the filter size(array) > 0 and pushes it to
    # the scan, where it computes the whole array expression a second time.
    "spark.sql.optimizer.excludedRules": "org.apache.spark.sql.catalyst.optimizer.InferFiltersFromGenerate",
}


def apply_runtime_conf(spark: SparkSession) -> None:
    """The same settings on a session somebody else built; rules that it excludes stay excluded."""
    rules = "spark.sql.optimizer.excludedRules"
    excluded = [r for r in (spark.conf.get(rules, None) or "").split(",") if r]
    wanted = _SEMANTIC_CONF[rules]
    merged = excluded if wanted in excluded else [*excluded, wanted]
    for key, value in (_SEMANTIC_CONF | {rules: ",".join(merged)}).items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)


def build_session(master: str | None = None, app: str = "docloom", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**_SEMANTIC_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def local_session(cpus: int | str = 8, **conf: str) -> SparkSession:
    """Single-machine session for tests and the bench."""
    defaults = {
        "spark.sql.shuffle.partitions": str(cpus) if str(cpus).isdigit() else "8",
        "spark.driver.memory": "12g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    spark = build_session(f"local[{cpus}]", **{**defaults, **conf})
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_ready(spark: SparkSession) -> None:
    """Make ``DataFrame.checkpoint`` usable.

    The cluster names a shared folder in ``spark.checkpoint.dir``; a private one
    is chosen only where nothing is set and the master is local (tests).
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    shared = spark.conf.get("spark.checkpoint.dir", "") or ""
    if shared:
        sc.setCheckpointDir(shared)
    elif sc.master.startswith("local"):
        own = tempfile.mkdtemp(prefix="spark-ckpt-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        sc.setCheckpointDir(own)
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder beside the checkpoints, shared by all executors."""
    checkpoint_ready(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex[:12]}"


def once(df: DataFrame, *columns: Column | str) -> DataFrame:
    """``select`` whose columns are computed once a row. An expression of a plain projection
    is written anew into each filter, function argument and column that uses it."""
    row = F.struct(*columns)
    return df.select(F.inline(F.array(row)))


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate that several branches read, and read it back. Unlike a
    cache it survives lost executors, and readers prune its columns."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
