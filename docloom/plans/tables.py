"""The fourteen input tables and the views derived from them."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from docloom.session import apply_runtime_conf


class Tables:
    """Lazy access: ``tables.documents`` reads ``<dir>/documents.parquet``."""

    NAMES = (
        "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
        "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
    )

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self._stored: dict[str, Any] = {}
        apply_runtime_conf(spark)

    #: Tests and the bench deal small text tables, single row groups, to so many tasks.
    spread: int | None = None

    def __getattr__(self, name: str) -> DataFrame:
        if name not in self.NAMES:
            raise AttributeError(name)
        df = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return df.repartition(self.spread) if self.spread and name in ("documents", "pages", "conversations") else df

    def stored(self, name: str, make: Callable[[], Any]) -> Any:
        """What ``make`` returns, made once for all parts of a query."""
        if name not in self._stored:
            self._stored[name] = make()
        return self._stored[name]
