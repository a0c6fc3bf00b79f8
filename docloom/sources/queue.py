"""Rows of Parquet files as a queue: a streaming source with offsets and a limit for each batch.

The files of a folder (or one file) are read in the order of their names. An offset is a file
and the number of its rows that are taken; a batch takes at most ``limit`` rows, cut at any
row, and its parts are read by executors in Arrow batches. A row group can only be decoded
from its start, so parts end where row groups do and a large group is cut into a few at most. Files that come later must sort
after those already taken. What was planned last is kept beside the stream's checkpoint,
so a restarted stream goes on with the same rows in the same batches.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

#: Rows of a batch and of a part; a row group has no more parts than this in a batch, whatever its rows.
LIMIT, PART_ROWS, GROUP_PARTS = 10_000, 2_000, 8


@dataclass
class Rows(InputPartition):
    """Rows ``start`` to ``stop`` of a file."""

    path: str
    start: int
    stop: int


def _filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


class QueueReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str], schema: StructType):
        self.path, self.state = options["path"], options["state"]
        self.limit, self.part_rows = int(options.get("limit", LIMIT)), int(options.get("part_rows", PART_ROWS))
        self.columns = schema.fieldNames()
        self.sizes: dict[str, list[int]] = {}
        self.planned: dict | None = None

    # --- files --------------------------------------------------------------
    def _files(self) -> list[str]:
        fs, path = _filesystem(self.path)
        info = fs.get_file_info(path)
        if info.type == pafs.FileType.NotFound:
            return []
        if info.type == pafs.FileType.File:
            return [path]
        found = fs.get_file_info(pafs.FileSelector(path, recursive=True))
        return sorted(f.path for f in found if f.type == pafs.FileType.File and f.path.endswith(".parquet") and "/_temporary/" not in f.path)

    def _groups(self, path: str) -> list[int]:
        """Rows of the file's row groups."""
        if path not in self.sizes:
            fs, _ = _filesystem(self.path)
            with fs.open_input_file(path) as f:
                metadata = pq.ParquetFile(f).metadata
                self.sizes[path] = [metadata.row_group(g).num_rows for g in range(metadata.num_row_groups)]
        return self.sizes[path]

    def _rows(self, path: str) -> int:
        return sum(self._groups(path))

    # --- offsets ------------------------------------------------------------
    def _kept(self) -> dict:
        fs, path = _filesystem(self.state)
        if fs.get_file_info(path).type == pafs.FileType.NotFound:
            return self.initialOffset()
        with fs.open_input_stream(path) as f:
            return json.loads(f.read())

    def _keep(self, offset: dict) -> None:
        fs, path = _filesystem(self.state)
        fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
        with fs.open_output_stream(f"{path}.draft") as f:
            f.write(json.dumps(offset).encode())
        fs.move(f"{path}.draft", path)

    def initialOffset(self) -> dict:
        return {"file": "", "row": 0}

    def latestOffset(self) -> dict:
        """At most ``limit`` rows after what was planned last."""
        at = dict(self.planned or self._kept())
        left = self.limit
        for path in self._files():
            if path < at["file"] or not left:
                continue
            done = at["row"] if path == at["file"] else 0
            taken = min(left, self._rows(path) - done)
            if taken > 0:
                at, left = {"file": path, "row": done + taken}, left - taken
        self.planned = at
        return at

    def partitions(self, start: dict, end: dict) -> list[Rows]:
        # Called for the batches that are run, first of all for one that a stopped run has left.
        if (end["file"], end["row"]) >= (self._kept()["file"], self._kept()["row"]):
            self._keep(end)
        self.planned = max(end, self.planned or end, key=lambda o: (o["file"], o["row"]))
        parts = []
        for path in self._files():
            if start["file"] <= path <= end["file"]:
                lo = start["row"] if path == start["file"] else 0
                hi = end["row"] if path == end["file"] else self._rows(path)
                first = 0
                for n in self._groups(path):
                    a, b = max(lo, first), min(hi, first + n)
                    step = max(self.part_rows, -(-n // GROUP_PARTS))
                    parts += [Rows(path, c, min(c + step, b)) for c in range(a, b, step)]
                    first += n
        return parts

    def commit(self, end: dict) -> None:
        pass

    # --- executors ----------------------------------------------------------
    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        fs, _ = _filesystem(self.path)
        with fs.open_input_file(partition.path) as f:
            source, first = pq.ParquetFile(f), 0
            for group in range(source.num_row_groups):
                n = source.metadata.row_group(group).num_rows
                if first < partition.stop and first + n > partition.start:
                    at = first
                    for batch in source.iter_batches(self.part_rows, [group], self.columns):
                        lo, hi = max(partition.start - at, 0), min(partition.stop - at, batch.num_rows)
                        if lo < hi:
                            yield batch.slice(lo, hi - lo)
                        at += batch.num_rows
                        if at >= partition.stop:
                            break
                first += n


class QueueSource(DataSource):
    """``spark.readStream.format("docqueue").schema(...).option("path", ...).option("state", ...)``,
    after ``spark.dataSource.register(QueueSource)``. Options: ``limit`` rows for a batch,
    ``part_rows`` rows for a task; ``state`` is a file of this stream's own."""

    @classmethod
    def name(cls) -> str:
        return "docqueue"

    def streamReader(self, schema: StructType) -> QueueReader:
        return QueueReader(self.options, schema)
