"""Tables of documents that change: immutable segments, tombstones and one manifest.

A change to any number of tables is one commit. It writes new rows as segments and the keys
of deleted documents as tombstones, below fresh folders, and then publishes a manifest that
names everything a snapshot consists of. Readers see a snapshot whole or not at all;
nothing that an older snapshot names is touched. A tombstone hides rows of segments older
than itself. Compaction rewrites only the segments that tombstones or their small size call
for; the others stay the same files.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping
from functools import reduce
from typing import Any, NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class Change(NamedTuple):
    """Rows to add to a table, and documents (a column of keys) whose rows go first."""

    add: DataFrame | None = None
    delete: DataFrame | None = None


class ConcurrentCommit(RuntimeError):
    """Another commit came first; read its snapshot and try again."""


class SegmentStore:
    """Tables below ``root``, a folder that driver and executors share. All tables have the
    column ``key``."""

    def __init__(self, spark: SparkSession, root: str, key: str = "doc_id"):
        self.spark, self.root, self.key = spark, root.rstrip("/"), key
        self._jvm = spark._jvm
        self._conf = spark._jsc.hadoopConfiguration()

    # --- manifests --------------------------------------------------------------
    def _path(self, *parts: str) -> Any:
        return self._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))

    def versions(self) -> list[int]:
        folder = self._path("manifests")
        fs = folder.getFileSystem(self._conf)
        if not fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict[str, Any]:
        """Version and tables of a snapshot, the last one if none is given."""
        known = self.versions()
        if version is None:
            if not known:
                return {"version": 0, "tables": {}}
            version = known[-1]
        if version not in known:
            raise ValueError(f"no snapshot {version}")
        path = self._path("manifests", f"{version:08d}.json")
        stream = path.getFileSystem(self._conf).open(path)
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _publish(self, manifest: dict[str, Any]) -> None:
        """The manifest appears under its final name at once, or not if that is taken."""
        draft = self._path("manifests", f".{uuid.uuid4().hex}")
        final = self._path("manifests", f"{manifest['version']:08d}.json")
        fs = draft.getFileSystem(self._conf)
        out = fs.create(draft, False)
        try:
            out.write(bytearray(json.dumps(manifest).encode()))
        finally:
            out.close()
        rename = self._jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.NONE
        try:
            files = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), self._conf)
            files.rename(fs.makeQualified(draft), fs.makeQualified(final), options)
        except Exception as exc:
            fs.delete(draft, False)
            if "FileAlreadyExistsException" in str(exc):
                raise ConcurrentCommit(f"snapshot {manifest['version']} exists") from exc
            raise

    # --- changes ----------------------------------------------------------------
    def _write(self, df: DataFrame, table: str, kind: str) -> str:
        name = f"{table}/{kind}-{uuid.uuid4().hex[:12]}"
        df.write.parquet(f"{self.root}/{name}")
        return name

    def _table(self, manifest: dict, table: str, schema: StructType | None) -> dict:
        known = manifest["tables"].setdefault(table, {"schema": None, "segments": [], "tombstones": []})
        if schema is not None:
            if known["schema"] is None:
                known["schema"] = json.loads(schema.json())
            elif StructType.fromJson(known["schema"]).simpleString() != schema.simpleString():
                raise ValueError(f"{table} has other columns")
        return known

    def commit(self, changes: Mapping[str, Change], base: int | None = None) -> int:
        """Apply changes to several tables at once; the new snapshot's version.

        Deleted keys hide the rows of all earlier snapshots, not those added by the same
        commit. ``base`` is the snapshot that the changes were made from, the last one by
        default; if there is a later one, nothing is published.
        """
        manifest = self.manifest()
        if base is not None and base != manifest["version"]:
            raise ConcurrentCommit(f"snapshot {manifest['version']} is newer than {base}")
        version = manifest["version"] + 1
        for table, change in changes.items():
            known = self._table(manifest, table, change.add.schema if change.add is not None else None)
            if change.delete is not None and known["segments"]:
                keys = change.delete.select(self.key).filter(F.col(self.key).isNotNull()).distinct()
                known["tombstones"].append({"path": self._write(keys, table, "tombstones"), "version": version})
            if change.add is not None:
                known["segments"].append({"path": self._write(change.add, table, "segment"), "version": version})
        self._publish(manifest | {"version": version})
        return version

    # --- reading ----------------------------------------------------------------
    def _segment(self, known: dict, segment: dict) -> DataFrame:
        schema = StructType.fromJson(known["schema"])
        rows = self.spark.read.schema(schema).parquet(f"{self.root}/{segment['path']}")
        return rows.withColumn("__version", F.lit(segment["version"]))

    def _living(self, known: dict, segments: list[dict]) -> DataFrame:
        """Rows of the segments that no later tombstone hides."""
        rows = reduce(DataFrame.unionAll, [self._segment(known, s) for s in segments])
        oldest = min(s["version"] for s in segments)
        later = [t for t in known["tombstones"] if t["version"] > oldest]
        if later:
            keys = [
                self.spark.read.parquet(f"{self.root}/{t['path']}").select(F.col(self.key).alias("__key"), F.lit(t["version"]).alias("__until"))
                for t in later
            ]
            gone = reduce(DataFrame.unionAll, keys).groupBy("__key").agg(F.max("__until").alias("__until"))
            rows = rows.join(gone, (F.col(self.key) == F.col("__key")) & (F.col("__version") < F.col("__until")), "left_anti")
        return rows.drop("__version")

    def read(self, table: str, version: int | None = None) -> DataFrame:
        """The table as it is in a snapshot, the last one by default."""
        known = self.manifest(version)["tables"].get(table)
        if known is None or known["schema"] is None:
            raise ValueError(f"no table {table}")
        if not known["segments"]:
            return self.spark.createDataFrame([], StructType.fromJson(known["schema"]))
        return self._living(known, known["segments"])

    # --- compaction -------------------------------------------------------------
    def compact(self, table: str, deleted_share: float = 0.2, small_rows: int = 100_000) -> int:
        """Rewrite segments of which more than ``deleted_share`` is hidden, and join small ones
        if there are several; the snapshot's version. Other segments keep their files, and
        tombstones stay while one of the segments left needs them. Rows are unchanged."""
        manifest = self.manifest()
        known = manifest["tables"][table]
        sized = []
        for segment in known["segments"]:
            held, living = self._segment(known, segment).count(), self._living(known, [segment]).count()
            sized.append((segment, held, living))
        hidden = [s for s, held, living in sized if held - living > deleted_share * held]
        small = [s for s, held, living in sized if living < small_rows]
        chosen = [s for s, _, _ in sized if s in hidden or (len(small) > 1 and s in small)]
        if not chosen:
            return manifest["version"]
        version = manifest["version"] + 1
        merged = {"path": self._write(self._living(known, chosen), table, "segment"), "version": version}
        kept = [s for s in known["segments"] if s not in chosen]
        oldest = min((s["version"] for s in kept), default=version)
        known["segments"] = [*kept, merged]
        known["tombstones"] = [t for t in known["tombstones"] if t["version"] > oldest]
        self._publish(manifest | {"version": version})
        return version

    def expire(self, keep: int = 1) -> list[str]:
        """Remove all snapshots but the last ``keep`` and the folders that only they name; these folders."""
        known = self.versions()
        old, recent = known[:-keep], known[-keep:]

        def named(versions: list[int]) -> set[str]:
            tables = [t for v in versions for t in self.manifest(v)["tables"].values()]
            return {x["path"] for t in tables for x in [*t["segments"], *t["tombstones"]]}

        gone = sorted(named(old) - named(recent))
        for path in [*(self._path("manifests", f"{v:08d}.json") for v in old), *map(self._path, gone)]:
            path.getFileSystem(self._conf).delete(path, True)
        return gone
