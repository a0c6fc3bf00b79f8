"""The store of segments: snapshots, tombstones, conflicts, compaction."""

import glob
import os

import pytest

from docloom.session import scratch
from docloom.sources.segments import Change, ConcurrentCommit, SegmentStore


@pytest.fixture
def store(spark):
    return SegmentStore(spark, scratch(spark, "store"))


def rows(spark, *pairs):
    return spark.createDataFrame(list(pairs), "doc_id long, text string")


def held(store, version=None, table="docs"):
    return sorted((r["doc_id"], r["text"]) for r in store.read(table, version).collect())


def files(store):
    root = store.root.replace("file://", "").replace("file:", "")
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{root}/**/*.parquet", recursive=True)}


def test_snapshots_stay_what_they_are(spark, store):
    one = store.commit({"docs": Change(rows(spark, (1, "a"), (2, "b"), (None, "n")))})
    two = store.commit({"docs": Change(rows(spark, (1, "new")), rows(spark, (1, ""), (None, "")))})
    three = store.commit({"docs": Change(delete=rows(spark, (2, ""), (9, "")))})
    four = store.commit({"docs": Change(rows(spark, (2, "back")))})
    assert (one, two, three, four) == (1, 2, 3, 4) and store.versions() == [1, 2, 3, 4]
    assert sorted(store.read("docs", 1).toPandas()["text"]) == ["a", "b", "n"]
    # A null key names no document.
    assert sorted(store.read("docs", 2).toPandas()["text"]) == ["b", "n", "new"]
    assert sorted(store.read("docs", 3).toPandas()["text"]) == ["n", "new"]
    assert sorted(store.read("docs").toPandas()["text"]) == ["back", "n", "new"]


def test_tables_change_together_or_not_at_all(spark, store):
    first = store.commit({"docs": Change(rows(spark, (1, "a"), (2, "b"))), "tags": Change(rows(spark, (1, "x"), (2, "y"), (2, "z")))})
    other = SegmentStore(spark, store.root)
    store.commit({n: Change(delete=rows(spark, (2, ""))) for n in ("docs", "tags")}, base=first)
    assert held(store) == [(1, "a")] and held(store, table="tags") == [(1, "x")]
    with pytest.raises(ConcurrentCommit):
        other.commit({"docs": Change(delete=rows(spark, (1, "")))}, base=first)
    assert held(other) == [(1, "a")]
    # Two writers that saw the same snapshot: one manifest gets the name.
    late = SegmentStore(spark, store.root)
    seen = late.manifest()
    late.manifest = lambda version=None: seen
    store.commit({"docs": Change(rows(spark, (3, "c")))})
    with pytest.raises(ConcurrentCommit):
        late.commit({"docs": Change(rows(spark, (4, "d")))})
    assert held(store) == [(1, "a"), (3, "c")]


def test_compaction_rewrites_what_it_must(spark, store):
    store.commit({"docs": Change(rows(spark, *[(i, f"t{i}") for i in range(100)]))})
    store.commit({"docs": Change(rows(spark, *[(i, f"t{i}") for i in range(100, 200)]))})
    store.commit({"docs": Change(delete=rows(spark, *[(i, "") for i in range(60)], (150, "")))})
    before, content = files(store), held(store)
    last = store.compact("docs", 0.2, small_rows=10)
    known = store.manifest()["tables"]["docs"]
    assert last == 4 and held(store) == content and held(store, 3) == content
    after = files(store)
    assert {f: after[f] for f in before} == before and len(after) > len(before)
    # The second segment, one row of a hundred hidden, is the same; its tombstone stays.
    assert [s["version"] for s in known["segments"]] == [2, 4] and len(known["tombstones"]) == 1
    assert store.compact("docs", 0.2, small_rows=10) == 4
    store.compact("docs", 0.0, small_rows=1000)
    known = store.manifest()["tables"]["docs"]
    assert held(store) == content and len(known["segments"]) == 1 and known["tombstones"] == []
    gone = store.expire()
    assert held(store) == content and store.versions() == [5] and len(gone) == 4
    with pytest.raises(ValueError):
        store.read("docs", 3)


def test_empty_and_unknown(spark, store):
    assert store.versions() == [] and store.manifest()["version"] == 0
    with pytest.raises(ValueError):
        store.read("docs")
    store.commit({"docs": Change(rows(spark, (1, "a")).limit(0)), "tags": Change(delete=rows(spark, (1, "")))})
    assert held(store) == []
    store.commit({"docs": Change(rows(spark, (1, "a")), rows(spark, (1, "")))})
    assert held(store) == [(1, "a")]
    with pytest.raises(ValueError):
        store.commit({"docs": Change(spark.range(3).withColumnRenamed("id", "doc_id"))})
    assert held(store) == [(1, "a")]
