"""Streams that stop and start again, sketches, and the newest records."""

import random
import time

import pytest
from pyspark.sql import functions as F

from docloom import scale
from docloom.functions import text as tx
from docloom.operators import analytics as an
from docloom.operators import sketches as sk
from docloom.plans.catalog import QUERIES
from docloom.session import scratch
from docloom.sources.queue import QueueReader
from docloom.streaming import streams as ss

MESSAGES = "conv_id long, turn long, role string, content string"


def folder(spark, name):
    return scratch(spark, name).removeprefix("file:")


def test_histories_survive_a_restart(spark):
    path, state = folder(spark, "turns"), folder(spark, "state")
    known = spark.createDataFrame([(7, 0, "user", "from the table")], MESSAGES)
    found = {}

    def keep(batch, batch_id):
        found.update({r["conv_id"]: [(h["turn"], h["content"]) for h in r["history"]] for r in batch.collect()})

    def run(*turns, **kw):
        spark.createDataFrame([(c, n, "user", text) for c, n, text in turns], MESSAGES).coalesce(1).write.mode("append").parquet(path)
        stream = spark.readStream.schema(MESSAGES).parquet(path)
        ss.run_batches(ss.session_history(stream, keep=3, known=known, **kw), "state", keep, "update", state)

    run((1, 0, "a"), (1, 1, "b"), (2, 5, "x"), (7, 1, "new"))
    assert found == {1: [(0, "a"), (1, "b")], 2: [(5, "x")], 7: [(0, "from the table"), (1, "new")]}
    run((1, 2, "c"), (1, 3, "d"), (1, 1, "again"), (7, 2, "more"))
    assert found == {1: [(1, "again"), (2, "c"), (3, "d")], 2: [(5, "x")], 7: [(0, "from the table"), (1, "new"), (2, "more")]}


def test_unused_histories_expire(spark):
    path, state = folder(spark, "turns"), folder(spark, "state")
    found = {}

    def keep(batch, batch_id):
        found.update({r["conv_id"]: r["n"] for r in batch.collect()})

    for turn in range(2):
        spark.createDataFrame([(1, turn, "user", "t")], MESSAGES).coalesce(1).write.mode("append").parquet(path)
        stream = spark.readStream.schema(MESSAGES).parquet(path)
        ss.run_batches(ss.session_history(stream, ttl_ms=500), "state", keep, "update", state)
        time.sleep(1)
    assert found == {1: 1}


def test_queue_reads_each_row_once(spark):
    path, state = folder(spark, "queue"), folder(spark, "state")
    schema = "doc_id long, text string"
    rows = [(i, f"t{i}") for i in range(50)]
    spark.createDataFrame(rows[:30], schema).repartition(4).write.parquet(f"{path}/batch=1")
    seen = {}

    def keep(batch, batch_id):
        seen[batch_id] = sorted(r["doc_id"] for r in batch.collect())

    def run(batches=None):
        stream = ss.queue_stream(spark, path, f"{state}/queue.json", schema, limit=7)
        return ss.drain(stream, keep, f"{state}/stream", batches)

    assert run(2) == 2 and [len(v) for v in seen.values()] == [7, 7]
    first = dict(seen)
    assert run() > 0
    assert {k: seen[k] for k in first} == first and all(len(v) <= 7 for v in seen.values())
    assert sorted(sum(seen.values(), [])) == list(range(30))
    spark.createDataFrame(rows[30:], schema).repartition(2).write.parquet(f"{path}/batch=2")
    run()
    assert sorted(sum(seen.values(), [])) == list(range(50))
    assert run() == 0


def test_offsets_cross_files_and_row_groups(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq
    from pyspark.sql.types import StructType

    for name, n in (("a", 10), ("b", 0), ("c", 5)):
        pq.write_table(pa.table({"x": [f"{name}{i}" for i in range(n)]}, schema=pa.schema([("x", pa.string())])), tmp_path / f"{name}.parquet", row_group_size=3)
    schema = StructType().add("x", "string")
    options = {"path": str(tmp_path), "state": str(tmp_path / "s" / "at.json"), "limit": "12", "part_rows": "4"}
    reader = QueueReader(options, schema)
    start, got = reader.initialOffset(), []
    while (end := reader.latestOffset()) != start:
        parts = reader.partitions(start, end)
        assert all(p.stop - p.start <= 4 for p in parts)
        got.append([v for p in parts for b in reader.read(p) for v in b.column(0).to_pylist()])
        start = end
    assert [len(g) for g in got] == [12, 3] and sum(got, []) == [f"a{i}" for i in range(10)] + [f"c{i}" for i in range(5)]
    again = QueueReader(options, schema)
    assert again.latestOffset() == end


def test_large_row_groups_have_few_parts(tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq
    from pyspark.sql.types import StructType

    pq.write_table(pa.table({"x": [str(i) for i in range(5000)]}), tmp_path / "a.parquet", row_group_size=2000)
    reader = QueueReader({"path": str(tmp_path), "state": str(tmp_path / "s" / "at.json"), "limit": "9000", "part_rows": "20"}, StructType().add("x", "string"))
    parts = reader.partitions(reader.initialOffset(), reader.latestOffset())
    # Each part decodes its group from the start: 100 parts of a group would decode it 100 times.
    assert len(parts) == 3 * 8 and all(p.start // 2000 == (p.stop - 1) // 2000 for p in parts)
    assert [v for p in parts for b in reader.read(p) for v in b.column(0).to_pylist()] == [str(i) for i in range(5000)]


def test_quantiles_of_merged_slices(spark):
    rnd = random.Random(1)
    rows = [("hot" if i % 3 else "k", i % 5000, None if i % 50 == 0 else rnd.lognormvariate(3, 1)) for i in range(30_000)]
    df = spark.createDataFrame(rows, "k string, s long, v double").withColumn("ts", F.timestamp_seconds("s"))
    slices = sk.quantile_slices(df, ["k"], "v", width="1 minute")
    got = {r["k"]: r for r in sk.merged_quantiles(slices, ["k"], {"a": 0.5, "b": 0.99}).collect()}
    for k in ("hot", "k"):
        values = sorted(v for g, _, v in rows if g == k and v is not None)
        assert got[k]["n"] == len(values)
        for name, q in (("a", 0.5), ("b", 0.99)):
            assert abs(sum(v <= got[k][name] for v in values) / len(values) - q) <= sk.KLL_ERROR
    assert sk.merged_quantiles(slices, [], {"a": 0.5}).count() == 1
    assert sk.merged_quantiles(slices.limit(0), ["k"], {"a": 0.5}).count() == 0


def test_distinct_of_merged_slices(spark):
    rows = [("a", i % 900, i) for i in range(4000)] + [("b", i % 1500 + 600, i) for i in range(4000)] + [("b", None, 1)]
    df = spark.createDataFrame(rows, "k string, u long, s long").withColumn("ts", F.timestamp_seconds("s"))
    slices = sk.distinct_slices(df, ["k"], "u", width="1 minute")
    got = {r["k"]: r["distinct"] for r in sk.merged_distinct(slices, ["k"]).collect()}
    assert abs(got["a"] - 900) <= 45 and abs(got["b"] - 1500) <= 75
    assert sk.shared_distinct(slices, "k").first()["shared"] == 300


@pytest.mark.parametrize("n", [0, 1, 7, 40, 100, 1000])
def test_newest_records(spark, n):
    rnd = random.Random(n)
    rows = [(i, None if i % 31 == 0 else rnd.randrange(12) * 1800) for i in range(100)]
    df = spark.createDataFrame(rows, "log_id long, s long").withColumn("created_at", F.timestamp_seconds("s"))
    got = sorted(r["log_id"] for r in an.last_records(df, n).collect())
    want = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), -r[0]))[:n]
    assert got == sorted(i for i, _ in want)


def test_rank_values_with_many_buckets(spark):
    rows = [("a", float(i % 977)) for i in range(4000)] + [("b", 1.0)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(4)
    got = scale.rank_values(df, ["k"], "v", {"p10": 0.1, "p95": 0.95, "last": 1.0}, bucket_values=20)
    ordered = sorted(v for k, v in rows if k == "a")
    assert {tuple(r) for r in got.collect()} == {("a", ordered[400], ordered[3800], ordered[-1]), ("b", 1.0, 1.0, 1.0)}


def test_tables_of_many_files_stream_whole(spark, sf_dir, tmp_path):
    for name in ("documents", "conversations"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").repartition(3).write.parquet(f"{tmp_path}/{name}.parquet")
    for name in ("stream_ingestion", "stream_session_history", "stream_history_from_table"):
        one, many = (QUERIES[name](spark, folder) for folder in (sf_dir, str(tmp_path)))
        expected = sorted(one.collect())
        assert expected and sorted(many.collect()) == expected


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


# Nothing is left of some: composed with a mark, "a" becomes a character that is removed.
ODD_TEXTS = [None, "", " \t\r\n", "\u2019\u2013", "a\u0323", "\u0301", "\u3000\u200b", "a", "a\u0301", "\u4e2d", "a\u0323 b", "x\n", "\u00e9"]


def test_documents_that_fail_are_those_that_clean_to_nothing(spark):
    docs = spark.createDataFrame(list(enumerate(ODD_TEXTS)), "doc_id long, text string")
    cleaned = {r["doc_id"]: r["c"] for r in docs.select("doc_id", tx.clean_text("text").alias("c")).collect()}
    _, failed = ss.prepare(docs)
    assert sorted(r["doc_id"] for r in failed.collect()) == sorted(i for i, c in cleaned.items() if c == "") == [0, 1, 2, 3, 4, 5, 6]
    sure = docs.filter(tx.surely_kept("text"))
    assert all(cleaned[r["doc_id"]] for r in sure.collect()) and sure.count() == 3
    # The others are told apart before anything goes to Python.
    assert "NOT RLIKE" in plan(failed).split("ArrowEvalPython")[-1]


def test_a_document_is_cleaned_once_and_dealt_to_many_tasks(spark):
    docs = spark.createDataFrame([(i, f"some words of document {i}. " * 40) for i in range(64)], "doc_id long, text string").coalesce(1)
    passed, _ = ss.prepare(docs)
    shown = plan(passed)
    assert shown.count("_compose(") == 1 and shown.count("{1,500}") == 1
    # The three counts of a chunk, and one of the whole text.
    assert shown.count("\\p{Nd}") == 1 and shown.count("XYZ ]+") == 1 and shown.count("XYZ]+") == 1
    chunks = passed.select("doc_id", F.spark_partition_id().alias("p")).collect()
    assert len({r["doc_id"] for r in chunks}) == 64 and len({r["p"] for r in chunks}) > 1


def test_one_key_does_not_make_one_task(spark):
    docs = spark.createDataFrame([(None, f"text number {i} without a key. " * 3) for i in range(64)], "doc_id long, text string")
    passed, _ = ss.prepare(docs)
    chunks = passed.select(F.spark_partition_id().alias("p")).collect()
    assert len(chunks) == 64 and len({r["p"] for r in chunks}) > 1


def test_fast_classes_hold_the_same_characters(spark):
    points = [chr(i) for i in range(0x3100) if i] + [chr(i) for i in (0x4E00, 0x9FFF, 0xA000, 0xF900, 0xFE10, 0xFF00, 0xFFEF, 0xFFF0, 0x1F600)]
    rows = spark.createDataFrame([(c,) for c in points], "c string")
    wide = r"[\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
    rnd = random.Random(5)
    spaced = spark.createDataFrame([("".join(rnd.choice("\r\n\n \t  a") for _ in range(rnd.randrange(40))),) for _ in range(3000)], "c string")
    slow = F.col("c")
    for pattern, to in ((r"\r\n?", "\n"), (r"\n{3,}", "\n\n"), (r"[ \t]{3,}", " ")):
        slow = F.regexp_replace(slow, pattern, to)
    assert spaced.filter(tx.clean_text("c") != tx.strip(slow)).count() == 0
    around = F.concat(F.lit("x"), "c", F.lit("x"))
    kept = tx.clean_text(around, compose=False) != F.regexp_replace(F.translate(around, "\r", "\n"), f"[^{tx.KEEP_RANGES}]", "")
    assert rows.filter(kept | (F.col("c").rlike(wide) != (tx.ascii_spaces("c") != F.col("c")))).count() == 0
    classes = F.lit(rf"{tx.PUNCTUATION}|\p{{Nd}}|{tx.CJK}")
    assert rows.filter(F.regexp_count("c", classes) != F.regexp_count(tx.beside_words("c"), classes)).count() == 0


def test_texts_of_a_batch_are_not_shuffled_for_its_dead_letters(spark, monkeypatch):
    written = {}
    monkeypatch.setattr(ss, "replace_partition", lambda df, path, **partition: written.update({path.rsplit("/", 1)[1]: df}))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        batch = spark.createDataFrame([(i, f"text {i} " * 30) for i in range(50)] + [(50, " "), (51, None)], "doc_id long, text string")
        ss.admit_batch("/nowhere")(batch, 0)
        shown = plan(written["dead"])
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in shown and "SortMergeJoin" not in shown
    assert sorted((r["doc_id"], r["text"]) for r in written["dead"].collect()) == [(50, " "), (51, None)]
