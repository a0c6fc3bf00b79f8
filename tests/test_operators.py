"""Operators whose results depend on order, models or files: small cases by hand."""

import random
import re
import time
import tracemalloc

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom import scale
from docloom.functions import classify as cl
from docloom.functions import text as tx
from docloom.operators import chunking as ch
from docloom.operators import expansion as ex
from docloom.operators import graph as gr
from docloom.operators import quality as ql
from docloom.operators import ranking as rk
from docloom.operators import relations as rl
from docloom.operators import retrieval as rt
from docloom.operators import structure as st
from docloom.operators.asof import asof_join
from docloom.sources import files as fl
from docloom.sources import sinks as sk
from docloom.streaming import streams as ss


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values))
    return df.select(column.alias("v")).first()["v"]


# --- text ----------------------------------------------------------------------
def test_clean_text_composes_and_strips(spark):
    raw = "e\u0301te\u0301\r\n\n\n\nx    y \u2014 z\U0001f600"
    assert one(spark, tx.clean_text("t"), t=raw) == "\u00e9t\u00e9\n\nx y  z"


@pytest.mark.parametrize(
    "text,expected",
    [
        ("short", "short"),
        ("x" * 40 + "a" * 30 + "tail", "x" * 40 + "\n\n【系统提示：检测到异常输出，已截断】"),
        ("【】" * 12 + "end", ("【】" * 12 + "end")[:100] + "\n\n【系统提示：检测到异常输出，已截断】"),
        ("head\nsecond\n" + "loop\n" * 8, "head\nsecond\n\n【系统提示：检测到重复输出，已截断】"),
        ("a line\nanother line", "a line\nanother line"),
    ],
)
def test_sanitize_output(spark, text, expected):
    assert one(spark, tx.sanitize_output("t"), t=text) == expected


def test_character_hashes_of_whole_batches(spark):
    texts = [None, "", "abc", "\u4e2d\u6587 \U0001f600", "\u07ff\u0800\uffff", "aab" * 50, "\u00e9"]
    assert tx._hash_all(pa.array(texts, pa.string()).slice(1)).to_pylist() == [tx.hash_characters(t) for t in texts[1:]]
    assert tx._hash_all(pa.array([None, None], pa.string())).to_pylist() == [None, None]
    arrays = [texts[1:4], [], None, texts[4:]]
    rows = spark.createDataFrame([(i, a) for i, a in enumerate(arrays)], "i int, a array<string>")
    got = {r["i"]: r["h"] for r in rows.select("i", tx.char_hashes("a").alias("h")).collect()}
    assert got == {i: None if a is None else [tx.hash_characters(t) for t in a] for i, a in enumerate(arrays)}


def test_safe_truncate_never_splits_a_character(spark):
    for text in ("ab\u00e9\u00e9", "\u4e2d\u6587\u5b57", "a\U0001f600b"):
        for n in range(1, 9):
            cut = one(spark, tx.safe_truncate("t", n), t=text)
            want = text.encode()[:n].decode("utf-8", "ignore")
            assert cut == want


def test_char_hash_matches_a_plain_fold():
    for text in ("", "abc", "\u4e2d\u6587 \U0001f600", "aab" * 50):
        h = 0
        for c in map(ord, text):
            h = (h ^ ((c << 5) + (c >> 2) + 0x9E3779B9)) & 0xFFFFFFFF
        assert tx.hash_characters(text) == h


def test_chinese_queries_are_routed(spark):
    df = cl.classify(spark.createDataFrame([("为什么数据库会变慢",), ("你好",), ("对比分析两种架构的优劣",)], ["query"]))
    rows = {r["query"]: r for r in df.collect()}
    assert rows["为什么数据库会变慢"]["intent"] == "REASONING"
    assert (rows["你好"]["tier"], rows["你好"]["route"]) == ("C0", "direct_answer")
    assert (rows["对比分析两种架构的优劣"]["tier"], rows["对比分析两种架构的优劣"]["route"]) == ("C2", "agentic_rag")


def test_whole_word_matching_is_optional(spark):
    q = "have you read this"
    assert one(spark, cl.admission("t")["decision"], t=q) == "refuse"  # "av" inside "have"
    assert one(spark, cl.admission("t", whole_word=True)["decision"], t=q) == "pass"


# --- chunking ---------------------------------------------------------------------
def test_sliding_chunks_pack_whole_sentences(spark):
    rng = random.Random(3)
    docs = [(i, "".join("w" * rng.randint(1, 30) + rng.choice("!?\n") for _ in range(40))) for i in range(20)]
    got = ch.sliding_chunks(spark.createDataFrame(docs, ["doc_id", "text"]), size=60, overlap=25)
    rows = {}
    for r in got.orderBy("doc_id", "chunk_idx").collect():
        rows.setdefault(r["doc_id"], []).append(r["content"])
    for doc_id, text in docs:
        sents = [s.strip() for s in text.replace("!", "!\0").replace("?", "?\0").replace("\n", "\n\0").split("\0")]
        sents = [s for s in sents if s]
        at = 0
        for chunk, after in zip(rows[doc_id], [*rows[doc_id][1:], None]):
            n = next(k for k in range(1, len(sents) - at + 1) if "".join(sents[at : at + k]) == chunk)
            end = at + n  # whole sentences, as many as fit
            assert n == 1 or len(chunk) <= 60
            assert end == len(sents) or len(chunk) + len(sents[end]) > 60
            if after is None:
                assert end == len(sents)
                break
            starts = [k for k in range(at + 1, end + 1) if "".join(sents[k:]).startswith(after)]
            fitting = [k for k in starts if sum(map(len, sents[k:end])) <= 25]
            at = min(fitting) if fitting else starts[0]  # as much overlap as fits
            assert at == at and (at == end or sum(map(len, sents[at:end])) <= 25)


def test_links_are_symmetric(spark):
    docs = spark.createDataFrame([(1, "a" * 1200), (2, "b" * 10)], ["doc_id", "text"])
    rows = {r["chunk_id"]: r for r in ch.fixed_chunks(docs).collect()}
    for r in rows.values():
        if r["next_chunk_id"]:
            assert rows[r["next_chunk_id"]]["prev_chunk_id"] == r["chunk_id"]
    assert "".join(rows[f"1:{i}"]["content"] for i in range(3)) == "a" * 1200


def test_recursive_chunks(spark):
    para = lambda c, n: c * n
    text = (
        "# One\nshort section\n# Two\n"
        + "\n\n".join([para("a", 30), para("b", 30), para("c", 30)])
        + "\n\n" + "Long one. " * 12
    )
    rows = ch.recursive_chunks(spark.createDataFrame([(7, text)], ["doc_id", "text"]), size=70, overlap=10)
    got = [(r["chunk_type"], r["heading"], r["content"]) for r in rows.orderBy("chunk_idx").collect()]
    assert got[0] == ("section", "One", "short section")
    assert got[1][0] == "parent" and len(got[1][2]) == 70
    leaves = [c for k, _, c in got[2:]]
    assert leaves[0] == "a" * 30 + "\n\n" + "b" * 30
    assert leaves[1] == "b" * 10 + "\n\n" + "c" * 30
    assert leaves[2] == "Long one." * 7 and leaves[3] == "Long one." * 5
    linked = ch.link_leaves(rows).filter("chunk_type = 'leaf'").orderBy("chunk_idx").collect()
    assert [r["next_chunk_id"] for r in linked[:-1]] == [r["chunk_id"] for r in linked[1:]]
    assert {r["parent_id"] for r in linked} == {"7:1"}


def test_procedure_pieces_keep_steps_whole(spark):
    text = "\n".join(f"Step {i}: " + "x" * 20 for i in range(1, 7))
    pieces = one(spark, ch.procedure_pieces("t", 70), t=text)
    assert "\n".join(pieces) == text and all(p.startswith("Step") for p in pieces)
    assert [p.count("Step") for p in pieces] == [2, 2, 2]


def test_table_pieces_repeat_the_header(spark):
    head, rule = "| k | v |", "|---|---|"
    rows = [f"| {i} | x |" for i in range(23)]
    pieces = one(spark, ch.table_pieces("t"), t="\n".join(["intro", head, rule, *rows, "", "| 99 | y |"]))
    assert [p.count("\n") - 1 for p in pieces] == [10, 10, 3]
    assert all(p.startswith(f"{head}\n{rule}\n") for p in pieces)


def test_section_tree_of_mixed_levels(spark):
    text = "### deep\n## mid\n#### low\n# top\n## child\n## sibling\n第一章 开始"
    tree = st.section_tree(st.headings(st.line_rows(spark.createDataFrame([(1, text)], ["doc_id", "text"]))))
    paths = [" > ".join(r["path"]) for r in tree.orderBy("order_index").collect()]
    assert paths == ["deep", "mid", "mid > low", "top", "top > child", "top > sibling", "第一章"]


def test_relation_graph_of_two_sections(spark):
    rows = [(1, f"c{i}", i, h, "x") for i, h in enumerate(["s1", "s1", "s2", "s2"], start=1)]
    df = spark.createDataFrame(rows, ["doc_id", "chunk_id", "chunk_idx", "heading", "content"])
    got = {r["chunk_id"]: r for r in ch.group_sections(df).collect()}
    assert (got["c1"]["next_chunk_id"], got["c2"]["prev_chunk_id"], got["c3"]["next_chunk_id"]) == ("c2", "c1", "c4")
    assert got["c2"]["next_chunk_id"] is None and got["c4"]["parent_chunk_id"] == "c3"


def test_asof_join_across_buckets(spark):
    rng = random.Random(5)
    left = [(k, rng.randint(0, 5000)) for k in (1, 2) for _ in range(200)]
    right = sorted({(k, rng.randint(0, 5000)) for k in (1, 2) for _ in range(40)})
    got = asof_join(
        spark.createDataFrame(left, ["k", "pos"]), spark.createDataFrame([(k, p, p) for k, p in right], ["k", "at", "val"]),
        ["k"], "pos", "at", ["val"], width=100,
    )
    want = sorted((k, p, max((a for kk, a in right if kk == k and a <= p), default=-1)) for k, p in left)
    assert sorted((r["k"], r["pos"], -1 if r["val"] is None else r["val"]) for r in got.collect()) == want


# --- quality ------------------------------------------------------------------------
def test_near_hashes_are_rejected_in_order():
    masks = ql.flips()
    assert len(masks) == 32 and all(m.bit_count() == 1 for m in masks)


def test_quality_rules(spark):
    good = "A sentence that is long enough to stay."
    pieces = [good, "tiny", "1" * 40, "!?" * 20, good, "x" + " " * 40]
    docs = spark.createDataFrame([(1, pieces)], ["doc_id", "pieces"])
    rows = ql.judge_chunks(docs, profile=None).orderBy("chunk_idx").collect()
    assert [r["reject_reason"] for r in rows] == [None, "MIN_LENGTH", "DIGIT_RATIO", "PUNCT_RATIO", "DEDUP", "CONTENT_RATIO"]


def test_legacy_score_example(spark):
    chunks = ["A valid chunk of sufficient length."] * 3 + ["short"] * 7
    df = spark.createDataFrame([(1, c) for c in chunks], ["doc_id", "content"])
    assert ql.legacy_scores(df).first()["valid_ratio"] == 0.3


# --- retrieval -------------------------------------------------------------------------
def brute_bm25(queries, docs):
    import math
    import re

    toks = {i: re.findall(r"[一-龥]+|[a-zA-Z0-9]+", d) for i, d in docs.items()}
    n, avg = len(docs), sum(map(len, toks.values())) / len(docs)
    df = {}
    for ts in toks.values():
        for t in set(ts):
            df[t] = df.get(t, 0) + 1
    idf = {t: math.log(n - c + 0.5) - math.log(c + 0.5) for t, c in df.items()}
    floor = 0.25 * sum(idf.values()) / len(idf)
    idf = {t: floor if v < 0 else v for t, v in idf.items()}
    out = {}
    for q, text in queries.items():
        for i, ts in toks.items():
            s = 0.0
            for t in re.findall(r"[一-龥]+|[a-zA-Z0-9]+", text):
                tf = ts.count(t)
                s += idf.get(t, 0) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(ts) / avg))
            if s > 0:
                out[q, i] = round(s, 6)
    return out


def test_bm25_equals_brute_force(spark):
    docs = {f"d{i}": f"common word{i % 4} Python 编程 " + "pad " * i for i in range(12)}
    docs["d99"] = "Python Python 编程"
    queries = {"q1": "Python 编程", "q2": "word1 word1 common", "q3": "absent"}
    hits = rt.bm25(
        spark.createDataFrame(list(queries.items()), ["query_id", "query"]),
        spark.createDataFrame(list(docs.items()), ["chunk_id", "content"]), k=None,
    )
    got = {(r["query_id"], r["id"]): r["score"] for r in hits.collect()}
    want = brute_bm25(queries, docs)
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-5 for k in want)


def test_rrf_counts_both_lists_and_order_of_sources(spark):
    schema = "query_id int, id string, score double, rnk int"
    dense = spark.createDataFrame([(1, "a", 0.9, 0), (1, "b", 0.8, 1)], schema)
    sparse = spark.createDataFrame([(1, "b", 3.0, 0), (1, "c", 2.0, 1)], schema)
    rows = rk.rrf({"dense": dense, "sparse": sparse}).orderBy("rnk").collect()
    assert [r["id"] for r in rows] == ["b", "a", "c"]
    assert rows[0]["rrf_score"] == round(1 / 62 + 1 / 61, 6)


def vectors(n, dim=16, seed=1):
    rng = np.random.default_rng(seed)
    return [(i, [float(x) for x in rng.normal(size=dim)]) for i in range(n)]


def test_exact_knn_blocks_agree(spark, monkeypatch):
    units = spark.createDataFrame(vectors(300), "id long, vec array<double>").repartition(7)
    queries = spark.createDataFrame(vectors(40, seed=2), "query_id long, vec array<double>")
    whole = {tuple(r) for r in rt.exact_knn(queries, units, 5).collect()}
    monkeypatch.setattr(rt, "BLOCK_ROWS", 9)
    for sent in (0, rt.SENT_BYTES):
        monkeypatch.setattr(rt, "SENT_BYTES", sent)
        assert {tuple(r) for r in rt.exact_knn(queries, units, 5).collect()} == whole
    assert len(whole) == 200


def test_exact_knn_shuffles_a_block_once(spark, monkeypatch):
    """Both sides are large: neither is repeated for the blocks of the other; copies are tied by id."""
    rows = [(i, v) for i, (_, v) in enumerate(vectors(60) * 3)]
    units = spark.createDataFrame(rows, "id long, vec array<double>").repartition(5)
    monkeypatch.setattr(rt, "BLOCK_ROWS", 9)
    monkeypatch.setattr(rt, "SENT_BYTES", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = rt.exact_knn(units.withColumnRenamed("id", "query_id"), units, 4)
        plan = found._jdf.queryExecution().toString()
        got = {(r["query_id"], r["rnk"]): r["id"] for r in found.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "CartesianProduct" in plan and "Generate" not in plan
    assert len(got) == 4 * 180 and all(got[q, n] == q % 60 + 60 * n for q in range(180) for n in range(3))


def test_ivf_recall(spark):
    units = spark.createDataFrame(vectors(600), "id long, vec array<double>")
    queries = spark.createDataFrame(vectors(30, seed=2), "query_id long, vec array<double>")
    exact = {(r["query_id"], r["id"]) for r in rt.exact_knn(queries, units, 10).collect()}
    centroids = rt.ivf_centroids(units, 12)
    near = {(r["query_id"], r["id"]) for r in rt.ivf_knn(queries, units, centroids, 10, probes=6, rows_per_part=20).collect()}
    assert len(near & exact) / len(exact) >= 0.75
    every = {(r["query_id"], r["id"]) for r in rt.ivf_knn(queries, units, centroids, 10, probes=12).collect()}
    assert every == exact


def test_pair_scorer_hook(spark):
    @F.pandas_udf(T.DoubleType())
    def overlap(query: pd.Series, text: pd.Series) -> pd.Series:
        return pd.Series([float(len(set(q.split()) & set(t.split()))) for q, t in zip(query, text)])

    hits = spark.createDataFrame(
        [(1, "a", 0, "x y", "z"), (1, "b", 1, "x y", "x y z"), (1, "c", 2, "x y", "y")], ["query_id", "id", "rnk", "query", "text"]
    )
    rows = rk.rerank_with(hits, overlap, top_n=2).orderBy("rnk").collect()
    assert [(r["id"], r["rerank_score"]) for r in rows] == [("b", 2.0), ("c", 1.0)]


def test_context_budget(spark):
    hits = spark.createDataFrame(
        [(1, 0, "a" * 50), (1, 1, "  "), (1, 2, "b" * 300), (1, 3, "c")], "query_id int, rnk int, text string"
    )
    text = rk.build_context(hits, max_chars=200).first()["context"]
    first, second = text.split("\n\n---\n\n")
    assert first == "[来源1]\n" + "a" * 50
    assert second == "[来源3]\n" + "b" * (200 - 56)


def test_expansion_skips_anchors_already_shown(spark):
    chunks = spark.createDataFrame([(f"1:{i}", 1, i, i // 4) for i in range(12)], ["chunk_id", "doc_id", "chunk_idx", "section_no"])
    hits = spark.createDataFrame([(1, "1:1", 0), (1, "1:2", 1), (1, "1:9", 2)], ["query_id", "id", "rnk"])
    rows = {(r["chunk_id"], r["anchor_rnk"]) for r in ex.expand(hits, chunks).collect()}
    assert rows == {("1:0", 0), ("1:2", 0), ("1:3", 0), ("1:7", 2), ("1:8", 2), ("1:10", 2), ("1:11", 2)}


# --- graph ---------------------------------------------------------------------------------
@pytest.mark.parametrize("limit", [None, 7])
def test_many_queries_walk_together(spark, limit):
    rnd = random.Random(6)
    edges = [(f"v{rnd.randrange(60):02d}", "r", f"v{rnd.randrange(60):02d}") for _ in range(70)] + [("hub", "r", f"v{i:02d}") for i in range(40)]
    seeds = [(q, f"v{rnd.randrange(60):02d}") for q in range(150) for _ in range(rnd.choice([1, 1, 2]))] + [(200, "hub"), (201, "nowhere")]
    near = {}
    for a, _, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    want = set()
    for q in {q for q, _ in seeds}:
        depth = {n: 0 for p, n in seeds if p == q}
        for d in range(1, 4):
            for n in [n for n, e in depth.items() if e == d - 1]:
                for m in near.get(n, ()):
                    depth.setdefault(m, d)
        rows = sorted((d, n) for n, d in depth.items())
        want |= {(q, n, d) for d, n in rows[:limit]}
    s, e = spark.createDataFrame(seeds, "query_id long, name string"), spark.createDataFrame(edges, "source string, relation_type string, target string")
    for walk in (gr.multi_hop, gr.multi_hop_packed):
        assert {(r["query_id"], r["name"], r["depth"]) for r in walk(s, e, hops=3, max_nodes=limit).collect()} == want
        assert walk(s.limit(0), e).count() == 0


def test_multi_hop_depths_and_limit(spark):
    edges = spark.createDataFrame([("a", "r", "b"), ("b", "r", "c"), ("c", "r", "d"), ("d", "r", "e")], ["source", "relation_type", "target"])
    seeds = spark.createDataFrame([(1, "a")], ["query_id", "name"])
    rows = {r["name"]: r["depth"] for r in gr.multi_hop(seeds, edges).collect()}
    assert rows == {"a": 0, "b": 1, "c": 2, "d": 3}
    assert gr.multi_hop(seeds, edges, max_nodes=2).count() == 2


# --- files ------------------------------------------------------------------------------------
def test_decode_falls_back(spark, tmp_path):
    cases = {"u.txt": "héllo 中文".encode(), "g.txt": "中文编程".encode("gbk"), "l.txt": b"\xff\xfe\xe9x\x80"}
    for name, raw in cases.items():
        (tmp_path / name).write_bytes(raw)
    rows = {r["path"].rsplit("/", 1)[-1]: r["text"] for r in fl.text_corpus(fl.read_files(spark, str(tmp_path))).collect()}
    assert rows["u.txt"] == "héllo 中文" and rows["g.txt"] == "中文编程"
    assert rows["l.txt"] == cases["l.txt"].decode("latin-1")


def test_parser_registry(spark):
    @fl.register_parser("rev")
    def reverse(content):
        return F.reverse(content.cast("string"))

    files = spark.createDataFrame(
        [("a.rev", bytearray(b"abc")), ("b.csv", bytearray(b"k,v\n1,2\n")), ("c.bin", bytearray(b"x"))],
        "path string, content binary",
    )
    rows = {r["path"]: r["text"] for r in fl.parse_files(files).collect()}
    assert rows == {"a.rev": "cba", "b.csv": "| k | v |\n| --- | --- |\n| 1 | 2 |", "c.bin": None}


def test_csv_records(spark):
    text = 'a,"b, ""c""\nd",e\r\n\n x ,5" pipe\n"open, end'
    rows = one(spark, fl.csv_rows("t"), t=text)
    assert rows == [["a", 'b, "c"\nd', "e"], [""], ["x", '5" pipe'], ["open, end"]]
    assert one(spark, fl.csv_rows("t"), t="") == [] and one(spark, fl.csv_rows("t"), t="\n\n") == [[""], [""]]
    long = "\n".join(f"{i},{'y' * 20_000 if i == 5 else i}" for i in range(7000))
    assert one(spark, fl.csv_markdown("t"), t=long).count("\n") == 7000
    assert one(spark, fl.csv_markdown("t", 10), t=long).count("\n") == 10


def test_equal_requests_are_all_visible(spark):
    from docloom.operators import relations as rl

    names = "doc_id long, tenant_id string, dept_id string, user_id long, n int"
    asked = spark.createDataFrame([(1, "t", None, 5, 1), (1, "t", None, 5, 1), (1, "t", None, 5, 2), (2, "t", "d", 5, 3)], names)
    granted = spark.createDataFrame([(1, "tenant", "t"), (1, "user", "5"), (2, "public", "x")], "doc_id long, scope_type string, scope_value string")
    assert sorted(r.n for r in rl.visible(asked, granted).collect()) == [1, 1, 2]


def test_append_new_is_idempotent(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], ["doc_id", "x"])
    for _ in range(2):
        sk.append_new(df, f"{tmp_path}/t", "doc_id")
    assert spark.read.parquet(f"{tmp_path}/t").count() == 2


# --- scale -------------------------------------------------------------------------------------
def test_rank_values_with_a_hot_key_and_ties(spark):
    rng = random.Random(11)
    rows = [("hot", 5.0)] * 400 + [("hot", rng.random() * 10) for _ in range(800)] + [("cold", 1.0)]
    got = scale.rank_values(spark.createDataFrame(rows, ["k", "v"]).repartition(5), ["k"], "v", {"p50": 0.5, "p99": 0.99})
    by_key = {r["k"]: r for r in got.collect()}
    for key in ("hot", "cold"):
        values = sorted(v for k, v in rows if k == key)
        assert by_key[key]["p50"] == values[int(len(values) * 0.5)]
        assert by_key[key]["p99"] == values[min(int(len(values) * 0.99), len(values) - 1)]


def test_results_do_not_depend_on_partitions(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")

    def run(df):
        pieces = df.select("doc_id", ch.fixed_pieces("text").alias("pieces"))
        return sorted(map(tuple, ql.near_duplicates(ql.judge_chunks(pieces, profile=None)).collect()))

    assert run(docs.repartition(1)) == run(docs.orderBy(F.rand(1)).repartition(13))


# --- streams --------------------------------------------------------------------------------------
def test_stream_equals_batch(spark, sf_dir):
    class Here:
        pass

    t = Here()
    t.spark, t.sf_dir = spark, sf_dir
    stream = ss.read_table_stream(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    batch = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    got = set(map(tuple, ss.run_to_table(ss.throughput(stream), "t").collect()))
    want = set(map(tuple, ss.throughput(batch).collect()))
    assert got <= want and len(want) - len(got) <= 11


def test_dead_letters(spark):
    dead = spark.createDataFrame([(1, 0), (2, 3)], ["doc_id", "retries"])
    again, lost = ss.retry_failed(dead)
    assert [tuple(r) for r in again.collect()] == [(1, 1)] and [r["doc_id"] for r in lost.collect()] == [2]


def test_ingest_is_idempotent_and_quarantines(spark, tmp_path):
    docs = spark.createDataFrame([(1, "A useful sentence, long enough to be kept by the rules. " * 3), (2, " ")], ["doc_id", "text"])
    for _ in range(2):
        ss.ingest_batch(str(tmp_path))(docs, 0)
    assert spark.read.parquet(f"{tmp_path}/chunks").count() == 1
    assert spark.read.parquet(f"{tmp_path}/failed").select("doc_id").collect()[0][0] == 2


def test_keyset_pages_cover_everything(spark):
    df = spark.createDataFrame([(i, i // 3) for i in range(20)], "id long, created_at long")
    seen, after = [], None
    while True:
        rows = rl.keyset_page(df, after, limit=6).collect()
        if not rows:
            break
        seen += [r["id"] for r in rows]
        after = (rows[-1]["created_at"], rows[-1]["id"])
    assert seen == list(range(19, -1, -1))


def test_overlap_suffix_takes_the_last_sentence_in_linear_time(spark):
    rnd = random.Random(5)
    texts = ["".join(rnd.choice("ab \n.!。é𝄞") for _ in range(rnd.randint(0, 30))) + "x" * rnd.choice([0, 12]) for _ in range(300)]
    long = ("x" * 40_000 + ".") * 3 + "y" * 15

    def expected(text):
        text, stops = text.rstrip(), tx.SENTENCE_STOP_DOT
        tail = text[-10:]
        if len(text) <= 10:
            return text
        if re.search(f"[{stops}]", tail):
            return re.search(f"[^{stops}]*[{stops}]", tail)[0].strip()
        return re.search(rf"[^{stops}]*(?:[{stops}][^{stops}]*)?\Z", text)[0].strip() or tail.strip()

    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r["i"]: r["o"] for r in rows.select("i", tx.overlap_suffix("t", 10).alias("o")).collect()}
    assert got == {i: expected(t) for i, t in enumerate(texts)}
    started = time.monotonic()
    only = spark.createDataFrame([(long,)], "t string").select(tx.overlap_suffix("t", 10).alias("o")).first()["o"]
    assert only == "x" * 40_000 + "." + "y" * 15 and time.monotonic() - started < 10


def test_character_hashes_take_memory_by_block():
    rnd = random.Random(6)
    texts = ["".join(rnd.choice("aé中𝄞") for _ in range(rnd.randint(0, 40))) for _ in range(200)] + [None, "", "é" * 5000]
    expected = [None if t is None else tx.hash_characters(t) for t in texts]
    whole = tx.HASH_BYTES
    try:
        for size in (1, 7, 64, whole):
            tx.HASH_BYTES = size
            assert tx._hash_all(pa.array(texts)).to_pylist() == expected
            assert tx._hash_all(pa.array(texts)[3:50]).to_pylist() == expected[3:50]
    finally:
        tx.HASH_BYTES = whole
    big = pa.array(["some words of a text " * 100] * 10_000)
    tracemalloc.start()
    assert set(tx._hash_all(big).to_pylist()) == {tx.hash_characters("some words of a text " * 100)}
    used = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert used < 150_000_000


def test_rows_are_packed_slice_by_slice():
    texts = [None if i % 7 == 0 else [f"t{i}"] * (i % 3) for i in range(10_000)]

    rows = pa.array(texts)
    assert ch._by_slices(rows, list).to_pylist() == texts and ch._by_slices(rows[:0], list).to_pylist() == []
    big = pa.array([["some words " * 40] * 5] * 10_000)
    tracemalloc.start()
    assert len(ch._by_slices(big, lambda parts: ["".join(parts)])) == len(big)
    used = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert used < 2_000_000


def test_extractions_are_read_once_and_relations_need_known_ends(spark):
    chunks = spark.createDataFrame([(1, "1:0", "alpha beta gamma alpha delta"), (1, "1:1", "beta beta gamma epsilon zeta"), (2, "2:0", "short")],
                                   "doc_id long, chunk_id string, content string")
    parsed, as_json = (gr.validate(gr.extract(chunks, e)) for e in (gr.term_graph, gr.term_chain))
    assert sorted(map(str, parsed.select("chunk_id", "entities", "relations").collect())) == sorted(
        map(str, as_json.select("chunk_id", "entities", "relations").collect()))
    mentions = gr.entities_of(gr.validate(gr.extract(chunks, gr.term_graph), relations=False))
    merged = gr.merge_entities(mentions.unionByName(mentions))
    got = {r["name"]: (r["type"], r["description"], r["documents"], r["chunks"]) for r in merged.collect()}
    assert got["beta"] == ("term", "", 1, 2) and got["zeta"] == ("term", "", 1, 1) and len(got) == 6
    # One pass over the mentions, not one for each count.
    assert gr.merge_entities(mentions)._jdf.queryExecution().optimizedPlan().toString().count("Generate explode") == 1
    raw = '{"entities":[{"name":"a"},{"name":"b"}],"relations":[{"source":"a","target":"b","relation":"r"},{"source":"a","target":"x","relation":"r"},{"source":"y","target":"b","relation":"r"}]}'
    linked = gr.validate(spark.createDataFrame([(raw,)], "raw string")).first()["relations"]
    assert [(r["source"], r["target"]) for r in linked] == [("a", "b")]
