"""Pruned sparse search, product-quantised neighbours and containment, by brute force."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docloom.operators import ann
from docloom.operators import containment as cn
from docloom.operators import retrieval as rt


# sparse ---------------------------------------------------------------------------
def plain_bm25(queries, units, k):
    n, tf = len(units), {i: Counter(t.split()) for i, t in units}
    avg = sum(sum(c.values()) for c in tf.values()) / n
    df = Counter(w for c in tf.values() for w in c)
    raw = {w: math.log(n - d + 0.5) - math.log(d + 0.5) for w, d in df.items()}
    mean = sum(raw.values()) / len(raw)
    out = {}
    for q, text in queries:
        scores = []
        for i, c in tf.items():
            dl = sum(c.values())
            s = sum(m * (raw[w] if raw[w] >= 0 else 0.25 * mean) * c[w] * 2.5 / (c[w] + 1.5 * (0.25 + 0.75 * dl / avg)) for w, m in Counter(text.split()).items() if c[w])
            if round(s, 6) > 0:
                scores.append((-round(s, 6), i))
        out[q] = [(i, -s) for s, i in sorted(scores)[:k]]
    return out


@pytest.mark.parametrize("units_of_block,seeds", [(128, 2000), (4, 3), (2, 1)])
def test_pruned_search_is_exact(spark, monkeypatch, units_of_block, seeds):
    monkeypatch.setattr(rt, "BLOCK_UNITS", units_of_block)
    monkeypatch.setattr(rt, "SEED_POSTINGS", seeds)
    monkeypatch.setattr(rt.thresholds, "__defaults__", (seeds,))
    rnd = random.Random(seeds)
    word = lambda: f"w{int(rnd.paretovariate(0.5)) % 300}"
    units = [(i, " ".join(word() for _ in range(rnd.choice([0, 1, 5, 40, 90])))) for i in range(300)]
    units += [(300 + i, units[7][1]) for i in range(15)]
    queries = [(i, " ".join(word() for _ in range(rnd.choice([0, 1, 3, 12])))) for i in range(40)] + [(99, "nowhere")]
    u, q = spark.createDataFrame(units, "chunk_id long, content string"), spark.createDataFrame(queries, "query_id long, query string")
    want = plain_bm25(queries, units, 10)
    got = {}
    for r in rt.bm25(q, u, 10).orderBy("query_id", "rnk").collect():
        got.setdefault(r["query_id"], []).append((r["id"], r["score"]))
    assert {k: [i for i, _ in v] for k, v in got.items()} == {k: [i for i, _ in v] for k, v in want.items() if v}
    assert all(s == pytest.approx(w, abs=2e-6) for k, v in got.items() for (_, s), (_, w) in zip(v, want[k]))
    bare = rt.search_index(q, rt.postings(u), rt.unit_lengths(u), 10)
    assert {(r["query_id"], r["id"]) for r in bare.collect()} == {(k, i) for k, v in want.items() for i, _ in v}
    index = rt.build_index(u)
    joined = rt.search_index(q, index.postings, index.lengths, 10)
    assert {(r["query_id"], r["id"]) for r in joined.collect()} == {(k, i) for k, v in want.items() for i, _ in v}
    monkeypatch.setattr(rt, "PASS_QUERIES", 7)
    monkeypatch.setattr(rt, "DENSE_QUERIES", 3)
    assert {(r["query_id"], r["id"]) for r in rt.bm25(q, u, 10).collect()} == {(k, i) for k, v in want.items() for i, _ in v}
    assert rt.bm25(q, u.limit(0), 10).count() == rt.bm25(q.limit(0), u, 10).count() == 0
    every = rt.bm25(q, u, None)
    assert every.count() == sum(len(v) for v in plain_bm25(queries, units, 10**6).values())


def test_few_blocks_are_scored(spark):
    """One rare word a query: what is scored are the blocks that have it."""
    units = spark.createDataFrame([(i, f"the of and x{i % 500} y{i}") for i in range(4000)], "chunk_id long, content string")
    queries = spark.createDataFrame([(i, f"the of and x{i}") for i in range(20)], "query_id long, query string")
    index = rt.build_index(units)
    weights = rt.query_weights(queries, index.postings, index.lengths)
    floors = rt.thresholds(weights, index.postings, F.lit(5.0), 8)
    assert floors.count() == 20
    found = rt.search_units(queries, index, 8)
    assert found.count() == 160 and {r["id"] % 500 == r["query_id"] for r in found.collect()} == {True}


def test_terms_are_counted_in_batches(spark):
    """An index has the terms that the row function counts, without calling it."""
    texts = ["b a b 9", "", None, "!!", "\u4e2d\u6587 z \u4e2d\u6587 A a", *[f"x{i % 7} y{i} x{i % 7}" for i in range(300)]]
    units = spark.createDataFrame(list(enumerate(texts)), "chunk_id long, content string").repartition(3)
    plain = rt.term_frequencies
    with pytest.MonkeyPatch.context() as patched:
        patched.setattr(rt, "term_frequencies", None)
        index = rt.build_index(units)
    assert index.units.schema.simpleString() == "struct<id:bigint,dl:int,terms:array<struct<term:string,tf:int>>,block:bigint>"
    tokens = units.select(F.col("chunk_id").alias("id"), rt.tx.tokenize("content").alias("t"))
    want = tokens.select("id", F.size("t").alias("dl"), plain("t").alias("terms"))
    assert {r.id: r for r in index.units.select("id", "dl", "terms").collect()} == {r.id: r for r in want.collect()}
    empty = rt.build_index(units.limit(0)).units
    assert empty.count() == 0


# dense ----------------------------------------------------------------------------
def vectors(n, dim, seed):
    return np.random.default_rng(seed).normal(size=(n, dim))


def test_quantised_neighbours(spark):
    x = vectors(1500, 16, 1)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1500, [0.0] * 16), (1501, x[3].tolist())]
    units = spark.createDataFrame(rows, "id long, vec array<float>")
    asked = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors(60, 16, 2))] + [(60, x[3].tolist()), (61, None)], "query_id long, vec array<float>")
    exact = {(r["query_id"], r["id"]) for r in rt.exact_knn(asked.filter("vec IS NOT NULL"), units, 5).collect()}
    index = ann.build_index(units, subspaces=8, list_rows=400)
    assert len(index.centres) == 4 and index.rows.selectExpr("sum(size(ids))").first()[0] == len(rows)
    got = ann.pq_knn(asked, units, index, 5, probes=4, short=60).collect()
    assert len({(r["query_id"], r["id"]) for r in got} & exact) >= 0.95 * len(exact)
    assert {r["id"] for r in got if r["query_id"] == 60 and r["rnk"] < 2} == {3, 1501}
    assert ann.shortlist(asked, index, probes=1, short=7).groupBy("query_id").count().filter("count <> 7").count() == 0
    with pytest.raises(ValueError):
        ann.build_index(units, subspaces=5)


def test_quantised_neighbours_among_many_copies(spark):
    x = vectors(30, 16, 4)
    rows = [(i, x[i % 30].tolist()) for i in random.Random(4).sample(range(1800), 1800)]
    units = spark.createDataFrame(rows, "id long, vec array<float>")
    asked = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "query_id long, vec array<float>")
    index = ann.build_index(units, subspaces=8, list_rows=900)
    got = {(r["query_id"], r["rnk"]): r["id"] for r in ann.pq_knn(asked, units, index, 5, short=8).collect()}
    assert got == {(q, n): q + 30 * n for q in range(30) for n in range(5)}


# containment ----------------------------------------------------------------------
@given(st.lists(st.text(alphabet="abé🙂 ", min_size=1, max_size=5), max_size=8, unique=True), st.lists(st.text(alphabet="abcé🙂 ", max_size=40), max_size=6))
@settings(max_examples=150, deadline=None)
def test_automaton(needles, texts):
    automaton = cn.Automaton(needles)
    for raw, ends in cn._slices(pa.array(texts, pa.string())):
        at, needle = automaton.scan(raw)
        got = {(int(np.searchsorted(ends, p - 1)), needles[i]) for p, i in zip(at, needle)}
        assert got == {(t, n) for t, text in enumerate(texts) for n in needles if n in text}


def test_automaton_over_many_stretches():
    rnd = random.Random(2)
    text = "".join(rnd.choice("ab") for _ in range(40_000))
    needles = ["abba", "b" * 9, text[9_000:12_500], "c"]
    raw = next(cn._slices(pa.array([text])))[0]
    at, needle = cn.Automaton(needles).scan(raw)
    got = Counter(needles[i] for _, i in set(zip(at.tolist(), needle.tolist())))
    assert got == {n: sum(text.startswith(n, i) for i in range(len(text))) for n in needles if n in text}


@pytest.mark.parametrize("limit", [10_000, 0])
def test_containment_both_ways(spark, limit):
    texts = [(1, "The quick\nFOX", "x"), (2, "", "y"), (3, None, "z"), (1, "The quick\nFOX", "x"), (4, "é" * 3000 + "fox", "needle"), (5, "o", "o")]
    df = spark.createDataFrame(texts, "id long, said string, other string")
    names = ["fox", "FOX", "quick\nf", "o", "", None, "éé", "absent", "the quick", "é" * 500 + "f"]
    needles = spark.createDataFrame([(n,) for n in names], "needle string")
    got = sorted((r["id"], r["needle"]) for r in cn.contains_terms(df, "said", needles, automaton_needles=limit).collect())
    wanted = {n.lower() for n in names if n}
    assert got == sorted((i, n) for i, t, _ in texts for n in wanted if n in (t or "").lower())
    none = needles.limit(0)
    assert cn.contains_terms(df, "said", none, automaton_needles=limit).count() == 0
    assert cn.contains_terms(df.limit(0), "said", needles, automaton_needles=limit).count() == 0


def test_indexed_needles_meet_each_text_once(spark):
    df = spark.createDataFrame([(1, "Alpha beta gamma"), (2, "nothing"), (3, "beta BETA alphabet"), (1, "Alpha beta gamma"), (4, None)], "id long, said string")
    needles = spark.createDataFrame([("alpha",), ("beta",), ("gamma",), ("alphabet",), ("et",), ("zz",)], "needle string")
    found = cn.contains_terms(df, "said", needles, automaton_needles=0)
    first = [(1, "alpha"), (1, "beta"), (1, "et"), (1, "gamma")]
    assert sorted((r["id"], r["needle"]) for r in found.collect()) == sorted(first * 2 + [(3, "alpha"), (3, "alphabet"), (3, "beta"), (3, "et")])
    # All needles of a text are looked for in one row: its text is not repeated for each of them.
    assert "collect_set" in found._jdf.queryExecution().optimizedPlan().toString()
    values, owners = np.array([7, 7, (1 << 32) - 1, 3, 7]), np.array([2, 2, 0, 2, 0])
    assert cn._lists(values, owners, 3, pa.int64()).to_pylist() == [[7, (1 << 32) - 1], [], [3, 7]]
