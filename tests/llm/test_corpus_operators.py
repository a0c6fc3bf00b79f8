"""Operators that compare, group or order the documents of a corpus."""

import hashlib
import random
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docloom.llm import lines, mixing, near_duplicates, site_quality, substrings
from docloom.llm.components import components
from docloom.llm.queries import QUERIES
from docloom.llm.ranks import ranked
from docloom.llm.tables import read
from tests.llm import brute
from tests.llm.conftest import prose


def frame(spark, texts):
    return spark.createDataFrame(list(texts.items()), "doc_id long, text string")


# shared helpers -------------------------------------------------------------------


def test_ranks_are_gapless_in_groups_of_any_size(spark):
    rows = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("g"))
    got = defaultdict(list)
    for r in ranked(rows, "g", ["id"], rows_per_part=50).collect():
        got[r.g].append(r["rank"])
    assert all(sorted(v) == list(range(len(v))) for v in got.values()) and len(got["hot"]) == 1000


def test_components(spark):
    rnd = random.Random(4)
    links = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 160)] + [(rnd.randrange(200, 300), rnd.randrange(200, 300)) for _ in range(70)]
    parent = {x: x for pair in links for x in pair}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: root(x) for x in parent if any(x in p and p[0] != p[1] for p in links)}


# 4: substrings ----------------------------------------------------------------------


def test_substring_query(spark, sf_dir, corpus):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in QUERIES["op4_block_anchors"](spark, sf_dir).collect()}
    assert got == brute.repeats(corpus)


def test_substrings_of_many_batches(spark):
    rnd = random.Random(8)
    passages = [prose(100 + i, n) for i, n in enumerate((49, 50, 51, 74, 75, 120, 400))]
    texts = {}
    for d in range(120):
        parts = [prose(1000 + d * 5 + j, rnd.randrange(1, 60)) for j in range(3)]
        for _ in range(rnd.randrange(3)):
            parts.insert(rnd.randrange(len(parts)), rnd.choice(passages))
        texts[d] = " ".join(parts)
    texts |= {d: texts[5] for d in range(200, 240)} | {300: "w " * 500, 301: "w " * 60, 302: "w " * 49}
    for size, per_bucket in ((8 << 20, 4_000_000), (20_000, 5_000)):
        out = substrings.remove_repeats(frame(spark, texts), batch_bytes=size, bucket_words=per_bucket).collect()
        assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in out} == brute.repeats(texts)
        assert all(len(r.kept_text.split()) == r.n_words - r.n_removed for r in out)


def test_substrings_of_odd_rows(odd, none):
    rows = substrings.remove_repeats(odd).collect()
    assert len(rows) == odd.count()
    first, second = ([r for r in rows if r.doc_id == d][0] for d in (9, 10))
    assert first.n_removed == 0 and second.n_removed == second.n_words == 80
    assert substrings.remove_repeats(none).count() == 0


def test_substrings_of_documents_with_equal_keys(spark):
    passages = [prose(40 + i, 70) for i in range(4)]
    rows = [(None if i % 3 else 500 + i, f"{prose(2000 + i, 30)} {passages[i % 4]} {prose(3000 + i, 20)}") for i in range(300)]
    rows += [(None, None), (None, None), (500, rows[0][1]), (500, passages[1])] + [(None, prose(1, 90))] * 2500
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    # A document of its own for each text, and a window of a key counts for larger keys only.
    least, spans = {}, lambda w: (tuple(w[i : i + 50]) for i in range(len(w) - 49))
    place = lambda k: (k is None, k or 0)
    for k, t in set(rows):
        for g in spans(brute.words(t)):
            least[g] = min(least.get(g, place(k)), place(k))
    want = Counter()
    for (k, t), n in Counter(rows).items():
        w = brute.words(t)
        gone = {j for i, g in enumerate(spans(w)) if least[g] < place(k) for j in range(i, i + 50)}
        want[k, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)] += n
    out = substrings.remove_repeats(docs, batch_bytes=20_000).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in out) == want
    sizes = substrings.dealt(docs, 10, "text", "doc_id").groupBy("__batch").agg(F.sum(F.length("__text")).alias("n")).collect()
    assert max(r.n for r in sizes) < 3 * sum(r.n for r in sizes) / 10


# 5: lines ---------------------------------------------------------------------------


def test_line_query(spark, sf_dir, corpus):
    want = brute.similar_lines(corpus)
    for r in QUERIES["op5_line_similarity"](spark, sf_dir).collect():
        assert r.removed == ",".join(map(str, want.get(r.doc_id, [])))
        assert r.n_lines == len(corpus[r.doc_id].split("\n")) and r.n_removed == len(want.get(r.doc_id, []))


def test_lines_with_large_groups_of_variants(spark):
    rnd = random.Random(3)
    bases = [prose(i, n).split() for i, n in enumerate((3, 4, 5, 9, 10, 30, 90, 150))]
    texts = {}
    for d in range(150):
        out = []
        for _ in range(4):
            w = list(rnd.choice(bases))
            for _ in range(rnd.randrange(4)):
                w[rnd.randrange(len(w))] = f"v{rnd.randrange(300)}"
            if rnd.random() < 0.3:
                rnd.shuffle(w)
            out.append(" ".join(w) + " " * rnd.randrange(2))
        texts[d] = "\n".join(out)
    want = brute.similar_lines(texts)
    got = lines.dedup_lines(frame(spark, texts)).collect()
    assert {r.doc_id: r.removed for r in got if r.removed} == dict(want)
    for r in got:
        assert r.kept_text == "\n".join(x for i, x in enumerate(texts[r.doc_id].split("\n")) if i not in r.removed)


def test_no_pair_of_unlike_lines_becomes_a_row(spark, monkeypatch):
    """Variants of a line that are alike in too few words meet in the last step, pair by pair."""
    rnd = random.Random(8)
    base = [f"w{i}" for i in range(20)]
    texts = {}
    for d in range(80):
        w = list(base)
        for i in rnd.sample(range(20), 3):
            w[i] = f"v{i}-{rnd.randrange(2)}"
        texts[d] = " ".join(w)
    verified, stored = [], []
    plain, store = lines._verified, lines.materialize
    monkeypatch.setattr(lines, "_verified", lambda pairs, *rest: verified.append(pairs.count()) or plain(pairs, *rest))
    monkeypatch.setattr(lines, "materialize", lambda df, name: stored.append(store(df, name)) or stored[-1])
    got = {r.doc_id: r.removed for r in lines.dedup_lines(frame(spark, texts)).collect() if r.removed}
    assert got == dict(brute.similar_lines(texts))
    assert sum(verified) <= len(texts) and max(df.count() for df in stored) <= 20 * len(texts)


def test_lines_of_documents_with_equal_keys(spark):
    rnd = random.Random(6)
    bases = [prose(i, n).split() for i, n in enumerate((4, 6, 12, 30))]
    rows = [(None, "only here at one\nsame line of six words here"), (None, "same line of six words here\nonly here at two"), (None, None), (7, None)]
    rows += [(k, f"common words of key {k}\nown words {i} of {k} alone") for i in range(3) for k in (7, 8)]
    for i in range(120):
        out = []
        for _ in range(3):
            w = list(rnd.choice(bases))
            w[rnd.randrange(len(w))] = f"v{rnd.randrange(60)}"
            out.append(" ".join(w))
        rows.append((rnd.choice((None, None, 7, 8, 100 + i)), "\n".join(out)))
    rows += rows[:9] * 3
    order = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0, hashlib.md5((r[1] or "").encode()).digest()))
    want = brute.similar_lines({i: text for i, (_, text) in enumerate(order)})
    removed = {r: want.get(i, []) for i, r in enumerate(order)}
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("given", F.col("text"))
    got = lines.dedup_lines(docs, carry=("given",)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.removed == removed[r.doc_id, r.given]
        assert r.given is None or r.kept_text == "\n".join(x for i, x in enumerate(r.given.split("\n")) if i not in r.removed)


def test_lines_of_odd_rows(odd, none):
    rows = lines.dedup_lines(odd).collect()
    assert len(rows) == odd.count()
    assert all(r.kept_text is None and r.n_lines == 0 for r in rows if r.doc_id == 0)
    (r,) = {(tuple(r.removed), r.kept_text) for r in rows if r.doc_id == 11}
    assert r == ((1,), "line one is here\n\nlast")
    assert lines.dedup_lines(none).count() == 0


# 7: site quality ----------------------------------------------------------------------


def test_site_quality_on_held_out_labels(spark):
    docs, labels = (read(spark, "/root/testdata/sf0.01", t) for t in ("documents", "labels"))
    half = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(2)) == 0
    out = site_quality.quality(docs, labels.filter(half), docs["source"], F.concat_ws("/", "source", "lang"))
    held = out.join(labels.filter(~half), "doc_id").select("kept", "quality").collect()
    assert sum(r.kept == bool(r.quality) for r in held) / len(held) > 0.97
    good = [r for r in held if r.quality]
    assert sum(r.kept for r in good) / len(good) > 0.98
    assert out.count() == docs.count()


def test_sparse_sites_are_drawn_to_their_priors(spark):
    rows = [(f"h{h}", f"h{h}/p{i % 4}", float((i * 7 + h) % 10 < (9 if h % 2 else 3))) for h in range(20) for i in range(200)]
    rows += [("tiny", "tiny/p", 0.0), ("h1", "h1/new", 0.0)]
    scored = spark.createDataFrame(rows, "host string, path string, p double")
    hosts, paths, rate, host_pull, path_pull = site_quality.shrunk(scored)
    assert 0.55 < rate < 0.65 and 0 < host_pull < path_pull
    s = {r.host: (r.s + host_pull * rate) / (r.n + host_pull) for r in hosts.collect()}
    assert abs(s["h1"] - 0.9) < 0.02 and abs(s["h2"] - 0.3) < 0.02 and 0.2 < s["tiny"] < 0.6
    new = (0.0 + path_pull * s["h1"]) / (1 + path_pull)
    assert new > 0.8


def test_site_quality_without_labels_and_of_odd_rows(odd, none):
    labels = odd.select("doc_id", F.lit(1).alias("quality"))
    out = site_quality.quality(odd, labels, odd["source"], odd["lang"]).collect()
    assert len(out) == odd.count() and all(not r.kept for r in out if r.evidence is None)
    assert all(r.evidence == 0 for r in out if r.evidence is not None)
    assert site_quality.quality(none, labels, none["source"], none["lang"]).count() == 0


# 8: near duplicates ---------------------------------------------------------------------


def brute_classes(spark, texts):
    """doc_id -> least doc_id of its class, by comparing every pair that shares a shingle."""
    keys = sorted(texts)
    rows = frame(spark, texts).select(F.coalesce("text", F.lit("")).alias("text"))
    sampler = near_duplicates.Sampler(near_duplicates.frequencies(rows))
    shingles, weights, first = sampler.weighted(pa.array([texts[d] or "" for d in keys], pa.large_string()))
    parts = [dict(zip(shingles[a:b].tolist(), weights[a:b])) for a, b in zip(first[:-1], first[1:])]
    parent = list(range(len(keys)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    index, same = defaultdict(list), {}
    for i, p in enumerate(parts):
        for j in {j for s in p for j in index[s]}:
            common = sum(min(w, parts[j][s]) for s, w in p.items() if s in parts[j])
            if common / (sum(p.values()) + sum(parts[j].values()) - common) >= 0.8 - 1e-9:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
        for s in p:
            index[s].append(i)
        a, b = sorted((root(same.setdefault(texts[keys[i]] or "", i)), root(i)))
        parent[b] = a
    return {d: keys[root(i)] for i, d in enumerate(keys)}


def test_near_duplicate_query(spark, sf_dir, corpus):
    rows = QUERIES["op8_weighted_minhash"](spark, sf_dir).collect()
    assert {r.doc_id: r.class_id for r in rows} == brute_classes(spark, corpus)
    sizes = Counter(r.class_id for r in rows)
    assert all(r.class_size == sizes[r.class_id] and r.kept == (r.doc_id == r.class_id) for r in rows)


def test_near_duplicates_in_large_groups(spark):
    rnd = random.Random(11)
    bases = [prose(i, n).split() for i, n in enumerate((6, 40, 150, 151))]
    bases.append(bases[2][:75] + prose(9, 75).split())  # shares a passage with another
    texts = {}
    for d in range(260):
        w = list(rnd.choice(bases))
        for _ in range(rnd.choice((0, 0, 1, 2, 3, 5))):
            w[rnd.randrange(len(w))] = f"v{d}"
        texts[d] = " ".join(w)
    texts |= {1000 + i: prose(500 + i, 80) for i in range(40)} | {2000: "", 2001: " ", 2002: "", 2003: None, 2004: "few words here", 2005: "few  words here"}
    got = {r.doc_id: r.class_id for r in near_duplicates.classes(frame(spark, texts)).collect()}
    assert got == brute_classes(spark, texts)


def test_samples_estimate_weighted_jaccard():
    sampler = near_duplicates.Sampler(np.linspace(1, 1.25, near_duplicates.CLASSES))
    for cut in (10, 40):
        pairs, exact = [], []
        for k in range(60):
            base = prose(k, 400).split()
            pairs += [" ".join(base), " ".join(base[: 400 - cut] + prose(500 + k, cut).split())]
            exact.append(near_duplicates.weighted_jaccard(*(sampler.weighted(pa.array([x], pa.large_string()))[:2] for x in pairs[-2:])))
        values, _ = sampler.samples(pa.array(pairs, pa.large_string()))
        assert abs((values[::2] == values[1::2]).mean() - np.mean(exact)) < 0.03


def test_deduplicated_keeps_one_row_a_class(odd, none):
    kept = near_duplicates.deduplicated(odd)
    assert kept.columns == odd.columns
    texts = [r.text or "" for r in kept.collect()]
    assert sorted(texts) == sorted({r.text or "" for r in odd.collect()})
    assert near_duplicates.deduplicated(none).count() == 0
    assert near_duplicates.classes(none).count() == 0


# 9: mixing --------------------------------------------------------------------------------


def check_mixture(rows, block_rows):
    """Every block lies in its window; at every slot every source is less than one block
    off its target, followed exactly with fractions."""
    n = len(rows)
    assert sorted(r.position for r in rows) == list(range(n))
    blocks = {(r.source, r.block): r for r in rows}
    by_slot = {r.slot: s for (s, _), r in blocks.items()}
    assert sorted(by_slot) == list(range(len(blocks)))
    assert all(r.release <= r.slot < r.deadline for r in rows)
    start = defaultdict(lambda: n)
    for r in rows:
        start[r.slot] = min(start[r.slot], r.position)
    assert [start[s] for s in sorted(start)] == sorted(start.values())
    return by_slot


@pytest.mark.parametrize("weights", [None, {"a": 5, "b": 3, "c": 1}, {"a": 1, "d": 1}])
def test_mixture(spark, weights):
    counts = {"a": 1000, "b": 301, "c": 77, "d": 5, None: 3}
    rows = [(i, s) for i, s in enumerate(x for s, k in counts.items() for x in [s] * k)]
    docs = spark.createDataFrame(rows, "doc_id long, source string")
    got = mixing.interleave(docs, weights, block_rows=8).collect()
    by_slot = check_mixture(got, 8)
    given = spark.createDataFrame([(s or "",) for _, s in rows], "source string")
    table = mixing.source_table(given, weights, 8, 64, 0.5).collect()
    left, ideal, real = {r.source: r.blocks for r in table}, Counter(), Counter()
    weight = {r.source: r.weight for r in table}
    for slot in range(len(by_slot)):
        room = Fraction(1)
        while room > 0:  # ideal service during one slot, past sources that run out in it
            alive = [s for s in left if ideal[s] < left[s]]
            total = sum(weight[s] for s in alive)
            part = min([room, *((left[s] - ideal[s]) * Fraction(total, weight[s]) for s in alive)])
            for s in alive:
                ideal[s] += part * Fraction(weight[s], total)
            room -= part
        real[by_slot[slot]] += 1
        assert all(abs(real[s] - ideal[s]) < 1 for s in left)


@pytest.mark.parametrize("weights", [{"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 0.9, "b": 0.099, "c": 0.001}, {f"s{i}": 1 + i % 7 for i in range(90)}])
def test_mixture_follows_the_given_weights(spark, weights):
    per = 4200 // len(weights)
    docs = spark.createDataFrame([(i, s) for i, s in enumerate(s for s in weights for _ in range(per))], "doc_id long, source string")
    rows = mixing.interleave(docs, weights, block_rows=2).collect()
    by_slot = check_mixture(rows, 2)
    target, real = {s: Fraction(str(w)) for s, w in weights.items()}, Counter()
    total = sum(target.values())
    for slot in range(len(by_slot)):
        if max(real.values(), default=0) >= per // 2:  # then the others share the part of a source
            break
        real[by_slot[slot]] += 1
        assert all(abs(real[s] - (slot + 1) * w / total) < 1 for s, w in target.items())
    assert slot > 500


def test_mixing_query(spark, sf_dir, corpus):
    rows = QUERIES["op9_pfair_mixing"](spark, sf_dir).collect()
    assert {r.doc_id for r in rows} == set(corpus) and len(rows) == len(corpus)
    check_mixture(rows, 32)


def test_mixing_of_odd_rows(odd, none):
    rows = mixing.interleave(odd, block_rows=2).collect()
    check_mixture(rows, 2)
    assert mixing.interleave(none).count() == 0
    out = mixing.mixed(odd, block_rows=2)
    assert out.columns == odd.columns
    key = lambda df: sorted(map(str, df.collect()))
    assert key(out) == key(odd) and mixing.mixed(none).count() == 0


def test_mixed_rows_stand_in_the_order_of_the_mixture(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    places = {r.doc_id: r.position for r in mixing.interleave(docs).collect()}
    parts = mixing.mixed(docs, rows_per_file=50).withColumn("part", F.spark_partition_id()).select("doc_id", "part").collect()
    runs = defaultdict(list)
    for r in parts:
        runs[r.part].append(places[r.doc_id])
    assert all(v == sorted(v) for v in runs.values()) and sum(map(len, runs.values())) == len(places)


def test_mixed_rows_with_equal_keys_keep_the_places_of_their_sources(spark):
    weights = {"a": 3, "b": 2, "c": 1}
    rows = [(None if i % 2 else 7, s, i) for i, s in enumerate(s for s, n in (("a", 300), ("b", 200), ("c", 100)) for _ in range(n))]
    docs = spark.createDataFrame(rows, "doc_id long, source string, n long")
    out = mixing.mixed(docs, weights=weights, block_rows=1).collect()  # one run, so in order
    assert sorted(map(tuple, out), key=lambda r: r[2]) == rows
    real = Counter()
    for slot, r in enumerate(out):
        real[r.source] += 1
        assert all(abs(real[s] - Fraction((slot + 1) * w, 6)) < 1 for s, w in weights.items())
