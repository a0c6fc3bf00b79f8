"""Scores by context mixing, periodic runs and phrase collocations."""

import hashlib
import math
import random
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docloom.llm import collocations, context_mixing, periodic_runs, word_bits
from docloom.llm.queries import QUERIES
from docloom.llm.words import mix
from tests.llm import brute
from tests.llm.conftest import prose

FOLD = {i: i + 32 for i in range(65, 91)}


def rows(df):
    return [r.asDict() for r in df.collect()]


# 11: scores ---------------------------------------------------------------------


def tokens(text):
    return [*brute.words((text or "").translate(FOLD)), None]


def base(docs):
    """(key, text) -> held out, tokens, known, N, base score of each row."""
    held = [k is not None and zlib.crc32(str(k).encode()) % 7 == 2 for k, _ in docs]
    c = Counter(t for (_, text), h in zip(docs, held) if not h for t in tokens(text))
    n, v = sum(c.values()), len(c)
    for (k, text), h in zip(docs, held):
        ts = tokens(text)
        yield k, h, len(ts), sum(c[t] > 0 for t in ts), n, sum(math.log10((c[t] + 1) / (n + v + 1)) for t in ts)


def same_base(got, docs):
    order = lambda r: tuple((x is None, x or 0) for x in r)
    got = sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in got), key=order)
    want = sorted(base(docs), key=order)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert [r[5] for r in got] == pytest.approx([r[5] for r in want])


def test_scores_of_the_table(spark, sf_dir, corpus):
    got = rows(QUERIES["op11_context_mixing"](spark, sf_dir))
    same_base(got, list(corpus.items()))
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)
    by_text = {}
    for r in got:
        by_text.setdefault(corpus[r["doc_id"]], set()).add(round(r["score"], 6))
    assert all(len(scores) == 1 for scores in by_text.values())


def test_scores_of_odd_rows(spark, odd, none):
    got = rows(context_mixing.score_texts(odd))
    same_base(got, [(r["doc_id"], r["text"]) for r in odd.collect()])
    assert all(math.isfinite(r["score"]) for r in got)
    assert context_mixing.score_texts(none).count() == 0


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    from pyspark.sql import functions as F

    for r in rows(context_mixing.score_texts(docs, held_out=F.lit(True))):
        assert (r["n_known"], r["train_tokens"], r["base_score"]) == (0, 0, 0.0) and math.isfinite(r["score"])


def test_held_out_texts_score_above_the_base(spark):
    """Two languages with words of their own: the text shows which one it is in."""
    rnd = random.Random(3)
    docs = []
    for i in range(700):
        own = "ab"[i % 2]
        words = [f"{own}{rnd.choice('lmnr')}{rnd.choice('aeiou')}{int(rnd.paretovariate(0.7)) % 150}" for _ in range(120)]
        docs.append((i, " ".join(words), own))
    got = rows(context_mixing.score_texts(spark.createDataFrame(docs, "doc_id long, text string, lang string")))
    held = [r for r in got if r["held_out"]]
    assert len(held) > 60
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    assert np.mean([r["bits_per_byte"] for r in held]) < 2.5


M = (1 << 64) - 1


def plain_mix(x):
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & M
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & M
    return x ^ (x >> 31)


def plain_cost(mixer, word):
    """Natural logarithm of a word's probability, bit by bit."""
    total, done = 0.0, b""
    for byte in word.encode() + b" ":
        for bit in range(8):
            node = 1 << bit | byte >> (8 - bit)
            one = byte >> (7 - bit) & 1
            inputs, gate = [], 0
            for k, order in enumerate(context_mixing.ORDERS):
                context = min(len(done), 15)
                if order:
                    context = 0
                    for back in range(1, order + 1):
                        context = context << 8 | (done[-back] if back <= len(done) else 0)
                h = plain_mix(context ^ plain_mix(order + 1))
                slot = ((h ^ (node * 0x9E3779B97F4A7C15 & M)) * 0xD6E8FEB86659FD93 & M) >> (64 - context_mixing.TABLE_BITS)
                state = int(mixer.tables[k][slot])
                inputs.append(math.log(((state & 255) + 0.3) / ((state >> 8) + 0.3)))
                gate = k + 1 if state else gate
            logit = max(-13, min(13, sum(w * x for w, x in zip(mixer.weights[bit][gate], inputs))))
            p = 1 / (1 + math.exp(-logit))
            cell = max(0, min(context_mixing.CELLS - 1, int((logit + 8) * (context_mixing.CELLS / 16))))
            n, hits = mixer.cells[0, bit, gate, cell], mixer.cells[1, bit, gate, cell]
            p = max(context_mixing.LIMIT, min(1 - context_mixing.LIMIT, (p + (hits + 4 * p) / (n + 4)) / 2))
            total += math.log(p if one else 1 - p)
        done += bytes([byte])
    return total


def test_spelling_against_single_bits(spark):
    words = sorted({*prose(5, 400, 300).split(), "é", "naïve", "日本語"})
    mixer = context_mixing.fit_spelling(spark.createDataFrame([(w,) for w in words], "word string"))
    asked = [*words[::40], "unseen", "", "zzzzzzzzzzzz", "é日"]
    assert mixer.cost(pa.array(asked)).tolist() == pytest.approx([plain_cost(mixer, w) for w in asked], rel=1e-3)
    assert mixer.cost(pa.array(words)).mean() > mixer.cost(pa.array([w[::-1] for w in words])).mean()


def test_experts_against_single_tokens():
    rnd = random.Random(8)
    totals = context_mixing.Totals(50, 9, 3)
    c, spelling = np.array([0, 5, 1, 20, 3, 7]), np.log([0.01, 0.002, 0.1, 0.2, 0.05, 0.3])
    lifts, share = np.log(np.array([[rnd.uniform(0.5, 2) for _ in range(context_mixing.GROUPS)] for _ in c])), np.full(context_mixing.GROUPS, 1 / 8)
    texts = [[rnd.randrange(5) for _ in range(n)] + [5] for n in (0, 3, 40, 100)]
    counts = np.array([len(t) for t in texts])
    got = context_mixing.text_scores(np.array(sum(texts, [])), counts, c, spelling, lifts, share, totals)
    for text, score in zip(texts, got):
        new = 4 / 52
        old = (1 - context_mixing.RECENT) * (1 - new) / 2
        logits = [math.log(x) for x in [(1 - context_mixing.RECENT) * new, context_mixing.RECENT, old, *(old * share)]]
        total, seen = 0.0, Counter()
        for lo in range(0, len(text), context_mixing.BLOCK):
            z = sum(math.exp(x) for x in logits)
            trust, worth, block = [math.exp(x) / z for x in logits], [0.0] * len(logits), text[lo : lo + context_mixing.BLOCK]
            for i, w in enumerate(block, lo):
                word = c[w] / 50
                p = [math.exp(spelling[w]), seen[w] / (i + 1), word, *[word * math.exp(x) for x in lifts[w]]]
                seen[w] += 1
                both = [a * b for a, b in zip(trust, p)]
                total += math.log(sum(both))
                worth = [a + b / sum(both) for a, b in zip(worth, both)]
            logits = [x + context_mixing.RATE * (a / len(block) - b) for x, a, b in zip(logits, worth, trust)]
        assert score == pytest.approx(total)


def test_chances_of_words_by_group_add_up(spark):
    docs = spark.createDataFrame([(i, prose(i, 60, 20), "abc"[i % 3]) for i in range(40)], "doc_id long, text string, lang string")
    from pyspark.sql import functions as F

    named = docs.select(F.col("doc_id").alias("__id"), F.lit(False).alias("__held"), F.pmod(F.xxhash64("lang"), F.lit(8)).cast("int").alias("__group"), F.col("text").alias("__text"))
    lifts, share = context_mixing.group_table(context_mixing._sliced(named))
    assert share.sum() == pytest.approx(1)
    assert (np.exp(lifts.astype(float)) * share).sum(axis=1) == pytest.approx(np.ones(len(lifts)), abs=2e-3)


def test_words_cost_less_where_they_are_expected(spark):
    """Every word has two that may follow: in another order the same words are told badly."""
    rnd = random.Random(4)
    follow = {i: rnd.sample(range(60), 2) for i in range(60)}
    docs = []
    for i in range(600):
        at, words = rnd.randrange(60), []
        for _ in range(80):
            words.append(f"w{at}")
            at = rnd.choice(follow[at])
        docs.append((i, " ".join(words)))
    held = [(k, t) for k, t in docs if zlib.crc32(str(k).encode()) % 7 == 2]
    other = [k for k in range(600, 2000) if zlib.crc32(str(k).encode()) % 7 == 2]
    docs += [(k, " ".join(rnd.sample(t.split(), 80))) for k, (_, t) in zip(other, held)]
    got = {r["doc_id"]: r["score"] for r in rows(context_mixing.score_texts(spark.createDataFrame(docs, "doc_id long, text string")))}
    assert sum(got[k] for k, _ in held) > 0.5 * sum(got[k] for k in other[: len(held)])


def a_word_mixer(n=12, texts=60):
    rnd = random.Random(5)
    names = [f"w{i}" for i in range(n)]
    code = word_bits.Code(pa.array([*names, ""]), np.array([2 * n - i for i in range(n)] + [texts]), 40)
    # Places 0 to n - 1 have paths, the next four have none, then the end.
    symbols, marks = np.array([*range(n), -1, -1, -1, -1, n]), np.arange(n + 5, dtype=np.uint64) * np.uint64(77)
    lifts = np.array([[rnd.uniform(-1, 1) for _ in range(3)] for _ in range(n + 5)], dtype=np.float32)
    tokens = lambda every: word_bits.Tokens(code, np.array(sum(every, [])), np.array([len(t) for t in every]), symbols, marks, lifts)
    learned = tokens([[rnd.choice([i % 4, rnd.randrange(n + 4)]) for i in range(rnd.randrange(90))] + [n + 4] for _ in range(texts)])
    counts = [np.zeros(2 << bits, dtype=np.int32) for bits in word_bits.TABLE_BITS]
    word_bits.count_bits(counts, learned)
    mixer = word_bits.WordMixer([(np.minimum(c[::2], 255) << 8 | np.minimum(c[1::2], 255)).astype(np.uint16) for c in counts])
    mixer.learn(learned)
    return mixer, code, tokens


def test_paths_of_a_text_against_single_bits():
    mixer, code, tokens = a_word_mixer()
    rnd = random.Random(6)
    every = [[rnd.randrange(16) for _ in range(n)] + [16] for n in (0, 3, 40, 200)]
    asked = tokens(every)
    at = 0
    for text, score in zip(every, mixer.cost(asked)):
        total, own = 0.0, [0.0] * word_bits.INPUTS
        for lo in range(0, len(text), word_bits.BLOCK):
            grad, n = [0.0] * word_bits.INPUTS, 0
            for i in range(at + lo, at + min(len(text), lo + word_bits.BLOCK)):
                _, ones, x, gate = mixer.inputs(asked, np.array([i]), without=False)
                for bit in range(len(ones)):
                    logit = max(-13, min(13, sum((w + d) * v for w, d, v in zip(mixer.weights[gate[bit]], own, x[:, bit].tolist()))))
                    p = 1 / (1 + math.exp(-logit))
                    grad, n = [g + (ones[bit] - p) * v for g, v in zip(grad, x[:, bit].tolist())], n + 1
                    cell = gate[bit] * word_bits.CELLS + max(0, min(word_bits.CELLS - 1, int((logit + 8) * word_bits.CELLS / 16)))
                    seen, hits = mixer.cells[:, cell]
                    p = max(word_bits.LIMIT, min(1 - word_bits.LIMIT, (p + (hits + 4 * p) / (seen + 4)) / 2))
                    total += math.log(p if ones[bit] else 1 - p)
            own = [d + word_bits.RATE * g / n for d, g in zip(own, grad)]
        assert score == pytest.approx(total, rel=1e-3)
        at += len(text)


def test_chances_of_the_next_path_add_up():
    mixer, code, tokens = a_word_mixer()
    start = [0, 1, 2, 3, 0, 1, 12, 2]
    # All words with a path and the end, one that came before and one that did not.
    every = tokens([[*start, w] for w in (*range(12), 16, 12, 13)])
    costs = mixer.cost(every) - mixer.cost(tokens([start]))[0]
    assert np.exp(costs).sum() == pytest.approx(1, abs=1e-3)


# 12: runs -----------------------------------------------------------------------


def plain_runs(words, least=12):
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            if j > i and length >= max(least, 2 * q):
                found.setdefault((i, length), q)
            i = j + 1
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def plain_row(key, text, repeats):
    words = brute.words(text)
    n = len(words)
    h = zlib.crc32(str(key).encode()) if key is not None else 1
    if repeats and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain_runs(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2])) if runs else (None, None, None)
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (
        key, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
        digest("".join(f"{s},{length},{q}\n" for s, length, q in runs)), digest(" ".join(w for i, w in enumerate(words) if i not in gone)),
    )


def test_runs_of_the_table(spark, sf_dir, corpus):
    got = {tuple(r) for r in QUERIES["op12_maximal_pair_runs"](spark, sf_dir).collect()}
    short = {k: t for k, t in corpus.items() if len(t or "") < 20_000}
    assert len(short) > 150
    assert {r for r in got if r[0] in short} == {plain_row(k, t, True) for k, t in short.items()}


def test_runs_of_odd_rows(spark, odd, none):
    for repeats in (False, True):
        got = sorted((tuple(r) for r in periodic_runs.periodic_runs(odd, repeats).collect()), key=str)
        want = [plain_row(r["doc_id"], r["text"], repeats) for r in odd.collect()]
        assert got == sorted(want, key=str)
    assert periodic_runs.periodic_runs(none).count() == 0


@given(st.lists(st.tuples(st.integers(1, 4), st.integers(0, 70), st.integers(1, 14), st.integers(0, 10**6)), max_size=5), st.sampled_from([4, 7, 12]))
@settings(max_examples=150, deadline=None)
def test_runs_of_random_words(shapes, least):
    texts = []
    for letters, n, p, seed in shapes:
        rnd = random.Random(seed)
        w = [rnd.randrange(letters) for _ in range(n)]
        a = rnd.randrange(n + 1)
        texts.append([x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)])
    flat = mix(np.array(sum(texts, []), dtype=np.uint64) + np.uint64(5))
    got = periodic_runs.find_runs(flat, np.array([len(t) for t in texts], dtype=np.int64), least)
    assert [tuple(r) for r in got.tolist()] == [(i, *r) for i, t in enumerate(texts) for r in plain_runs(t, least)]


# 13: phrases --------------------------------------------------------------------


def plain_phrases(docs, least, top=2000):
    f, n = Counter(), Counter()
    for text, lang in docs:
        lang, piece = lang or "und", []
        for c in (text or "").translate(FOLD) + "\n":
            if c not in ".,;:!?\n\v\f\r":
                piece.append(c)
                continue
            words = [w for w in "".join(piece).replace("\t", " ").split(" ") if w]
            n[lang] += len(words)
            f.update((lang, tuple(words[i : i + k])) for k in range(1, 6) for i in range(len(words) - k + 1))
            piece = []
    frequent = {key: a for key, a in f.items() if a >= least and len(key[1]) > 1}
    found = {}
    for (lang, p), a in frequent.items():
        inside = any(
            lg == lang and len(q) > len(p) and 100 * b >= 100 * a and any(q[i : i + len(p)] == p for i in range(len(q)))
            for (lg, q), b in frequent.items()
        )
        if not inside:
            cuts = [(math.floor(Fraction(1000 * a * n[lang], f[lang, p[:k]] * f[lang, p[k:]])), k) for k in range(1, len(p))]
            score, k = min(cuts)
            found.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return {
        (lang, i, p.decode(), -a, left, right, n[lang], -s)
        for lang, rs in found.items() for i, (s, a, p, left, right) in enumerate(sorted(rs)[:top], 1)
    }


def phrases(df, **kw):
    return {tuple(r) for r in collocations.collocations(df, **kw).collect()}


def test_phrases_of_small_texts(spark):
    rnd = random.Random(4)
    docs = []
    for i in range(120):
        w = [rnd.choice(["New", "york", "city", "of", "the", "é", "a", "B\tc", "end.", "x;y", "new york", "\v", "."]) for _ in range(rnd.randrange(40))]
        docs.append((" ".join(w), rnd.choice(["en", "fr", None, "und", ""])))
    df = spark.createDataFrame(docs, "text string, lang string")
    for least, top in ((3, 2000), (8, 5), (1, 40)):
        got = phrases(df, min_count=least, top=top)
        want = plain_phrases([(t, g if g != "" else "\0") for t, g in docs], least, top)
        assert got == {("" if r[0] == "\0" else r[0], *r[1:]) for r in want}


def test_phrases_of_odd_rows(spark, odd, none):
    got = phrases(odd, min_count=2)
    assert got == plain_phrases([(r["text"], r["lang"]) for r in odd.collect()], 2) and got
    assert phrases(none) == set()
    assert phrases(odd, min_count=10**6) == set()


def test_full_bit_table_leaves_nothing_out(spark):
    docs = [(prose(i, 80, 2), "en") for i in range(12)]
    df = spark.createDataFrame(docs, "text string, lang string")
    assert phrases(df, min_count=2, filter_bits=64) == plain_phrases(docs, 2)


def test_scores_beyond_64_bits(spark):
    """1000 * a * n over l * r where the products pass 64 bits."""
    from pyspark.sql import functions as F

    a, n, l, r = 3 * 10**9, 4 * 10**11, 5 * 10**9, 7 * 10**9  # noqa: E741
    df = spark.createDataFrame([(a, n, l, r)], "a long, n long, l long, r long")
    assert df.select(F.expr(collocations.SCORE)).first()[0] == 1000 * a * n // (l * r)


def test_windows_are_counted_in_little_memory():
    import tracemalloc

    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * 4000), pa.array(["some plain words of a text " * 75] * 4000)], names=["lang", "text"])
    tracemalloc.start()
    counted = sum(pa.compute.sum(b.column(2)).as_py() for b in collocations._counter(1, None)([batch]))
    used = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # The empty phrase counts all words once more.
    assert counted == 2 * 4000 * 75 * 6 and used < 150_000_000
