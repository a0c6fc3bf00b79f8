"""Operators that look at one text at a time."""

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docloom.llm import bpe, hilbert, order_minhash, pii, repetition, words
from docloom.llm.queries import QUERIES
from tests.llm import brute
from tests.llm.conftest import ODD, prose

P = pytest.importorskip("public_tokenizers")


def by_key(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


# words -----------------------------------------------------------------------


@given(st.lists(st.text(alphabet="ab é\n\t 🙂"), max_size=6))
@settings(max_examples=80, deadline=None)
def test_words_and_lines(texts):
    t = words.Texts(pa.array(texts, pa.large_string()))
    raw = "".join(texts).encode()
    got = [raw[a:b].decode() for a, b in zip(t.starts, t.ends)]
    assert got == [w for x in texts for w in brute.words(x)]
    assert t.counts.tolist() == [len(brute.words(x)) for x in texts]
    starts, ends, owner = t.lines()
    assert [(o, raw[a:b].decode()) for a, b, o in zip(starts, ends, owner)] == [(i, x) for i, s in enumerate(texts) for x in s.split("\n")]
    hashes = t.word_hashes()
    assert len(set(zip(hashes.tolist(), got))) == len(set(got)) == len(set(hashes.tolist()))


def test_hashes_do_not_depend_on_the_slice():
    text = prose(1, 3000)
    alone = words.Texts(pa.array([text], pa.large_string())).word_hashes()
    after = words.Texts(pa.array(["q " * 70_000, text], pa.large_string())).word_hashes()[-3000:]
    assert (alone == after).all()


# 1: personal data --------------------------------------------------------------


def test_pii_against_plain_patterns(spark, odd):
    cases = [
        "mail a.b+c@d-e.co.uk, x@y z@w.q", "a@b.cd@e.fg a@b.c%x@e.fg", "1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.0004", "@@ a@.b a@b.",
        "4111 1111 1111 1111 and 4111-1111-1111-1112", "12345678901234567890 4111111111111111 1", "+1 (269) 555-3296. +12 +1234567890123456",
        "é🙂 +44 20 7946 0958 a@b.cc", "5500 0000 0000 0004 4111 1111 1111 1111", "+1 2+3 4567 8901", "1" * 5000, "a" * 5000 + "@b.cc",
        "4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1",
    ]
    rows = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    got = by_key(pii.find(rows))
    for i, text in enumerate(cases):
        assert got[i].base_spans == brute.pii(text), text
    assert pii.find(odd).count() == odd.count()


@given(st.text(alphabet="a.@-+1 4%(", max_size=60))
@settings(max_examples=30, deadline=None)
def test_pii_patterns_find_what_the_plain_ones_find(text):
    import re

    # The linear forms, in the syntax that both engines share.
    for plain, fast in ((brute.IP, pii._IP), (brute.CARD, pii._CARD)):
        want = [m.span() for m in plain.finditer(text) if plain is not brute.CARD or len(re.sub("[^0-9]", "", m.group())) >= 12]
        assert [m.span() for m in re.finditer(fast, text)] == want


def test_pii_query(spark, sf_dir, corpus):
    got = by_key(QUERIES["op1_bootstrapped_pii"](spark, sf_dir))
    assert set(got) == set(corpus)
    for d, text in corpus.items():
        spans = brute.pii(text)
        assert got[d].base_sha256 == hashlib.sha256(spans.encode()).hexdigest()
        assert set(filter(None, spans.split(","))) <= set(got[d].spans.split(","))


def test_contexts_find_unseen_identifiers(spark):
    ids = [f"AB-{i:04d}-{i * 7 % 1000:03d}" for i in range(5)]
    texts = [f"{prose(i, 20)} reach her under user{i}@mail.example.com tomorrow {prose(i + 50, 10)}" for i in range(30)]
    texts += [f"{prose(i + 100, 15)} reach her under {x} tomorrow" for i, x in enumerate(ids)]
    texts += [f"{prose(i + 200, 15)} the Apache License, Version 2.0 of build 77{i:04d} of it" for i in range(10)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = by_key(pii.find(rows))
    for i, x in enumerate(ids):
        at = texts[30 + i].index(x)
        assert got[30 + i].spans == f"email_like:{at}:{at + len(x)}" and got[30 + i].base_spans == ""
    assert all(got[i].spans == "" for i in range(35, 45))


# 2: sharding --------------------------------------------------------------------


@pytest.mark.parametrize("dims, bits", [(2, 4), (3, 3), (4, 2)])
def test_hilbert_curve_visits_neighbours(dims, bits):
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
    index = hilbert.hilbert_index(cells, bits)
    assert sorted(index.tolist()) == list(range(len(cells)))
    path = cells[np.argsort(index)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_shards_query(spark, sf_dir, corpus):
    rows = QUERIES["op2_hilbert_shards"](spark, sf_dir).collect()
    assert {r.doc_id: (r.size, r.text_crc32) for r in rows} == {
        d: (len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in corpus.items()
    }
    slots = {s: sorted(r.slot for r in rows if r.shard == s) for s in range(16)}
    assert all(v == list(range(len(v))) for v in slots.values())
    sizes = [len(v) for v in slots.values()]
    assert max(sizes) - min(sizes) <= 1 and sum(sizes) == len(corpus)
    ordered = sorted(rows, key=lambda r: (r.shard, r.slot))
    assert [r.curve for r in ordered] == sorted(r.curve for r in rows)


@pytest.mark.parametrize("law", ["rows", "bytes"])
def test_shards_of_odd_rows(odd, none, law):
    dims = {"source": odd["source"], "lang": odd["lang"], "n_chars": odd["n_chars"]}
    rows = hilbert.shard(odd, dims, shards=4, law=law).collect()
    assert sorted(r.position for r in rows) == list(range(odd.count()))
    for s in range(4):
        slots = sorted(r.slot for r in rows if r.shard == s)
        assert slots == list(range(len(slots)))
    assert hilbert.shard(none, {"source": none["source"]}, law=law).count() == 0


# 3: byte-level BPE ---------------------------------------------------------------


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")), P.PATTERN)


@pytest.fixture(scope="module")
def reference(codec):
    import tiktoken

    return tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks={t: i for i, t in enumerate(codec.tokens)}, special_tokens={})


@given(st.text(max_size=80))
@settings(max_examples=300, deadline=None)
def test_bpe_of_any_text(codec, reference, text):
    ids = codec.encode(text)
    assert np.frombuffer(ids, "<u4").tolist() == reference.encode_ordinary(text)
    assert codec.decode(ids) == text.encode()


def test_bpe_of_long_tokens_and_small_cache(codec, reference, monkeypatch):
    monkeypatch.setattr(bpe, "CACHED_TOKENS", 64)
    small = bpe.Codec(codec.tokens, P.PATTERN)
    for text in [*filter(None, ODD), prose(3, 2000), "ab" * 4000, "<|endoftext|>", "  " * 90]:
        assert np.frombuffer(small.encode(text), "<u4").tolist() == reference.encode_ordinary(text)


def test_every_token_of_the_vocabulary(codec):
    letters = [bpe.mapped(t) for t in codec.tokens]
    assert [x[0] if len(x) == 1 else None for x in codec.pieces.encode(letters[:3000])] == list(range(3000))


def test_bpe_query(spark, sf_dir, corpus, reference):
    got = by_key(QUERIES["op3_byte_bpe"](spark, sf_dir))
    assert set(got) == set(corpus)
    for d, text in corpus.items():
        ids = np.asarray(reference.encode_ordinary(text or ""), "<u4")
        want = len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()
        assert (got[d].n_tokens, got[d].ids_sha256, got[d].decoded_sha256) == want


def test_bpe_of_odd_rows(odd, none):
    path = P.path("byte_bpe_50k.tiktoken")
    rows = bpe.encode(odd, path, P.PATTERN).collect()
    assert len(rows) == odd.count() and all(r.n_tokens == len(r.ids) for r in rows)
    assert bpe.encode(none, path, P.PATTERN).count() == 0


# 6: repetition -------------------------------------------------------------------


def test_repetition_query(spark, sf_dir, corpus):
    got = by_key(QUERIES["op6_repetition_rules"](spark, sf_dir))
    assert set(got) == set(corpus)
    for d, text in corpus.items():
        want = brute.rules(text)
        assert {k: got[d][k] for k in want} == want
        for n, limit in repetition.DUPLICATE_NGRAMS.items():
            share = brute.duplicate_share(text, n)
            assert abs(got[d][f"dup_share_{n}"] - share) < 1e-9
            assert not (got[d].kept and share > limit)
        assert not (got[d].kept and want["base_failed"])


def test_repetition_of_odd_rows(odd, none):
    rows = repetition.quality(odd, carry=tuple(odd.columns)).collect()
    assert len(rows) == odd.count()
    assert all(r.base_failed and not r.kept for r in rows if not brute.words(r.text))
    assert repetition.quality(none).count() == 0


def test_repetitive_texts_go(spark):
    half = prose(1, 200)
    texts = [prose(2, 300), half + " " + half, "\n".join([prose(3, 12)] * 9), prose(4, 60) + "\n" + prose(4, 12)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [by_key(repetition.quality(rows))[i].kept for i in range(4)] == [True, False, False, False]


# 10: fingerprints -----------------------------------------------------------------


def brute_signature(text):
    return order_minhash.fingerprints([text])[0]


def test_fingerprint_query(spark, sf_dir, corpus):
    got = by_key(QUERIES["op10_order_minhash"](spark, sf_dir))
    assert set(got) == set(corpus)
    keys = sorted(corpus, reverse=True)
    for d, following in zip(keys, [*keys[1:], keys[0]]):
        text, nxt = corpus[d] or "", corpus[following] or ""
        half = len(text) // 2
        changed = text[: len(text) - half] + nxt[:half]
        assert got[d].n_chars == len(text) and got[d].edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        own, edit, other = map(brute_signature, (text, changed, nxt))
        assert got[d].fingerprint == own.tobytes().hex() and got[d].edited_fingerprint == edit.tobytes().hex()
        assert got[d].near_edited == (own == edit).mean() and got[d].near_next == (own == other).mean()
    mean = lambda c: sum(r[c] for r in got.values()) / len(got)
    assert mean("near_edited") > mean("near_next") + 0.05


def test_fingerprints_see_order():
    a, b = prose(5, 120), prose(6, 120)
    one, swapped, other = order_minhash.fingerprints([a + " " + b, b + " " + a, prose(7, 240)])
    assert 0.2 < (one == swapped).mean() < 0.9  # the same k-mers in another order
    assert (one == other).mean() < 0.05
    words_ = (a + " " + b).split()
    words_[100] = "changed"
    assert (one == order_minhash.fingerprints([" ".join(words_)])[0]).mean() > 0.9


def test_fingerprints_over_chunk_borders(spark):
    texts = {k * k - 50: prose(k, 30) for k in range(60)}
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(7)
    for size in (1, 4, 1000):
        got = by_key(order_minhash.fingerprint_pairs(rows, rows_per_chunk=size))
        keys = sorted(texts, reverse=True)
        for d, following in zip(keys, [*keys[1:], keys[0]]):
            half = len(texts[d]) // 2
            want = texts[d][: len(texts[d]) - half] + texts[following][:half]
            assert got[d].edited_sha256 == hashlib.sha256(want.encode()).hexdigest()


def test_fingerprints_of_odd_rows(odd, none):
    rows = order_minhash.fingerprint_pairs(odd).collect()
    assert len(rows) == odd.count()
    same = {r.doc_id: r.fingerprint for r in rows}
    assert same[9] == same[10] and same[0] == same[1] == same[2]
    assert order_minhash.fingerprint_pairs(none).count() == 0
    one = order_minhash.fingerprint_pairs(odd.filter(F.col("doc_id") == 7)).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
