"""The stages of the corpus pipeline, one after the other, against plain versions."""

import hashlib

import pytest

import corpus_pipeline
from docloom.llm import mixing, repetition
from docloom.llm.queries import QUERIES
from docloom.llm.tables import read
from docloom.session import materialize
from tests.llm import brute
from tests.llm.test_corpus_operators import brute_classes


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    """Each stage's input and output."""
    out, docs = {}, read(spark, sf_dir, "documents")
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), name)
        out[name] = before, docs
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_rules_stage(stages):
    before, after = stages["quality_rules"]
    assert after.columns == before.columns
    old, new = texts(before), texts(after)
    assert new == {d: old[d] for d in new}
    for d, text in old.items():
        repetitive = any(brute.duplicate_share(text, n) > most for n, most in repetition.DUPLICATE_NGRAMS.items())
        if brute.rules(text)["base_failed"] or repetitive:
            assert d not in new
        elif not brute.rules(text)["n_dup_lines"]:
            assert d in new


def test_line_stage(stages):
    before, after = stages["line_dedup"]
    old, gone = texts(before), brute.similar_lines(texts(before))
    want = {d: "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone.get(d, [])) for d, t in old.items()}
    assert texts(after) == {d: t for d, t in want.items() if brute.words(t)}
    assert after.columns == before.columns and all(r.n_chars == len(r.text) for r in after.collect())


def test_near_stage(spark, stages):
    before, after = stages["near_dedup"]
    old = texts(before)
    assert set(texts(after)) == set(brute_classes(spark, old).values()) and after.columns == before.columns


def test_mixing_stage(stages):
    before, after = stages["mix_sources"]
    assert sorted(map(str, before.collect())) == sorted(map(str, after.collect()))
    places = {r.doc_id: r.position for r in mixing.interleave(before).collect()}
    assert len(places) == after.count()


def test_encoding_stage(stages):
    before, after = stages["encode"]
    old = texts(before)
    got = after.collect()
    assert {r.doc_id: r.decoded_sha256 for r in got} == {d: hashlib.sha256(t.encode()).hexdigest() for d, t in old.items()}


def test_stages_of_odd_rows(spark, odd, none, sf_dir):
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd, sf_dir)
        if name != "encode":
            assert out.columns == odd.columns
        assert out.count() <= odd.count() and stage(spark, none, sf_dir).count() == 0


def test_run_is_registered(spark, sf_dir, stages):
    import __spark_entry__ as entry

    assert entry.queries()["pipeline"] is corpus_pipeline.run and set(QUERIES) < set(entry.queries())
    assert corpus_pipeline.run(spark, sf_dir).count() == stages["encode"][1].count()
