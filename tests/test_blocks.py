"""Flat queries scored in blocks of documents."""

import os
import random
import re

import pytest

from gleanery import queries as core
from gleanery.operators import blocks, feedback
from gleanery.plans.compile import query_terms, rank_batch, rank_query, rank_set
from gleanery.plans.models import BM25, RankedBoolean
from gleanery.sources.index import build_index

SF = "/root/testdata/sf0.001"
TEXTS = {
    "a": "#AND(sun.title moon)", "b": "sun moon star rain cloud", "c": "#WSUM(0.3 sun 0.7 rain)", "d": "#WSUM(0 sun 0 moon)", "e": "#NEAR/3(sun star)", "f": "#WINDOW/5(rain moon sun)", "g": "#OR(sun cloud.title)",
    "h": "rare", "i": "#SUM(sun sun moon)", "j": "#AND(sun none)", "k": "#NEAR/2(sun none)", "l": "none", "m": "#SUM(sun.title none)", "n": "#AND(sun moon star)", "o": "#NEAR/2(sun moon)",
}


@pytest.fixture(scope="module")
def ix(spark):
    rng, words = random.Random(8), "sun moon star rain cloud".split()
    rows = [(f"d{i:03}", " ".join(rng.choice(words) for _ in range(1 + i % 7)) + (" rare" if i == 9 else ""), rng.choice(words)) for i in range(160)]
    df = spark.createDataFrame(rows, "eid string, body string, title string").repartition(3)
    return build_index(df, {"body": "body", "title": "title"}).stored()


@pytest.mark.parametrize(("ask_rows", "at_once"), [(blocks.ASK_ROWS, blocks.MATCHED_AT_ONCE), (4, 1)])
def test_blocks_rank_like_each_query_alone(spark, ix, monkeypatch, ask_rows, at_once):
    monkeypatch.setattr(blocks, "ASK_ROWS", ask_rows)
    monkeypatch.setattr(blocks, "MATCHED_AT_ONCE", at_once)
    got = rank_set(spark.createDataFrame([*TEXTS.items()], "qid string, qstring string"), ix, BM25(), 12, boolean=True).collect()
    want = [r for q, t in TEXTS.items() for r in rank_query(t, ix, RankedBoolean() if t[:3] in ("#AN", "#OR") else BM25(), 12, q).collect()]
    key = lambda rows: sorted((r.qid, r.rank, r.eid, round(r.score, 8)) for r in rows)
    assert key(got) == key(want) and len({r.qid for r in got}) == 12  # many documents tie, in different blocks


def test_no_row_is_made_for_a_query_and_a_document_it_meets(spark, ix):
    asked = spark.createDataFrame([*TEXTS.items()], "qid string, qstring string")
    flat = query_terms(asked.filter("qid in ('b', 'c', 'i')"), ix)
    for plan in (rank_set(asked, ix, BM25(), 3, boolean=True), rank_batch(flat, ix, BM25(), 3)):
        text = plan._jdf.queryExecution().executedPlan().toString()
        assert not re.search(r"keys=\[qid#\d+, (node#\d+, )?eid#\d+", text) and "MapInArrow" in text


def test_feedback_shuffles_documents_and_not_their_terms(spark, ix):
    run = spark.createDataFrame([(f"q{i % 4}", f"d{i:03}", i // 4 + 1, 9.0 - i) for i in range(40)], "qid string, eid string, rank int, score double")
    for how in ("rm3", "okapi"):
        text = feedback.expansion_terms(run, ix, feedback.Feedback(how))._jdf.queryExecution().executedPlan().toString()
        assert not re.search(r"hashpartitioning\(qid#\d+, term#", text) and not re.search(r"hashpartitioning\(term#", text)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_the_trained_ranker_builds_one_index(spark, monkeypatch):
    built, stored = [], core.stored
    monkeypatch.setattr(core, "stored", lambda *a, **k: built.append(a) or stored(*a, **k))
    assert core.ltr_trained(spark, SF).count() and len(built) == 1


def test_a_stored_index_does_not_read_its_documents_again(spark, tmp_path):
    rows = [("a", "apple pie apple", None), ("b", "pie the tart", "x"), ("c", None, "y")]
    spark.createDataFrame(rows, "eid string, body string, page_rank string").write.parquet(str(tmp_path / "docs"))
    source = spark.read.parquet(str(tmp_path / "docs"))
    whole, slim = (build_index(source, {"body": "body"}, attributes=["page_rank"], positions=p).stored() for p in (True, False))
    for ix in (whole, slim):
        assert not any(str(tmp_path / "docs") in f for name in ("docs", "postings", "lengths", "field_stats") for f in getattr(ix, name).inputFiles())
    of = lambda ix: sorted(ix.postings.select("field", "term", "eid", "tf", "len").collect())
    assert of(whole) == of(slim) and sorted(slim.term_stats.collect()) == sorted(whole.term_stats.collect())
    assert slim.field_stats.collect() == whole.field_stats.collect() and slim.field_stats.first()["num_docs"] == 3
