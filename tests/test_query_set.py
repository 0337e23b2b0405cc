"""Queries that run over the whole query set, structured queries too."""

import os

import duckdb
import pytest

from gleanery import queries as core
from gleanery.plans.compile import rank_query, rank_set
from gleanery.plans.models import BM25, RankedBoolean, UnrankedBoolean
from gleanery.sources.index import build_index

SF = "/root/testdata/sf0.001"


def test_every_structure_is_ranked_like_its_single_query(spark):
    words = "sun moon star sun rain moon star cloud".split()
    rows = [(f"d{i}", " ".join(words[i % 5 :] + words[: i % 3]), " ".join(words[i % 4 : i % 4 + 2])) for i in range(12)]
    ix = build_index(spark.createDataFrame(rows, "eid string, body_string string, title_string string"), {"body": "body_string", "title": "title_string"}).stored()
    texts = {"p": "sun moon", "t": "#SUM(sun.title moon)", "w": "#WSUM(0.3 sun 0.7 rain)", "n": "#NEAR/2(sun star)", "3": "#NEAR/3(sun moon star)", "u": "#WINDOW/4(rain moon)", "a": "#AND(sun.title moon star)", "o": "#OR(sun cloud)", "x": "#SUM(#NEAR/2(sun moon) rain)", "s": "the of"}
    got = rank_set(spark.createDataFrame([*texts.items(), ("z", None)], "qid string, qstring string"), ix, BM25(), 5, boolean=True).collect()
    want = [r for q, t in texts.items() for r in rank_query(t, ix, RankedBoolean() if q in "ao" else BM25(), 5, q).collect()]
    key = lambda rows: sorted((r.qid, r.rank, r.eid, round(r.score, 8)) for r in rows)
    assert key(got) == key(want) and {r.qid for r in got} == set("ptwn3uaox")


NESTED = {
    "BM25": {
        "1": "#SUM(#NEAR/2(#SYN(sun rain) star) #WSUM(0.2 moon 0.8 #SUM(cloud cloud sun)))", "2": "#WSUM(0 sun 0 moon)", "3": "#WINDOW/5(#NEAR/2(sun moon) star)", "4": "#SUM(#SYN(sun #NEAR/2(moon star)) #WINDOW/3(star sun rain) none)",
        "5": "#WSUM(0.5 #WSUM(2 sun 1 moon) 1.5 #SUM(star #SYN(cloud rain)))", "6": "none", "7": "#NEAR/1(sun none)",
    },
    "RankedBoolean": {"1": "#AND(#OR(sun cloud) #NEAR/3(moon star))", "2": "sun moon", "3": "#OR(#AND(sun rain) #AND(cloud #OR(star moon)))", "4": "#AND(sun.title #SYN(moon rain))", "5": "#OR(none sun)"},
    "UnrankedBoolean": {"1": "#AND(#OR(sun cloud) moon)", "2": "#OR(#NEAR/2(sun moon) rain)", "3": "#AND(#SUM(sun cloud) moon)", "4": "#AND(none sun)"},
}


@pytest.mark.parametrize("model", [BM25(), RankedBoolean(), UnrankedBoolean()])
def test_nested_queries_together_equal_each_alone(spark, model):
    words = "sun moon star sun rain moon star cloud".split()
    rows = [(f"d{i}", " ".join(words[i % 5 :] + words[: i % 3]), " ".join(words[i % 4 : i % 4 + 2])) for i in range(12)]
    ix = build_index(spark.createDataFrame(rows, "eid string, body_string string, title_string string"), {"body": "body_string", "title": "title_string"}).stored()
    texts = NESTED[type(model).__name__]
    key = lambda rows: sorted((r.qid, r.rank, r.eid, round(r.score, 8)) for r in rows)
    want = [r for q, t in texts.items() for r in rank_query(t, ix, model, 6, q).collect()]
    assert want and key(rank_set(spark.createDataFrame([*texts.items()], "qid string, qstring string"), ix, model, 6).collect()) == key(want)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_prompts_and_rankings_for_structured_queries(spark):
    texts = {r.qid for r in core.query_set(spark, SF).filter("qstring IS NOT NULL").collect()}
    prompts = {r.qid: r.prompt for r in core.rag_prompt(spark, SF).collect()}
    assert set(prompts) == texts and not any("#" in p.split("Context")[0] for p in prompts.values())
    ranked = {r.qid for r in core.bm25_batch(spark, SF).select("qid").distinct().collect()}
    plain = {r.qid for r in core.query_set(spark, SF).filter("qstring NOT LIKE '%#%'").collect()}
    assert ranked <= texts and ranked - plain


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_passages_reach_the_end_of_each_body(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW docs AS SELECT * FROM '{SF}/docs.parquet'")
    want = con.execute(core.oracle_sql()["passage_windows"]).fetchall()
    got = [tuple(r) for r in core.queries()["passage_windows"](spark, SF).select("eid", "psg_no", "text").collect()]
    assert sorted(got) == sorted(want) and max(r[1] for r in got) > 4


def test_the_head_is_scored_by_words_beyond_the_fifth_window(spark, tmp_path):
    body = " ".join(["filler"] * 400 + ["compass", "meadow"])
    tables = {
        "docs": spark.createDataFrame([("e1", 1, body, "t", "u", "", "", 1.0, 1.0)], "eid string, crawled_at long, body_string string, title_string string, raw_url string, keywords string, inlink string, spam_score double, page_rank double"),
        "queries": spark.createDataFrame([("q1", "#SUM(compass meadow)")], "qid string, qstring string"),
        "rankings": spark.createDataFrame([("bm25", "q1", "e1", 1, 2.0)], "runid string, qid string, eid string, rank int, score double"),
    }
    for name, df in tables.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    assert [r.score for r in core.rerank_maxp(spark, str(tmp_path)).collect()] == [1.0]
    assert "compass meadow" in core.rag_context(spark, str(tmp_path)).first().context


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_the_pivot_has_every_run(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW rankings AS SELECT * FROM '{SF}/rankings.parquet'")
    res = con.execute(core.oracle_sql()["te2csv_pivot"])
    cols = [d[0] for d in res.description]
    got = core.queries()["te2csv_pivot"](spark, SF).select(*cols).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(res.fetchall(), key=repr)
    runs = {r for (r,) in con.execute("SELECT DISTINCT runid FROM rankings WHERE qid IS NOT NULL AND runid IS NOT NULL").fetchall()}
    assert runs <= set(cols)
