"""A part of the registered queries against their SQL; tools/compare.py runs all of them."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from gleanery import queries as core

SF = "/root/testdata/sf0.001"
NAMES = ["index_postings", "bool_nested", "near_tf", "window_tf", "bm25_batch", "prf_rm3_terms", "ltr_features", "ltr_rerank", "ltr_feature_lines", "rerank_merge", "rag_prompt", "run_file", "trec_run_lines", "passage_windows", "rerank_maxp", "dense_topk", "trec_run"]
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def plain(v):
    return round(v, 5) + 0.0 if isinstance(v, float) else v


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    res = con.execute(core.oracle_sql()[name])
    cols = [d[0] for d in res.description]
    want = sorted((tuple(plain(v) for v in r) for r in res.fetchall()), key=repr)
    df = core.queries()[name](spark, SF)
    assert sorted(df.columns) == sorted(cols)
    assert sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr) == want


def test_entry(spark):
    assert entry.entry(spark).columns == ["qid", "rank", "eid", "score"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
