import pytest

from gleanery.functions.text import Analyzer
from gleanery.operators import feedback, inspection
from gleanery.plans.compile import positions, query_leaves, query_terms, rank_batch, rank_query, rank_set
from gleanery.plans.models import BM25, RankedBoolean, UnrankedBoolean, model_of
from gleanery.plans.query import QuerySyntaxError, parse
from gleanery.sources.index import build_index, open_index

BODIES = {"1": "apple pie apple tart", "2": "pie apple crust", "3": "cherry pie recipe with apple", "10": "banana bread", "11": "apple", "12": "cherry tart pie"}


@pytest.fixture(scope="module")
def index(spark):
    return build_index(spark.createDataFrame(list(BODIES.items()), "eid string, body string"), {"body": "body"}, analyzer=Analyzer(("with",))).persist()


def ranked(index, q, model=BM25()):
    return {r.eid: round(r.score, 6) for r in rank_query(q, index, model).orderBy("rank").collect()}


def test_statistics(index):
    s = inspection.list_stats(index).first()
    assert (s.num_docs, s.doc_count, s.sum_len, round(s.avg_len, 4)) == (6, 6, 17, 2.8333)
    assert index.lengths.filter("eid = '3'").first().len == 5
    p = inspection.list_postings(index, "apple", "body").filter("eid = '1'").first()
    assert (p.tf, p.positions, p.df, p.ctf) == (2, [0, 2], 4, 5)
    assert [r.eid for r in inspection.list_docids(index).orderBy("iid").collect()] == ["1", "10", "11", "12", "2", "3"]
    assert inspection.list_termvector(index, "3").count() == 4


@pytest.mark.parametrize(
    ("q", "expected"),
    [
        ("#SUM(apple)", [("11", 0.273133), ("1", 0.247485), ("2", 0.196114), ("3", 0.152977)]),
        ("#SUM(apple pie)", [("1", 0.419365), ("2", 0.392228), ("3", 0.305953), ("11", 0.273133), ("12", 0.196114)]),
        ("#WSUM(0.7 apple 0.3 pie)", [("1", 0.224803), ("2", 0.196114), ("11", 0.191193), ("3", 0.152977), ("12", 0.058834)]),
        ("#SUM(apple apple pie)", [("1", 0.222283), ("2", 0.196114), ("11", 0.182089), ("3", 0.152977), ("12", 0.065371)]),
        ("#SUM(#SYN(cherry apple))", [("11", 0.149082), ("1", 0.135083), ("3", 0.124047), ("12", 0.107043), ("2", 0.107043)]),
    ],
)
def test_bm25(index, q, expected):
    assert list(ranked(index, q).items()) == expected


@pytest.mark.parametrize(
    ("q", "expected"),
    [
        ("#SYN(cherry apple)", {"1": [0, 2], "11": [0], "12": [0], "2": [1], "3": [0, 4]}),
        ("#NEAR/1(apple pie)", {"1": [1]}), ("#NEAR/3(apple pie)", {"1": [1]}), ("#NEAR/1(pie apple)", {"1": [2], "2": [1]}),
        ("#NEAR/3(pie apple)", {"1": [2], "2": [1], "3": [4]}), ("#WINDOW/2(apple pie)", {"1": [1], "2": [1]}),
        ("#WINDOW/4(apple pie)", {"1": [1], "2": [1], "3": [4]}), ("#NEAR/1(#SYN(apple cherry) pie)", {"1": [1], "3": [1]}),
        ("#NEAR/2(apple pie apple)", {"1": [2]}),
    ],
)
def test_positions(index, q, expected):
    assert {r.eid: r.positions for r in positions(parse(q, index.analyzer), index).collect()} == expected


def test_boolean_models(index):
    assert ranked(index, "#AND(apple pie)", RankedBoolean()) == {"1": 1.0, "2": 1.0, "3": 1.0}
    assert list(ranked(index, "#OR(cherry apple)", RankedBoolean()).items()) == [("1", 2.0), ("11", 1.0), ("12", 1.0), ("2", 1.0), ("3", 1.0)]
    assert ranked(index, "#AND(apple pie)", UnrankedBoolean()) == {"1": 1.0, "2": 1.0, "3": 1.0}
    assert ranked(index, "#AND(#SUM(tart crust) pie)", UnrankedBoolean()) == {"1": 1.0, "12": 1.0, "2": 1.0}
    assert ranked(index, "#AND(with)", RankedBoolean()) == {}


def test_operators_without_a_score_raise(index):
    for q, model in (("#AND(apple pie)", BM25()), ("#OR(apple pie)", BM25()), ("#SUM(apple pie)", RankedBoolean())):
        with pytest.raises(QuerySyntaxError):
            rank_query(q, index, model)
    with pytest.raises(ValueError):
        model_of("bm25")


def test_batch_equals_single_queries(spark, index):
    texts = {"a": "apple pie", "b": "apple apple pie", "c": "with", "d": "#WSUM(0.7 apple 0.3 pie)"}
    rows = spark.createDataFrame([*texts.items(), ("e", "#NEAR/1(apple pie)"), ("g", None)], "qid string, qstring string")
    batch = {(r.qid, r.eid): (r.rank, round(r.score, 6)) for r in rank_batch(query_terms(rows, index), index, BM25()).collect()}
    single = {(q, r.eid): (r.rank, round(r.score, 6)) for q, t in texts.items() for r in rank_query(t, index, BM25()).collect()}
    assert batch == single


@pytest.mark.parametrize("bad", ["#SUM(apple", "apple (pie)", "what is the u.s. apple", "#FOO(apple)", "#NEAR(apple pie)"])
def test_a_malformed_query_raises_with_its_qid(spark, index, bad):
    rows = spark.createDataFrame([("good", "apple"), ("bad7", bad)], "qid string, qstring string")
    for plan in (lambda: rank_set(rows, index, BM25()), lambda: query_terms(rows, index), lambda: query_leaves(rows, index)):
        with pytest.raises(Exception, match="in query bad7"):
            plan().collect()


def test_leaves_keep_repeats_in_any_structure(spark, index):
    rows = spark.createDataFrame([("a", "apple apple pie"), ("b", "#WSUM(2 #NEAR/2(apple pie) 1 #SUM(apple with))"), ("c", "with"), ("d", None)], "qid string, qstring string")
    got = sorted((r.qid, r.term) for r in query_leaves(rows, index).collect())
    assert got == [("a", "apple"), ("a", "apple"), ("a", "pie"), ("b", "apple"), ("b", "apple"), ("b", "pie")]


def test_feedback(spark, index):
    run = spark.createDataFrame([("q", 1, "1", 0.4), ("q", 2, "12", 0.2)], "qid string, rank int, eid string, score double")
    okapi = feedback.expansion_terms(run, index, feedback.Feedback("okapi"))
    assert {r.term: round(r.weight, 6) for r in okapi.collect()} == {"tart": 1.175573, "cherry": 0.587787}
    rm3 = feedback.expansion_terms(run, index, feedback.Feedback("rm3"))
    assert {r.term: round(r.weight, 6) for r in rm3.collect()} == {"tart": 0.356678, "apple": 0.244755, "pie": 0.241153, "cherry": 0.142671}
    queries = spark.createDataFrame([("q", "apple"), ("r", "pie")], "qid string, qstring string")
    out = {r.qid: r.qstring for r in feedback.expanded_queries(okapi, queries, feedback.Feedback("okapi", field_out="title")).collect()}
    assert out == {"q": "#SUM( cherry.title tart.title )", "r": "pie"}
    mixed = {r.qid: r.qstring for r in feedback.expanded_queries(rm3, queries, feedback.Feedback("rm3", orig_weight=0.5)).collect()}
    assert mixed["q"].startswith("#WSUM( 0.5 #SUM(apple) 0.5 #WSUM( 0.142671")
    assert ranked(index, mixed["q"])["1"] > 0


def test_write_and_open(spark, index, tmp_path):
    index.write(str(tmp_path / "ix"))
    again = open_index(spark, str(tmp_path / "ix"), index.analyzer)
    assert ranked(again, "#SUM(apple pie)") == ranked(index, "#SUM(apple pie)")
    with pytest.raises(Exception):
        open_index(spark, str(tmp_path / "none"))


def test_empty_and_null_documents(spark):
    df = spark.createDataFrame([("1", ""), ("2", None), (None, "apple"), ("3", "the")], "eid string, body string")
    ix = build_index(df, {"body": "body"})
    assert ix.postings.count() == 0
    assert {r.eid: (r.len, r.poslen) for r in ix.lengths.collect()} == {"1": (0, 0), "3": (1, 0)}
    assert rank_query("apple", ix, BM25()).count() == 0
    assert rank_query("apple", build_index(df.limit(0), {"body": "body"}), BM25()).count() == 0
