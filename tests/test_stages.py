import json
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleanery.operators import answers, dense, ltr, passages, scale
from gleanery.operators.scale import heavy_keys, hot_cold_join, latest, numbered, split_by
from gleanery.plans import pipeline
from gleanery.sources import files, sinks
from gleanery.sources.index import build_index


@pytest.mark.parametrize(("n", "length", "stride", "count", "expected"), [(10, 4, 2, 50, 4), (10, 2, 20, 50, 1), (0, 4, 2, 5, 0), (10, 4, 2, 2, 2), (3, 4, 4, None, 1)])
def test_passage_windows(spark, n, length, stride, count, expected):
    df = spark.createDataFrame([("d", " ".join(str(i) for i in range(n)), None)], "eid string, b string, t string")
    got = passages.passages(df, "eid", "b", "t", length, stride, count).orderBy("psg_no").collect()
    assert len(got) == expected
    for i, r in enumerate(got):
        assert r.text == " ".join(str(x) for x in range(i * stride, min(n, i * stride + length)))


def test_title_only_passage(spark):
    df = spark.createDataFrame([("d", None, "A b c"), ("e", "", None)], "eid string, b string, t string")
    assert [(r.eid, r.text) for r in passages.passages(df, "eid", "b", "t", 4, title_length=2).collect()] == [("d", "A b")]
    with pytest.raises(ValueError):
        passages.passages(df, "eid", "b", "t", 0)


def run_of(spark, rows):
    return spark.createDataFrame(rows, "qid string, rank int, eid string, score double")


def test_merge_keeps_the_head_above_the_tail(spark):
    old = run_of(spark, [("q", 1, "a", 9.0), ("q", 2, "b", 8.0), ("q", 3, "c", 7.0)])
    head = spark.createDataFrame([("q", "b", 0.5), ("q", "a", 0.2)], "qid string, eid string, score double")
    got = [(r.rank, r.eid, round(r.score, 6)) for r in passages.merge_head(old, head, 2).orderBy("rank").collect()]
    assert got == [(1, "b", 0.5), (2, "a", 0.2), (3, "c", 0.1)]
    bad = head.withColumn("score", F.lit(float("-inf")))
    assert [r.score for r in passages.merge_head(old, bad, 2).orderBy("rank").collect()][-1] == 7.0
    assert passages.merge_head(old, head.limit(0), 0).count() == 3


def test_aggregations_and_unknown_documents(spark):
    scored = spark.createDataFrame([("q", "a", 0, "x", 0.1), ("q", "a", 1, "y", 0.5), ("q", "a", 2, "z", 0.5)], "qid string, eid string, psg_no int, text string, score double")
    for how, score, text in (("firstp", 0.1, "x"), ("maxp", 0.5, "y"), ("avgp", 1.1 / 3, "y")):
        r = passages.document_scores(scored, how).first()
        assert (round(r.score, 6), r.text) == (round(score, 6), text)
    with pytest.raises(ValueError):
        passages.document_scores(scored, "sum")
    run = run_of(spark, [("q", 1, "none", 1.0)])
    asked = spark.createDataFrame([("q", "x")], "qid string, qstring string")
    psgs = scored.select("eid", "psg_no", "text")
    assert passages.score_head(run, asked, psgs, lambda q, t: F.lit(1.0), 10, "maxp").first().score == float("-inf")


def test_min_max(spark):
    rows = [("q", "a", 2.0, 5.0), ("q", "b", None, 5.0), ("q", "c", 4.0, None), ("q", "d", 3.0, 5.0)]
    got = ltr.min_max(spark.createDataFrame(rows, "qid string, eid string, f1 double, f2 double"), [1, 2]).orderBy("eid").collect()
    assert [(r.f1, r.f2) for r in got] == [(0.0, 0.0), (None, 0.0), (1.0, None), (0.5, 0.0)]


def test_learning_orders_by_the_useful_feature(spark):
    rng = random.Random(3)
    rows = []
    for q in range(12):
        for d in range(10):
            good = rng.random()
            rows.append((f"q{q}", f"d{d}", int(good > 0.6), good, rng.random()))
    df = spark.createDataFrame(rows, "qid string, eid string, label int, f1 double, f2 double")
    for model in (ltr.fit_pairwise(df, [1, 2]), ltr.fit_coordinate_ascent(df, [1, 2])):
        assert model.weights[0] > abs(model.weights[1])
    run = run_of(spark, [("q0", d + 1, f"d{d}", float(-d)) for d in range(10)])
    feats = df.filter("qid = 'q0' and eid != 'd3'")
    got = ltr.rerank(run, feats.filter("eid < 'd8'"), ltr.LinearRanker((1, 2), (1.0, 0.0)), 8).orderBy("rank").collect()
    assert [r.eid for r in got][-3:] == ["d3", "d8", "d9"] and [r["rank"] for r in got] == list(range(1, 11))
    assert ltr.fit_pairwise(df.limit(0), [1, 2]).weights == (0.0, 0.0)


def test_the_tail_of_a_learned_ranking_stays_below_its_head(spark):
    run = run_of(spark, [("q", 1, "a", 9.0), ("q", 2, "b", 8.0), ("q", 3, "c", 7.0), ("q", 4, "d", 6.5)])
    feats = spark.createDataFrame([("q", "a", 0.2), ("q", "b", 0.5)], "qid string, eid string, f1 double")
    got = ltr.rerank(run, feats, ltr.LinearRanker((1,), (1.0,)), 3).orderBy("rank").collect()
    assert [(r.eid, round(r.score, 6)) for r in got] == [("b", 0.5), ("a", 0.2), ("c", 0.1), ("d", -0.4)]
    low = run.withColumn("score", F.col("score") - 100)
    assert [r.score for r in ltr.rerank(low, feats, ltr.LinearRanker((1,), (1.0,)), 2).orderBy("rank").collect()][2:] == [-93.0, -93.5]


def test_pairwise_gradient_equals_all_pairs():
    rng = np.random.default_rng(4)
    s, y, x = rng.normal(size=40), rng.integers(0, 4, 40), rng.normal(size=(40, 3))
    want = sum((x[i] - x[j] for i in range(40) for j in range(40) if y[i] > y[j] and s[i] - s[j] < 1), np.zeros(3))
    assert np.allclose(ltr._lost_pairs(s, y, x), want)


def test_pairwise_training_reads_every_judged_row(spark):
    # one query of 100,001 judged rows was left out as a whole, and of many queries only a hash's choice was read
    large = spark.range(100_001).select(F.lit("q").alias("qid"), F.col("id").cast("string").alias("eid"), (F.col("id") % 2).cast("int").alias("label"), (F.col("id") % 2).cast("double").alias("f1"), F.lit(0.5).alias("f2"))
    assert ltr.fit_pairwise(large, [1, 2], steps=5).weights[0] > 0.01


def test_pairwise_training_is_the_same_in_the_driver_and_over_the_blocks(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(f"q{q}", f"d{d}", rng.randrange(4), rng.random(), rng.random()) for q in range(30) for d in range(2 + q * 3)]
    df = spark.createDataFrame(rows, "qid string, eid string, label int, f1 double, f2 double")
    qid, y, x = np.array([r[0] for r in rows]), np.array([r[2] for r in rows], float), np.array([r[3:] for r in rows])
    groups = [np.flatnonzero(qid == q) for q in sorted(set(qid))]
    pairs, w = sum(int((y[m][:, None] > y[m][None, :]).sum()) for m in groups), np.zeros(2)
    for t in range(6):
        w = w - (0.5 / (1 + 0.05 * t)) * (0.001 * w - sum(ltr._lost_pairs(x[m] @ w, y[m], x[m]) for m in groups) / pairs)
    for held in (ltr.HELD_BYTES, 0):
        assert np.allclose(ltr.fit_pairwise(df, [1, 2], steps=6, held=held).weights, w)
    monkeypatch.setattr(ltr, "BLOCK_ROWS", 7)  # queries go on from batch to batch
    assert np.allclose(ltr.fit_pairwise(df, [1, 2], steps=6).weights, w)


def test_features_of_a_query_without_terms_are_zero(spark):
    ix = build_index(spark.createDataFrame([("a", "apple pie", None)], "eid string, body string, title string"), {"body": "body", "title": "title"})
    pairs = spark.createDataFrame([("q", "a", 1)], "qid string, eid string, label int")
    r = ltr.extract(pairs, spark.createDataFrame([], "qid string, term string"), ix).first()
    assert [r[f"f{i}"] for i in (5, 6, 7, 17, 18, 20)] == [0.0] * 6 and r.f8 is None and r.f19 is None


def test_a_given_run_is_not_cut(spark, tmp_path):
    ix = build_index(spark.createDataFrame([("a", "apple")], "eid string, body string"), {"body": "body"})
    lines = "".join(f"1 Q0 d{i} {i} {2000 - i} r\n" for i in range(1, 1501))
    batch = pipeline.Batch(spark.createDataFrame([("1", "apple", None)], "qid string, qstring string, original_qstring string"))
    got = pipeline.rank(batch, ix, {"type": "inRankFile", "inRankFile:Path": write(tmp_path / "r", lines)}, pipeline.Models())
    assert got.rankings.count() == 1500


def test_the_expansion_file_holds_what_was_learned(spark, tmp_path):
    ix = build_index(spark.createDataFrame([("1", "apple pie tart"), ("2", "plum cake"), ("3", "pear")], "eid string, body string"), {"body": "body"})
    batch = pipeline.Batch(spark.createDataFrame([("1", "apple", None)], "qid string, qstring string, original_qstring string"), run_of(spark, [("1", 1, "1", 2.0)]))
    path = str(tmp_path / "x")
    got = pipeline.rewrite(batch, ix, {"type": "prf", "prf:algorithm": "rm3", "prf:rm3:origWeight": 0.4, "prf:expansionQueryFile": path})
    line = spark.read.text(path).first().value
    assert line.startswith("1: #WSUM( ") and "#SUM" not in line and "#SUM(apple)" in got.queries.first().qstring


def test_dense_search_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    v, q = rng.normal(size=(200, 8)).astype("float32"), rng.normal(size=(7, 8)).astype("float32")
    vectors = spark.createDataFrame([(f"d{i}", x.tolist()) for i, x in enumerate(v)] + [("null", None), ("short", [1.0])], "eid string, embedding array<float>").repartition(5)
    asked = spark.createDataFrame([(str(i), x.tolist()) for i, x in enumerate(q)] + [("n", None)], "qid string, query_vector array<float>")
    for block in (2, 100):
        got = {(r.qid, r["rank"]): r.eid for r in dense.dense_topk(asked, vectors, 5, 8, block).collect()}
        for i, x in enumerate(q):
            s = v.astype(float) @ x.astype(float)
            assert [got[(str(i), k + 1)] for k in range(5)] == [f"d{j}" for j in np.argsort(-s)[:5]]
    same = spark.createDataFrame([(f"d{i:03d}", [1.0] * 8) for i in range(300)], "eid string, embedding array<float>").coalesce(1)
    assert [r.eid for r in dense.dense_topk(asked.filter("qid = '0'"), same, 5, 8).orderBy("rank").collect()] == [f"d{i:03d}" for i in range(5)]
    assert dense.dense_topk(asked.limit(0), vectors, 5, 8).count() == 0
    assert dense.dense_topk(asked, vectors.limit(0), 5, 8).count() == 0


def test_prompts(spark):
    df = spark.createDataFrame([("q", 'Who "is" it?', "ctx")], "qid string, q string, c string")
    for i in range(1, 7):
        m = json.loads(df.select(answers.prompt(F.col("q"), F.col("c"), i).alias("x")).first().x)
        assert [x["role"] for x in m] == ["authorize", "system", "user"] and 'Who "is" it?' in m[2]["content"]
    assert m[2]["content"].endswith("Answer: ")
    with pytest.raises(ValueError):
        answers.prompt(F.col("q"), F.col("c"), 7)
    assert answers.socket_client("127.0.0.1/1")("[]").startswith("EXCEPTION:: ")


def test_heavy_groups(spark):
    df = spark.createDataFrame([("h", i) for i in range(50)] + [("l", 1), (None, 2)], "k string, v int")
    heavy = heavy_keys(df, ["k"], 10)
    assert [(r.k, r.rows_in_group) for r in heavy.collect()] == [("h", 50)]
    hot, cold = split_by(df, heavy, ["k"])
    assert hot.count() == 50 and {r.k for r in cold.collect()} == {"l", None}
    assert heavy_keys(df, ["k"], 100) is None
    got = numbered(df.repartition(7), ["k"], [F.desc("v")], "n", 5).collect()
    assert sorted((r.v, r.n) for r in got if r.k == "h") == [(v, 50 - v) for v in range(50)]
    assert [r.n for r in got if r.k is None] == [1]
    right = spark.createDataFrame([("h", 50), ("l", 1)], "k string, w int")
    for limit in (0, 10, 100):
        assert hot_cold_join(df, right, "k", "w", limit).count() == 51


def test_written_tables_are_released(spark, monkeypatch):
    monkeypatch.setattr(scale, "_WRITTEN", [])
    table = scale.materialise(spark.range(5))
    path = scale._WRITTEN[0][1].removeprefix("file:")
    assert table.count() == 5 and os.path.isdir(path)
    scale.release()
    assert not os.path.exists(path) and scale._WRITTEN == []


def test_few_groups_can_be_heavy(spark):
    assert scale.heavy_limit(100, spark) == scale.LEAST_HEAVY
    rows, parts = 10**9, int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert rows // scale.heavy_limit(rows, spark) <= scale.SHARE * parts + 1


def test_latest(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("a", 2, "y"), ("b", None, None), (None, 1, "z")], "k string, t int, v string")
    assert {(r.k, r.v) for r in latest(df, "k", "t", ["v"]).collect()} == {("a", "y"), ("b", None)}


def write(path, text):
    path.write_text(text)
    return str(path)


def test_readers(spark, tmp_path):
    q = files.read_queries(spark, write(tmp_path / "q.qry", "1: apple: pie \n\n2:x\n1: later\n"))
    assert {r.qid: r.qstring for r in q.collect()} == {"1": "later", "2": "x"}
    qrels = files.read_qrels(spark, write(tmp_path / "q.qrels", "1 0 d1 2\n1 0 d2\n2 0 d3 x y\n"))
    assert {(r.qid, r.eid, r.rel) for r in qrels.collect()} == {("1", "d1", "2"), ("2", "d3", "x y")}
    run = files.read_run(spark, write(tmp_path / "r.run", "1 Q0 b 1 2.0 r\n1 Q0 a 2 3.0 r\nbad line\n2 Q0 c 1 1 r\n1 Q0 z 1 9 r\n"), 5)
    assert {(r.qid, r["rank"], r.eid) for r in run.collect()} == {("1", 1, "z"), ("2", 1, "c")}
    p = files.read_predictions(spark, write(tmp_path / "p", "1 0 0.5\n\n7 x\n"))
    assert [r.score for r in p.orderBy("at").collect()] == [0.5, 7.0]
    assert files.read_parameters(write(tmp_path / "p.json", '{"a": "2"}')) == {"a": 2}
    with pytest.raises(FileNotFoundError):
        files.read_parameters(str(tmp_path / "none"))
    for name in ("a", "b"):
        write(tmp_path / f"{name}.teOut", f"map all {name}1\np10 all {name}2\n")
    values = files.read_evaluation(spark, [str(tmp_path / "a.teOut"), str(tmp_path / "b.teOut")])
    got = {(r.metric, r.qid): (r["a.teOut"], r["b.teOut"]) for r in sinks.evaluation_table(values, ["a.teOut", "b.teOut"]).collect()}
    assert got == {("map", "all"): ("a1", "b1"), ("p10", "all"): ("a2", "b2")}


def test_a_whole_run(spark, tmp_path):
    rows = [("1", "apple pie apple tart", "Apples"), ("2", "pie apple crust", "Crust"), ("3", "cherry pie recipe with apple", None), ("4", "banana bread", "Bread")]
    docs = spark.createDataFrame(rows, "eid string, body_string string, title_string string")
    ix = build_index(docs, {"body": "body_string", "title": "title_string"}, attributes=["body_string", "title_string"])
    ix.persist()
    qrels = write(tmp_path / "t.qrels", "1 0 1 1\n1 0 2 0\n1 0 3 -1\n")
    ltr_files = {k: str(tmp_path / k[4:]) for k in ("ltr:trainingFeatureVectorsFile", "ltr:testingFeatureVectorsFile", "ltr:testingDocumentScores", "ltr:modelFile")}
    p = {
        "queryFilePath": write(tmp_path / "q.qry", "1: apple pie\n2: zebra\n10: #NEAR/1(apple pie)\n"),
        "task_1:ranker": {"type": "BM25", "outputLength": 10},
        "task_2:rewriter": {"type": "PRF", "prf:algorithm": "rm3", "prf:numTerms": 3, "prf:rm3:origWeight": 0.5},
        "task_3:ranker": {"type": "BM25"},
        "task_4:reranker": {"type": "bertrr", "rerankDepth": 2, "bertrr:psgLen": 3, "bertrr:scoreAggregation": "maxp"},
        "task_5:reranker": {"type": "ltr", "rerankDepth": 2, "ltr:trainingQueryFile": str(tmp_path / "q.qry"), "ltr:trainingQrelsFile": qrels, "ltr:toolkit": "SVMrank", **ltr_files},
        "task_6:agent": {"type": "rag", "agentDepth": 2, "rag:psgLen": 4, "rag:psgCnt": 2},
        "task_7:output": {"type": "trec_eval", "outputPath": str(tmp_path / "out"), "outputLength": 2},
        "task_8:output": {"type": "triviaqa_evaluation", "outputPath": str(tmp_path / "a.json"), "promptPath": str(tmp_path / "prompts")},
    }
    pipeline.run(spark, p, index=ix)
    lines = [r.value for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert [x.split()[0] for x in lines] == ["1", "1", "2", "10", "10"]
    assert "2 Q0 Nonexistent_Docid 1 0.000000000000 reference" in lines
    assert json.load(open(tmp_path / "a.json"))["1"]
    assert len(open(tmp_path / "prompts").read().splitlines()) == 3
    assert [r.value.split()[:2] for r in spark.read.text(ltr_files["ltr:trainingFeatureVectorsFile"]).collect()] == [["0", "qid:1"], ["0", "qid:1"], ["1", "qid:1"]]
    assert {"ids", "weights"} == set(json.loads(spark.read.text(ltr_files["ltr:modelFile"]).first().value))
    assert spark.read.text(ltr_files["ltr:testingDocumentScores"]).count() == spark.read.text(ltr_files["ltr:testingFeatureVectorsFile"]).count() > 0
    learn = p["task_5:reranker"]
    start = {"queryFilePath": p["queryFilePath"], "task_1:ranker": {"type": "BM25"}}
    for wrong in ({k: v for k, v in learn.items() if k != "ltr:modelFile"}, {**learn, "ltr:toolkit": "x"}, {**learn, "ltr:toolkit": "RankLib", "ltr:RankLib:model": 6}, {**learn, "ltr:toolkit": "RankLib", "ltr:RankLib:metric2t": "NDCG@5"}):
        with pytest.raises(ValueError):
            pipeline.run(spark, {**start, "task_2:reranker": wrong}, index=ix)
    for bad in ({"task_1:x": {}}, {"task_1:ranker": {"type": "bm25"}}, {"task_1:output": {"type": "x"}}, {"task_1:rewriter": {"type": "x"}, "task_0:ranker": {"type": "BM25"}}):
        bad = dict(sorted(bad.items()))
        with pytest.raises(ValueError):
            pipeline.run(spark, {"queryFilePath": p["queryFilePath"], **bad}, index=ix)


def test_the_tour(spark, capsys):
    from gleanery.__main__ import main

    assert main(["demo"]) == 0
    out = capsys.readouterr().out.splitlines()
    assert out[0] == "ranking: p1 p2" and out[2] == "answer: Lighthouses A lighthouse warns ships of rocks"


def test_models_are_loaded_by_their_path(spark):
    rows = [("1", "apple pie apple tart", "A"), ("2", "pie crust", "B")]
    ix = build_index(spark.createDataFrame(rows, "eid string, body_string string, title_string string"), {"body": "body_string"}, attributes=["body_string", "title_string"])
    batch = pipeline.Batch(spark.createDataFrame([("q", "apple", None)], "qid string, qstring string, original_qstring string"), run_of(spark, [("q", 1, "1", 2.0), ("q", 2, "2", 1.0)]))

    def pairs(path):
        return lambda asked, texts: [float(len(t.split())) if path == "m" else -1.0 for t in texts]

    def encoder(path):
        return lambda texts: np.array([[float("apple" in t), 1.0] for t in texts])

    p = {"type": "bertrr", "rerankDepth": 2, "bertrr:psgLen": 4, "bertrr:modelPath": "m", "bertrr:batchSize": 1, "bertrr:maxSeqLength": 7}
    got = pipeline.rerank(batch, ix, p, pipeline.Models(pair_loader=pairs)).rankings.collect()
    assert {r.eid: r.score for r in got} == {"1": 3.0, "2": 2.0}
    with pytest.raises(ValueError):
        pipeline.rerank(batch, ix, {k: v for k, v in p.items() if k != "bertrr:modelPath"}, pipeline.Models(pair_loader=pairs))
    rag = {"type": "rag", "agentDepth": 2, "rag:psgLen": 2, "rag:psgCnt": 2, "rag:encoderPath": "e"}
    assert pipeline.agent(batch, ix, rag, pipeline.Models(encoder_loader=encoder)).answers.first().answer


def test_timer():
    t = pipeline.Timer()
    t.start()
    with pytest.raises(RuntimeError):
        t.start()
    t.stop()
    assert str(t).endswith(" secs")
    with pytest.raises(RuntimeError):
        t.stop()


def test_command_line(spark, tmp_path, capsys):
    from gleanery.__main__ import main

    ix = build_index(spark.createDataFrame([("a", "apple pie"), ("b", "pie")], "eid string, body string"), {"body": "body"})
    ix.write(str(tmp_path / "ix"))
    assert main(["inspect", str(tmp_path / "ix"), "terms", "body"]) == 0
    assert main(["inspect", str(tmp_path / "ix"), "eid", "1"]) == 0
    assert capsys.readouterr().out.splitlines() == ["apple\t1\t1", "pie\t2\t2", "1\tb"]
    assert main(["inspect", str(tmp_path / "ix"), "eid", "2"]) == 1 and main(["inspect", str(tmp_path / "ix"), "termvector", "b"]) == 0
    assert capsys.readouterr().out.splitlines() == ["Error: no document 2, there are 2, from 0", "body\tpie\t1\t[0]"]
    p = {"indexPath": str(tmp_path / "ix"), "queryFilePath": write(tmp_path / "q.qry", "1: apple\n"), "task_1:ranker": {"type": "BM25"}, "task_2:output": {"type": "trec_eval", "outputPath": str(tmp_path / "o"), "outputLength": "5"}}
    write(tmp_path / "x.param", json.dumps(p))
    assert main(["run", str(tmp_path / "x.param")]) == 0
    assert spark.read.text(str(tmp_path / "o")).first().value.startswith("1 Q0 a 1 ")
    assert main([]) == 1
    for name, text in (("a", "map all 1\n"), ("b", "map all 2\n"), ("c", "")):
        write(tmp_path / f"{name}.teOut", text)
    assert main(["te2csv", str(tmp_path / "csv"), str(tmp_path / "a.teOut"), str(tmp_path / "b.teOut")]) == 0
    assert [r.value for r in spark.read.text(str(tmp_path / "csv")).collect()] == ["metric,qid,a.teOut,b.teOut", "map,all,1,2"]
