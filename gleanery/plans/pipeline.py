"""A run from a parameter object: stages in order, each from (queries, rankings) to the next."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions.text import plain_query
from gleanery.operators import answers, dense, feedback, ltr, passages
from gleanery.operators.scale import checkpoint
from gleanery.plans.compile import query_leaves, rank_set
from gleanery.plans.models import model_of
from gleanery.sources import files, sinks
from gleanery.sources.index import Index, open_index


class Timer:
    """Wall time between start and stop; misuse raises."""

    def __init__(self):
        self._from: float | None = None
        self.seconds = 0.0

    def start(self) -> None:
        if self._from is not None:
            raise RuntimeError("the timer runs already")
        self._from = time.perf_counter()

    def stop(self) -> None:
        if self._from is None:
            raise RuntimeError("the timer does not run")
        self.seconds, self._from = self.seconds + time.perf_counter() - self._from, None

    def __str__(self) -> str:
        return f"{self.seconds:.1f} secs"


@dataclass(frozen=True)
class Models:
    """What a run takes from outside: a pair scorer, text encoders and an answering model, none of them by default.

    A loader makes a scorer or an encoder of the model path in the settings, once a worker task.
    """

    pair_scorer: Callable[[Column, Column], Column] | None = None
    encoder: Callable[[Column], Column] | None = None
    answerer: Callable[[Column], Column] | None = None
    pair_loader: Callable[[str], Callable] | None = None
    encoder_loader: Callable[[str], Callable] | None = None

    def pairs(self, p: dict, default: Callable[[Column, Column], Column]) -> Callable[[Column, Column], Column]:
        if self.pair_scorer or not self.pair_loader:
            return self.pair_scorer or default
        path, batch, most = _required(p, "bertrr:modelPath"), int(p.get("bertrr:batchSize", 16)), int(p.get("bertrr:maxSeqLength", 512))
        if min(batch, most) <= 0:
            raise ValueError("bertrr:batchSize and bertrr:maxSeqLength must be positive")
        load = self.pair_loader
        return passages.model_score(lambda: load(path), batch, most)

    def encodes(self, p: dict, key: str) -> Callable[[Column], Column] | None:
        if self.encoder or not self.encoder_loader:
            return self.encoder
        path, load = _required(p, key), self.encoder_loader
        return dense.encode(lambda: load(path))


def _required(p: dict, key: str):
    if not p.get(key):
        raise ValueError(f"missing settings ['{key}']")
    return p[key]


@dataclass(frozen=True)
class Batch:
    queries: DataFrame  # qid, qstring, original_qstring
    rankings: DataFrame | None = None
    answers: DataFrame | None = None


def rank(batch: Batch, index: Index, p: dict, models: Models) -> Batch:
    kind, n = str(p.get("type")), int(p.get("outputLength", 1000))
    if kind == "inRankFile":
        run = files.read_run(index.docs.sparkSession, p["inRankFile:Path"]).drop("runid")  # as it is, however long
        return replace(batch, rankings=run.join(batch.queries.select("qid"), "qid", "left_semi"))
    if kind.lower() == "dense":
        encoder = models.encodes(p, "dense:modelPath")
        if encoder is None:
            raise ValueError("a dense ranker needs an encoder")
        vectors = files.read_vectors(index.docs.sparkSession, p["dense:indexPath"])
        asked = batch.queries.select("qid", encoder(plain_query(F.coalesce("original_qstring", "qstring"))).alias("query_vector"))
        return replace(batch, rankings=dense.dense_topk(asked, vectors, n, int(p.get("dense:dim", 768))))
    return replace(batch, rankings=rank_set(batch.queries, index, model_of(kind, p), n))


def rewrite(batch: Batch, index: Index, p: dict) -> Batch:
    how = feedback.Feedback.of(p)
    if batch.rankings is None:
        return batch
    terms = checkpoint(feedback.expansion_terms(batch.rankings, index, how))  # read twice
    if path := p.get("prf:expansionQueryFile"):
        sinks.write_expanded(feedback.learned_queries(terms, how).join(batch.queries.select("qid"), "qid", "left_semi").withColumnRenamed("learned", "qstring"), path)
    return replace(batch, queries=feedback.expanded_queries(terms, batch.queries, how))


def rerank(batch: Batch, index: Index, p: dict, models: Models, training: tuple[DataFrame, DataFrame] | None = None) -> Batch:
    kind, depth = str(p.get("type")).lower(), int(p.get("rerankDepth", 1000))
    if kind == "bertrr":
        length = int(p.get("bertrr:psgLen", 0))
        psgs = passages.passages(index.docs, "eid", "body_string", "title_string", length, int(p.get("bertrr:psgStride", length)), int(p.get("bertrr:psgCnt", 1)) or None, int(p.get("bertrr:maxTitleLength", 0)))
        scorer = models.pairs(p, lambda q, t: passages.overlap_score(q, t, index.analyzer))
        asked = batch.queries.select("qid", plain_query(F.col("qstring")).alias("qstring"))
        head = passages.score_head(batch.rankings, asked, psgs, scorer, depth, p.get("bertrr:scoreAggregation", "firstp"))
        if path := p.get("bertrr:topPsgPath"):
            sinks.write_lines(sinks.passage_lines(head).select("value"), path)
        return replace(batch, rankings=passages.merge_head(batch.rankings, head, depth))
    if kind == "ltr":
        return replace(batch, rankings=learn_and_rerank(batch, index, p, training))
    raise ValueError(f"unknown reranker {p.get('type')}")


#: The settings without which no learning to rank starts.
LTR_SETTINGS = ("ltr:trainingQueryFile", "ltr:trainingQrelsFile", "ltr:trainingFeatureVectorsFile", "ltr:testingFeatureVectorsFile", "ltr:testingDocumentScores", "ltr:modelFile", "ltr:toolkit")


def learn_and_rerank(batch: Batch, index: Index, p: dict, training: tuple[DataFrame, DataFrame] | None) -> DataFrame:
    """Train on the judged pages of the training queries, write features, model and scores where the settings say, and re-rank the head.

    The toolkits' trainers are this package's own: coordinate ascent on average precision for RankLib's ranker 4 with MAP, pairwise hinge loss on scaled features
    for SVMrank. Other rankers and metrics are refused. A query's terms are those of its leaves, as often as it has them.
    """
    spark = index.docs.sparkSession
    missing = [k for k in LTR_SETTINGS if p.get(k) is None]
    if missing:
        raise ValueError(f"missing settings {missing}")
    toolkit, svm = str(p["ltr:toolkit"]).lower(), str(p["ltr:toolkit"]).lower() == "svmrank"
    if toolkit not in ("ranklib", "svmrank"):
        raise ValueError(f"unknown toolkit {p['ltr:toolkit']}")
    if not svm and (int(p.get("ltr:RankLib:model", 4)) != 4 or str(p.get("ltr:RankLib:metric2t", "MAP")) != "MAP"):
        raise ValueError("of RankLib's rankers only 4, coordinate ascent, is there, with the metric MAP")
    off = frozenset(int(x) for x in str(p.get("ltr:featureDisable", "")).split(",") if x.strip())
    how = ltr.Features(float(p.get("ltr:BM25:k_1", 1.2)), float(p.get("ltr:BM25:b", 0.75)), float(p.get("ltr:QL:mu", 2500)), off)
    known = files.read_queries(spark, p["ltr:trainingQueryFile"]) if training is None else training[0]
    judged = files.read_qrels(spark, p["ltr:trainingQrelsFile"]) if training is None else training[1]
    scaled = lambda f: ltr.min_max(f, how.ids) if svm else f
    depth = int(p.get("rerankDepth", 1000))

    train = checkpoint(scaled(ltr.extract(ltr.training_pairs(known, judged, index), query_leaves(known, index), index, how)))
    sinks.write_features(ltr.feature_lines(train, how.ids), p["ltr:trainingFeatureVectorsFile"])
    model = ltr.fit_pairwise(train, how.ids, float(p.get("ltr:svmRankParamC", 0.001))) if svm else ltr.fit_coordinate_ascent(train, how.ids)
    sinks.write_lines(spark.createDataFrame([(model.to_json(),)], "value string"), p["ltr:modelFile"])

    head = batch.rankings.filter(F.col("rank") <= depth).select("qid", "eid", F.lit(0).alias("label"))
    feats = checkpoint(scaled(ltr.extract(head, query_leaves(batch.queries, index), index, how)))
    sinks.write_features(ltr.feature_lines(feats, how.ids), p["ltr:testingFeatureVectorsFile"])
    saved = ltr.LinearRanker.from_json(files.read_lines(spark, p["ltr:modelFile"]).first()["value"])
    sinks.write_lines(feats.orderBy(*sinks.qid_order(), "eid").select(F.concat_ws("\t", "qid", "eid", saved.score().cast("string")).alias("value")), p["ltr:testingDocumentScores"])
    return ltr.rerank(batch.rankings, feats, saved, depth)


def agent(batch: Batch, index: Index, p: dict, models: Models) -> Batch:
    if str(p.get("type")).lower() != "rag":
        raise ValueError(f"unknown agent {p.get('type')}")
    depth, length, count = (int(p.get(k, 0)) for k in ("agentDepth", "rag:psgLen", "rag:psgCnt"))
    if min(depth, length, count) <= 0:
        raise ValueError("agentDepth, rag:psgLen and rag:psgCnt must be positive")
    psgs = passages.passages(index.docs, "eid", "body_string", "title_string", length, int(p.get("rag:psgStride", length)), count, int(p.get("rag:maxTitleLength", 0)))
    asked = batch.queries.select("qid", plain_query(F.coalesce("original_qstring", "qstring")).alias("qstring"))
    head = batch.rankings.filter(F.col("rank") <= depth).select("qid", "eid", "rank")
    encoder = models.encodes(p, "rag:encoderPath")
    if encoder:  # each query and each passage of a ranked page is encoded once
        psgs = psgs.join(head.select("eid").distinct(), "eid", "left_semi").withColumn("text_vector", encoder(F.col("text")))
        pairs = head.join(checkpoint(psgs), "eid").join(checkpoint(asked.withColumn("query_vector", encoder(F.col("qstring")))), "qid")
        score = dense.dot(F.col("query_vector"), F.col("text_vector"))
    else:
        pairs = head.join(psgs, "eid").join(asked, "qid")
        score = passages.overlap_score(F.col("qstring"), F.col("text"), index.analyzer)
    best = answers.best_passages(pairs.withColumn("score", score))
    # a given model comes first, then a server named in the settings
    answerer = models.answerer
    if answerer is None and p.get("rag:modelServer"):
        address = str(p["rag:modelServer"])
        answerer = answers.ask_model(lambda: answers.socket_client(address))
    out = answers.answers(asked, answers.contexts(best), int(p.get("rag:prompt", 1)), answerer, p.get("rag:email", ""), p.get("rag:code", ""))
    return replace(batch, answers=out)


def output(batch: Batch, p: dict) -> None:
    if p.get("type") == "trec_eval":
        sinks.write_run(batch.queries, batch.rankings, int(p["outputLength"]), p["outputPath"])
    elif p.get("type") == "triviaqa_evaluation":
        sinks.write_answers(batch.queries, batch.answers, p["outputPath"])
        if path := p.get("promptPath", p.get("rag:promptPath")):
            sinks.write_prompts(batch.answers, path)
    else:
        raise ValueError(f"unknown output type {p.get('type')}")


def run(spark, parameters: dict, models: Models | None = None, index: Index | None = None) -> Batch:
    """Run the `task_*:stage` entries in their order: ranker, rewriter, reranker, agent and output."""
    models = models or Models()
    index = index or open_index(spark, parameters["indexPath"])
    queries = files.read_queries(spark, parameters["queryFilePath"])
    batch = Batch(queries.withColumn("original_qstring", F.lit(None).cast("string")))
    for key, p in parameters.items():
        if not key.startswith("task_"):
            continue
        stage = key.split(":", 1)[1] if ":" in key else ""
        if stage == "ranker":
            batch = rank(batch, index, p, models)
        elif stage == "rewriter":
            batch = rewrite(batch, index, p)
        elif stage == "reranker":
            batch = rerank(batch, index, p, models)
        elif stage == "agent":
            batch = agent(batch, index, p, models)
        elif stage == "output":
            output(batch, p)
        else:
            raise ValueError(f"unknown stage {key}")
        if stage in ("ranker", "reranker"):  # a barrier: what follows reads the ranking several times
            batch = replace(batch, rankings=checkpoint(batch.rankings))
        elif stage == "rewriter":
            batch = replace(batch, queries=checkpoint(batch.queries))
    return batch
