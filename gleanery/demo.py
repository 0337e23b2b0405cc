"""A small tour: index three pages, rank them for a question, choose passages, build a prompt and answer from the pages."""

from __future__ import annotations

from pyspark.sql import SparkSession

from gleanery.operators import answers, passages
from gleanery.plans.compile import rank_set
from gleanery.plans.models import BM25
from gleanery.sources.index import build_index

PAGES = [
    ("p1", "Lighthouses", "A lighthouse warns ships of rocks. Its lamp turns all night."),
    ("p2", "Harbours", "A harbour shelters ships from storms. Boats are moored along its quays."),
    ("p3", "Orchards", "Apples ripen in an orchard until autumn."),
]
QUESTION = "What warns ships of rocks?"


def tour(spark: SparkSession) -> list[tuple[str, str]]:
    """(what, value) of each stage."""
    pages = spark.createDataFrame(PAGES, "eid string, title_string string, body_string string")
    asked = spark.createDataFrame([("1", QUESTION.rstrip("?"))], "qid string, qstring string")
    index = build_index(pages, {"body": "body_string", "title": "title_string"})
    ranking = rank_set(asked, index, BM25(), 2)
    psgs = passages.passages(pages, "eid", "body_string", "title_string", 8, 4, 3, 2)
    pairs = ranking.select("qid", "eid", "rank").join(psgs, "eid").join(asked, "qid")
    best = answers.best_passages(pairs.withColumn("score", passages.overlap_score(pairs.qstring, pairs.text, index.analyzer)))
    told = answers.answers(asked, answers.contexts(best), 2).first()
    return [("ranking", " ".join(r.eid for r in ranking.orderBy("rank").collect())), ("prompt", told.prompt), ("answer", told.answer)]
