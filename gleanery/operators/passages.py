"""Passage windows, pair scorers and the re-ranking of documents by their passages."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.functions.text import Analyzer, truncate_words, words


def window_count(n: Column, length: int, stride: int, count: int | None) -> Column:
    """Number of windows of n words: none beyond the end, none after one that reaches it, at most count."""
    reach = 1 + F.ceil(F.greatest(n - length, F.lit(0)) / stride)
    out = F.least(reach, F.ceil(n / stride))
    out = F.least(out, F.lit(count)) if count else out
    return F.when(n > 0, out).otherwise(0).cast("int")


def passages(docs: DataFrame, id_col: str, body: str, title: str | None, length: int, stride: int | None = None, count: int | None = 1, title_length: int = 0) -> DataFrame:
    """(eid, psg_no, text): windows of `length` words each `stride`, prefixed by the title's first words.

    A document without body words has its title as its only passage, if there is one; without that none.
    """
    if length <= 0:
        raise ValueError("passage length must be positive")
    stride = stride or length
    src = docs.select(F.col(id_col).alias("eid"), words(F.coalesce(F.col(body), F.lit(""))).alias("w"), (F.coalesce(truncate_words(F.col(title), title_length), F.lit("")) if title and title_length > 0 else F.lit("")).alias("t"))
    n = window_count(F.size("w"), length, stride, count)
    texts = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.btrim(F.concat_ws(" ", "t", F.array_join(F.slice("w", i * stride + 1, length), " ")), F.lit(" ")))
    texts = F.when(n > 0, texts).when(F.col("t") != "", F.array("t")).otherwise(F.array().cast("array<string>"))
    return src.select("eid", F.posexplode(texts).alias("psg_no", "text"))


def overlap_score(query: Column, text: Column, analyzer: Analyzer) -> Column:
    """Default pair scorer: the part of the query's distinct terms that the passage holds."""
    q = F.array_distinct(analyzer.terms(query))
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, analyzer.terms(text))) / F.size(q)).otherwise(0.0)


def model_score(load: Callable[[], Callable[[list[str], list[str]], list[float]]], batch: int = 16, most_words: int = 512) -> Callable[[Column, Column], Column]:
    """A pair scorer from a model: load() is called once a worker task and gives a function of (queries, texts).

    Texts are cut so that query, text and three marks have at most `most_words` words.
    """

    def cut(q: str, t: str) -> str:
        return " ".join(t.split()[: max(0, most_words - len(q.split()) - 3)])

    @F.pandas_udf("double")
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = load()
        for q, t in parts:
            out: list[float] = []
            for at in range(0, len(q), batch):
                asked = list(q[at : at + batch])
                out += list(model(asked, [cut(a, b) for a, b in zip(asked, t[at : at + batch])]))
            yield pd.Series(out, dtype="float64")

    return run


def document_scores(scored: DataFrame, aggregation: str) -> DataFrame:
    """(qid, eid, score, text) from scored passages by firstp, avgp or maxp; text is the first or the earliest best passage."""
    g = scored.groupBy("qid", "eid")
    if aggregation == "firstp":
        return g.agg(F.min_by("score", "psg_no").alias("score"), F.min_by("text", "psg_no").alias("text"))
    best = F.max_by("text", F.struct("score", -F.col("psg_no"))).alias("text")
    if aggregation == "avgp":
        return g.agg(F.avg("score").alias("score"), best)
    if aggregation == "maxp":
        return g.agg(F.max("score").alias("score"), best)
    raise ValueError(f"unknown aggregation {aggregation}")


def score_head(rankings: DataFrame, queries: DataFrame, psgs: DataFrame, scorer: Callable[[Column, Column], Column], depth: int, aggregation: str) -> DataFrame:
    """(qid, eid, score, text) of the first `depth` documents of each query; no passage or unknown document gives minus infinity."""
    head = rankings.filter(F.col("rank") <= depth).select("qid", "eid")
    pairs = head.join(psgs, "eid").join(queries.select("qid", "qstring"), "qid")
    scored = pairs.select("qid", "eid", "psg_no", "text", scorer(F.col("qstring"), F.col("text")).alias("score"))
    docs = document_scores(scored, aggregation)
    return head.join(docs, ["qid", "eid"], "left").withColumn("score", F.coalesce("score", F.lit(float("-inf"))))


def merge_head(rankings: DataFrame, head: DataFrame, depth: int) -> DataFrame:
    """(qid, rank, eid, score): the re-scored head above the old tail, whose scores are lowered to stay below it.

    The tail is shifted by max(0, its first score + 0.1 - the head's last score). An empty head or one that ends in minus infinity shifts nothing.
    """
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "eid")
    new = head.select("qid", "eid", "score").withColumn("rank", F.row_number().over(w))
    last = new.filter(F.col("score") > float("-inf")).groupBy("qid").agg(F.min("score").alias("low"))
    size = new.groupBy("qid").agg(F.max("rank").alias("size"))
    tail = rankings.filter(F.col("rank") > depth).select("qid", "eid", "score", "rank")
    first = tail.groupBy("qid").agg(F.max_by("score", -F.col("rank")).alias("high"), F.min("rank").alias("start"))
    shift = F.greatest(F.lit(0.0), F.coalesce(F.col("high") + 0.1 - F.col("low"), F.lit(0.0)))
    tail = tail.join(first, "qid").join(last, "qid", "left").join(size, "qid", "left")
    tail = tail.select("qid", "eid", (F.col("score") - shift).alias("score"), (F.col("rank") - F.col("start") + 1 + F.coalesce("size", F.lit(0))).cast("int").alias("rank"))
    return new.unionByName(tail).select("qid", "rank", "eid", "score")
