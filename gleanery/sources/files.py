"""Readers of the experiment file formats. Each gives a DataFrame; bad lines are skipped, not fatal."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleanery.functions.text import coerce_numbers
from gleanery.operators.scale import numbered


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, at, value): the lines in file order; at grows along a file."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at"), "value")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """`.qry`: (qid, qstring) from `qid: text`, split at the first colon; of a repeated qid the later line holds, blank lines are skipped."""
    rows = _lines(spark, path).filter(F.col("value").contains(":"))
    at = F.instr("value", ":")
    rows = rows.select("at", F.btrim(F.substring("value", F.lit(1), at - 1)).alias("qid"), F.btrim(F.substring(F.col("value"), at + 1, F.length("value"))).alias("qstring"))
    return rows.filter(F.col("qid") != "").groupBy("qid").agg(F.max_by("qstring", "at").alias("qstring"))


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    """`.qrels`: (qid, ignored, eid, rel) of lines with at least four words."""
    parts = F.split(F.btrim("value"), r"\s+", 4)
    rows = spark.read.text(path).select(parts.alias("p")).filter(F.size("p") >= 4)
    return rows.select(*[F.col("p")[i].alias(n) for i, n in enumerate(("qid", "ignored", "eid", "rel"))])


def read_run(spark: SparkSession, path: str, max_rank: int | None = None) -> DataFrame:
    """A run file's (qid, rank, eid, score, runid) in file order: rank counts each query's kept lines. Lines without six columns are skipped.

    Where a qid comes in several stretches of a file, the last stretch holds.
    """
    p = F.split(F.btrim("value"), r"\s+")
    rows = _lines(spark, path).select("file", "at", p.alias("p")).filter(F.size("p") == 6)
    rows = rows.select("file", "at", F.col("p")[0].alias("qid"), F.col("p")[2].alias("eid"), F.col("p")[3].try_cast("int").alias("given"), F.col("p")[4].try_cast("double").alias("score"), F.col("p")[5].alias("runid"))
    rows = numbered(rows, ["file"], [F.asc("at")], "n")  # over all tasks, however long the file
    mine = Window.partitionBy("file", "qid").orderBy("at")
    rows = rows.withColumn("stretch", F.col("n") - F.row_number().over(mine))
    rows = rows.withColumn("last", F.max("stretch").over(Window.partitionBy("file", "qid"))).filter(F.col("stretch") == F.col("last"))
    if max_rank is not None:
        rows = rows.filter(F.col("given") <= max_rank)
    return rows.select("qid", F.row_number().over(Window.partitionBy("qid").orderBy("at")).alias("rank"), "eid", "score", "runid")


def ranked_from_run(run: DataFrame, n: int | None = None) -> DataFrame:
    """Rows of a run table (qid, rank, eid, score) as a ranking in the order of their ranks."""
    order = Window.partitionBy("qid").orderBy("rank", "eid")
    out = run.withColumn("rank", F.row_number().over(order))
    return out.filter(F.col("rank") <= n) if n else out


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """(at, score): the last word of each line that is not blank as a number, else the first."""
    words = F.split(F.btrim("value"), r"\s+")
    rows = _lines(spark, path).filter(F.btrim("value") != "").select("at", words.alias("w"))
    return rows.select("at", F.coalesce(F.element_at("w", -1).try_cast("double"), F.element_at("w", 1).try_cast("double")).alias("score"))


def read_evaluation(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, file, metric, qid, value) of evaluator outputs."""
    p = F.split(F.btrim("value"), r"\s+")
    rows = spark.read.text(paths).select(F.col("_metadata.file_path").alias("path"), p.alias("p")).filter(F.size("p") >= 3)
    return rows.select("path", F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), *[F.col("p")[i].alias(n) for i, n in enumerate(("metric", "qid", "value"))])


def read_parameters(path: str) -> dict:
    """A JSON parameter object; numeric-looking strings become numbers."""
    file = Path(path)
    if not file.is_file():
        raise FileNotFoundError(path)
    return coerce_numbers(json.loads(file.read_text()))


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(eid, embedding) from Parquet."""
    return spark.read.parquet(path).select("eid", "embedding")
