"""Writers of the experiment file formats."""

from __future__ import annotations

import json
from collections.abc import Iterable
from itertools import chain

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Fixed values of the run format.
NO_DOCUMENT, RUN_ID = "Nonexistent_Docid", "reference"


def qid_order() -> list:
    """Whole numbers first, then other numbers, then strings."""
    return [F.col("qid").try_cast("bigint").asc_nulls_last(), F.col("qid").try_cast("double").asc_nulls_last(), F.col("qid").asc()]


def run_rows(queries: DataFrame, rankings: DataFrame, n: int, run_id: str = RUN_ID) -> DataFrame:
    """(qid, rank, eid, score, value): at most n rows a query; a query without documents has one row that says so."""
    top = rankings.filter(F.col("rank") <= n).select("qid", F.col("rank").alias("r"), F.col("eid").alias("e"), F.col("score").alias("s"))
    rows = queries.select("qid").distinct().join(top, "qid", "left")
    rows = rows.select("qid", F.coalesce("r", F.lit(1)).cast("int").alias("rank"), F.coalesce("e", F.lit(NO_DOCUMENT)).alias("eid"), F.coalesce("s", F.lit(0.0)).alias("score"))
    return rows.withColumn("value", F.format_string(f"%s Q0 %s %d %.12f {run_id}", "qid", "eid", "rank", "score"))


def write_run(queries: DataFrame, rankings: DataFrame, n: int, path: str, single_file: bool = True) -> None:
    """The run in order of qid and rank: one file, or sorted parts for runs too large for one."""
    rows = run_rows(queries, rankings, n).orderBy(*qid_order(), "rank").select("value")
    (rows.coalesce(1) if single_file else rows).write.mode("overwrite").text(path)


def qa_answers(queries: DataFrame, answers: DataFrame) -> DataFrame:
    """(qid, answer) with an empty answer where there is none."""
    return queries.select("qid").distinct().join(answers.select("qid", "answer"), "qid", "left").select("qid", F.coalesce("answer", F.lit("")).alias("answer"))


def write_file(spark: SparkSession, path: str, parts: Iterable[str]) -> None:
    """One text file on whatever file system the path names, written piece by piece."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    try:
        for part in parts:
            out.write(bytearray(part.encode()))
    finally:
        out.close()


def write_answers(queries: DataFrame, answers: DataFrame, path: str) -> None:
    """One JSON object qid -> answer; one answer a query passes the driver."""
    rows = qa_answers(queries, answers).orderBy(*qid_order()).toLocalIterator()
    entries = ((", " if i else "") + f"{json.dumps(r['qid'])}: {json.dumps(r['answer'])}" for i, r in enumerate(rows))
    write_file(queries.sparkSession, path, chain(["{"], entries, ["}"]))


def write_prompts(prompts: DataFrame, path: str) -> None:
    """Lines `qid: [messages]` in ASCII."""
    rows = prompts.orderBy(*qid_order()).toLocalIterator()
    write_file(prompts.sparkSession, path, (f"{r['qid']}: {json.dumps(json.loads(r['prompt']))}\n" for r in rows))


def write_expanded(queries: DataFrame, path: str) -> None:
    queries.select(F.concat_ws(": ", "qid", "qstring").alias("value")).coalesce(1).write.mode("overwrite").text(path)


def write_features(lines: DataFrame, path: str) -> None:
    """Feature vectors in order of qid."""
    lines.orderBy(*qid_order(), "value").select("value").coalesce(1).write.mode("overwrite").text(path)


def passage_lines(head: DataFrame) -> DataFrame:
    """(qid, eid, value): `eid.0 passage` of every scored document with a passage."""
    return head.filter(F.col("text").isNotNull()).select("qid", "eid", F.concat("eid", F.lit(".0 "), "text").alias("value"))


def write_lines(lines: DataFrame, path: str) -> None:
    lines.select(F.col(lines.columns[0]).cast("string").alias("value")).write.mode("overwrite").text(path)


def evaluation_table(values: DataFrame, files: list[str]) -> DataFrame:
    """(metric, qid, a column for each file): evaluator outputs side by side, matched by metric and qid."""
    return values.groupBy("metric", "qid").pivot("file", files).agg(F.first("value"))


def write_evaluation_table(values: DataFrame, files: list[str], path: str) -> None:
    evaluation_table(values, files).orderBy("metric", *qid_order()).coalesce(1).write.mode("overwrite").csv(path, header=True)
