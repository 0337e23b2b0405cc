"""Passage selection, prompts and extractive answers."""

from __future__ import annotations

import socket
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions.text import collapse_whitespace, fallback_answer, postprocess_answer

#: The six prompts as (system text, label before the context, instruction line).
PROMPTS = {
    1: ("You are a helpful chatbot. Use the passage below to provide a short answer to the specified question. Don't explain your reasoning. Just generate a short answer.", "Context:", None),
    2: ("Answer the question using only the provided context. Return a very short answer of at most five words. Do not add any explanation.", "Context: ", "Return only the answer phrase."),
    3: ("Answer only from the provided context. If the context is insufficient, answer Not enough information. Keep the answer brief and do not speculate.", "Context: ", "Give a short answer grounded in the context."),
    4: ("You are extracting a named answer span from the context. Respond with only the best entity, title, date, place, or number that answers the question. Do not write a sentence.", "Context: ", "Extract the shortest correct answer span."),
    5: ("Use only the context to answer the question. Prefer canonical names over descriptions, and avoid lists unless the answer truly requires multiple items. Do not explain.", "Context: ", "Return a clean canonical answer with no extra words."),
    6: ("Answer directly from the provided context. Give the answer first, in the shortest natural form possible. Avoid hedging, preambles, and explanations.", "Context: ", "Write only the direct answer."),
}


def best_passages(scored: DataFrame) -> DataFrame:
    """(qid, eid, rank, text): of each ranked document the passage of largest score, the earliest of equal ones."""
    return scored.groupBy("qid", "eid", "rank").agg(F.max_by("text", F.struct("score", -F.col("psg_no"))).alias("text"))


def contexts(best: DataFrame) -> DataFrame:
    """(qid, context): the documents' passages in rank order, joined by spaces; bounded by the depth of the ranking."""
    parts = F.sort_array(F.collect_list(F.struct("rank", F.btrim("text").alias("text"))))
    return best.groupBy("qid").agg(F.array_join(F.filter(F.transform(parts, lambda x: x["text"]), lambda t: t != ""), " ").alias("context"))


def prompt(question: Column, context: Column, prompt_id: int = 1, email: str = "", code: str = "") -> Column:
    """The messages as a JSON array; an id without a prompt raises."""
    if prompt_id not in PROMPTS:
        raise ValueError(f"unsupported prompt {prompt_id}, expected 1 to 6")
    system, label, instruction = PROMPTS[prompt_id]
    q, c = F.btrim(F.coalesce(question, F.lit(""))), F.btrim(F.coalesce(context, F.lit("")))
    third = F.concat(F.lit("Question: "), q) if instruction is None else F.lit(instruction)
    user = F.concat(F.lit("Question: "), q, F.lit(f"\n{label}"), c, F.lit("\n"), third, F.lit("\nAnswer: "))
    message = lambda role, text: F.to_json(F.struct(F.lit(role).alias("role"), text.alias("content")))
    first = F.to_json(F.struct(F.lit("authorize").alias("role"), F.lit(email).alias("email"), F.lit(code).alias("code")))
    return F.concat(F.lit("["), first, F.lit(", "), message("system", F.lit(system)), F.lit(", "), message("user", user), F.lit("]"))


def socket_client(address: str, most: int = 20 * 1024) -> Callable[[str], str]:
    """A client of `host/port`: sends the messages and four zero bytes, reads up to four zero bytes or `most` bytes."""

    def ask(messages: str) -> str:
        try:
            host, port = address.split("/")
            with socket.create_connection((host, int(port)), timeout=60) as s:
                s.sendall(messages.encode() + b"\0\0\0\0")
                data = b""
                while len(data) < most and not data.endswith(b"\0\0\0\0") and (part := s.recv(most - len(data))):
                    data += part
            return data.removesuffix(b"\0\0\0\0").decode()
        except Exception as e:  # the answer stage falls back on such replies
            return f"EXCEPTION:: {e}"

    return ask


def ask_model(client: Callable[[], Callable[[str], str]]) -> Callable[[Column], Column]:
    """An injected client as an Arrow UDF; client() is called once a task."""

    @F.pandas_udf("string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        ask = client()
        for prompts in parts:
            yield prompts.map(ask)

    return run


def answers(queries: DataFrame, contexts_: DataFrame, prompt_id: int = 1, model: Callable[[Column], Column] | None = None, email: str = "", code: str = "") -> DataFrame:
    """(qid, prompt, answer); without a model, or where it fails, the answer is extracted from the context."""
    q = queries.join(contexts_, "qid", "left").withColumn("context", F.coalesce("context", F.lit("")))
    q = q.withColumn("prompt", prompt(F.col("qstring"), F.col("context"), prompt_id, email, code))
    reply = collapse_whitespace(model(F.col("prompt"))) if model else F.lit("")
    return q.select("qid", "prompt", fallback_answer(postprocess_answer(reply), F.col("qstring"), F.col("context")).alias("answer"))
