"""Mix sources to target weights by weighted fair queueing over virtual finish times."""

from __future__ import annotations

import base64
import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.operators.scale import checkpoint, materialise

#: The most target rows; each source is a row of the driver's plan.
MOST_TARGETS = 10_000
#: About so many rows share a bin of the distributed prefix sums.
BIN_ROWS = 50_000
WHITESPACE = " \t\r\n"


def words(text: Column) -> Column:
    """Number of words separated by space, tab, CR or LF."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t\r\n]+")), F.lit(0)).cast("long")


def tokens(path: str, pattern: str, most_bytes: int = 64_000_000):
    """Column function that counts a text's tokens with a rank file of a public tokenizer (path and pattern are the caller's).

    The file is read here and travels with the function, so executors need no such path; it is refused over `most_bytes`. A task builds its tokenizer once.
    """
    if os.path.getsize(path) > most_bytes:
        raise ValueError(f"{path} has more than {most_bytes} bytes")
    with open(path, "rb") as file:
        packed = zlib.compress(file.read())

    @F.pandas_udf("long")
    def count(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, zlib.decompress(packed).splitlines())}
        own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        for texts in parts:
            yield pd.Series([len(t) for t in own.encode_ordinary_batch([t or "" for t in texts], num_threads=1)], dtype="int64")

    return count


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the running sum of `size` within the task, and the task's number."""
    part, upto = TaskContext.get().partitionId(), 0
    for batch in batches:
        run = np.cumsum(batch.column("size").to_numpy()) + upto
        upto = int(run[-1]) if len(run) else upto
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(run), pa.array(np.full(len(run), part, np.int32))], names=[*batch.schema.names, "run", "part"])


@dataclass
class Mix:
    """drawn: (id, source, copy, size, finish), in parts sorted by finish; report: a row for each target."""

    drawn: DataFrame
    report: DataFrame


def horizon(wanted: list[tuple[float, float]], budget: float) -> float:
    """Virtual time at which the queues have sent the budget; wanted: (share, most tokens to be had) of each source."""
    ends = sorted((most / share, share, most) for share, most in wanted if share > 0 and most > 0)
    done, open_share = 0.0, sum(s for _, s, _ in ends)
    for end, share, most in ends:
        if done + open_share * end >= budget:
            break
        done, open_share = done + most, open_share - share
    return (budget - done) / open_share if open_share > 1e-12 else (ends[-1][0] if ends else 0.0)


def mix_sources(
    documents: DataFrame, targets: DataFrame, id_col: str, text_col: str, source_col: str = "source",
    size: Column | None = None, budget: int | None = None, seed: int = 0, bin_rows: int = BIN_ROWS,
) -> Mix:
    """Draw documents so that each source gives its share of the budget, repeating sources at most max_repeats times.

    `targets` has source, target_share and max_repeats, at most MOST_TARGETS rows; sources compare trimmed and lower-cased, and
    documents of other or null sources are left out. `size` is the size of a row (default: its words); `budget` the total
    size to draw (default: that of all documents of the listed sources, W). Each source's documents are shuffled by a hash of id and seed; copy c of a
    document finishes at virtual time (c * source size + size of the documents up to it) / target_share. All are
    ordered by that time, ties by source, id and copy, and drawn while the running size stays within the budget.

    report: source, target_share, max_repeats, available, drawn, actual_share, repeats and outcome: `cut` if the first round lasts to
    target_share * W, `repeated` if max_repeats rounds do, else `short`. A source without documents is short. Empty documents have size 0 and may be drawn.
    A null share or repeat counts as 0; target rows without a source give a row with nothing drawn.

    A source's prefix sums are taken in bins of equal ranges of the hash, those of the queue after a sort by ranges of the virtual time, so a source that holds most
    rows is spread like any other. No document is left out by an estimate: what ends later than all that can be drawn has been shown to.
    """
    spark = documents.sparkSession
    name = lambda c: F.lower(F.btrim(c, F.lit(WHITESPACE)))
    rows = targets.select("source", F.coalesce(F.col("target_share").cast("double"), F.lit(0.0)).alias("target_share"), F.coalesce(F.col("max_repeats").cast("int"), F.lit(0)).alias("max_repeats")).withColumn("key", name(F.col("source"))).limit(MOST_TARGETS + 1).collect()
    if len(rows) > MOST_TARGETS:
        raise ValueError(f"more than {MOST_TARGETS} targets")
    known = {r["key"]: r for r in reversed(rows) if r["key"] is not None}
    listed = F.broadcast(spark.createDataFrame([(k,) for k in known], "key string"))
    docs = documents.select(F.col(id_col).alias("id"), name(F.col(source_col)).alias("key"), (words(F.col(text_col)) if size is None else size.cast("long")).alias("size"))
    docs = docs.join(listed, "key").withColumn("h", F.xxhash64("id", F.lit(seed)))
    docs = materialise(docs)
    sums = docs.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("s"), F.max("size").alias("most")).collect()
    totals = {r["key"]: (r["n"], r["s"]) for r in sums}
    count, whole = sum(n for n, _ in totals.values()), sum(s for _, s in totals.values())
    goal = whole if budget is None else budget
    wanted = {k: (r["target_share"], totals.get(k, (0, 0))[1], r["max_repeats"]) for k, r in known.items()}
    until = horizon([(share, have * times) for share, have, times in wanted.values()], goal)
    # each queue is behind the fluid one by less than its largest document: all that is drawn ends before these are made up
    lag = sum(r["most"] or 0 for r in sums)
    end = max(until, horizon([(share, have * times) for share, have, times in wanted.values()], goal + lag + 1))
    # rounds are queued until that time and until W is due; at least one, so that each source shows when its first would end
    plan = [(k, share, have, max(1, min(times, int(share * max(end, whole) / have) + 1)), times) for k, (share, have, times) in wanted.items() if share > 0 and have > 0]
    plan_df = F.broadcast(spark.createDataFrame(plan, "key string, share double, have long, copies int, times int"))

    bits = max(1, (count // bin_rows).bit_length())
    docs = docs.withColumn("bin", F.shiftrightunsigned("h", 64 - bits))
    inside = Window.partitionBy("key", "bin").orderBy("h", "id", "size").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("key").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    starts = docs.groupBy("key", "bin").agg(F.sum("size").alias("b")).select("key", "bin", F.coalesce(F.sum("b").over(before), F.lit(0)).alias("start"))
    queued = docs.withColumn("upto", F.sum("size").over(inside)).join(starts, ["key", "bin"]).withColumn("upto", F.col("upto") + F.col("start"))
    queued = queued.join(plan_df, "key").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    queued = materialise(queued.select("id", "key", "size", "copy", "times", "share", ((F.col("copy") * F.col("have") + F.col("upto")) / F.col("share")).alias("finish")))

    ends = {r["key"]: r for r in queued.groupBy("key").agg(F.max(F.when(F.col("copy") == 0, F.col("finish") * F.col("share"))).alias("first"), F.max(F.when(F.col("copy") < F.col("times"), F.col("finish") * F.col("share"))).alias("last")).collect()}  # a row a target

    sent = queued.filter((F.col("finish") <= 1.001 * end + 1) & (F.col("copy") < F.col("times"))).select("id", F.col("key").alias("source"), "copy", "size", "finish")
    order = ["finish", "source", "id", "copy"]
    sent = checkpoint(sent.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_running, f"id {dict(sent.dtypes)['id']}, source string, copy int, size long, finish double, run long, part int"))
    earlier = Window.partitionBy(F.lit(1)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a task
    base = sent.groupBy("part").agg(F.max("run").alias("b")).select("part", F.coalesce(F.sum("b").over(earlier), F.lit(0)).alias("base"))
    drawn = sent.join(F.broadcast(base), "part").filter(F.col("run") + F.col("base") <= goal).select("id", "source", "copy", "size", "finish")

    got = {r["source"]: r for r in drawn.groupBy("source").agg(F.sum("size").alias("s"), F.max("copy").alias("c"), F.count(F.lit(1)).alias("n")).collect()}
    total = sum(r["s"] for r in got.values())
    report = []
    for r in rows:
        have, mine = totals.get(r["key"], (0, 0))[1], got.get(r["key"])
        # the queue's own times: a round lasts until the virtual time W if its last document ends there or later
        due, queue = r["target_share"] * whole * (1 - 1e-12), ends.get(r["key"])
        first, last = (queue["first"] or 0, queue["last"] or 0) if queue else (0, 0)
        outcome = "cut" if first >= due else "repeated" if last >= due else "short"
        report.append((r["source"], r["target_share"], r["max_repeats"], have, mine["s"] if mine else 0, (mine["s"] / total if total else 0.0) if mine else 0.0, mine["c"] + 1 if mine else 0, outcome))
    shape = "source string, target_share double, max_repeats int, available long, drawn long, actual_share double, repeats int, outcome string"
    return Mix(drawn, spark.createDataFrame(report, shape))
