"""The best documents of many flat queries, scored in blocks of documents.

Every query meets every document that has one of its terms, so the pairs grow with queries times documents. They are never rows: a task holds the postings of a block of
documents by term, adds them up in arrays, a query at a time, and hands on no more than the block's best n of each query.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.operators.positional import matches
from gleanery.operators.scale import materialise, numbered
from gleanery.sources.index import Index

#: Most terms of queries that travel to the tasks at once; more are taken in rounds of whole queries.
ASK_ROWS = 1_000_000
#: Postings a block should have at most, on average, and documents whose proximity is matched in one step.
BLOCK_POSTINGS, MATCHED_AT_ONCE = 4_000_000, 100_000
#: Most documents whose numbers are broadcast.
FEW_DOCS = 500_000
#: Below this, differences may vanish in rounding to nine places.
SLACK = 2e-9
OPS = ("SUM", "AND", "OR", "NEAR", "WINDOW")
VALUES = ("BM25", "RankedBoolean", "UnrankedBoolean")


def best_of_set(asks: DataFrame, index: Index, k1: float, b: float, n: int) -> DataFrame:
    """(qid, rank, eid, score) of the n best documents of each query, scores of nine places, ties by the lower eid.

    `asks` has a row for each known term of each query: (qid, op, args, distance, arg, field, term, weight, model, df, num_docs, avg_len). SUM adds weighted scores, AND takes the
    least where all `args` are met, OR the largest, NEAR and WINDOW score the matches of their terms within the distance as BM25 does those of a term.
    """
    asks = materialise(asks)
    ids = index.lengths.select(F.lit(1).alias("one"), "eid").distinct()
    docs = materialise(numbered(ids, ["one"], [F.asc("eid")], "no").select("eid", F.col("no").cast("int").alias("no")))
    small = F.broadcast if docs.count() <= FEW_DOCS else (lambda d: d)
    rounds = max(1, math.ceil(asks.count() / ASK_ROWS))
    part = F.pmod(F.xxhash64("qid"), F.lit(rounds))
    out = None
    for i in range(rounds):
        mine = _round(asks.filter(part == i) if rounds > 1 else asks, index, small(docs), k1, b, n)
        out = mine if out is None else out.unionByName(mine)
    return out.join(small(docs), "no").select("qid", "rank", "eid", "score")


def _round(asks: DataFrame, index: Index, docs: DataFrame, k1: float, b: float, n: int) -> DataFrame:
    spark = asks.sparkSession
    t = asks.toArrow().sort_by([("qid", "ascending"), ("arg", "ascending")])
    of = lambda name: t[name].to_numpy()
    key = pc.binary_join_element_wise(t["field"].cast("string"), t["term"].cast("string"), "\x1f").combine_chunks().dictionary_encode()
    tid, names, qid = key.indices.to_numpy(), key.dictionary.to_pylist(), t["qid"].combine_chunks().cast("string").dictionary_encode()
    first = np.flatnonzero(np.r_[True, np.diff(qid.indices.to_numpy()) != 0]) if len(t) else np.zeros(0, np.int64)
    ops, models = np.array([OPS.index(x) for x in t["op"].to_pylist()], np.int8), np.array([VALUES.index(x) for x in t["model"].to_pylist()], np.int8)
    df, num = of("df").astype(float), of("num_docs").astype(float)
    by_term, avg, placed = np.zeros(len(names)), np.zeros(len(names)), np.zeros(len(names), bool)
    by_term[tid], avg[tid] = df, of("avg_len").astype(float)
    placed[tid[ops >= 3]] = True
    idf = np.log((num + 1) / (df + 0.5))
    sent = spark.sparkContext.broadcast({
        "qid": qid.dictionary, "start": np.r_[first, len(t)], "tid": tid, "op": ops[first], "model": models[first], "args": of("args")[first], "distance": of("distance")[first].astype(np.int64), "num": num[first],
        "factor": of("weight") * np.where(models == 0, idf, 1.0), "idf": idf, "avg": avg, "terms": len(names),
    })
    pairs = [x.split("\x1f", 1) for x in names]
    terms = spark.createDataFrame(pa.table({"field": pa.array([x[0] for x in pairs], pa.string()), "term": pa.array([x[1] for x in pairs], pa.string()), "tid": pa.array(np.arange(len(names), dtype=np.int32)), "placed": pa.array(placed)}))
    terms = F.broadcast(terms) if len(names) <= 500_000 else terms
    positions = F.when(F.col("placed"), F.col("positions")) if placed.any() else F.lit(None).cast("array<int>")
    met = index.postings.join(terms, ["field", "term"]).select("eid", "tid", "tf", F.col("len").cast("int").alias("len"), positions.alias("positions")).join(docs, "eid").select("no", "tid", "tf", "len", "positions")
    blocks = max(spark.sparkContext.defaultParallelism, math.ceil(by_term.sum() / BLOCK_POSTINGS))

    def score(batches):
        yield from _scored(batches, sent.value, k1, b, n)

    def merge(batches):
        yield from _merged(batches, sent.value, n)

    found = met.repartition(blocks, "no").mapInArrow(score, "q int, nos binary, scores binary, met long")
    return found.repartition("q").sortWithinPartitions("q").mapInArrow(merge, "qid string, rank int, no int, score double")


def _best(nos: np.ndarray, v: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The n best by rounded score, ties by number."""
    if len(v) > n:
        near = np.flatnonzero(v >= np.partition(v, -n)[-n] - SLACK)
        nos, v = nos[near], v[near]
    v = np.round(v, 9)
    order = np.lexsort((nos, -v))[:n]
    return nos[order], v[order]


def _scored(batches, q: dict, k1: float, b: float, n: int):
    """(query, numbers, scores, matches) of the best documents of a block; of NEAR and WINDOW the scores lack the factor that all documents share."""
    held = [x for x in batches if x.num_rows]
    if not held:
        return
    t = pa.Table.from_batches(held)
    lists, held = t["positions"].combine_chunks(), None
    nos, doc = np.unique(t["no"].to_numpy(), return_inverse=True)
    tid, width = t["tid"].to_numpy(), len(nos)
    order = np.argsort(tid.astype(np.int64) * width + doc, kind="stable")
    tid, doc, tf, length = tid[order], doc[order].astype(np.int32), t["tf"].to_numpy()[order].astype(float), t["len"].to_numpy()[order].astype(float)
    at = np.searchsorted(tid, np.arange(q["terms"] + 1))
    avg = q["avg"][tid]
    with np.errstate(divide="ignore", invalid="ignore"):
        k = np.where(avg > 0, k1 * ((1 - b) + b * length / avg), k1)
    values, flat, ends = (tf / (tf + k), tf, np.ones(len(tf))), lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
    begin, end = ends[:-1][order].astype(np.int64), ends[1:][order].astype(np.int64)
    del t, avg, length, tid, order
    acc, where = np.zeros(width), np.full(width, -1, np.int64)
    rows: list[tuple] = []

    def shared(terms: list[int]) -> np.ndarray:
        """A row of places in the postings for each document that has all the terms."""
        cols = np.arange(at[terms[0]], at[terms[0] + 1])[:, None]
        for x in terms[1:]:
            own = np.arange(at[x], at[x + 1])
            where[doc[own]] = own
            other = where[doc[cols[:, 0]]]
            where[doc[own]] = -1
            cols = np.column_stack([cols[other >= 0], other[other >= 0]])
        return cols

    def batch():
        nonlocal rows
        out = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1].astype(np.int32).tobytes() for r in rows], pa.binary()), pa.array([r[2].tobytes() for r in rows], pa.binary()), pa.array([r[3] for r in rows], pa.int64())], ["q", "nos", "scores", "met"])
        rows = []
        return out

    near: dict[tuple, list] = {}
    waiting = 0
    for i, op in enumerate(q["op"]):
        mine = slice(q["start"][i], q["start"][i + 1])
        terms, factor, value = q["tid"][mine].tolist(), q["factor"][mine], values[q["model"][i]]
        sizes = at[[x + 1 for x in terms]] - at[terms]
        if op != 0 and op != 2 and (len(terms) < q["args"][i] or not sizes.all()) or not sizes.any():
            continue
        if op >= 3:
            cols = shared(terms)
            if len(cols):
                near.setdefault((int(op), cols.shape[1]), []).append((i, cols))
                waiting += len(cols)
            if waiting >= MATCHED_AT_ONCE:
                rows += _proximities(near, q, doc, nos, flat, begin, end, k, n)
                near, waiting = {}, 0
            if len(rows) >= 1000:
                yield batch()
            continue
        if op == 1:
            cols = shared(terms)
            d, v = doc[cols[:, 0]], (value[cols] * factor).min(axis=1)
        elif len(terms) == 1:
            a, e = at[terms[0]], at[terms[0] + 1]
            d, v = doc[a:e], value[a:e] * factor[0]
        elif op == 0 and sizes.sum() > width // 4 and (factor > 0).all():
            acc.fill(0.0)
            for x, f in zip(terms, factor):
                a, e = at[x], at[x + 1]
                acc[doc[a:e]] += value[a:e] * f  # a term has a document once
            some = acc[::8]
            least = np.partition(some, -n)[-n] - SLACK if len(some) > n else 0.0
            d = np.flatnonzero(acc >= least) if least > 0 else np.flatnonzero(acc > 0)
            v = acc[d]
        else:
            d, inverse = np.unique(np.concatenate([doc[at[x] : at[x + 1]] for x in terms]), return_inverse=True)
            each = np.concatenate([value[at[x] : at[x + 1]] * f for x, f in zip(terms, factor)])
            if op == 0:
                v = np.bincount(inverse, weights=each, minlength=len(d))
            else:
                v = np.zeros(len(d))
                np.maximum.at(v, inverse, each)
        if op == 2:
            v = np.maximum(v, 0.0)
        if len(d):
            rows.append((i, *_best(nos[d], v, n), 0))
        if len(rows) >= 1000:
            yield batch()
    if near:
        rows += _proximities(near, q, doc, nos, flat, begin, end, k, n)
    if rows:
        yield batch()


def _proximities(near: dict, q: dict, doc, nos, flat, begin, end, k, n: int) -> list[tuple]:
    """Rows of the queries in `near` ((op, number of terms) to (query, places of their postings)), matched together."""
    out = []
    for (op, _), found in near.items():
        cols, query = np.concatenate([c for _, c in found]), np.repeat([i for i, _ in found], [len(c) for _, c in found])
        which, _ = matches(OPS[op], q["distance"][query], flat, begin[cols], end[cols])
        count = np.bincount(which, minlength=len(cols)).astype(float)
        hit = np.flatnonzero(count)
        first = cols[hit, 0]  # all postings of a document in a field have its length
        v, query = count[hit] / (count[hit] + k[first]), query[hit]
        cut = np.r_[0, np.flatnonzero(np.diff(query)) + 1, len(query)]
        for a, e in zip(cut[:-1], cut[1:]):
            if a == e:
                continue
            i, own, numbers = int(query[a]), v[a:e], nos[doc[first[a:e]]]
            if len(own) > n:  # the factor is at least that of the rarest term
                slack = SLACK / q["idf"][q["start"][i] : q["start"][i + 1]].max()
                keep = np.flatnonzero(own >= np.partition(own, -n)[-n] - slack)
                own, numbers = own[keep], numbers[keep]
            out.append((i, numbers, own, int(e - a)))
    return out


def _merged(batches, q: dict, n: int):
    """The best documents of each query from those of the blocks."""

    def one(i: int, rows: list[tuple]) -> tuple:
        nos, v = np.concatenate([np.frombuffer(r[0], np.int32) for r in rows]), np.concatenate([np.frombuffer(r[1], np.float64) for r in rows])
        if q["op"][i] >= 3:
            v = v * np.log((q["num"][i] + 1) / (sum(r[2] for r in rows) + 0.5))
        return i, *_best(nos, v, n)

    def out(done: list[tuple]) -> pa.RecordBatch:
        size = [len(x[1]) for x in done]
        which = np.repeat([x[0] for x in done], size)
        rank = np.concatenate([np.arange(1, s + 1) for s in size])
        return pa.RecordBatch.from_arrays([q["qid"].take(pa.array(which)), pa.array(rank.astype(np.int32)), pa.array(np.concatenate([x[1] for x in done]).astype(np.int32)), pa.array(np.concatenate([x[2] for x in done]))], ["qid", "rank", "no", "score"])

    last, held, done = None, [], []
    for batch in batches:
        for i, nos, scores, met in zip(*(batch.column(c).to_pylist() for c in range(4))):
            if i != last and held:
                done.append(one(last, held))
                held = []
                if len(done) >= 100:
                    yield out(done)
                    done = []
            last = i
            held.append((nos, scores, met))
    if held:
        done.append(one(last, held))
    if done:
        yield out(done)
