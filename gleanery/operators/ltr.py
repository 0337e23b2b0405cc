"""Learning to rank: features of (query, document) pairs, normalisation, training and re-ranking."""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.functions.text import safe_double
from gleanery.operators.scale import materialise
from gleanery.plans.compile import bm25
from gleanery.sources.index import Index

#: First feature of each field's BM25, likelihood and overlap.
FIELD_FEATURES = {"body": 5, "title": 8, "url": 11, "inlink": 14}


#: Most query terms, and queries, whose rows are broadcast.
MOST_TERMS = 500_000


@dataclass(frozen=True)
class Features:
    k1: float = 1.2
    b: float = 0.75
    mu: float = 2500.0
    disabled: frozenset[int] = frozenset()
    custom: dict[int, Callable[[], Column]] = field(default_factory=dict)

    @property
    def ids(self) -> list[int]:
        return sorted((set(range(1, 21)) | set(self.custom)) - self.disabled)


def training_pairs(queries: DataFrame, qrels: DataFrame, index: Index) -> DataFrame:
    """(qid, eid, label) of the judged documents of known queries; labels that are no whole number drop out, negative ones become 0."""
    label = F.col("rel").try_cast("int")
    judged = qrels.select("qid", "eid", label.alias("label")).filter(F.col("label").isNotNull() & F.col("eid").isNotNull())
    judged = judged.groupBy("qid", "eid").agg(F.max(F.greatest(F.lit(0), F.col("label"))).alias("label"))
    return judged.join(queries.select("qid").distinct(), "qid", "left_semi").join(index.docs.select("eid"), "eid", "left_semi")


def extract(pairs: DataFrame, terms: DataFrame, index: Index, p: Features = Features()) -> DataFrame:
    """pairs with the columns f1.. of p.ids.

    `terms` holds (qid, term) with repeats as the query has them. One aggregation over (pair, field) gives BM25, likelihood, overlap and the
    body's further features; a document without the field has null, one without a matching term 0 likelihood.
    """
    stats = index.field_stats.filter(F.col("field").isin(*FIELD_FEATURES))
    names = index.docs.columns
    pairs, asked = materialise(pairs), materialise(terms.groupBy("qid", "term").agg(F.count(F.lit(1)).alias("times")))  # read several times each
    few = asked.limit(MOST_TERMS + 1).count() <= MOST_TERMS  # then one query with very many pages is no matter
    small = F.broadcast if few else (lambda d: d)
    total = asked.groupBy("qid").agg(F.sum("times").alias("tokens"), F.count(F.lit(1)).alias("stems"))
    fields = pairs.select("qid", "eid").distinct().join(index.lengths.filter((F.col("poslen") > 0) & F.col("field").isin(*FIELD_FEATURES)), "eid").join(F.broadcast(stats), "field").join(small(total), "qid", "left")
    # every query term with every field of the pair: a bounded product, as a query has few terms
    # every page with the field, also for a query without terms, has values: its counts are 0
    wanted = fields.join(small(asked), "qid", "left").withColumns({"times": F.coalesce("times", F.lit(0)), "tokens": F.coalesce("tokens", F.lit(0)), "stems": F.coalesce("stems", F.lit(0))}).join(index.term_stats.select("field", "term", "df", "ctf"), ["field", "term"], "left")
    words = asked.select("term").distinct()
    hits = index.of_documents(pairs).select("field", "term", "eid", "tf").join(small(words), "term", "left_semi")  # of these pages and the queries' terms alone
    full = wanted.join(hits, ["field", "term", "eid"], "left").withColumn("tf", F.coalesce("tf", F.lit(0)))
    avg = F.col("sum_len") / F.col("doc_count")
    idf = F.log((F.col("num_docs") + 1) / (F.col("df") + 0.5))
    weight = F.when(F.col("tf") > 0, F.col("times") * bm25(F.col("tf"), F.col("len"), F.col("df"), F.col("num_docs"), avg, p.k1, p.b)).otherwise(0.0)
    chance = (F.col("tf") + p.mu * F.coalesce(F.col("ctf"), F.lit(0)) / F.col("sum_len")) / (F.col("len") + p.mu)
    hit = F.when(F.col("tf") > 0, 1).otherwise(0)
    g = full.groupBy("qid", "eid", "field").agg(
        F.sum(weight).alias("bm25"),
        F.min(chance).alias("least"), F.sum(F.when(chance > 0, F.col("times") * F.log(chance))).alias("logs"), F.max("tokens").alias("tokens"),
        F.sum(hit).cast("double").alias("overlap"),
        (F.sum(F.col("tf") * F.col("times")) / F.max("poslen")).alias("density"),
        F.max(F.when(F.col("tf") > 0, idf).otherwise(0.0)).alias("max_idf"),
        F.when(F.max("stems") > 0, F.sum(hit) / F.max("stems")).otherwise(0.0).alias("coverage"),
        F.sum(F.when(F.col("tf") > 0, F.col("tf") * F.col("times") * idf).otherwise(0.0)).alias("tfidf"),
    )
    likelihood = F.when((F.col("overlap") > 0) & (F.col("least") > 0), F.exp(F.col("logs") / F.col("tokens"))).otherwise(0.0)  # overlap needs a term
    g = g.withColumn("ql", likelihood)
    pick = lambda f, v: F.max(F.when(F.col("field") == f, F.col(v)))
    cols = []
    for f, first in FIELD_FEATURES.items():
        cols += [pick(f, v).alias(f"f{first + i}") for i, v in enumerate(("bm25", "ql", "overlap"))]
    cols += [pick("body", "density").alias("f17"), pick("body", "max_idf").alias("f18"), pick("title", "coverage").alias("f19"), pick("body", "tfidf").alias("f20")]
    text = g.groupBy("qid", "eid").agg(*cols)
    has = lambda c: F.col(c) if c in names else F.lit(None)
    url = has("raw_url").cast("string")
    own = index.docs.select(
        "eid", safe_double(has("spam_score").cast("string")).alias("f1"),
        F.when(F.length(url) > 0, F.length(url) - F.length(F.replace(url, F.lit("/"), F.lit("")))).cast("double").alias("f2"),
        F.when(F.lower(url).contains("wikipedia.org"), 1.0).otherwise(0.0).alias("f3"), safe_double(has("page_rank").cast("string")).alias("f4"),
        *[make().cast("double").alias(f"f{i}") for i, make in p.custom.items()],
    )
    return pairs.join(own, "eid", "left").join(text, ["qid", "eid"], "left").select(*pairs.columns, *[f"f{i}" for i in p.ids])


def min_max(features: DataFrame, ids: list[int]) -> DataFrame:
    """Each feature scaled to 0..1 within its query; a constant one becomes 0, null stays null.

    Least and largest values are aggregated, so a query with very many documents is no group of one task.
    """
    features = materialise(features)
    ends = features.groupBy(F.col("qid").alias("_q")).agg(*[f(f"f{i}").alias(f"_{n}{i}") for i in ids for n, f in (("lo", F.min), ("hi", F.max))])
    ends = F.broadcast(ends) if ends.limit(MOST_TERMS + 1).count() <= MOST_TERMS else ends
    met = features.join(ends, F.col("qid").eqNullSafe(F.col("_q")))
    out = []
    for i in ids:
        c, lo, hi = F.col(f"f{i}"), F.col(f"_lo{i}"), F.col(f"_hi{i}")
        out.append(F.when(c.isNull(), None).when(hi > lo, (c - lo) / (hi - lo)).otherwise(0.0).alias(f"f{i}"))
    return met.select(*[c for c in features.columns if c not in {f"f{i}" for i in ids}], *out)


def feature_lines(features: DataFrame, ids: list[int], fill_missing: bool = True) -> DataFrame:
    """(qid, value): lines `label qid:q i:v .. # eid`, values with nine decimals; missing features are 0.0 or left out."""
    value = lambda i: F.coalesce(F.col(f"f{i}"), F.lit(0.0)) if fill_missing else F.col(f"f{i}")
    cells = [F.when(value(i).isNotNull(), F.format_string(f"{i}:%.9f", value(i))) for i in ids]
    return features.select("qid", F.concat_ws(" ", F.col("label").cast("string"), F.concat(F.lit("qid:"), "qid"), *cells, F.lit("#"), "eid").alias("value"))


@dataclass(frozen=True)
class LinearRanker:
    """Weights of features; score = their sum, missing features counting as 0."""

    ids: tuple[int, ...]
    weights: tuple[float, ...]

    def to_json(self) -> str:
        return json.dumps({"ids": self.ids, "weights": self.weights})

    @classmethod
    def from_json(cls, text: str) -> LinearRanker:
        read = json.loads(text)
        return cls(tuple(read["ids"]), tuple(read["weights"]))

    def score(self) -> Column:
        return sum((F.coalesce(F.col(f"f{i}"), F.lit(0.0)) * w for i, w in zip(self.ids, self.weights)), F.lit(0.0))


def _matrix(features: DataFrame, ids: list[int], most_rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Judged rows of whole queries in the order of a hash, as many as make at most `most_rows` rows."""
    sizes = features.groupBy("qid").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") <= most_rows)
    upto = F.sum("n").over(Window.partitionBy(F.lit(1)).orderBy(F.xxhash64("qid"), "qid").rowsBetween(Window.unboundedPreceding, 0))  # a row a query
    some = sizes.withColumn("upto", upto).filter(F.col("upto") <= most_rows).select("qid")
    rows = features.join(some, "qid", "left_semi").select("qid", "eid", "label", *[F.coalesce(f"f{i}", F.lit(0.0)).alias(f"f{i}") for i in ids]).orderBy("qid", "eid").toPandas()
    return rows["qid"].to_numpy(), rows["label"].to_numpy(float), rows[[f"f{i}" for i in ids]].to_numpy(float)


def _lost_pairs(s: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Sum of (better - worse) features over the pairs of a query that are ordered by less than 1, from sorted scores; no pair is formed."""
    out = np.zeros(x.shape[1])
    for label in np.unique(y)[1:]:
        hi, lo = np.flatnonzero(y == label), np.flatnonzero(y < label)
        above = len(lo) - np.searchsorted(np.sort(s[lo]), s[hi] - 1, side="right")  # worse ones that come too near to each better one
        below = np.searchsorted(np.sort(s[hi]), s[lo] + 1, side="left")
        out += above @ x[hi] - below @ x[lo]
    return out


#: Rows of a query from which its pairs are counted from sorted scores and not listed, and rows of a block of whole queries.
LISTED_ROWS, BLOCK_ROWS = 32, 50_000
#: Most bytes of blocks that the driver trains on itself; beyond them each step is a job over all of them.
HELD_BYTES = 96_000_000


def _packed(qid: np.ndarray, y: np.ndarray, x: np.ndarray) -> dict[str, bytes] | None:
    """Whole queries, sorted by qid: their features and labels, the listed (better, worse) pairs of small queries and the (start, end) of large ones. Queries of one label have no pair."""
    cut = np.r_[0, np.flatnonzero(qid[1:] != qid[:-1]) + 1, len(qid)] if len(qid) else np.zeros(1, np.int64)
    hi, lo, large, keep, at = [], [], [], [], 0
    for start, end in zip(cut[:-1], cut[1:]):
        own = y[start:end]
        if own.min() == own.max():
            continue
        if end - start <= LISTED_ROWS:
            i, j = np.nonzero(own[:, None] > own[None, :])
            hi.append(i + at)
            lo.append(j + at)
        else:
            large.append((at, at + end - start))
        keep.append(np.arange(start, end))
        at += end - start
    if not keep:
        return None
    rows, none = np.concatenate(keep), [np.zeros(0, np.int64)]
    parts = {"x": x[rows].astype(np.float64), "y": y[rows].astype(np.float64), "hi": np.concatenate(hi or none).astype(np.int32), "lo": np.concatenate(lo or none).astype(np.int32), "large": np.array(large, np.int32)}
    return {k: v.tobytes() for k, v in parts.items()}


def _unpacked(row: dict, width: int) -> tuple[np.ndarray, ...]:
    of = lambda k, kind: np.frombuffer(row[k], kind)
    return of("x", np.float64).reshape(-1, width), of("y", np.float64), of("hi", np.int32), of("lo", np.int32), of("large", np.int32).reshape(-1, 2)


def _pairs(y: np.ndarray, hi: np.ndarray, large: np.ndarray) -> int:
    """Pairs of a block."""
    return len(hi) + sum(int(n * below) for a, b in large for n, below in _steps(np.unique(y[a:b], return_counts=True)[1]))


def _steps(counts: np.ndarray) -> zip:
    """Of labels in ascending order: how many rows have each and how many a lower one."""
    return zip(counts, np.cumsum(counts) - counts)


def _lost(w: np.ndarray, x: np.ndarray, y: np.ndarray, hi: np.ndarray, lo: np.ndarray, large: np.ndarray) -> np.ndarray:
    """Sum of (better - worse) features over a block's pairs that the weights order by less than 1."""
    s = x @ w
    near = s[lo] > s[hi] - 1
    counts = np.bincount(hi[near], minlength=len(s)) - np.bincount(lo[near], minlength=len(s))
    return counts @ x + sum((_lost_pairs(s[a:b], y[a:b], x[a:b]) for a, b in large), np.zeros(len(w)))


def _blocks(features: DataFrame, ids: list[int]) -> DataFrame:
    """All judged rows, packed into blocks of whole queries."""
    names = [f"f{i}" for i in ids]

    def pack(batches):
        held, rows = [], 0

        def out(table: pa.Table):
            qid = table["qid"].to_pandas().to_numpy()
            block = _packed(qid, table["label"].to_numpy().astype(float), np.column_stack([table[n].to_numpy() for n in names]))
            if block:
                yield pa.RecordBatch.from_pylist([block], pa.schema([(k, pa.binary()) for k in BLOCK]))

        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= BLOCK_ROWS:
                table = pa.Table.from_batches(held)
                whole = pc.index(table["qid"], table["qid"][-1]).as_py()  # the last query may go on
                if whole:
                    yield from out(table.slice(0, whole))
                    table = table.slice(whole)
                held, rows = table.to_batches(), table.num_rows
        if rows:
            yield from out(pa.Table.from_batches(held))

    judged = features.filter(F.col("qid").isNotNull() & F.col("label").isNotNull()).select("qid", "eid", F.col("label").cast("double").alias("label"), *[F.coalesce(F.col(n).cast("double"), F.lit(0.0)).alias(n) for n in names])
    return judged.repartition("qid").sortWithinPartitions("qid", "eid").mapInArrow(pack, ", ".join(f"{k} binary" for k in BLOCK))


BLOCK = ("x", "y", "hi", "lo", "large")


def fit_pairwise(features: DataFrame, ids: list[int], c: float = 0.001, steps: int = 300, held: int = HELD_BYTES) -> LinearRanker:
    """Hinge loss over all pairs of differently judged documents of a query, over every judged row.

    The rows become blocks of whole queries. Up to `held` bytes of blocks come to the driver; more stay where they are written and each step is a job that sums over them.
    """
    blocks, width = materialise(_blocks(features, ids)), len(ids)
    size = blocks.agg(F.sum(sum((F.length(k) for k in BLOCK), F.lit(0)))).first()[0] or 0
    mine = [_unpacked(r.asDict(), width) for r in blocks.toLocalIterator()] if size <= held else None

    def over(f: Callable[..., np.ndarray]) -> np.ndarray:
        """The sum of f over all blocks."""
        if mine is not None:
            return sum((f(*b) for b in mine), np.zeros(1))

        def partial(batches):
            for batch in batches:
                for row in batch.to_pylist():
                    yield pa.RecordBatch.from_pydict({"v": pa.array([np.atleast_1d(f(*_unpacked(row, width))).astype(float).tolist()], pa.list_(pa.float64()))})

        got = [r["v"] for r in blocks.mapInArrow(partial, "v array<double>").collect()]
        return np.array([math.fsum(v) for v in zip(*got)])  # in any order of blocks the same

    pairs = over(lambda x, y, hi, lo, large: np.array([_pairs(y, hi, large)], float))[0] if size else 0
    w = np.zeros(width)
    for t in range(steps if pairs else 0):
        w = w - (0.5 / (1 + 0.05 * t)) * (c * w - over(lambda *b, w=w: _lost(w, *b)) / pairs)
    return LinearRanker(tuple(ids), tuple(map(float, w)))


def average_precision(qid: np.ndarray, y: np.ndarray, s: np.ndarray) -> float:
    out = []
    for q in np.unique(qid):
        m = np.flatnonzero(qid == q)
        r = y[m][np.argsort(-s[m], kind="stable")] > 0
        if r.any():
            out.append((np.cumsum(r)[r] / (np.flatnonzero(r) + 1)).mean())
    return float(np.mean(out)) if out else 0.0


def fit_coordinate_ascent(features: DataFrame, ids: list[int], rounds: int = 3, most_rows: int = 20_000) -> LinearRanker:
    """Weights changed one at a time as long as mean average precision grows, on at most `most_rows` judged rows."""
    qid, y, x = _matrix(features, ids, most_rows)
    w = np.full(len(ids), 1.0 / max(1, len(ids)))
    best = average_precision(qid, y, x @ w) if len(y) else 0.0
    for _ in range(rounds if len(y) else 0):
        for j in range(len(ids)):
            for step in (-1.0, -0.3, -0.1, -0.03, 0.03, 0.1, 0.3, 1.0):
                v = w.copy()
                v[j] += step
                got = average_precision(qid, y, x @ v)
                if got > best + 1e-12:
                    best, w = got, v
    return LinearRanker(tuple(ids), tuple(map(float, w)))


def rerank(rankings: DataFrame, features: DataFrame, model: LinearRanker, depth: int) -> DataFrame:
    """(qid, rank, eid, score): head by model score, ties by the old rank, then unscored head documents, then the tail.

    What follows the scored head keeps its order; its scores are lowered by as much as brings the first of them 0.1 below the head's last, or not at all if it is.
    """
    scored = features.select("qid", "eid", F.round(model.score(), 9).alias("new"))
    head = rankings.filter(F.col("rank") <= depth).join(scored, ["qid", "eid"], "left")
    tail = rankings.filter(F.col("rank") > depth).withColumn("new", F.lit(None).cast("double"))
    part = F.when(F.col("rank") > depth, 2).when(F.col("new").isNull(), 1).otherwise(0)
    both = head.unionByName(tail.select(*head.columns)).withColumn("part", part)
    w = Window.partitionBy("qid").orderBy("part", F.desc_nulls_last("new"), "rank")
    low = both.groupBy("qid").agg(F.min("new").alias("low"), F.max(F.when(F.col("new").isNull(), F.col("score"))).alias("high"))
    shift = F.greatest(F.lit(0.0), F.coalesce(F.col("high") + 0.1 - F.col("low"), F.lit(0.0)))
    out = both.withColumn("new_rank", F.row_number().over(w)).join(low, "qid")
    return out.select("qid", F.col("new_rank").alias("rank"), "eid", F.coalesce("new", F.col("score") - shift).alias("score"))
