"""Dense retrieval by exact dot products of a query set in blocks against all vectors."""

from __future__ import annotations

import ctypes
import glob
import os
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.operators.scale import materialise
from gleanery.operators.topn import top_by_score


@cache
def one_thread() -> None:
    """Gives the linear algebra of this worker one thread: the tasks share the cores already, and waiting threads burn them."""
    for path in glob.glob(os.path.join(os.path.dirname(np.__file__), "..", "numpy.libs", "*openblas*")):
        library = ctypes.CDLL(path)
        for name in ("scipy_openblas_set_num_threads64_", "openblas_set_num_threads64_", "openblas_set_num_threads"):
            if hasattr(library, name):
                getattr(library, name)(1)


def dot(a: Column, b: Column) -> Column:
    """Dot product of two arrays as doubles, in order."""
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def encode(load: Callable[[], Callable[[list[str]], np.ndarray]], batch: int = 16) -> Callable[[Column], Column]:
    """A text encoder as an Arrow UDF; load() is called once a worker task."""

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in parts:
            yield pd.Series([v for at in range(0, len(texts), batch) for v in model(list(texts[at : at + batch])).astype("float32").tolist()])

    return run


def _search(ids: list, matrix: np.ndarray, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_thread()
        names = np.array(ids, object)
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, matrix.shape[1])
                eid = np.array(batch.column(0).to_pylist(), object)
                s = np.round(matrix @ x.T, 9)
                # of those that tie with the k-th the lower ids stay
                m = min(k, s.shape[1])
                floor = np.partition(s, s.shape[1] - m, axis=1)[:, s.shape[1] - m]
                q, d = np.nonzero(s >= floor[:, None])
                place = np.argsort(np.argsort(eid, kind="stable"), kind="stable")
                order = np.lexsort((place[d], -s[q, d], q))
                q, d = q[order], d[order]
                nth = np.arange(len(q)) - np.searchsorted(q, q)
                q, d = q[nth < m], d[nth < m]
                yield pa.RecordBatch.from_arrays([pa.array(names[q], pa.string()), pa.array(eid[d], pa.string()), pa.array(s[q, d])], names=["qid", "eid", "score"])

    return run


def dense_topk(queries: DataFrame, vectors: DataFrame, k: int, dim: int, block: int = 2000) -> DataFrame:
    """(qid, rank, eid, score): the k vectors of largest dot product with each query, ties by eid.

    queries (qid, query_vector) and vectors (eid, embedding); vectors of another length, null or with a value that is no finite number
    take no part. Queries go to the tasks in blocks of `block`, so memory stays bounded; each block reads the vectors once.
    """
    good = lambda c: (F.size(c) == dim) & F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    asked = queries.filter(good("query_vector")).select(F.col("qid").cast("string").alias("qid"), "query_vector").groupBy("qid").agg(F.min("query_vector").alias("v"))
    known = vectors.filter(F.col("eid").isNotNull() & good("embedding")).select(F.col("eid").cast("string").alias("eid"), "embedding")
    asked = materialise(asked)
    blocks = max(1, -(-asked.count() // block))
    parts = []
    for b in range(blocks):
        rows = asked.filter(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == b).collect()
        if rows:
            matrix = np.array([r["v"] for r in rows], np.float64)
            found = known.mapInArrow(_search([r["qid"] for r in rows], matrix, k), "qid string, eid string, score double")
            parts.append(top_by_score(found, "qid", "eid", "score", k).select("qid", "rank", "eid", "score"))
    out = parts[0] if parts else queries.sparkSession.createDataFrame([], "qid string, rank int, eid string, score double")
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
