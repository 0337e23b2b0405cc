"""Positional matching over position arrays: synonyms, ordered proximity and unordered windows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def near_walk(lists: list[list[int]], n: int) -> list[int]:
    """Positions of the last list where each list's element follows its predecessor's within n; every element serves once."""
    return walk("NEAR", n, [lists])[0]


def window_walk(lists: list[list[int]], n: int) -> list[int]:
    """Largest positions of groups, one element of each list, that span fewer than n; every element serves once."""
    return walk("WINDOW", n, [lists])[0]


def walk(kind: str, n: int, documents: list[list[list[int]]]) -> list[list[int]]:
    """matches() for lists of position lists, all of one number."""
    sizes = np.array([[len(x) for x in d] for d in documents], np.int64)
    ends = np.cumsum(sizes).reshape(sizes.shape)
    flat = np.array([p for d in documents for x in d for p in x], np.int64)
    doc, at = matches(kind, np.full(len(documents), n), flat, ends - sizes, ends)
    return [at[doc == i].tolist() for i in range(len(documents))]


def matches(kind: str, n: np.ndarray, flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, position) of every match; starts and ends say where each document's k lists lie in `flat`.

    All documents step together: each step moves one pointer of each document that is not done, or records its match and moves all, so the
    number of steps is that of the positions in the longest document.
    """
    at, k = starts.copy(), starts.shape[1]
    live = np.flatnonzero((at < ends).all(axis=1))
    docs, found = [], []
    while len(live):
        here = flat[at[live]]
        if kind == "NEAR":
            gap = np.diff(here, axis=1)
            wrong = (gap <= 0) | (gap > n[live, None])
            bad = wrong.any(axis=1)
            first = wrong.argmax(axis=1) if k > 1 else np.zeros(len(live), np.int64)
            # a follower that does not come after its predecessor moves on, else the predecessor that is too far behind
            move = first + (gap[np.arange(len(live)), first] <= 0) if k > 1 else first
            last = here[:, -1]
        else:
            last = here.max(axis=1)
            bad = last - here.min(axis=1) >= n[live]
            move = here.argmin(axis=1)
        met = live[~bad]
        docs.append(met)
        found.append(last[~bad])
        at[met] += 1
        at[live[bad], move[bad]] += 1
        live = live[(at[live] < ends[live]).all(axis=1)]
    if not docs:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    doc, position = np.concatenate(docs), np.concatenate(found)
    order = np.argsort(doc, kind="stable")
    return doc[order], position[order]


def proximity(kind: Column, distance: Column, lists: Column) -> Column:
    """Matches of the position lists of each row by NEAR or WINDOW within its distance; any number of lists. Rows of another kind have none."""
    return F.arrow_udf(_proximity, "array<int>")(kind, distance, lists)


def _proximity(kind: pa.Array, distance: pa.Array, lists: pa.Array) -> pa.Array:
    kinds, far = np.array(kind.to_pylist(), object), distance.to_numpy(zero_copy_only=False).astype(np.int64)
    k = lists.value_lengths().to_numpy(zero_copy_only=False)
    inner = lists.flatten()
    size = inner.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    end = np.cumsum(size)
    flat = inner.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    first = np.cumsum(k) - k
    docs, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for name in ("NEAR", "WINDOW"):
        for count in np.unique(k):
            rows = np.flatnonzero((kinds == name) & (k == count))
            if len(rows) and count:
                which = first[rows][:, None] + np.arange(count)
                doc, position = matches(name, far[rows], flat, end[which] - size[which], end[which])
                docs.append(rows[doc])
                found.append(position)
    doc, position = np.concatenate(docs), np.concatenate(found)
    order = np.argsort(doc, kind="stable")
    ends = np.r_[0, np.cumsum(np.bincount(doc, minlength=len(k)))]
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(position[order].astype(np.int32)))


def merged(lists: Column) -> Column:
    """Sorted distinct positions of several lists."""
    return F.array_sort(F.array_distinct(F.flatten(lists)))


def synonym(parts: list[DataFrame]) -> DataFrame:
    """(eid, positions) of documents with any of the lists; positions sorted and distinct."""
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    return union.groupBy("eid", "len").agg(merged(F.collect_list("positions")).alias("positions"))


def together(kind: str, parts: list[DataFrame], n: int) -> DataFrame:
    """(eid, len, positions) of documents where the lists meet by NEAR or WINDOW at least once."""
    joined = parts[0].select("eid", "len", F.col("positions").alias("p0"))
    for i, p in enumerate(parts[1:], 1):
        joined = joined.join(p.select("eid", F.col("positions").alias(f"p{i}")), "eid")
    found = proximity(F.lit(kind), F.lit(n), F.array(*[F.col(f"p{i}") for i in range(len(parts))]))
    return joined.select("eid", "len", found.alias("positions")).filter(F.size("positions") > 0)
