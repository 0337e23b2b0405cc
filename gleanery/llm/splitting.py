"""Cut oversized texts into overlapping pieces at natural boundaries by dynamic programming."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A boundary lies right after a line feed, and right after one of these marks if white space follows.
BOUNDARY = re.compile(r"\n|[.!?;|](?=[ \t\r\n])")
WORD_END = re.compile(r"[ \t\r\n]+")
#: What a cut costs by its kind, beside the squared difference of a piece from the even length, as a share of the limit.
PENALTY = {"line": 0.0, "sentence": 0.02, "word": 1.0, "inside": 4.0}


def cut_points(text: str, step: int) -> tuple[np.ndarray, np.ndarray, list[str], int]:
    """(positions with 0 and the end, penalties, kinds, longest stretch between boundaries); no gap exceeds step."""
    n = len(text)
    kinds = {m.end(): "line" if m.group() == "\n" else "sentence" for m in BOUNDARY.finditer(text)}
    at = sorted({0, n, *kinds})
    gaps = np.diff(at)
    longest = int(gaps.max()) if len(gaps) else 0
    if longest > step:
        for a, b in zip(at, at[1:]):
            if b - a > step:
                words = [a, *(m.end() for m in WORD_END.finditer(text, a, b) if m.end() < b), b]
                for w in words[1:-1]:
                    kinds.setdefault(w, "word")
                for x, y in zip(words, words[1:]):
                    if y - x > step:
                        for z in range(x + max(1, step // 16), y, max(1, step // 16)):
                            kinds.setdefault(z, "inside")
        at = sorted({0, n, *kinds})
    names = [kinds.get(p, "end") for p in at]
    names[-1] = "end"
    return np.array(at), np.array([PENALTY.get(k, 0.0) for k in names]), names, longest


def split_text(text: str, limit: int, overlap: int) -> tuple[list[tuple[int, int, str]], int]:
    """([(start, end, kind of the cut at the end)], longest stretch): the cheapest cuts with every piece within limit."""
    n, step = len(text), limit - overlap
    if n <= limit:
        return [(0, n, "end")], cut_points(text, limit)[3] if n else 0
    at, cost, names, longest = cut_points(text, step)
    pieces = 1 + -(-(n - limit) // step)
    even = (n + overlap * (pieces - 1)) / pieces
    best = np.full(len(at), np.inf)
    back = np.zeros(len(at), np.int64)
    first = (at >= max(1, overlap)) & (at <= limit)
    best[first] = cost[first] + ((at[first] - even) / limit) ** 2
    back[first] = 0
    low = 1
    lows = np.searchsorted(at, at - step)
    for i in range(int(np.searchsorted(at, max(1, overlap), side="right")), len(at)):
        low = max(1, int(lows[i]))
        if low >= i:
            continue
        total = best[low:i] + ((at[i] - at[low:i] + overlap - even) / limit) ** 2
        j = int(total.argmin())
        if total[j] + cost[i] < best[i]:
            best[i], back[i] = total[j] + cost[i], low + j
    ends, i = [], len(at) - 1
    while i > 0:
        ends.append(i)
        i = int(back[i])
    ends.reverse()
    return [(0 if k == 0 else int(at[ends[k - 1]]) - overlap, int(at[e]), names[e]) for k, e in enumerate(ends)], longest


def _split(limits: dict[str, tuple[int, int]], id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for key, field, text in zip(*(c.to_pylist() for c in batch.columns)):
                limit, overlap = limits[field]
                pieces, longest = split_text(text, limit, overlap)
                rows += [(key, field, k, a, b, kind, text[a:b], longest > limit) for k, (a, b, kind) in enumerate(pieces)]
            names = ["id", "field_name", "piece", "start", "end", "cut_kind", "text", "forced"]
            kinds = [batch.schema.field(0).type, pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows) if rows else [[]] * 8, kinds)], names=names)

    return run


def split_oversized(df: DataFrame, id_col: str, limits: dict[str, tuple[int, int]]) -> DataFrame:
    """Pieces of every text longer than its field's limit: (id, field_name, piece, start, end, cut_kind, text, forced).

    `limits` gives (limit, overlap) in characters for each text column. Each piece is at most limit characters long, and
    each but the first begins with the last overlap characters of the one before. Boundaries are ends of lines and of
    sentences; where two neighbouring ones are too far apart, ends of words and at last places within words serve too. The cuts minimise the
    sum of their penalties and of the pieces' squared differences from the even length. forced: some stretch between two boundaries (or an end) is
    longer than the limit. Null, empty and short texts give no piece; rows are independent, so repeated ids give repeated pieces.
    """
    for name, (limit, overlap) in limits.items():
        if not 0 <= overlap < limit:
            raise ValueError(f"{name}: 0 <= overlap < limit is needed")
    fields = [F.struct(F.lit(c).alias("field"), F.when(F.length(c) > limit, F.col(c)).alias("text")) for c, (limit, _) in limits.items()]
    long = df.select(F.col(id_col).alias("id"), F.explode(F.array(*fields)).alias("x")).select("id", "x.field", "x.text").filter(F.col("text").isNotNull())
    kind = df.schema[id_col].dataType.simpleString()
    return long.mapInArrow(_split(limits, None), f"id {kind}, field_name string, piece int, start long, end long, cut_kind string, text string, forced boolean")
