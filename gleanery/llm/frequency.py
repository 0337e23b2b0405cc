"""Occurrences and records of every distinct value, term or n-gram, by suffix arrays over blocks of records."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.operators.scale import materialise

#: A term is a maximal run of letters or digits.
TERM = re.compile(r"[^\W_]+")
#: Values are separated by one of these and trimmed of WHITESPACE.
SEPARATORS = re.compile(r"[,;|]")
WHITESPACE = " \t\r\n"


def terms_of(text: str) -> list[str]:
    """Lower-cased terms; runs are found first, as the lower case of a letter may hold a sign that is none."""
    return [t.lower() for t in TERM.findall(text)] if "İ" in text else TERM.findall(text.lower())


def values_of(text: str) -> list[str]:
    return [v for x in SEPARATORS.split(text) if (v := x.strip(WHITESPACE).lower())]


def suffix_array(tokens: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes in order, longest common prefix of each with the one before), by prefix doubling; left: tokens from each place to its record's end.

    A suffix ends with its record; one that is the start of another comes before it, equal ones stay in the order of their places. Each round sorts only those
    that still tie by the ranks of what follows, and keeps its ranks: two suffixes that tie there agree so far, which gives the common prefixes by halving.
    """
    size = len(tokens)
    order = np.argsort(tokens, kind="stable")
    start = np.r_[True, tokens[order][1:] != tokens[order][:-1]]
    rank = np.empty(size, np.int64)
    rank[order] = np.maximum.accumulate(np.where(start, np.arange(size), 0))
    levels, reach = [rank.astype(np.int32)], 1
    while True:
        # ties of suffixes that go on beyond what is compared
        end = np.r_[start[1:], True]
        place = np.flatnonzero(~(start & end))
        tied = order[place]
        after = left[tied] > reach
        if not after.any():
            break
        follow = np.zeros(len(tied), np.int64)
        follow[after] = rank[tied[after] + reach] + 1
        key = rank[tied] * (size + 1) + follow
        sort = np.argsort(key, kind="stable")
        tied, key = tied[sort], key[sort]
        order[place] = tied
        first = np.r_[True, key[1:] != key[:-1]] if len(key) else np.zeros(0, bool)
        start[place] |= first
        rank = rank.copy()
        rank[tied] = np.maximum.accumulate(np.where(first, place, 0))
        levels.append(rank.astype(np.int32))
        reach *= 2
    a, b, lcp = order[:-1].copy(), order[1:].copy(), np.zeros(size, np.int64)
    open_ = np.arange(size - 1)
    for k in range(len(levels) - 1, -1, -1):
        same = levels[k][a] == levels[k][b]
        step = np.minimum(1 << k, left[a[same]])
        lcp[open_[same] + 1] += step
        a[same] += step
        b[same] += step
        # whoever has come to the end of its record is done
        done = np.zeros(len(a), bool)
        done[same] = (left[a[same] - step] == step) | (left[b[same] - step] == step)
        a, b, open_ = a[~done], b[~done], open_[~done]
    return order, lcp


def least_between(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The least of values[lo + 1 .. hi] for each pair, lo < hi, from minima over stretches of powers of two."""
    out = np.zeros(len(lo), values.dtype)
    width = hi - lo
    table, span = values, 1
    while len(lo) and span <= width.max():
        here = (width >= span) & (width < 2 * span)
        out[here] = np.minimum(table[lo[here] + 1], table[hi[here] - span + 1])
        if 2 * span <= len(values):
            table = np.minimum(table[:-span], table[span:])
        span *= 2
    return out


def interval_counts(tokens: np.ndarray, record: np.ndarray, max_n: int | None) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For n = 1..max_n (None: as long as there are any): (n, a start of each distinct n-gram, its occurrences, its records).

    Suffixes next to each other in the suffix array that share n tokens form an interval, which is an n-gram, and its width is the number of occurrences. Neighbours of one
    record in the array whose common prefix is the least between them, and at least n, are one occurrence too many for the number of records.
    """
    size = len(tokens)
    if not size:
        return
    last = np.flatnonzero(np.r_[record[1:] != record[:-1], True])
    left = np.repeat(last, np.diff(np.r_[-1, last])) - np.arange(size) + 1
    order, lcp = suffix_array(tokens, left)
    of = record[order]
    by_record = np.argsort(of, kind="stable")
    again = of[by_record[1:]] == of[by_record[:-1]]
    lo, hi = by_record[:-1][again], by_record[1:][again]
    shared = least_between(lcp, lo, hi)
    n = 1
    while max_n is None or n <= max_n:
        usable = np.flatnonzero(left[order] >= n)
        if not len(usable):
            return
        new = lcp[usable] < n
        new[0] = True
        starts = np.flatnonzero(new)
        count = np.diff(np.r_[starts, len(usable)])
        hi, shared = hi[shared >= n], shared[shared >= n]
        interval = np.zeros(size, np.int64)
        interval[usable] = np.cumsum(new) - 1
        yield n, order[usable[starts]], count, count - np.bincount(interval[hi], minlength=len(starts))
        n += 1


def _blocks(split: str, max_n: int | None, block: int):
    cut = terms_of if split == "terms" else values_of

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary: dict[str, int] = {}
        ids: list[int] = []
        lengths: list[int] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if not lengths:
                return
            names, tokens = np.array(list(vocabulary), object), np.array(ids, np.int64)
            record = np.repeat(np.arange(len(lengths)), lengths)
            yield pa.RecordBatch.from_arrays([pa.array([""]), pa.array([0], pa.int32()), pa.array([len(ids)]), pa.array([len(lengths)])], names=["term", "n", "occurrences", "records"])
            for n, at, count, records in interval_counts(tokens, record, max_n):
                grams = names[tokens[at]]
                for d in range(1, n):
                    grams = grams + " " + names[tokens[at + d]]
                yield pa.RecordBatch.from_arrays([pa.array(grams, pa.string()), pa.array(np.full(len(at), n, np.int32)), pa.array(count), pa.array(records)], names=["term", "n", "occurrences", "records"])
            vocabulary.clear()
            ids.clear()
            lengths.clear()

        for batch in batches:
            for text in batch.column(0):
                if (found := text.as_py()) and (found := cut(found)):
                    ids.extend([vocabulary.setdefault(t, len(vocabulary)) for t in found])
                    lengths.append(len(found))
                    if len(ids) >= block:
                        yield from flush()
        yield from flush()

    return run


def frequencies(
    records: DataFrame, text_col: str, split: str = "terms", max_n: int | None = 1,
    rare_records: int = 1, common_share: float = 0.2, block: int = 500_000,
) -> DataFrame:
    """How often every term occurs and in how many records: (term, n, occurrences, records, rare, common).

    Each row of `records` is one record. split="terms": maximal runs of letters or digits; "values": pieces
    between `,` `;` `|`, trimmed; both lower-cased, empty ones dropped. All n-grams of up to max_n
    neighbouring terms count, or of any number with None, n telling their length. rare: in at most `rare_records` records; common: in more than `common_share` of the
    records with any term. Null and empty texts hold no term; an empty table gives an empty result.

    Records are taken in blocks of about `block` tokens; each block's suffix array (of whole suffixes, whatever max_n is) gives exact counts of its n-grams, and as no record
    spans two blocks, the sums over blocks are exact too. So each term leaves a block once, however frequent it is.
    """
    counted = records.select(F.col(text_col).cast("string").alias("t")).filter(F.length("t") > 0)
    part = counted.mapInArrow(_blocks(split, max_n, block), "term string, n int, occurrences long, records long")
    summed = materialise(part.groupBy("term", "n").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records")))
    total = F.broadcast(summed.filter(F.col("n") == 0).select(F.lit(True).alias("any"), F.col("records").alias("all_records")))  # one row
    out = summed.filter(F.col("n") > 0).withColumn("any", F.lit(True)).join(total, "any")
    millionths = round(common_share * 1_000_000)
    common = F.col("records") * 1_000_000 > F.col("all_records") * millionths
    return out.select("term", "n", "occurrences", "records", (F.col("records") <= rare_records).alias("rare"), common.alias("common"))


def marks(counts: DataFrame) -> DataFrame:
    """(term, mark) of the rare and common ones; in tiny collections a term may be both."""
    both = F.array(F.when(F.col("rare"), "rare"), F.when(F.col("common"), "common"))
    return counts.select("term", F.explode(F.array_compact(both)).alias("mark"))
