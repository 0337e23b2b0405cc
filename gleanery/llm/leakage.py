"""Test passages in a training corpus: n-gram seeds find candidates, Smith-Waterman alignment decides."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.operators.scale import heavy_limit, materialise

WORD = re.compile(r"[^\W_]+")
MARKUP = re.compile(r"<[^<>]{1,200}>")
#: Alignment, in thousandths: a word met, a word altered, and gaps by their opening and by each word.
MATCH, MISMATCH, GAP_OPEN, GAP_DOC, GAP_ITEM = 1000, -600, 1500, 20, 150
#: Scores are packed above this many bits, the number of words met below.
BITS = 20


def words_of(text: str) -> list[str]:
    return WORD.findall(MARKUP.sub(" ", text).lower() if "<" in text else text.lower())


@dataclass
class Items:
    """A block of test items as numbers: words from 1 on, seeds as sorted keys, and for each seed the items that have it."""

    ids: list
    words: list[np.ndarray]
    vocabulary: dict[str, int]
    seeds: np.ndarray
    owner_at: np.ndarray
    owners: np.ndarray
    n: int

    @classmethod
    def of(cls, rows: list[tuple], n: int) -> Items:
        vocabulary: dict[str, int] = {}
        ids, words, pairs = [], [], []
        for key, text in rows:
            found = words_of(text or "")
            if found:
                words.append(np.array([vocabulary.setdefault(w, len(vocabulary) + 1) for w in found], np.int64))
                ids.append(key)
        base = len(vocabulary) + 1
        for i, w in enumerate(words):
            pairs.append(np.stack([keys(w, n, base), np.full(max(0, len(w) - n + 1), i)], axis=1))
        both = np.unique(np.concatenate(pairs), axis=0) if pairs else np.zeros((0, 2), np.int64)
        seeds, at = np.unique(both[:, 0], return_index=True)
        return cls(ids, words, vocabulary, seeds, np.r_[at, len(both)], both[:, 1], n)


def keys(words: np.ndarray, n: int, base: int) -> np.ndarray:
    """The key of the n words from each place on."""
    if len(words) < n:
        return np.zeros(0, np.int64)
    out = np.zeros(len(words) - n + 1, np.int64)
    for d in range(n):
        out = out * base + words[d : len(words) - n + 1 + d]
    return out


def hits(texts: list[str | None], items: Items) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(all texts' words with n zeros after each, where each text starts, places of seeds, their numbers)."""
    known, end = items.vocabulary.get, [0] * items.n
    flat: list[int] = []
    starts = np.zeros(len(texts) + 1, np.int64)
    for i, t in enumerate(texts):
        if t:
            flat += [known(w, 0) for w in words_of(t)]
        flat += end
        starts[i + 1] = len(flat)
    words = np.array(flat, np.int64)
    key = keys(words, items.n, len(items.vocabulary) + 1)
    if not len(items.seeds) or not len(key):
        return words, starts, np.zeros(0, np.int64), np.zeros(0, np.int64)
    place = np.searchsorted(items.seeds, key)
    place[place == len(items.seeds)] = 0
    at = np.flatnonzero(items.seeds[place] == key)
    return words, starts, at, place[at]


def align(items: list[np.ndarray], docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(scores, words met) of the best local alignment with affine gaps of each pair; one row of all pairs' matrices at a time."""
    width, rows = max(map(len, docs)), max(map(len, items))
    doc = np.full((len(docs), width), -1, np.int32)
    item = np.full((len(items), rows), -2, np.int32)  # what pads one never meets what pads the other
    for k, (i, d) in enumerate(zip(items, docs)):
        item[k, : len(i)], doc[k, : len(d)] = i, d
    one = np.int64(1) << BITS
    along = np.arange(width, dtype=np.int64) * (GAP_DOC * one)
    h = np.zeros((len(docs), width + 1), np.int64)
    f = np.full((len(docs), width), -(np.int64(1) << 50))
    best = np.zeros(len(docs), np.int64)
    for r in range(rows):
        row = np.where(doc == item[:, r : r + 1], MATCH * one + 1, MISMATCH * one)
        row += h[:, :-1]
        np.maximum(f, h[:, 1:] - GAP_OPEN * one, out=f)
        f -= GAP_ITEM * one
        np.maximum(row, f, out=row)
        np.maximum(row, 0, out=row)
        np.maximum(best, row.max(axis=1), out=best)
        gap = np.maximum.accumulate(row + along, axis=1)
        gap -= along + GAP_OPEN * one
        np.maximum(row, gap, out=h[:, 1:])
    return (best >> BITS) / MATCH, best & (one - 1)


def align_all(items: list[np.ndarray], docs: list[np.ndarray], cells: int = 40_000) -> tuple[np.ndarray, np.ndarray]:
    """align() over batches of pairs of like width."""
    score, met = np.zeros(len(docs)), np.zeros(len(docs), np.int64)
    order = sorted(range(len(docs)), key=lambda k: (len(docs[k]), len(items[k])))
    while order:
        widest = len(docs[order[-1]])
        take = max(1, min(len(order), cells // max(1, widest)))
        part, order = order[-take:], order[:-take]
        score[part], met[part] = align([items[k] for k in part], [docs[k] for k in part])
    return score, met


def seeds_needed(words: int, n: int, least_hits: int) -> int:
    """Places of seeds from which an item of so many words is looked for in a document."""
    return max(1, min(least_hits, max(1, words // 2 - n)))


def finder(items: Items, least_hits: int, least_share: float, slack: int, most: int = 2_000_000):
    """A function of texts that gives (text's number, item's number, share, score) of all that are found."""
    count = len(items.ids)
    enough = np.array([seeds_needed(len(w), items.n, least_hits) for w in items.words], np.int64)
    owners_of = np.diff(items.owner_at)

    def found(texts: list[str | None]) -> Iterator[tuple[int, int, float, float]]:
        words, starts, place, seed = hits(texts, items)
        owner = np.searchsorted(starts, place, side="right") - 1
        # documents at a time whose seeds meet about `most` items, however common the seeds are
        group = np.cumsum(owners_of[seed]) // most
        group = group[np.searchsorted(owner, owner)] if len(owner) else group
        edges = np.flatnonzero(np.r_[True, np.diff(group) != 0, True]) if len(group) else np.zeros(0, int)
        for lo, hi in zip(edges, edges[1:]):
            yield from among(words, starts, owner[lo:hi], place[lo:hi], seed[lo:hi])

    def among(words: np.ndarray, starts: np.ndarray, owner: np.ndarray, place: np.ndarray, seed: np.ndarray) -> Iterator[tuple[int, int, float, float]]:
        times = owners_of[seed]
        inner = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        item = items.owners[np.repeat(items.owner_at[seed], times) + inner]
        pair, where = np.repeat(owner, times) * count + item, np.repeat(place, times)
        order = np.argsort(pair, kind="stable")
        pair, where = pair[order], where[order]
        cuts = np.flatnonzero(np.r_[True, np.diff(pair) != 0, True]) if len(pair) else np.zeros(1, int)
        a, b = cuts[:-1], cuts[1:]
        keep = b - a >= enough[pair[a] % count]
        tried: list[tuple[int, int]] = []
        spans: list[np.ndarray] = []
        for a, b in zip(a[keep], b[keep]):
            d, i = divmod(int(pair[a]), count)
            w = items.words[i]
            lo = max(starts[d], where[a] - len(w) - slack)
            span = words[lo : min(starts[d + 1] - items.n, where[b - 1] + len(w) + slack)]
            # no alignment meets more words than the span has of the item's
            if np.isin(w, span).sum() >= least_share * len(w):
                tried.append((d, i))
                spans.append(span)
        score, met = align_all([items.words[i] for _, i in tried], spans)
        yield from ((d, i, m / len(items.words[i]), s) for (d, i), m, s in zip(tried, met, score) if m >= least_share * len(items.words[i]))

    return found


def _rows(ids: pa.Array, texts: np.ndarray, items: list, shares: list, scores: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([ids.take(pa.array(texts)), pa.array(items, pa.int64()), pa.array(shares, pa.float64()), pa.array(scores, pa.float64())], names=["doc_id", "item_id", "share", "score"])


def _aligned(items: Items, least_hits: int, least_share: float, slack: int):
    """All documents against items that came along."""
    found = finder(items, least_hits, least_share, slack)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                rows = list(found(part.column(1).to_pylist()))
                yield _rows(part.column(0), np.array([r[0] for r in rows], np.int64), [items.ids[r[1]] for r in rows], [r[2] for r in rows], [r[3] for r in rows])

    return run


def _aligned_candidates(n: int, least_hits: int, least_share: float, slack: int):
    """Each document against the items listed with it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                wanted = [{x["item_id"]: x["text"] for x in row} for row in part.column(2).to_pylist()]
                items = Items.of(sorted({k: t for w in wanted for k, t in w.items()}.items()), n)
                rows = [r for r in finder(items, least_hits, least_share, slack)(part.column(1).to_pylist()) if items.ids[r[1]] in wanted[r[0]]]
                yield _rows(part.column(0), np.array([r[0] for r in rows], np.int64), [items.ids[r[1]] for r in rows], [r[2] for r in rows], [r[3] for r in rows])

    return run


def hashed_seeds(texts: list[str | None], n: int, known: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text's number, 64-bit hash of its n words, words of each text) for each place; known remembers words' hashes."""
    if len(known) > 500_000:
        known.clear()
    out, where, sizes = [], [], np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        found = words_of(t) if t else []
        sizes[i] = len(found)
        if len(found) < n:
            continue
        for w in found:
            if w not in known:
                known[w] = xxhash.xxh3_64_intdigest(w)
        h = np.array([known[w] for w in found], np.uint64)
        with np.errstate(over="ignore"):
            key = np.zeros(len(h) - n + 1, np.uint64)
            for d in range(n):
                key = (key ^ h[d : len(h) - n + 1 + d]) * np.uint64(0x9E3779B97F4A7C15)
                key ^= key >> np.uint64(29)
        out.append(key.astype(np.int64))
        where.append(np.full(len(key), i))
    return np.concatenate(where or [np.zeros(0, np.int64)]), np.concatenate(out or [np.zeros(0, np.int64)]), sizes


#: Bits of the filter of seeds: a fixed size, however many seeds there are.
FILTER_BITS = 1 << 27


def _places(seed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    u = seed.astype(np.uint64)
    return (u & np.uint64(FILTER_BITS - 1)).astype(np.int64), (u >> np.uint64(37)).astype(np.int64)


def _filter_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    for batch in batches:
        for place in _places(batch.column(0).to_numpy()):
            np.bitwise_or.at(bits, place >> 3, (1 << (place & 7)).astype(np.uint8))
    yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(bits.tobytes(), 1)], pa.binary())], names=["bits"])


def _item_seeds(n: int, least_hits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch in batches:
            at, seed, sizes = hashed_seeds(batch.column(1).to_pylist(), n, known)
            need = np.array([seeds_needed(int(w), n, least_hits) for w in sizes], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(seed), batch.column(0).take(pa.array(at)), pa.array(need[at])], names=["seed", "item_id", "need"])

    return run


def _doc_seeds(n: int, packed: bytes):
    """(doc_id, seed, places): the seeds of each document that pass the filter of the items' seeds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, known = np.frombuffer(zlib.decompress(packed), np.uint8), {}
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                at, seed, _ = hashed_seeds(part.column(1).to_pylist(), n, known)
                keep = np.ones(len(seed), bool)
                for place in _places(seed):
                    keep &= (bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1
                both, times = np.unique(np.stack([at[keep], seed[keep]], axis=1), axis=0, return_counts=True)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(both[:, 0])), pa.array(both[:, 1]), pa.array(times)], names=["doc_id", "seed", "places"])

    return run


def _joined(docs: DataFrame, items: DataFrame, n: int, least_hits: int, least_share: float, slack: int) -> DataFrame:
    """Candidates by a join of seeds, for any number of items: the corpus is read twice, and only seeds that may be an item's, and texts with candidates, are shuffled."""
    seeds = materialise(items.mapInArrow(_item_seeds(n, least_hits), "seed long, item_id long, need long").distinct())
    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in seeds.select("seed").coalesce(4).mapInArrow(_filter_part, "bits binary").toLocalIterator():  # at most 4 rows of a fixed size
        bits |= np.frombuffer(zlib.decompress(r["bits"]), np.uint8)
    hits = docs.mapInArrow(_doc_seeds(n, zlib.compress(bits.tobytes(), 1)), "doc_id long, seed long, places long")
    # a seed of very many documents is met where their rows lie
    hits = materialise(hits)
    often = hits.groupBy("seed").agg(F.count(F.lit(1)).alias("docs")).join(seeds.select("seed").distinct(), "seed")
    hot = F.broadcast(often.filter(F.col("docs") > heavy_limit(hits.count(), docs.sparkSession)).select("seed"))  # a multiple of the number of tasks at most
    met = hits.join(F.broadcast(seeds.join(hot, "seed")), "seed").unionByName(hits.join(hot, "seed", "left_anti").join(seeds.join(hot, "seed", "left_anti"), "seed"))
    pairs = met.groupBy("doc_id", "item_id", "need").agg(F.sum("places").alias("places")).filter(F.col("places") >= F.col("need"))
    # a document of very many items comes in several rows
    listed = pairs.join(items, "item_id").groupBy("doc_id", F.pmod(F.xxhash64("item_id"), F.lit(64)).alias("salt")).agg(F.collect_list(F.struct("item_id", "text")).alias("items"))
    found = docs.join(listed, "doc_id").select("doc_id", "text", "items")
    return found.mapInArrow(_aligned_candidates(n, least_hits, least_share, slack), "doc_id long, item_id long, share double, score double")


def leaked_items(
    corpus: DataFrame, doc_id: str, text: str, tests: DataFrame, item_id: str, item_text: str, n: int = 3,
    least_share: float = 0.5, least_hits: int = 2, slack: int = 40, block_words: int = 1_000_000,
) -> DataFrame:
    """Documents that hold at least `least_share` of a test item's words, in one place and in order: (doc_id, item_id, share, score).

    Case, punctuation and markup are set aside. Seeds are the items' runs of n words, however common: documents with at least `least_hits` seeds
    of an item (fewer for very short items) are aligned with it by Smith-Waterman with affine gaps, in which altered words and a sentence put in between
    cost little, unless they lack too many of the item's words; share is the part of the item's words met by the best alignment, scanned from the first seed
    to the last and a margin.

    Up to `block_words` words of items travel to the tasks; then the corpus is read once and never shuffled. Beyond that, seeds of documents meet seeds of items by a join
    behind a filter of fixed size, and documents with candidates meet the items' texts, so any number of items costs two readings. Both ways give the same rows.
    Rows with a null id or text hold nothing; repeated ids give repeated rows. Ids are whole numbers.
    """
    docs = corpus.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    wanted = tests.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).cast("string").alias("text")).filter(F.col("item_id").isNotNull() & F.col("text").isNotNull()).distinct()
    total = wanted.agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0] or 0
    if total > block_words:
        return _joined(docs, wanted, n, least_hits, least_share, slack)
    items = Items.of([(r["item_id"], r["text"]) for r in wanted.collect()], n)
    return docs.mapInArrow(_aligned(items, least_hits, least_share, slack), "doc_id long, item_id long, share double, score double")
