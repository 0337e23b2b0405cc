"""Languages of documents and of their passages: scripts narrow the candidates, Viterbi over words labels the spans."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Languages of each script: fixed values. Latin has the languages that are learnt.
SCRIPTS = {
    "el": "Ͱ-Ͽἀ-῿", "ru": "Ѐ-ԯ", "he": "֐-׿", "ar": "؀-ۿݐ-ݿ",
    "hi": "ऀ-ॿ", "th": "฀-๿", "ja": "぀-ヿ", "zh": "㐀-鿿", "ko": "가-힯ᄀ-ᇿ",
}
#: Scripts without spaces between words: each sign is a word.
SIGNS = "぀-ヿ㐀-鿿฀-๿"
WORD = re.compile(rf"[{SIGNS}]|[^\W\d_{SIGNS}]+")
FOREIGN = {code: re.compile(f"[{chars}]") for code, chars in SCRIPTS.items()}
OTHER_SCRIPT = re.compile("[" + "".join(SCRIPTS.values()) + "]")
#: Query operators with their arguments, one level of nesting, and links: no language.
SYNTAX = re.compile(r"#\w+(?:/\d+)?\s*\((?:[^()]|\([^()]*\))*\)|#\w+(?:/\d+)?|https?://\S+|<[^<>]{1,200}>")


def words_of(text: str) -> list[str]:
    return WORD.findall(SYNTAX.sub(" ", text) if "#" in text or "<" in text or "://" in text else text)


@dataclass
class Model:
    """Scores of words by language; words that were not seen get those of their letter groups, names none."""

    languages: list[str]
    words: dict[str, int]
    table: np.ndarray
    grams: dict[str, np.ndarray]
    cap: float
    cache: dict[str, int] = field(default_factory=dict)
    rows: list[np.ndarray] = field(default_factory=list)

    @property
    def states(self) -> list[str]:
        return [*self.languages, *[s for s in SCRIPTS if s not in self.languages]]

    def row(self, word: str) -> np.ndarray:
        states, low = self.states, word.lower()
        out = np.full(len(states), -self.cap, np.float32)
        if OTHER_SCRIPT.search(word):  # scripts first: a word of another script leaves only that script's language
            out[[i for i, s in enumerate(states) if s in FOREIGN and FOREIGN[s].search(word)]] = self.cap
            return out
        known = self.words.get(low)
        if known is not None:
            out[: len(self.languages)] = self.table[known]
            return out
        if word[0].isupper() or len(low) < 3:
            out[:] = 0
            return out
        total = np.zeros(len(self.languages), np.float32)
        for g in grams_of(low):
            total += self.grams.get(g, 0)
        out[: len(self.languages)] = np.clip(0.5 * total / max(1, len(low)) * 3, -self.cap / 2, self.cap / 2)
        return out

    def scores(self, words: list[str]) -> np.ndarray:
        if len(self.cache) > 300_000:  # names never end
            self.cache.clear()
            self.rows.clear()
        cache = self.cache
        ids = [cache.get(w, -1) for w in words]
        for i, k in enumerate(ids):
            if k < 0:
                w = words[i]
                if w not in cache:
                    cache[w] = len(self.rows)
                    self.rows.append(self.row(w))
                ids[i] = cache[w]
        return np.array(self.rows)[ids] if ids else np.zeros((0, len(self.states)), np.float32)


def grams_of(word: str) -> list[str]:
    w = f"^{word}$"
    return [w[i : i + 3] for i in range(len(w) - 2)]


def _table(counts: dict[str, Counter], languages: list[str], cap: float, least: int) -> tuple[dict[str, int], np.ndarray]:
    total = Counter()
    for c in counts.values():
        total.update(c)
    index = {w: i for i, w in enumerate(w for w, n in total.items() if n >= least)}
    p = np.zeros((len(index), len(languages)))
    for j, lang in enumerate(languages):
        size = max(1, sum(counts[lang].values()))
        for w, n in counts[lang].items():
            if w in index:
                p[index[w], j] = n / size
    p += 0.02 * p.sum(axis=1, keepdims=True) + 1e-9
    return index, np.clip(np.log(p / p.mean(axis=1, keepdims=True)), -cap, cap).astype(np.float32)


def train(rows: list[tuple[str, str]], languages: list[str], cap: float = 2.0) -> Model:
    """Fit on (language, text), on the words of no other script. Texts whose words speak against their label are left out in a second round."""
    texts = [(lang, Counter(w.lower() for w in words_of(t) if not OTHER_SCRIPT.search(w))) for lang, t in rows]
    kept = texts
    for _ in range(2):
        counts: dict[str, Counter] = defaultdict(Counter)
        for lang, c in kept:
            counts[lang].update(c)
        words, table = _table(counts, languages, cap, 2)
        kept = []
        for lang, c in texts:
            known = [(words[w], n) for w, n in c.items() if w in words]
            if known:
                i, n = np.array(known).T
                s = table[i] * n[:, None]
                best = s.sum(axis=0)
                if languages[int(best.argmax())] == lang and (table[i].argmax(axis=1) == best.argmax()) @ n >= 0.3 * n.sum():
                    kept.append((lang, c))
    counts = defaultdict(Counter)
    for lang, c in kept:
        counts[lang].update(c)
    words, table = _table(counts, languages, cap, 2)
    letters: dict[str, Counter] = defaultdict(Counter)
    for lang, c in counts.items():
        for w in c:
            letters[lang].update(grams_of(w))
    index, grams = _table(letters, languages, cap, 1)
    return Model(languages, words, table, {g: grams[i] for g, i in index.items()}, cap)


def viterbi(scores: np.ndarray, starts: np.ndarray, penalty: float) -> np.ndarray:
    """Best state of every word of many documents at once; each change of state costs the penalty."""
    lengths = np.diff(starts)
    order = np.argsort(-lengths, kind="stable")
    first, size = starts[:-1][order], lengths[order]
    longest = int(size[0]) if len(size) else 0
    states = scores.shape[1]
    back = np.zeros((len(scores), states), np.int8)
    value = np.zeros((len(size), states), np.float32)
    own = np.arange(states, dtype=np.int8)
    open_at = np.searchsorted(-size, -np.arange(longest), side="left")  # documents longer than t
    for t in range(longest):
        k = open_at[t]
        at = first[:k] + t
        if t:
            v = value[:k]
            best = v.max(axis=1, keepdims=True) - penalty
            stay = v >= best
            back[at] = np.where(stay, own, v.argmax(axis=1)[:, None])
            value[:k] = np.where(stay, v, best) + scores[at]
        else:
            value[:k] = scores[at]
    state = value.argmax(axis=1)
    path = np.zeros(len(scores), np.int8)
    for t in range(longest - 1, -1, -1):
        k = open_at[t]
        at = first[:k] + t
        path[at] = state[:k]
        if t:
            state[:k] = back[at, state[:k]]
    return path


def spans_of(path: np.ndarray, scores: np.ndarray, least: int) -> list[tuple[int, int, int, float]]:
    """(state, first word, end, confidence) of a document; spans under `least` words join their neighbour."""
    cuts = np.flatnonzero(np.r_[True, np.diff(path) != 0, True])
    spans = [[int(path[a]), int(a), int(b)] for a, b in zip(cuts, cuts[1:])]
    while len(spans) > 1 and min(b - a for _, a, b in spans) < least:
        i = min(range(len(spans)), key=lambda j: spans[j][2] - spans[j][1])
        left, right = (spans[i - 1] if i else None), (spans[i + 1] if i + 1 < len(spans) else None)
        if left and right and left[0] == right[0]:
            spans[i - 1 : i + 2] = [[left[0], left[1], right[2]]]
        elif left and (not right or left[2] - left[1] >= right[2] - right[1]):
            spans[i - 1 : i + 1] = [[left[0], left[1], spans[i][2]]]
        else:
            spans[i : i + 2] = [[right[0], spans[i][1], right[2]]]
    return [(s, a, b, confidence(scores[a:b])) for s, a, b in spans]


def confidence(scores: np.ndarray) -> float:
    """Share of the best state when the words' scores, tempered by the root of their number, are taken as log odds."""
    total = scores.sum(axis=0) / np.sqrt(max(1, len(scores)))
    p = np.exp(total - total.max())
    return float((1 / p.sum()).round(6))


def label_of(label: str | None, languages: list[str]) -> str | None:
    code = (label or "").strip()[:2].lower()
    return code if code in languages else None


SEGMENTS = "doc_id long, label string, label_state string, mixed boolean, segment int, start long, end long, lang string, words int, confidence double"


def _label(model: Model, penalty: float, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states = model.states
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                ids, labels, texts = (c.to_pylist() for c in part.columns)
                found = [words_of(t) if t else [] for t in texts]
                starts = np.r_[0, np.cumsum([len(w) for w in found])].astype(np.int64)
                scores = model.scores([w for ws in found for w in ws])
                path = viterbi(scores, starts, penalty)
                turns = np.zeros(len(path) + 1, bool)
                turns[1:-1] = path[1:] != path[:-1]
                turns[starts] = False
                many = np.add.reduceat(np.r_[turns, False].astype(np.int64), starts[:-1]) if len(starts) > 1 else np.zeros(0, int)
                rows: list[tuple] = []
                for d, n in enumerate(np.diff(starts)):
                    if not n:
                        continue
                    a, b = starts[d], starts[d + 1]
                    if many[d]:
                        spans = spans_of(path[a:b], scores[a:b], least)
                    else:
                        spans = [(int(path[a]), 0, int(n), confidence(scores[a:b]))]
                    held = {states[s] for s, x, y, _ in spans if y - x >= least}
                    code = label_of(labels[d], states)
                    mixed = len(held) > 1
                    main = states[max(spans, key=lambda s: s[2] - s[1])[0]]
                    state = "missing" if code is None else "right" if code in (held or {main}) else "wrong"
                    if len(spans) > 1:
                        blank = SYNTAX.sub(lambda m: " " * len(m.group()), texts[d])
                        places = [m.start() for m in WORD.finditer(blank)]
                        edge = [0, *(places[x] for _, x, _, _ in spans[1:]), len(texts[d])]
                    else:
                        edge = [0, len(texts[d])]
                    rows += [(ids[d], labels[d], state, mixed, k, edge[k], edge[k + 1], states[s], y - x, c) for k, (s, x, y, c) in enumerate(spans)]
                kinds = [pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.float64()]
                names = ["doc_id", "label", "label_state", "mixed", "segment", "start", "end", "lang", "words", "confidence"]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows) if rows else [[]] * len(kinds), kinds)], names=names)

    return run


def label_languages(
    df: DataFrame, id_col: str, text_col: str, label_col: str, languages: list[str], sample_per_language: int = 1000, sample_chars: int = 5_000_000,
    penalty: float = 6.0, least_words: int = 8,
) -> DataFrame:
    """Language of each passage of each document, with a confidence and a judgement of the document's label.

    One row a passage: doc_id, label, label_state (`right`, `wrong`, `missing`), mixed, segment, start and end (characters), lang, words,
    confidence. Passages of fewer than `least_words` words join their neighbours; a shorter document is one passage. mixed: passages of that length in two or more
    languages. A label counts by its first two letters; unknown codes are missing. Documents without a word (null and empty
    texts too) give no row; rows are independent, so repeated documents give repeated rows. With no labelled row at all only scripts tell languages apart.

    The words' scores are fitted on at most `sample_per_language` labelled documents and `sample_chars` characters of each language, picked by a hash of the
    whole collection; the sample's text is all that reaches the driver. Words in another script than Latin leave its language only. Labelling needs no shuffle.
    """
    src = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("string").alias("label"), F.col(text_col).cast("string").alias("text"))
    code = F.lower(F.substring(F.trim("label"), 1, 2))
    pick = Window.partitionBy("code").orderBy("h", "doc_id")
    sample = src.withColumn("code", code).filter(F.col("code").isin(languages) & F.col("doc_id").isNotNull() & (F.length("text") > 0)).withColumn("h", F.xxhash64("doc_id"))
    chosen = sample.select("code", "h", "doc_id", F.length("text").alias("c")).filter(F.col("c") <= sample_chars).withColumn("n", F.row_number().over(pick)).filter(F.col("n") <= sample_per_language)
    chosen = chosen.withColumn("upto", F.sum("c").over(pick.rowsBetween(Window.unboundedPreceding, 0))).filter(F.col("upto") <= sample_chars)
    rows = sample.join(F.broadcast(chosen.select("code", "h", "doc_id")), ["code", "h", "doc_id"]).select("code", "text").collect()
    model = train(sorted((r["code"], r["text"]) for r in rows), languages)
    return src.filter(F.col("doc_id").isNotNull()).mapInArrow(_label(model, penalty, least_words), SEGMENTS)
