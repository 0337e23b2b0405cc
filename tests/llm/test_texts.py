import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleanery.llm import boilerplate, language, leakage
from gleanery.llm.distinctive import term_weights
from gleanery.llm.frequency import frequencies, interval_counts, marks
from gleanery.llm.mixing import horizon, mix_sources, tokens
from gleanery.llm.splitting import split_oversized, split_text

WORDS = "ant bee cat dog elk fox gnu hen ibis jay".split()


# 5: frequencies


@pytest.mark.parametrize("max_n", [1, 2, 4])
def test_suffix_intervals_equal_counting(max_n):
    rng = np.random.default_rng(6)
    tokens_ = rng.integers(0, 4, 300)
    record = np.sort(rng.integers(0, 25, 300))
    for n, at, count, records in interval_counts(tokens_, record, max_n):
        grams = [(tuple(tokens_[i : i + n]), record[i]) for i in range(301 - n) if record[i] == record[i + n - 1]]
        all_, per = Counter(g for g, _ in grams), Counter(g for g, _ in set(grams))
        got = {tuple(tokens_[i : i + n]): (c, r) for i, c, r in zip(at, count, records)}
        assert got == {g: (all_[g], per[g]) for g in all_}


def test_intervals_of_any_length_and_repeated_records():
    rng = np.random.default_rng(7)
    for _ in range(60):
        size = rng.integers(1, 60)
        tokens_, record = rng.integers(0, rng.integers(1, 4), size), np.sort(rng.integers(0, rng.integers(1, 8), size))
        longest = 0
        for n, at, count, records in interval_counts(tokens_, record, None):
            grams = [(tuple(tokens_[i : i + n]), record[i]) for i in range(size - n + 1) if record[i] == record[i + n - 1]]
            all_, per = Counter(g for g, _ in grams), Counter(g for g, _ in set(grams))
            assert {tuple(tokens_[i : i + n]): (c, r) for i, c, r in zip(at, count, records)} == {g: (all_[g], per[g]) for g in all_}
            longest = n
        assert longest == max(Counter(record.tolist()).values())


@pytest.mark.parametrize("block", [1, 50, 10**6])
def test_frequencies(spark, block):
    rng = random.Random(7)
    texts = [" ".join(rng.choices(WORDS, k=rng.randint(1, 30))) for _ in range(40)] + [None, "", " .. ", "Ant, ANT! İx"] + ["zebra " * 5000]
    df = spark.createDataFrame([(t, "x", 1) for t in texts], "t string, term string, n int").repartition(3)
    got = {r.term: r for r in frequencies(df, "t", block=block).collect()}
    split = [[w.lower() for w in re.findall(r"[^\W_]+", t or "")] for t in texts]
    tf, df_ = Counter(w for s in split for w in s), Counter(w for s in split for w in set(s))
    with_terms = sum(bool(s) for s in split)
    assert {t: (r.occurrences, r.records) for t, r in got.items()} == {t: (tf[t], df_[t]) for t in tf}
    assert {t for t, r in got.items() if r.common} == {t for t in tf if df_[t] * 5 > with_terms}
    assert got["zebra"].rare and not got["zebra"].common
    assert frequencies(df.limit(0), "t").count() == 0


def test_values_and_marks(spark):
    df = spark.createDataFrame([("Big Dog; cat,, CAT |\tbig dog ",), (" ; ",), (None,)], "k string")
    got = frequencies(df, "k", "values", common_share=0.05)
    assert {r.term: (r.occurrences, r.records) for r in got.collect()} == {"big dog": (2, 1), "cat": (2, 1)}
    assert {(r.term, r["mark"]) for r in marks(got).collect()} == {(t, m) for t in ("big dog", "cat") for m in ("rare", "common")}


# 6: splitting


@pytest.mark.parametrize("seed", range(6))
def test_pieces_rebuild_the_text_within_the_limit(seed):
    rng = random.Random(seed)
    text = "".join(rng.choice(["word ", "Longer sentence here. ", "line\n", "x" * rng.randint(1, 150), "; ", "é"]) for _ in range(200))
    limit, overlap = 120, 20
    pieces, _ = split_text(text, limit, overlap)
    assert all(0 < b - a <= limit for a, b, _ in pieces) and pieces[0][0] == 0 and pieces[-1][1] == len(text)
    assert all(a == e - overlap for (_, e, _), (a, _, _) in zip(pieces, pieces[1:]))
    assert text[pieces[0][0] : pieces[0][1]] + "".join(text[a + overlap : b] for a, b, _ in pieces[1:]) == text


def test_cuts_lie_at_boundaries_where_possible_and_cost_least():
    text = "One two three. " * 30
    pieces, longest = split_text(text, 100, 10)
    assert longest == 15 and {k for _, _, k in pieces[:-1]} == {"sentence"}
    from gleanery.llm.splitting import PENALTY, cut_points

    small = "A b. Cc dd. Eee ff. G. Hh ii jj. K"
    limit, overlap = 14, 3
    at, cost, _, _ = cut_points(small, limit - overlap)
    pieces_ = 1 + -(-(len(small) - limit) // (limit - overlap))
    even = (len(small) + overlap * (pieces_ - 1)) / pieces_

    def best(last, first):
        if last == len(small):
            return 0.0
        out = float("inf")
        for p, c in zip(at, cost):
            length = p - last + (0 if first else overlap)
            if p > last and length <= limit and not (first and p < overlap):
                out = min(out, c + ((length - even) / limit) ** 2 + best(p, False))
        return out

    got, _ = split_text(small, limit, overlap)
    total = sum(((b - a - even) / limit) ** 2 + PENALTY.get(k, 0.0) for a, b, k in got)
    assert total == pytest.approx(best(0, True))


def test_split_table(spark):
    rows = [("a", "x" * 50, "short", 1), ("b", "ab. " * 10, None, 1), ("c", "", "y" * 21 + ". z", 1), (None, "z" * 30, None, 1)]
    df = spark.createDataFrame(rows, "eid string, body string, title string, piece int")
    got = split_oversized(df, "eid", {"body": (20, 5), "title": (20, 2)}).collect()
    assert {(r.id, r.field_name): r.forced for r in got} == {("a", "body"): True, ("b", "body"): False, ("c", "title"): True, (None, "body"): True}
    assert all(len(r.text) <= 20 and r.text == {"a": rows[0][1], "b": rows[1][1], "c": rows[2][2], None: rows[3][1]}[r.id][r.start : r.end] for r in got)
    assert split_oversized(df.limit(0), "eid", {"body": (20, 5)}).count() == 0
    with pytest.raises(ValueError):
        split_oversized(df, "eid", {"body": (20, 20)})


def test_very_long_text_without_boundaries():
    pieces, longest = split_text("q" * 300_000, 2000, 100)
    assert longest == 300_000 and all(b - a <= 2000 for a, b, _ in pieces) and pieces[-1][1] == 300_000


# 7: distinctive terms


@pytest.mark.parametrize("heavy", [2, 10_000])
def test_weights_equal_the_formula(spark, heavy):
    rng = random.Random(8)
    texts = {f"d{i}": " ".join(rng.choices(WORDS, k=rng.randint(1, 20))) for i in range(20)}
    rows = [(k, t[:5], t[5:], "x") for k, t in texts.items()] + [("null", None, None, "x"), ("empty", "", ".", "x"), (None, "ant", "ant", "x")]
    df = spark.createDataFrame(rows, "eid string, a string, b string, term string")
    got = {(r.id, r.term): r for r in term_weights(df, "eid", ["a", "b"], heavy_rows=heavy).collect()}
    split = {k: re.findall(r"\w+", f"{a}\n{b}") for k, a, b, _ in rows[:20]}
    tf = {k: Counter(w) for k, w in split.items()}
    total = Counter(w for s in split.values() for w in s)
    smooth = sum(len(s) ** 0.75 for s in split.values())
    assert set(got) == {(k, w) for k in tf for w in tf[k]}
    for (k, w), r in got.items():
        want = max(0.0, np.log(tf[k][w] * smooth / (total[w] * len(split[k]) ** 0.75)))
        assert r.weight == pytest.approx(want, abs=1e-9) and r.df == sum(w in t for t in tf.values())
    assert term_weights(df.limit(0), "eid", ["a", "b"]).count() == 0


# 8: leaks

ITEM = "the quick brown fox jumps over one lazy dog while seven small birds sing loud songs near old mill ponds"


def test_alignment_finds_edited_copies(spark):
    w = ITEM.split()
    altered = " ".join("zzz" if i % 6 == 3 else x for i, x in enumerate(w))
    inserted = " ".join(w[:10]) + " here stands another sentence of some ten or more words which nobody asked for today. " + " ".join(w[10:])
    shuffled = " ".join(random.Random(1).sample(w, len(w)))
    docs = {1: "Intro. " + ITEM.upper() + "! Outro.", 2: altered, 3: inserted, 4: "x " * 50 + " ".join(w[:12]), 5: " ".join(w[:5]) + " and so on", 6: shuffled, 7: None, 8: "", 9: "<p>" + ITEM.replace("fox", "<b>fox</b>") + "</p>", 10: "word " * 20_000 + ITEM}
    df = spark.createDataFrame([(k, v, 1, "x") for k, v in docs.items()] + [(None, ITEM, 1, "x")], "doc_id long, text string, item_id int, share string")
    items = spark.createDataFrame([(100, ITEM), (100, ITEM), (101, "something else entirely with other words than that"), (102, None), (None, ITEM), (103, "")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in leakage.leaked_items(df, "doc_id", "text", items, "item_id", "text").collect()}
    assert got == {(i, 100) for i in (1, 2, 3, 4, 9, 10)}
    assert {(r.doc_id, r.item_id) for r in leakage.leaked_items(df, "doc_id", "text", items, "item_id", "text", block_words=5).collect()} == got
    assert leakage.leaked_items(df.limit(0), "doc_id", "text", items, "item_id", "text").count() == 0
    assert leakage.leaked_items(df, "doc_id", "text", items.limit(0), "item_id", "text").count() == 0


def test_an_item_in_a_third_of_all_documents_keeps_its_seeds(spark):
    df = spark.createDataFrame([(i, ITEM if i % 3 == 0 else f"other words number {i} stand here") for i in range(300)], "doc_id long, text string")
    items = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    assert leakage.leaked_items(df, "doc_id", "text", items, "item_id", "text").count() == 100


def test_half_copies_in_a_third_of_all_documents_are_found(spark):
    one, two = [f"w{i}" for i in range(60)], [f"v{i}" for i in range(60)]
    edited = " ".join("zzz" if i % 8 == 7 else w for i, w in enumerate(two[:40]))
    texts = {0: " ".join(one[:30]), 1: edited, 2: " ".join(one[:20])}
    df = spark.createDataFrame([(i, f"head {i} {texts.get(i % 3)} tail") for i in range(300)], "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(one)), (2, " ".join(two))], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in leakage.leaked_items(df, "doc_id", "text", items, "item_id", "text").collect()}
    assert got == {(i, i % 3 + 1) for i in range(300) if i % 3 < 2}


def test_batched_alignment_equals_the_matrix():
    rng = np.random.default_rng(9)
    items = [rng.integers(1, 6, rng.integers(2, 12)) for _ in range(30)]
    docs = [rng.integers(0, 7, rng.integers(2, 25)) for _ in range(30)]
    score, _ = leakage.align_all(items, docs, 100)
    for k, (a, b) in enumerate(zip(items, docs)):
        h = np.zeros((len(a) + 1, len(b) + 1))
        best = 0.0
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                diag = h[i - 1, j - 1] + (leakage.MATCH if a[i - 1] == b[j - 1] else leakage.MISMATCH)
                up = max(h[i - g, j] - leakage.GAP_OPEN - leakage.GAP_ITEM * g for g in range(1, i + 1))
                left = max(h[i, j - g] - leakage.GAP_OPEN - leakage.GAP_DOC * g for g in range(1, j + 1))
                h[i, j] = max(0, diag, up, left)
                best = max(best, h[i, j])
        assert score[k] == pytest.approx(best / leakage.MATCH)


# 9: mixing


def corpus(spark, sizes):
    rows, n = [], 0
    for source, counts in sizes.items():
        for c in counts:
            rows.append((n, " ".join(["w"] * c), source, "x", 1))
            n += 1
    return spark.createDataFrame(rows, "doc_id long, text string, source string, key string, size int")


@pytest.mark.parametrize("bin_rows", [3, 50_000])
def test_shares(spark, bin_rows):
    docs = corpus(spark, {" Big ": [10] * 300, "small": [10] * 20, "tiny": [10] * 2, "other": [10] * 50, None: [10] * 5, "big": [0, 3]})
    targets = spark.createDataFrame([("big", 0.5, 1), ("Small", 0.2, 6), ("tiny", 0.2, 3), ("lost", 0.1, 2), ("nul", None, None)], "source string, target_share double, max_repeats int")
    mix = mix_sources(docs, targets, "doc_id", "text", bin_rows=bin_rows)
    rep = {r.source: r for r in mix.report.collect()}
    assert {k: r.outcome for k, r in rep.items()} == {"big": "cut", "Small": "repeated", "tiny": "short", "lost": "short", "nul": "cut"}
    drawn = mix.drawn.collect()
    total = sum(r.size for r in drawn)
    whole = 3003 + 200 + 20
    assert whole - 40 <= total <= whole
    assert rep["tiny"].drawn == 60 and rep["tiny"].repeats == 3 and rep["lost"].drawn == 0
    per = Counter()
    for r in drawn:
        per[r.source] += r.size
    assert abs(per["small"] / per["big"] - 0.2 / 0.5) < 0.02
    copies = Counter((r.id, r.copy) for r in drawn)
    assert max(copies.values()) == 1 and max(r.copy for r in drawn if r.source == "small") < 6
    assert sorted(r.finish for r in drawn)[-1] <= horizon([(0.5, 3003), (0.2, 1200), (0.2, 60)], whole) * 1.01


def test_a_very_long_text_leaves_no_budget_unfilled(spark):
    docs = corpus(spark, {"long": [400], "short": [1] * 100})
    targets = spark.createDataFrame([("long", 0.5, 1), ("short", 0.5, 6)], "source string, target_share double, max_repeats int")
    drawn = mix_sources(docs, targets, "doc_id", "text", budget=300).drawn.collect()
    # the long text ends at 800 and does not fit; 300 words of the other, which end at 600, do
    assert {r.source for r in drawn} == {"short"} and sum(r.size for r in drawn) == 300


@pytest.mark.parametrize("budget", [100, 37, 400, 5000])
def test_drawn_documents_equal_a_sequential_queue(spark, budget):
    sizes = {"long": [100] * 5, "short": [1] * 300, "few": [7, 0, 3]}
    docs = corpus(spark, sizes)
    targets = spark.createDataFrame([("long", 0.5, 1), ("short", 0.4, 2), ("few", 0.1, 3)], "source string, target_share double, max_repeats int")
    got = {(r.id, r.copy): r for r in mix_sources(docs, targets, "doc_id", "text", budget=budget).drawn.collect()}
    size, source = {r.doc_id: len(r.text.split()) for r in docs.collect()}, {r.doc_id: r.source for r in docs.collect()}
    order = {k: [r.doc_id for r in docs.filter(docs.source == k).selectExpr("doc_id", "xxhash64(doc_id, 0) h").orderBy(F.col("h") < 0, "h").collect()] for k in sizes}
    queue = []
    for k, share, times in (("long", 0.5, 1), ("short", 0.4, 2), ("few", 0.1, 3)):
        upto = 0
        for copy in range(times):
            for d in order[k]:
                upto += size[d]
                queue.append((upto / share, k, d, copy))
    run, want = 0, set()
    for _, _, d, copy in sorted(queue):
        run += size[d]
        if run > budget:
            break
        want.add((d, copy))
    assert set(got) == want and all(got[d, c].source == source[d] for d, c in want)


def test_the_queue_fills_a_tight_budget(spark):
    docs = corpus(spark, {"long": [100] * 5, "short": [1] * 300})
    targets = spark.createDataFrame([("long", 0.5, 1), ("short", 0.5, 1)], "source string, target_share double, max_repeats int")
    # the hundredth word and the first long text end at the same time; the long one comes first and does not fit
    assert sum(r.size for r in mix_sources(docs, targets, "doc_id", "text", budget=100).drawn.collect()) == 99


def test_mixing_without_rows(spark):
    docs = corpus(spark, {"a": [3]})
    targets = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int")
    none = mix_sources(docs.limit(0), targets, "doc_id", "text")
    assert none.drawn.count() == 0 and none.report.first().drawn == 0
    assert mix_sources(docs, targets.limit(0), "doc_id", "text").drawn.count() == 0


def test_sizes_in_tokens(spark):
    import public_tokenizers as P

    docs = corpus(spark, {"a": [3, 4], "b": [5]})
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 1)], "source string, target_share double, max_repeats int")
    count = tokens(str(P.path("byte_bpe_50k.tiktoken")), P.PATTERN)
    got = mix_sources(docs, targets, "doc_id", "text", size=count(F.col("text"))).report.collect()
    assert {r.source: r.available for r in got} == {"a": 7, "b": 5}


# 10: languages

EN = "the old house stands near the river and nobody knows who built the bridge over the water".split()
DE = "das alte haus steht nahe dem fluss und niemand weiß wer die brücke über das wasser gebaut hat".split()


def sentence(rng, words, n):
    return " ".join(rng.choices(words, k=n))


def test_languages(spark):
    rng = random.Random(10)
    rows = [(i, sentence(rng, EN if i % 2 else DE, 30), "en" if i % 2 else "DE-at", "x") for i in range(200)]
    rows[7] = (7, rows[7][1], "de", "x")
    rows += [
        (1000, sentence(rng, EN, 30), None, "x"), (1001, sentence(rng, EN, 20) + ". " + sentence(rng, DE, 20), "en", "x"), (1002, sentence(rng, EN, 20) + " (das haus) " + sentence(rng, EN, 20), "en", "x"),
        (1003, None, "en", "x"), (1004, "", None, "x"), (1005, "123 ...", "en", "x"), (1006, "Это старый дом у реки и никто не знает кто построил мост", "ru", "x"), (1007, "das haus", "xx", "x"),
        (1008, sentence(rng, DE, 15) + " #SUM( the river and the bridge over the water near the house )", "de", "x"), (None, "the river", "en", "x"), (1009, sentence(rng, EN, 40_000), "en", "x"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, label string")
    got = {}
    for r in language.label_languages(df, "doc_id", "text", "lang", ["de", "en"]).collect():
        got.setdefault(r.doc_id, []).append(r)
    lang = lambda i: [r.lang for r in sorted(got[i], key=lambda r: r.segment)]
    assert all(lang(i) == (["en"] if i % 2 else ["de"]) for i in range(200))
    assert got[7][0].label_state == "wrong" and got[8][0].label_state == "right" and got[1000][0].label_state == "missing"
    assert lang(1001) == ["en", "de"] and all(r.mixed for r in got[1001])
    a, b = sorted(got[1001], key=lambda r: r.segment)
    assert a.end == b.start and abs(a.words - 20) <= 2
    assert lang(1002) == ["en"] and lang(1006) == ["ru"] and lang(1007) == ["de"] and lang(1008) == ["de"] and lang(1009) == ["en"]
    assert not {1003, 1004, 1005, None} & set(got)
    assert all(0 < r.confidence <= 1 for rs in got.values() for r in rs)
    assert language.label_languages(df.limit(0), "doc_id", "text", "lang", ["de", "en"]).count() == 0


def test_scripts_come_before_the_vocabulary():
    rng = random.Random(13)
    cyrillic = "мост река дом старый".split()
    rows = [("en", sentence(rng, EN, 20) + " " + sentence(rng, cyrillic, 6)) for _ in range(20)] + [("de", sentence(rng, DE, 20)) for _ in range(20)]
    model = language.train(rows, ["de", "en"])
    assert not set(model.words) & set(cyrillic)
    for w in cyrillic:
        row = dict(zip(model.states, model.row(w)))
        assert row["ru"] > 0 and max(row["en"], row["de"]) < 0
    words = language.words_of(sentence(rng, EN, 12) + " " + sentence(rng, cyrillic, 12))
    path = language.viterbi(model.scores(words), np.array([0, 24]), 6.0)
    assert [model.states[s] for s in path] == ["en"] * 12 + ["ru"] * 12


def test_viterbi_equals_trying_all_paths():
    import itertools

    rng = np.random.default_rng(11)
    lengths = [5, 1, 0, 6, 3]
    starts = np.r_[0, np.cumsum(lengths)]
    scores = rng.normal(size=(starts[-1], 3)).astype(np.float32) * 2
    path = language.viterbi(scores, starts, 1.5)

    def value(p, s):
        return sum(s[i, x] for i, x in enumerate(p)) - 1.5 * sum(a != b for a, b in zip(p, p[1:]))

    for a, b in zip(starts, starts[1:]):
        best = max((value(p, scores[a:b]) for p in itertools.product(range(3), repeat=b - a)), default=0)
        assert value(path[a:b], scores[a:b]) == pytest.approx(best, abs=1e-4)


# 4: main content


def test_main_content(spark):
    rng = random.Random(12)
    rows, truth = [], {}
    for i in range(120):
        site = f"site{i % 4}"
        lines = [("Home | News | Shop | Contact", 0), (f"Welcome to {site}, all about things", 0), (f"Report number {i}", 1)]
        for _ in range(6):
            lines.append((sentence(rng, EN, 12).capitalize() + ".", 1))
            lines.append((f"- {sentence(rng, WORDS, 3)}", 1))
        lines += [("Subscribe to our letter", 0), ("Related: Report number " + str(rng.randint(0, 500)), 0), (f"Copyright {site} 20{i % 30:02d}", 0)]
        rows.append((f"p{i}", f"https://www.{site}.example/a/{i}", f"Report number {i}", "\r\n".join(x for x, _ in lines) + "\n\n", "x"))
        truth.update({(f"p{i}", n): bool(v) for n, (_, v) in enumerate(lines)})
    rows += [("empty", None, None, "", "x"), ("null", None, None, None, "x"), (None, None, None, "text", "x"), ("bare", None, None, "One sentence stands here all alone without anything.\n", "x"), ("long", None, None, "word " * 100_000, "x")]
    df = spark.createDataFrame(rows, "eid string, raw_url string, title_string string, body_string string, path string")
    for broadcast in (10**6, 0):
        got = {(r.eid, r.line_no): r.content for r in boilerplate.page_lines(df, "eid", "raw_url", "title_string", "body_string", broadcast_rows=broadcast).collect()}
        assert {k for k in got if k[0] not in ("bare", "long")} == set(truth)
        wrong = [k for k, v in truth.items() if got[k] != v]
        assert len(wrong) <= 0.01 * len(truth)
        assert got["bare", 0] and ("empty", 0) not in got
    assert boilerplate.page_lines(df.limit(0), "eid", "raw_url", "title_string", "body_string").count() == 0
