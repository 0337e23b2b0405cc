import random

import pytest

from gleanery.llm.outranking import net_flow
from gleanery.llm.topn import top_n_per_group

NAN = float("nan")


@pytest.mark.parametrize("heavy", [10, 10_000])
def test_top_n(spark, heavy):
    rng = random.Random(4)
    rows = [(rng.choice("ab") if i % 3 else "hot", f"e{rng.randint(0, 40)}", rng.choice([0.5, 1.0, 1.5, None, NAN]), "x", 7) for i in range(400)] + [(None, "e1", 1.0, "x", 7), ("a", None, 9.0, "x", 7), ("none", "e1", NAN, "x", 7)]
    df = spark.createDataFrame(rows, "g string, item string, s double, g0 string, place int")
    got = {(r.g, r.item): (r.s, r.place) for r in top_n_per_group(df, ["g"], "item", "s", 5, heavy).collect()}
    best = {}
    for g, e, s, *_ in rows:
        if e is not None and s is not None and s == s:
            best[g, e] = max(best.get((g, e), s), s)
    want = {}
    for g in {g for g, _ in best}:
        for n, (s, e) in enumerate(sorted((-s, e) for (h, e), s in best.items() if h == g)[:5], 1):
            want[g, e] = (-s, n)
    assert got == want
    assert top_n_per_group(df.limit(0), ["g"], "item", "s", 5, heavy).count() == 0


def strength(d, q, p):
    return min(1.0, max(0.0, (d - q) / (p - q)))


def brute_flows(rows, q, p, n_scores):
    """{(g, item): (net, [place..])} by comparing every pair."""
    out = {}
    for g in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == g and r[1] is not None]
        for r in mine:
            net, places = 0.0, []
            for c in range(n_scores):
                have = [(x[2 + c], x[1]) for x in mine if x[2 + c] is not None and x[2 + c] == x[2 + c]]
                v = r[2 + c]
                if v is None or v != v:
                    places.append(None)
                    continue
                pct = lambda y: (sum(z < y for z, _ in have) + sum(z <= y for z, _ in have)) / (2 * len(have))  # noqa: B023, E731
                x = pct(v)
                if len(have) > 1:
                    net += sum(strength(x - pct(y), q, p) - strength(pct(y) - x, q, p) for y, _ in have) / (len(have) - 1)
                places.append(sum((-z, e) < (-v, r[1]) for z, e in have) + 1)
            out[g, r[1]] = (net / n_scores, places)
    return out


@pytest.mark.parametrize("heavy", [15, 10_000])
def test_net_flow_equals_brute_force(spark, heavy):
    rng = random.Random(5)
    rows = [(g, f"e{i:02d}", *[rng.choice([None, NAN, 1.0, 2.0, rng.uniform(-5, 900)]) for _ in range(3)]) for g, n in (("a", 40), ("b", 7), ("c", 1), (None, 3)) for i in range(n)]
    rows += [("a", None, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "g string, item string, s0 double, s1 double, s2 double, c string, pct int")
    got = {(r.g, r.item): r for r in net_flow(df, "g", "item", ["s0", "s1", "s2"], heavy_rows=heavy).collect()}
    want = brute_flows(rows, 0.02, 0.25, 3)
    assert set(got) == set(want)
    for k, (net, places) in want.items():
        assert got[k].net == pytest.approx(net, abs=1e-7)
        assert [got[k][f"place_{i + 1}"] for i in range(3)] == places
    for g in ("a", "b"):
        mine = sorted((r for (h, _), r in got.items() if h == g), key=lambda r: (-r.net, r.item))
        assert [r["rank"] for r in mine] == list(range(1, len(mine) + 1))


def test_no_score_dominates_by_its_range(spark):
    df = spark.createDataFrame([("q", f"e{i}", float(i), float(-i * 10**6)) for i in range(20)], "g string, item string, a double, b double")
    assert {round(r.net, 9) for r in net_flow(df, "g", "item", ["a", "b"]).collect()} == {0.0}
    assert net_flow(df.limit(0), "g", "item", ["a", "b"]).count() == 0
    with pytest.raises(ValueError):
        net_flow(df, "g", "item", ["a"], indifference=0.5, preference=0.5)


def test_weights(spark):
    df = spark.createDataFrame([("q", f"e{i}", float(i), float(-i)) for i in range(20)], "g string, item string, a double, b double")
    got = net_flow(df, "g", "item", ["a", "b"], [3.0, 1.0]).orderBy("rank").collect()
    assert got[0].item == "e19" and got[-1].item == "e0"
