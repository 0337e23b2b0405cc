from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gleanery.operators.positional import near_walk, proximity, walk, window_walk

positions = st.lists(st.integers(0, 30), max_size=8, unique=True).map(sorted)


def test_known_walks():
    assert near_walk([[1], [2, 4], [7]], 3) == [7]
    assert near_walk([[1, 2, 3], [1, 2, 3]], 1) == [2, 3]
    assert window_walk([[3, 9], [3, 9]], 8) == [3, 9]


@given(st.lists(positions, min_size=2, max_size=3), st.integers(1, 8))
@settings(max_examples=200, deadline=None)
def test_a_match_exists_exactly_if_the_walk_finds_one(lists, n):
    def chain(i, last):
        return i == len(lists) or any((last is None or 0 < p - last <= n) and chain(i + 1, p) for p in lists[i])

    def spans(i, lo, hi):
        return hi - lo < n if i == len(lists) else any(spans(i + 1, min(lo, p), max(hi, p)) for p in lists[i])

    assert bool(near_walk(lists, n)) == chain(0, None)
    assert bool(window_walk(lists, n)) == any(spans(1, p, p) for p in lists[0])


def stepwise(kind, lists, n):
    """The same, a document at a time, one pointer step after the other."""
    at, out, k = [0] * len(lists), [], len(lists)
    while all(a < len(x) for a, x in zip(at, lists)):
        here = [x[a] for a, x in zip(at, lists)]
        move = None
        if kind == "NEAR":
            for i in range(1, k):
                if not 0 < here[i] - here[i - 1] <= n:
                    move = i if here[i] <= here[i - 1] else i - 1
                    break
        elif max(here) - min(here) >= n:
            move = here.index(min(here))
        if move is None:
            out.append(here[-1] if kind == "NEAR" else max(here))
            at = [a + 1 for a in at]
        else:
            at[move] += 1
    return out


def test_documents_together_equal_each_alone(spark):
    import random

    rng = random.Random(1)
    some = lambda: sorted(rng.sample(range(25), rng.randint(0, 7)))
    rows = [(rng.choice(["NEAR", "WINDOW"]), rng.randint(1, 9), [some() for _ in range(rng.randint(1, 4))]) for _ in range(600)] + [("SYN", 1, [[1], [2]]), ("NEAR", 1, [])]
    got = spark.createDataFrame(rows, "k string, n int, x array<array<int>>").select("k", "n", "x", proximity(F.col("k"), F.col("n"), F.col("x")).alias("z")).collect()
    assert len(got) == len(rows) and all(r.z == (stepwise(r.k, r.x, r.n) if r.k != "SYN" and r.x else []) for r in got)
    for kind in ("NEAR", "WINDOW"):
        documents = [[some() for _ in range(3)] for _ in range(50)]
        assert walk(kind, 5, documents) == [stepwise(kind, d, 5) for d in documents]


def test_a_very_long_document_takes_linear_time():
    import time

    start = time.perf_counter()
    assert len(near_walk([list(range(0, 200_000, 2)), list(range(1, 200_000, 2))], 1)) == 100_000
    assert time.perf_counter() - start < 60
