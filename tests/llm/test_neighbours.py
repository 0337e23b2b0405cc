import gc
import os
import threading

import numpy as np
import pytest

from gleanery.llm import neighbours
from gleanery.llm.neighbours import Plan, choose, hadamard, hash_widths, nearest_vectors, probes, rotate

NAN = float("nan")


def frame(spark, rows):
    rows = [(i, None if v is None else [None if x is None else float(x) for x in v], *rest) for i, v, *rest in rows]
    return spark.createDataFrame(rows, "vec_id long, v array<float>, id string, cls int, cos double")


def brute(ids, x, k):
    x = x / np.linalg.norm(x, axis=1)[:, None]
    s = x @ x.T
    np.fill_diagonal(s, -2)
    return {i: [ids[j] for j in sorted(range(len(ids)), key=lambda j: (-round(s[n, j], 6), ids[j])) if j != n][:k] for n, i in enumerate(ids)}


def test_rotation_keeps_lengths_and_is_fast_hadamard():
    x = np.random.default_rng(0).normal(size=(5, 64)).astype(np.float32)
    assert np.allclose(np.linalg.norm(rotate(x, 3), axis=1), np.linalg.norm(x, axis=1), rtol=1e-5)
    h = hadamard(np.eye(8, dtype=np.float32))
    assert np.allclose(h @ h.T, 8 * np.eye(8)) and set(np.unique(h)) == {-1.0, 1.0}


def test_widths_follow_the_number_of_rows():
    assert hash_widths(100, 64, 512) == [1]
    assert hash_widths(512 * 128, 64, 512) == [64]
    assert hash_widths(512 * 128 * 10, 64, 512) == [64, 5]


def test_first_probe_is_the_own_bucket_and_probes_differ():
    x = np.random.default_rng(1).normal(size=(50, 64)).astype(np.float32)
    p = probes(x, 2, [64, 5], 6)
    assert p.shape == (50, 7) and all(len(set(r)) == 7 for r in p) and (p[:, :1] == probes(x, 2, [64, 5], 0)).all()


@pytest.mark.parametrize("largest_block", [4096, 40])
def test_recall_against_brute_force(spark, largest_block):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(60, 16))
    x = np.concatenate([base, base[:40] + 0.05 * rng.normal(size=(40, 16)), rng.normal(size=(300, 16))]) * rng.uniform(0.1, 50, size=(400, 1))
    ids = list(range(0, 4000, 10))
    rows = [(i, v.tolist(), "x", 1, 0.0) for i, v in zip(ids, x)]
    got = nearest_vectors(frame(spark, rows).repartition(3), "vec_id", "v", 16, 5, plan=Plan(6, 5, tuple(hash_widths(400, 16, 64)), 0.0), largest_block=largest_block).collect()
    want = brute(ids, x.astype(np.float32).astype(float), 5)
    hits = sum(r.other_id in want[r.id] for r in got)
    assert len(got) == 5 * 400 and hits / len(got) > 0.95
    near = {(r.id, r.other_id) for r in got if r.cosine > 0.9}
    assert {(ids[i], ids[60 + i]) for i in range(40)} <= near
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    for r in got[:50]:
        assert abs(r.cosine - unit[ids.index(r.id)] @ unit[ids.index(r.other_id)]) < 1e-5


def test_a_group_in_another_bucket_is_found_whole_and_from_both_sides(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(60, 16))
    x = (centres[:, None, :] + 0.25 * rng.normal(size=(60, 11, 16))).reshape(-1, 16)
    rows = [(i, v.tolist(), "x", 1, 0.0) for i, v in enumerate(x)]
    got = nearest_vectors(frame(spark, rows), "vec_id", "v", 16, 10, plan=Plan(1, 4, tuple(hash_widths(660, 16, 40)), 0.0)).collect()
    lists = {i: {} for i in range(len(x))}
    for r in got:
        lists[r.id][r.other_id] = r.cosine
    # who is in a list, and nearer than the other's last, has the other in its own
    assert not [(a, b) for a, near in lists.items() for b, cos in near.items() if a not in lists[b] and (len(lists[b]) < 10 or cos > min(lists[b].values()) + 1e-6)]
    want = brute(list(range(len(x))), x.astype(np.float32).astype(float), 10)
    assert sum(r.other_id in want[r.id] for r in got) / (10 * len(x)) > 0.99


def test_copies_bad_vectors_and_ties(spark):
    one, two = [1.0, 0.0, 0.0, 0.0], [0.9, 0.1, 0.0, 0.0]
    bad = [(90, None), (91, [0.0] * 4), (92, [1.0]), (93, [NAN, 1, 1, 1]), (94, [float("inf"), 1, 1, 1]), (None, one), (95, [None, 1.0, 1.0, 1.0])]
    rows = [(i, [x * (i + 1) for x in one]) for i in range(30)] + [(50, two)] + bad
    got = nearest_vectors(frame(spark, [(i, v, "x", 1, 0.0) for i, v in rows]), "vec_id", "v", 4, 3).collect()
    by = {}
    for r in sorted(got, key=lambda r: (r.id, r.place)):
        by.setdefault(r.id, []).append(r.other_id)
    assert set(by) == {*range(30), 50}
    assert by[0] == [1, 2, 3] and by[29] == [0, 1, 2] and by[50] == [0, 1, 2]


def test_empty_and_single(spark):
    assert nearest_vectors(frame(spark, []), "vec_id", "v", 4).count() == 0
    assert nearest_vectors(frame(spark, [(1, [1.0, 0, 0, 0], "x", 1, 0.0)]), "vec_id", "v", 4).count() == 0


def test_a_repeated_id_counts_once(spark):
    rows = [(1, [1.0, 0, 0, 0], "x", 1, 0.0)] * 3 + [(2, [0, 1.0, 0, 0], "x", 1, 0.0)]
    assert {(r.id, r.other_id) for r in nearest_vectors(frame(spark, rows), "vec_id", "v", 4).collect()} == {(1, 2), (2, 1)}


def test_the_plan_follows_the_number_of_rows_and_meets_the_recall():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(3000, 16)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1)[:, None]
    s = x[:100] @ x.T
    s[np.arange(100), np.arange(100)] = -2
    near = np.argsort(-s, axis=1)[:, :10]
    small, large = (choose(x[:100], x[near.ravel()], np.repeat(np.arange(100), 10), rows, 0.95) for rows in (50, 50_000_000))
    assert small.recall == 1.0 and small.buckets == small.extra + 1
    assert large.buckets > 32 and large.recall >= 0.95
    met = np.zeros((100, 10), bool)
    for t in range(large.tables):
        mine, theirs = probes(x[:100], t, list(large.widths), large.extra), probes(x[near.ravel()], t, list(large.widths), large.extra)
        met |= (theirs[:, 0].reshape(100, 10, 1) == mine[:, None, :]).any(axis=2) | (theirs.reshape(100, 10, -1) == mine[:, None, :1]).any(axis=2)
    assert met.mean() == pytest.approx(large.recall)


@pytest.mark.parametrize("largest_block", [50, 10_000])
def test_one_bucket_with_most_vectors_is_compared_whole(spark, largest_block):
    rng = np.random.default_rng(7)
    x = np.concatenate([np.eye(16)[0] + 0.05 * rng.normal(size=(300, 16)), rng.normal(size=(60, 16))])
    rows = [(i, v.tolist(), "x", 1, 0.0) for i, v in enumerate(x)]
    got = nearest_vectors(frame(spark, rows), "vec_id", "v", 16, 5, plan=Plan(1, 31, (16,), 1.0), largest_block=largest_block, task_vectors=500).collect()
    want = brute(list(range(len(x))), x.astype(np.float32).astype(float), 5)
    assert len(got) == 5 * len(x) and sum(r.other_id in want[r.id] for r in got) / len(got) > 0.999


class Disk:
    """The most bytes that shuffles and the shared folder held at once."""

    def __init__(self, spark):
        env = spark._jvm.org.apache.spark.SparkEnv.get()
        self.at = [d.getPath() for d in env.blockManager().diskBlockManager().localDirs()] + [spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:")]
        self.most, self.over, self.thread = 0, threading.Event(), threading.Thread(target=self.watch)

    def used(self):
        total = 0
        for top in self.at:
            for folder, _, names in os.walk(top):
                for name in names:
                    try:
                        total += os.path.getsize(os.path.join(folder, name))
                    except OSError:
                        pass
        return total

    def watch(self):
        while not self.over.wait(0.05):
            self.most = max(self.most, self.used() - self.before)

    def __enter__(self):
        self.before = self.used()
        self.thread.start()
        return self

    def __exit__(self, *_):
        self.over.set()
        self.thread.join()


def test_the_disk_does_not_grow_with_the_number_of_visits(spark, monkeypatch):
    x = np.random.default_rng(8).normal(size=(6000, 64))
    df = frame(spark, [(i, v.tolist(), "x", 1, 0.0) for i, v in enumerate(x)]).repartition(2)
    plan, got = Plan(4, 3, tuple(hash_widths(6000, 64, 200)), 0.0), {}
    for room in (3_000_000, 1_000_000_000):
        monkeypatch.setattr(neighbours, "LEAST_ROOM", room, raising=False)
        gc.collect()
        spark._jvm.System.gc()
        with Disk(spark) as disk:
            got[room] = {(r.id, r.place): (r.other_id, round(r.cosine, 5)) for r in nearest_vectors(df, "vec_id", "v", 64, 10, plan=plan, task_vectors=3000).collect()}
        if room == 3_000_000:
            assert disk.most < 8 * 4 * x.size
    few, all_at_once = got.values()
    assert len(few) == 60_000 and sum(few[k] == all_at_once.get(k) for k in few) > 59_900


@pytest.mark.parametrize("rows, visits, room", [(1000, [4000] * 3, 10**9), (1_000_000, [16_000_000] * 5, 6 * 10**8), (1_000_000, [2_000_000, 900_000_000, 2_000_000], 6 * 10**8)])
def test_rounds_hold_every_cell_once_and_keep_to_their_room(rows, visits, room):
    rounds = neighbours.rounds_for(rows, visits, 6, 250_000, 256, 120, room)
    seen = [(t, p) for r in rounds for t in range(r.first, r.last) for p in range(r.at, r.at + r.parts)]
    assert len(seen) == len(set(seen)) == sum(r.of for t in range(len(visits)) for r in rounds if r.first <= t < r.last and r.at == 0)
    for r in rounds:
        v = sum(visits[r.first : r.last]) * r.parts / r.of
        assert rows * r.parts * (1 - (1 - 1 / r.parts) ** (v / rows)) * (256 + 120) <= room
        assert min(rows, rows * (1 - (1 - 1 / r.parts) ** (v / rows))) <= 250_000 * 1.01


def test_a_bucket_cut_into_blocks_is_compared_whole_over_several_rounds(spark, monkeypatch):
    rng = np.random.default_rng(7)
    x = np.concatenate([np.eye(16)[0] + 0.05 * rng.normal(size=(300, 16)), rng.normal(size=(60, 16))])
    rows = [(i, v.tolist(), "x", 1, 0.0) for i, v in enumerate(x)] + [(1000 + i, x[i].tolist(), "x", 1, 0.0) for i in range(0, 300, 100)]
    monkeypatch.setattr(neighbours, "LEAST_ROOM", 180_000)
    rounds = []
    monkeypatch.setattr(neighbours, "rounds_for", lambda *a, f=neighbours.rounds_for: rounds.extend(f(*a)) or rounds)
    got = nearest_vectors(frame(spark, rows), "vec_id", "v", 16, 5, plan=Plan(1, 31, (16,), 1.0), largest_block=50, task_vectors=500).collect()
    assert len(rounds) > 2
    ids = [r[0] for r in rows]
    want = brute(ids, np.concatenate([x, x[[0, 100, 200]]]).astype(np.float32).astype(float), 5)
    assert len(got) == 5 * len(rows) and sum(r.other_id in want[r.id] for r in got) / len(got) > 0.995
