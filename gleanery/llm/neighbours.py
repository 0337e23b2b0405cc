"""Most similar vectors for every vector: cross-polytope hashing with several probes a table and exact reranking."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleanery.operators.dense import one_thread
from gleanery.operators.scale import discard, hot_cold_join, settle, taken

#: Directions that agree to so many decimals in every coordinate count as copies of each other.
COPY_DECIMALS = 5
#: Seconds that one more copy of a vector and one more comparison cost; only their ratio matters for the choice of a plan.
COPY_COST, PAIR_COST = 4e-6, 2e-9
#: Most tables, and the numbers of probes that are tried.
MOST_TABLES, PROBES = 32, (1, 2, 3, 4, 5, 6, 8, 10, 12, 14, 16)
#: Most vectors a bucket on average.
FULL = 4096
#: At most so many buckets are ever cut into blocks: the sizes from which they are follow from it.
MOST_LARGE = 100_000
#: Bytes of disk that the copies of a round's vectors and the lists they bring may take: so many, and so many for each byte of the vectors.
LEAST_ROOM, ROOM = 200_000_000, 2.0
#: Lists that rounds brought are merged once they take so many bytes for each byte of the vectors, or sooner.
WAITING = 0.25


def hadamard(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of each row; the width is a power of two."""
    n, step = x.shape[1], 1
    while step < n:
        x = x.reshape(-1, n // (2 * step), 2, step)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(-1, n)
        step *= 2
    return x


def rotate(x: np.ndarray, seed: int) -> np.ndarray:
    """Pseudo-random rotation: three times random signs and a Hadamard transform, zero-padded to a power of two."""
    width = 1 << max(1, (x.shape[1] - 1).bit_length())
    if width > x.shape[1]:
        x = np.pad(x, ((0, 0), (0, width - x.shape[1])))
    signs = np.random.default_rng(seed).choice(np.array([-1, 1], np.float32), (3, width))
    for s in signs:
        x = hadamard(x * s) / np.float32(math.sqrt(width))
    return x


def hash_widths(rows: int, dim: int, target: int) -> list[int]:
    """Numbers of axes hashed one after the other so that about `target` of `rows` vectors share a bucket.

    All but the last are whole rotations (2 * width buckets each); the last may use only its first axes.
    """
    width = 1 << max(1, (dim - 1).bit_length())
    want, out = max(1.0, rows / target), []
    while want > 1:
        axes = min(width, max(1, math.ceil(want / 2)))
        out.append(axes)
        want /= 2 * axes
    return out or [1]


_ROTATIONS: dict[tuple[int, int, int], np.ndarray] = {}


def _rotation(seed: int, dim: int, axes: int) -> np.ndarray:
    """The matrix of rotate(), for batches large enough that one product is cheaper than its steps."""
    key = (seed, dim, axes)
    if key not in _ROTATIONS:
        _ROTATIONS[key] = np.ascontiguousarray(rotate(np.eye(dim, dtype=np.float32), seed)[:, :axes])
    return _ROTATIONS[key]


def probes(x: np.ndarray, table: int, widths: list[int], extra: int) -> np.ndarray:
    """Bucket codes of each row: its own first, then the `extra` next best (as many as there are)."""
    codes = np.zeros((len(x), 1), np.int64)
    loss = np.zeros((len(x), 1), np.float32)
    for level, axes in enumerate(widths):
        y = x @ _rotation(1009 * table + level, x.shape[1], axes)
        both = np.concatenate([y, -y], axis=1)
        if extra:
            m = min(extra + 1, both.shape[1])
            best = np.argpartition(-both, m - 1, axis=1)[:, :m] if m < both.shape[1] else np.tile(np.arange(m), (len(x), 1))
            best = np.take_along_axis(best, np.argsort(-np.take_along_axis(both, best, axis=1), axis=1), axis=1)
        else:
            best = both.argmax(axis=1)[:, None]
        gap = both.max(axis=1, keepdims=True) - np.take_along_axis(both, best, axis=1)
        total = (loss[:, :, None] + (gap**2)[:, None, :]).reshape(len(x), codes.shape[1] * best.shape[1])
        joint = (codes[:, :, None] * (2 * axes) + best[:, None, :]).reshape(total.shape)
        order = np.argsort(total, axis=1, kind="stable")[:, : extra + 1]
        codes, loss = np.take_along_axis(joint, order, axis=1), np.take_along_axis(total, order, axis=1)
    return codes


@dataclass(frozen=True)
class Plan:
    """Tables, probes besides the own bucket, axes a level, and the share of true neighbours it found in the sample."""

    tables: int
    extra: int
    widths: tuple[int, ...]
    recall: float

    @property
    def buckets(self) -> int:
        return math.prod(2 * a for a in self.widths)


def choose(x: np.ndarray, near: np.ndarray, asker: np.ndarray, rows: int, recall: float) -> Plan:
    """The cheapest plan that finds `recall` of the sample's true neighbours.

    x: sampled unit vectors; near[i]: a true neighbour of x[asker[i]]. A pair is met if one's own bucket is among the other's probes in any table, so the
    codes of the sample and of its neighbours tell the recall of every plan without running it. Buckets hold FULL vectors at most on average, so that the
    work does not grow with the square of the rows; if no plan finds enough, the one that finds most is taken.
    """
    plans: list[tuple[float, Plan]] = []
    most = Plan(1, 0, (1,), -1.0)
    buckets = 2
    while rows / buckets > FULL:
        buckets *= 2
    while rows / buckets >= 64 or buckets == 2:
        widths = tuple(hash_widths(rows, x.shape[1], max(1, rows / buckets)))
        count = math.prod(2 * a for a in widths)
        steps = sorted({min(count, p) for p in PROBES})
        met = {p: np.zeros(len(near), bool) for p in steps}
        open_steps = list(steps)
        for table in range(MOST_TABLES):
            mine, theirs = probes(x, table, list(widths), steps[-1] - 1)[asker], probes(near, table, list(widths), steps[-1] - 1)
            for p in list(open_steps):
                met[p] |= (theirs[:, :1] == mine[:, :p]).any(axis=1) | (mine[:, :1] == theirs[:, :p]).any(axis=1)
                found = float(met[p].mean()) if len(near) else 1.0
                cost = (table + 1) * p * (COPY_COST + PAIR_COST * rows / count)
                if found > most.recall:
                    most = Plan(table + 1, p - 1, widths, found)
                if found >= recall:
                    plans.append((cost, Plan(table + 1, p - 1, widths, found)))
                    open_steps.remove(p)
            least = min((c for c, _ in plans), default=math.inf)
            if not open_steps or (table + 2) * open_steps[0] * (COPY_COST + PAIR_COST * rows / count) > least:
                break
        buckets *= 2
    return min(plans, key=lambda c: c[0])[1] if plans else most


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    """The float32 rows of a binary column without nulls."""
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, dim)


def _sampled(sample: np.ndarray, names: np.ndarray, dim: int, k: int):
    """The k best of the sampled vectors' partners in each batch: (asker, cls, cos, u)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_thread()
        for batch in batches:
            x, cls = _vectors(batch.column(1), dim), batch.column(0).to_numpy()
            s = sample @ x.T
            s[names[:, None] == cls[None, :]] = -2
            m = min(k, len(x))
            pick = np.argpartition(-s, m - 1, axis=1)[:, :m].ravel()
            asker = np.repeat(np.arange(len(sample)), m)
            yield pa.RecordBatch.from_arrays([pa.array(asker.astype(np.int32)), pa.array(cls[pick]), pa.array(s[asker, pick]), batch.column(1).take(pa.array(pick))], names=["asker", "cls", "cos", "u"])

    return run


def plan_for(classes: DataFrame, rows: int, dim: int, k: int, recall: float, sample: int) -> Plan:
    """Fit the plan on `sample` vectors picked by a hash: their true neighbours among all vectors come from one distributed scan."""
    if rows < 2:
        return Plan(1, 1, (1,), 1.0)
    picked = classes.select("cls", "u").orderBy(F.xxhash64("cls"), "cls").limit(sample).collect()
    x = np.frombuffer(b"".join(r["u"] for r in picked), np.float32).reshape(-1, dim)
    names = np.array([r["cls"] for r in picked], np.int64)
    w = Window.partitionBy("asker").orderBy(F.desc("cos"), "cls")
    found = classes.select("cls", "u").mapInArrow(_sampled(x, names, dim, k), "asker int, cls long, cos float, u binary")
    true = found.withColumn("n", F.row_number().over(w)).filter((F.col("n") <= k) & (F.col("cos") > -1.5)).select("asker", "u").collect()  # sample * k rows
    near = np.frombuffer(b"".join(r["u"] for r in true), np.float32).reshape(-1, dim)
    return choose(x, near, np.array([r["asker"] for r in true], np.int64), rows, recall)


def _counted(dim: int, plan: Plan, among: np.ndarray | None = None):
    """(bucket, n): sizes of the buckets, or how many ask in those of `among`, summed within a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_thread()
        for batch in batches:
            x = _vectors(batch.column(0), dim)
            if among is None:
                codes = np.concatenate([t * plan.buckets + probes(x, t, list(plan.widths), 0)[:, 0] for t in range(plan.tables)])
            else:
                codes = np.concatenate([(t * plan.buckets + probes(x, t, list(plan.widths), plan.extra)[:, 1:]).ravel() for t in np.unique(among // plan.buckets).tolist()])
                codes = codes[np.isin(codes, among)]
            bucket, n = np.unique(codes, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(n)], names=["bucket", "n"])

    return run


def _mixed(a: np.ndarray) -> np.ndarray:
    """A well-mixed non-negative number of each."""
    z = a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    z ^= z >> np.uint64(29)
    z *= np.uint64(0xBF58476D1CE4E5B9)
    return ((z ^ (z >> np.uint64(32))) >> np.uint64(1)).astype(np.int64)


#: What a vector does in a cell: it is compared with all that ask and with its fellows, or it asks, or it is compared with those that ask only.
MEMBER, ASKS, LISTED = 0, 1, 2
#: Columns of a vector's list: its partners and their cosines.
LISTS = ["others", "cos"]


def _cells(own: np.ndarray, bucket: np.ndarray, row: np.ndarray, cls: np.ndarray, large: np.ndarray, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, cell * 4 + role) for each bucket a vector visits.

    A bucket of b blocks is a square of b * b cells: member block i is in the cells (i, 0..b-1), whoever asks is in one column j. A member of
    block i asks only the blocks after it, as those before have it among those that ask.
    """
    b = np.ones(len(bucket), np.int64)
    if len(large):
        at = np.minimum(np.searchsorted(large, bucket), len(large) - 1)
        hit = large[at] == bucket
        b[hit] = blocks[at[hit]]
    many = b > 1
    out_row, out_code = [row[~many]], [(bucket[~many] << 26) | np.where(own[~many], MEMBER, ASKS)]
    if many.any():
        n = b[many]
        h = _mixed(cls[row[many]])
        t = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        r, g, mine, i, j = (np.repeat(v, n) for v in (row[many], bucket[many] << 26, own[many], h % n, (h // n) % n))
        asks = ~mine | (t > i)
        out_row += [r[mine], r[asks]]
        out_code += [(g | i << 14 | t << 2 | np.where(t == 0, MEMBER, LISTED))[mine], (g | t << 14 | j << 2 | ASKS)[asks]]
    return np.concatenate(out_row), np.concatenate(out_code)


@dataclass(frozen=True)
class Round:
    """Tables first to last - 1; of the `of` parts that their cells are hashed to, the `parts` from number `at` on."""

    first: int
    last: int
    at: int
    parts: int
    of: int


def _parts(rows: int, visits: float, cores: int, task_vectors: int) -> int:
    """The least number of parts, as many as cores at least, of which none holds over about `task_vectors` vectors, or 16 visits for each of these."""
    parts = max(cores, math.ceil(visits / (16 * task_vectors)))
    if rows > task_vectors and visits:
        parts = max(parts, math.ceil(-1 / math.expm1(math.log1p(-task_vectors / rows) * rows / visits)))
    return parts


def rounds_for(rows: int, visits: list[int], cores: int, task_vectors: int, vector: int, partners: int, room: float) -> list[Round]:
    """Rounds over all cells of all tables, so that each writes `room` bytes at most.

    visits: by table, in how many cells its vectors are; vector, partners: bytes of a vector, and of the list that a copy of it brings. The copies of
    vectors whose visits are unequal are fewer than is counted here.
    """

    def written(v: float) -> float:
        parts = _parts(rows, v, cores, task_vectors)
        return rows * parts * -math.expm1(math.log1p(-1 / parts) * v / rows) * (vector + partners + 56) + 8 * v

    out: list[Round] = []
    first = 0
    while first < len(visits) and rows:
        last = first + 1
        while last < len(visits) and written(sum(visits[first : last + 1])) <= room:
            last += 1
        mine, pieces = sum(visits[first:last]), 1
        while written(mine / pieces) > room and mine / pieces > 1:
            pieces += max(1, pieces // 16)
        parts = _parts(rows, mine / pieces, cores, task_vectors)
        out += [Round(first, last, i * parts, parts, pieces * parts) for i in range(pieces)]
        first = last
    return out


def _start(dim: int, k: int):
    """(cls, ids, u) to (cls, ids, u, floor, others, cos): the k best among a vector's neighbours in the input are its first candidates.

    The least of them is the floor under which no other needs to be kept.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_thread()
        for whole in batches:
            for start in range(0, whole.num_rows, 10_000):
                batch = whole.slice(start, 10_000)
                x, cls = _vectors(batch.column(2), dim), batch.column(0).to_numpy()
                m = min(k, len(x) - 1)
                best, cos = np.zeros((len(x), m), np.int64), np.zeros((len(x), m), np.float32)
                for i in range(0, len(x) if m else 0, 1000):
                    s = x[i : i + 1000] @ x.T
                    s[np.arange(len(s)), i + np.arange(len(s))] = -2
                    best[i : i + 1000] = np.argpartition(s, len(x) - m, axis=1)[:, len(x) - m :]
                    cos[i : i + 1000] = np.take_along_axis(s, best[i : i + 1000], axis=1)
                floor = cos.min(axis=1) if m == k else np.full(len(x), -2, np.float32)
                ends = pa.array(np.arange(len(x) + 1, dtype=np.int32) * m)
                lists = [pa.ListArray.from_arrays(ends, pa.array(cls[best].ravel())), pa.ListArray.from_arrays(ends, pa.array(cos.ravel()))]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(floor), *lists], names=["cls", "ids", "u", "floor", "others", "cos"])

    return run


def _sent(dim: int, plan: Plan, now: Round, large: np.ndarray, blocks: np.ndarray):
    """(cls, u, floor) to (part, cls, u, codes, floor): each vector once for each task that holds one of its buckets in this round."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_thread()
        for whole in batches:
            for start in range(0, whole.num_rows, 10_000):
                batch = whole.slice(start, 10_000)
                x, cls = _vectors(batch.column(1), dim), batch.column(0).to_numpy()
                codes = np.concatenate([t * plan.buckets + probes(x, t, list(plan.widths), plan.extra) for t in range(now.first, now.last)], axis=1)
                per = codes.shape[1] // (now.last - now.first)
                own = np.tile(np.arange(codes.shape[1]) % per == 0, (len(x), 1))
                row, code = _cells(own.ravel(), codes.ravel(), np.repeat(np.arange(len(x)), codes.shape[1]), cls, large, blocks)
                part = _mixed(code >> 2) % now.of - now.at
                if now.parts < now.of:
                    some = (part >= 0) & (part < now.parts)
                    row, code, part = row[some], code[some], part[some]
                order = np.lexsort((part, row))
                row, code, part = row[order], code[order], part[order]
                first = np.flatnonzero(np.r_[True, (np.diff(row) != 0) | (np.diff(part) != 0)]) if len(row) else np.zeros(0, int)
                at = pa.array(row[first])
                lists = pa.ListArray.from_arrays(pa.array(np.r_[first, len(row)].astype(np.int32)), pa.array(code))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part[first].astype(np.int32)), batch.column(0).take(at), batch.column(1).take(at), lists, batch.column(2).take(at)],
                    names=["part", "cls", "u", "codes", "floor"],
                )

    return run


class Best:
    """The k best partners so far of each of a task's vectors; pairs are kept in a buffer and merged in bulk."""

    def __init__(self, floor: np.ndarray, k: int, cls: np.ndarray):
        count = len(cls)
        self.k, self.cls = k, cls
        self.other = np.full((count, k), -1, np.int32)
        self.cos = np.full((count, k), -2, np.float32)
        self.floor = floor.copy()  # no partner below it can be among the k best
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = 0

    def meet(self, rows: np.ndarray, others: np.ndarray, s: np.ndarray, both: bool) -> None:
        """s: cosines of rows against others, -2 where a vector meets itself; with `both` the others learn of the rows too."""
        k, (n, m) = self.k, s.shape
        new = np.flatnonzero(self.floor[rows] == -2)
        if len(new) and m > k:
            self.floor[rows[new]] = np.partition(s[new], m - k, axis=1)[:, m - k]
        i, j = np.divmod(np.flatnonzero(s >= np.maximum(self.floor[rows], -1.5)[:, None]), m)
        self.hold(rows[i], others[j], s[i, j])
        if both:
            new = np.flatnonzero(self.floor[others] == -2)
            if len(new) and n > k:
                self.floor[others[new]] = np.partition(np.ascontiguousarray(s[:, new].T), n - k, axis=1)[:, n - k]
            i, j = np.divmod(np.flatnonzero(s >= np.maximum(self.floor[others], -1.5)[None, :]), m)
            self.hold(others[j], rows[i], s[i, j])

    def hold(self, rows: np.ndarray, others: np.ndarray, cos: np.ndarray) -> None:
        self.held.append((rows, others, cos))
        self.size += len(rows)
        if self.size > 400_000:
            self.merge()

    def merge(self) -> None:
        if not self.size:
            return
        row, other, cos = (np.concatenate(x) for x in zip(*self.held))
        self.held, self.size = [], 0
        known = np.unique(row)
        old = self.other[known] >= 0
        row = np.concatenate([row, np.repeat(known, old.sum(axis=1))])
        other, cos = np.concatenate([other, self.other[known][old]]), np.concatenate([cos, self.cos[known][old]])
        # one sort by row and falling cosine, whose bits are made to sort like whole numbers; a pair may be there more than once, so more than k stay at first
        bits = cos.astype(np.float32).view(np.uint32)
        rising = np.where(bits >> 31, ~bits, bits | np.uint32(1 << 31))
        key = (row.astype(np.uint64) << np.uint64(32)) | (~rising).astype(np.uint64)
        order = np.argsort(key)
        row = row[order]
        start = np.flatnonzero(np.r_[True, np.diff(row) != 0])
        nth = np.arange(len(row)) - np.repeat(start, np.diff(np.r_[start, len(row)]))
        last = key[order[np.minimum(start + 4 * self.k, np.r_[start[1:], len(row)]) - 1]]
        some = (nth < 4 * self.k) | (key[order] == np.repeat(last, np.diff(np.r_[start, len(row)])))  # with what ties with the last
        row, order = row[some], order[some]
        other, cos, key = other[order], cos[order], key[order]
        pair = row.astype(np.int64) * len(self.cls) + other
        _, once = np.unique(pair, return_index=True)
        row, other, cos, key = row[once], other[once], cos[once], key[once]
        order = np.lexsort((self.cls[other], key))
        row, other, cos = row[order], other[order], cos[order]
        start = np.flatnonzero(np.r_[True, np.diff(row) != 0])
        nth = np.arange(len(row)) - np.repeat(start, np.diff(np.r_[start, len(row)]))
        keep = nth < self.k
        self.other[known], self.cos[known] = -1, -2
        self.other[row[keep], nth[keep]], self.cos[row[keep], nth[keep]] = other[keep], cos[keep]
        self.floor[known] = np.maximum(self.floor[known], self.cos[known, -1])  # -2 where there are fewer than k


def _compare(dim: int, k: int, chunk: int = 2048):
    """Rows of one part after the other: (part, cls, u, codes, floor) to (cls, others, cos), the k best each vector met in the part."""

    def answers(cls: np.ndarray, x: np.ndarray, floor: np.ndarray, row: np.ndarray, code: np.ndarray) -> Iterator[pa.RecordBatch]:
        best = Best(floor, k, cls)
        order = np.argsort(code, kind="stable")
        row, code = row[order], code[order]
        cell = code >> 2
        edges = np.flatnonzero(np.r_[True, np.diff(cell) != 0, True]) if len(cell) else np.zeros(0, int)
        for a, b in zip(edges, edges[1:]):
            role, r = code[a:b] & 3, row[a:b]
            members, asks = r[role != ASKS], r[role == ASKS]
            if not len(members):
                continue
            own = role[0] == MEMBER
            known = x[members]
            for at in range(0, len(members) if own and len(members) > 1 else 0, chunk):
                mine = members[at : at + chunk]
                s = known[at : at + chunk] @ known.T
                s[np.arange(len(mine)), at + np.arange(len(mine))] = -2
                best.meet(mine, members, s, False)
            for at in range(0, len(asks), chunk):
                mine = asks[at : at + chunk]
                best.meet(mine, members, x[mine] @ known.T, True)
        best.merge()
        found = best.other >= 0
        n = found.sum(axis=1)
        some = np.flatnonzero(n)
        ends = pa.array(np.r_[0, np.cumsum(n[some])].astype(np.int32))
        yield pa.RecordBatch.from_arrays([pa.array(cls[some]), pa.ListArray.from_arrays(ends, pa.array(cls[best.other[found]])), pa.ListArray.from_arrays(ends, pa.array(best.cos[found]))], names=["cls", "others", "cos"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_thread()
        held: dict[int, list] = {}

        def close(part: int) -> Iterator[pa.RecordBatch]:
            cls, x, floor, n, code = (np.concatenate(c) for c in zip(*held.pop(part)))
            yield from answers(cls, x, floor, np.repeat(np.arange(len(cls)), n), code)

        for batch in batches:
            parts = batch.column(0).to_numpy()
            cuts = np.flatnonzero(np.r_[True, np.diff(parts) != 0, True])
            for a, b in zip(cuts, cuts[1:]):
                rows = batch.slice(a, b - a)
                for other in [p for p in held if p != parts[a]]:  # parts come sorted
                    yield from close(other)
                codes = rows.column(3)
                held.setdefault(int(parts[a]), []).append((rows.column(1).to_numpy(), _vectors(rows.column(2), dim), rows.column(4).to_numpy(), codes.value_lengths().to_numpy(), codes.flatten().to_numpy()))
        for part in list(held):
            yield from close(part)

    return run


def _merge(k: int):
    """Rows come sorted by cls; the k best distinct partners of each cls go out as (cls, others, cos), the best first."""

    def best(cls: np.ndarray, other: np.ndarray, cos: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((-cos, other, cls))
        cls, other, cos = cls[order], other[order], cos[order]
        first = np.r_[True, (np.diff(cls) != 0) | (np.diff(other) != 0)] if len(cls) else np.zeros(0, bool)
        cls, other, cos = cls[first], other[first], cos[first]
        order = np.lexsort((other, -cos, cls))
        cls, other, cos = cls[order], other[order], cos[order]
        start = np.flatnonzero(np.r_[True, np.diff(cls) != 0]) if len(cls) else np.zeros(0, int)
        nth = np.arange(len(cls)) - np.repeat(start, np.diff(np.r_[start, len(cls)]))
        cls, other, cos, nth = (x[nth < k] for x in (cls, other, cos, nth))
        start = np.flatnonzero(nth == 0)
        ends = pa.array(np.r_[start, len(cls)].astype(np.int32))
        return pa.RecordBatch.from_arrays([pa.array(cls[start]), pa.ListArray.from_arrays(ends, pa.array(other)), pa.ListArray.from_arrays(ends, pa.array(cos))], names=["cls", "others", "cos"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)]
        for batch in batches:
            lengths = batch.column(1).value_lengths().to_numpy(zero_copy_only=False)
            new = [np.repeat(batch.column(0).to_numpy(), lengths), batch.column(1).flatten().to_numpy(), batch.column(2).flatten().to_numpy()]
            held = [np.concatenate(x) for x in zip(held, new)]
            done = int(np.searchsorted(held[0], held[0][-1])) if len(held[0]) else 0
            if done:
                yield best(*[x[:done] for x in held])
                held = [x[done:] for x in held]
        yield best(*held)

    return run


def _units(dim: int, arrays: bool):
    """(id, values) to (id, unit vector as bytes, its direction to COPY_DECIMALS places as a digest), for valid vectors only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = batch.column(1)
            right = pc.and_(pc.fill_null(pc.equal(pc.list_value_length(col), dim), False), pc.is_valid(batch.column(0)))
            batch = batch.filter(right)
            x = np.asarray(pc.fill_null(batch.column(1).flatten(), float("nan")), np.float64).reshape(-1, dim)
            top = np.abs(x).max(axis=1, initial=0)  # scaled first, so that squares neither vanish nor overflow
            good = np.isfinite(top) & (top > 0)
            x = x[good] / top[good][:, None]
            x /= np.sqrt((x * x).sum(axis=1))[:, None]
            grid = np.rint(x * 10**COPY_DECIMALS).astype(np.int32)
            digest = [hashlib.blake2b(g.tobytes(), digest_size=16).digest() for g in grid]
            x = x.astype(np.float32)
            out = [batch.column(0).filter(pa.array(good)), pa.array([v.tobytes() for v in x], pa.binary()), pa.array(digest, pa.binary())]
            if arrays:
                out.append(pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * dim), pa.array(x.ravel())))
            yield pa.RecordBatch.from_arrays(out, names=["id", "u", "dir", "v"][: len(out)])

    return run


def nearest_units(df: DataFrame, id_col: str, vector_col: str, dim: int = 64, arrays: bool = True) -> DataFrame:
    """(id, u, dir[, v]): the unit vectors that take part in a search, as bytes and as arrays, and their directions' digests; one for each id."""
    src = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    wanted = ["u", "dir", *(["v"] if arrays else [])]
    unit = src.mapInArrow(_units(dim, arrays), "id long, u binary, dir binary" + (", v array<float>" if arrays else ""))
    return unit.groupBy("id").agg(F.min(F.struct(*wanted)).alias("x")).select("id", *[f"x.{c}" for c in wanted])


def nearest_vectors(
    df: DataFrame, id_col: str, vector_col: str, dim: int = 64, k: int = 10,
    recall: float = 0.97, sample: int = 200, largest_block: int | None = None, task_vectors: int = 250_000, plan: Plan | None = None,
) -> DataFrame:
    """The k vectors most similar (by cosine) to each vector: (id, place, other_id, cosine).

    Vectors take part that have `dim` finite numbers, not all zero, and a non-null id; an id that comes again
    keeps its least vector. Ties in cosine go to the lower id. Directions equal to COPY_DECIMALS places are copies: one of
    them is hashed, and its copies join the lists of all that have it near, at cosine 1 among themselves, so any
    number of copies costs one search. An empty table gives an empty result; other columns are left alone.

    Each table rotates the vectors by signed Hadamard transforms and puts each in the bucket of its nearest signed axes. A vector is
    compared exactly with all members of its own bucket and of the next likely ones, and each member with all that asked it, so a pair counts for both sides.
    Numbers of tables, probes and buckets are chosen at every size (or given as `plan`): the true neighbours of `sample` vectors are found by
    one scan of all, and of the plans that meet at least `recall` of them the cheapest is taken. In a small table that is a comparison of all with all.

    A vector travels once to each task that holds one of its buckets, however many of its buckets are there. Buckets over `largest_block` members (by default a
    part of a task's share, between 1,000 and 16,384) are cut into squares of blocks, so that a task holds about `task_vectors` vectors however large a
    bucket is, and none is ever skipped. Where the copies of all vectors would take more disk than LEAST_ROOM and ROOM allow, the tables, or parts of a table, are gone
    through in rounds, each deletes its shuffles and hands on the lists as they are and, now and then, their floors: the same pairs are met.
    """
    spark = df.sparkSession
    unit, unit_at = settle(nearest_units(df, id_col, vector_col, dim, False))
    # a class of copies: its least id, its first k + 1 ids (enough for any list of k), its vector
    first = unit.withColumn("nth", F.row_number().over(Window.partitionBy("dir").orderBy("id"))).filter(F.col("nth") <= k + 1)
    classes = first.groupBy("dir").agg(F.min("id").alias("cls"), F.sort_array(F.collect_list("id")).alias("ids"), F.min_by("u", "id").alias("u"))
    lists = "others array<long>, cos array<float>"
    classes, classes_at = settle(classes.select("cls", "ids", "u").mapInArrow(_start(dim, k), f"cls long, ids array<long>, u binary, floor float, {lists}"))
    rows = classes.count()
    plan = plan or plan_for(classes, rows, dim, k, recall, sample)
    cores = max(2, spark.sparkContext.defaultParallelism)  # no more parts than keep all busy: a vector has a copy in each it visits
    limit = max(largest_block or min(16_384, max(1000, rows * plan.tables // (8 * cores))), rows * plan.tables // MOST_LARGE)

    def counted(among: np.ndarray | None = None) -> DataFrame:
        return classes.select("u").mapInArrow(_counted(dim, plan, among), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))

    cut = counted().filter(F.col("n") > limit).orderBy("bucket").collect()  # at most MOST_LARGE rows
    large = np.array([r["bucket"] for r in cut], np.int64)
    blocks = np.array([min(4096, -(-r["n"] // limit)) for r in cut], np.int64)
    visits = [rows * min(plan.extra + 1, plan.buckets)] * plan.tables
    asked = {r["bucket"]: r["n"] for r in counted(large).collect()} if cut and plan.extra else {}
    for r, b in zip(cut, blocks.tolist()):
        visits[r["bucket"] // plan.buckets] += r["n"] * (b - 1) + r["n"] * (b - 1) // 2 + asked.get(r["bucket"], 0) * (b - 1)
    rounds = rounds_for(rows, visits, cores, task_vectors, 4 * dim, 12 * k, LEAST_ROOM + ROOM * 4 * dim * rows)
    members, pairs, base, base_at = classes.filter(F.size("ids") > 1).select("cls", "ids"), classes.select("cls", *LISTS), classes, classes_at
    if len(rounds) > 1:
        members, narrow = settle(members)[0], settle(unit.select("id", "dir"))[0]
        discard(unit_at)
        unit = narrow
    pairs_at: list[str] = []
    waiting: list[str] = []  # lists of the rounds since the last merge
    for n, now in enumerate(rounds, 1):
        sent = base.select("cls", "u", "floor").mapInArrow(_sent(dim, plan, now, large, blocks), "part int, cls long, u binary, codes array<long>, floor float")
        met = sent.repartitionById(now.parts, "part").sortWithinPartitions("part").mapInArrow(_compare(dim, k), f"cls long, {lists}")
        doubled = n & (n - 1) == 0
        if len(rounds) > 1:
            met, at = settle(met)
            waiting.append(at)
            if n < len(rounds) and not doubled and sum(taken(spark, at) for at in waiting) <= WAITING * 4 * dim * rows:
                continue
            met = spark.read.schema(met.schema).parquet(*waiting)
        # a pair may be met in several tasks and rounds; the best k classes of each class stay
        pairs = pairs.unionByName(met).repartition("cls").sortWithinPartitions("cls").mapInArrow(_merge(k), f"cls long, {lists}")
        if len(rounds) == 1:
            break
        pairs, at = settle(pairs)
        for old in waiting + pairs_at:
            discard(old)
        waiting, pairs_at = [], [at]
        if n == len(rounds):
            discard(base_at)
        elif doubled:  # the floors rise most in the first rounds
            last = pairs.filter(F.size("cos") == k).select("cls", F.element_at("cos", -1).alias("last"))
            higher = base.select("cls", "u", "floor").join(last, "cls", "left").select("cls", "u", F.greatest("floor", F.least("last", F.lit(1.0).cast("float"))).alias("floor"))
            old, (base, base_at) = base_at, settle(higher)
            discard(old)
    # back from classes to ids: the copies of a class, then its neighbours' copies
    pairs = pairs.select("cls", F.explode(F.arrays_zip(*LISTS)).alias("p")).select("cls", F.col("p.others").alias("other"), F.least(F.col("p.cos").cast("double"), F.lit(1.0)).alias("cos"))
    many = members.select(F.col("cls").alias("other"), F.col("ids").alias("others"))
    lists = pairs.join(many, "other", "left").select("cls", F.explode(F.coalesce("others", F.array("other"))).alias("other_id"), "cos")
    own = members.select("cls", F.explode("ids").alias("other_id"), F.lit(1.0).alias("cos"))
    nth = Window.partitionBy("cls").orderBy(F.desc("cos"), "other_id")
    best = lists.unionByName(own).withColumn("nth", F.row_number().over(nth)).filter(F.col("nth") <= k + 1)
    best = best.groupBy("cls").agg(F.sort_array(F.collect_list(F.struct((-F.col("cos")).alias("far"), "other_id"))).alias("near"))
    sized = unit.groupBy("dir").agg(F.min("id").alias("cls"), F.count(F.lit(1)).alias("size"))
    near = sized.join(best, "cls", "inner").select("dir", "size", "near")
    out = hot_cold_join(unit.select("id", "dir"), near, "dir", "size", limit=10_000)
    others = F.slice(F.filter("near", lambda x: x["other_id"] != F.col("id")), 1, k)
    out = out.select("id", F.posexplode(others).alias("place", "n"))
    return out.select("id", (F.col("place") + 1).alias("place"), F.col("n.other_id").alias("other_id"), (-F.col("n.far")).alias("cosine"))
