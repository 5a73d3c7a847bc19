"""Training of the vector machine by working sets, for rows that the driver does not hold.

Copies (rows of the same label and features) are one unknown, the sum of their coefficients, with
the sum of their bounds, which fills one copy after the other. The unknowns lie packed in files. The driver
keeps a digest and a number for each row, and a few numbers for each unknown (label, copies,
coefficient, gradient), picks those that violate the conditions most and the free ones, closes their
gap by steps of two, and a pass over the files adds what they changed to every gradient. The first
coefficients come from a model of the kernel by its constant and linear terms; they save passes
only: the gradient is computed from the whole kernel, and training ends when its gap is closed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.store import setting, settle, ship
from .cf import packed_row, unpacked
from .sorting import with_position

#: Rows of a packed block, most rows of a file (a pass is short, so there are as many files as cores before that), rows and columns of a tile of the kernel, which stays in a core's cache.
BLOCK, FILE_ROWS, STRIP, TILE = 1_024, 32_768, 128, 512
#: The most violating rows of a working set, and the most free ones beside them; columns that go to the tasks at once.
WORKING, COLUMNS = 2_048, 16_384
#: The first coefficients are modelled up to so many features, and are 0 beyond.
START_FEATURES = 512
#: The dampings that a Newton step tries in one pass, times that of the step before.
DAMPINGS = 10 ** np.arange(-1.5, 1.6, 0.5)
PACKED = "block long, kind int, data binary"


def kernel(x: np.ndarray, b: np.ndarray, gamma: float) -> np.ndarray:
    k = x @ b.T
    k *= 2
    k -= (x * x).sum(1)[:, None]
    k -= (b * b).sum(1)
    k *= gamma
    return np.exp(k, out=k)


def columns_of(b: np.ndarray, gamma: float) -> np.ndarray:
    """The rows b as columns of the kernel: times the rows x that `weighted` makes, they give the exponents."""
    return np.column_stack([b, np.ones(len(b)), -gamma * (b * b).sum(1)])


def weighted(x: np.ndarray, columns: np.ndarray, w: np.ndarray, gamma: float, back: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The kernels of the rows x with the columns, times w; and the kernels of the columns with the rows, times back if given."""
    left, out, other = np.column_stack([2 * gamma * x, -gamma * (x * x).sum(1), np.ones(len(x))]), np.zeros(len(x)), np.zeros(len(columns))
    for j in range(0, len(columns), TILE):
        right, each = columns[j : j + TILE].T, w[j : j + TILE]
        for i in range(0, len(x), STRIP):
            k = left[i : i + STRIP] @ right
            out[i : i + STRIP] += np.exp(k, out=k) @ each
            if back is not None:
                other[j : j + TILE] += back[i : i + STRIP] @ k
    return out, other


def _features(f: pa.ListArray) -> np.ndarray:
    lengths = pc.unique(pc.list_value_length(f)).to_pylist()
    if len(lengths) != 1 or lengths[0] is None:
        raise ValueError("rows must have the same number of features")
    return f.flatten().to_numpy(zero_copy_only=False).reshape(len(f), lengths[0])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(place, digest of label and features) packed, of (place, y, features)."""
    for b in batches:
        if len(b):
            rows = np.column_stack([b.column(1).to_numpy(), _features(b.column(2))]) + 0.0  # no negative zeros
            yield packed_row(0, 0, (b.column(0).to_numpy(), np.frombuffer(b"".join(blake2b(r, digest_size=16).digest() for r in rows), "u8").reshape(-1, 2)))


def _blocks(b: pa.RecordBatch, number: np.ndarray, copies: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(number, y, copies, features) packed, of (place, y, features) and the places' numbers, -1 for those left out; features that are single-precision numbers are kept as such."""
    place = b.column(0).to_numpy()
    b = b.filter(pa.array(number[place] >= 0))
    for lo in range(0, len(b), BLOCK):
        part = b.slice(lo, BLOCK)
        at, x = number[part.column(0).to_numpy()], _features(part.column(2))
        small = x.astype(np.float32)
        yield packed_row(0, 0, (at, part.column(1).to_numpy(), copies[at], small if np.array_equal(small, x) else x))


def pair_steps(k: np.ndarray, y: np.ndarray, a: np.ndarray, f: np.ndarray, cost: np.ndarray, epsilon: float, gap: float) -> int:
    """Changes a and f, each a within 0 and its cost, until the gap is `gap` at most. The first of a pair violates most, the second gains most with it."""
    pos, steps = y > 0, 0
    up, down = np.where(pos, a < cost - epsilon, a > epsilon), np.where(pos, a > epsilon, a < cost - epsilon)
    while True:
        h = int(np.where(up, f, np.inf).argmin())
        more = np.where(down, f - f[h], -np.inf)
        if not up[h] or not more.max() > gap:
            return steps
        eta = np.maximum(2 - 2 * k[h], 1e-12)
        low = int(np.where(more > 0, more * more / eta, -1.0).argmax())
        t = min(more[low] / eta[low], cost[h] - a[h] if pos[h] else a[h], a[low] if pos[low] else cost[low] - a[low])
        a[h] += t * y[h]
        a[low] -= t * y[low]
        f += t * (k[h] - k[low])
        for i in (h, low):
            up[i], down[i] = (a[i] < cost[i] - epsilon, a[i] > epsilon) if pos[i] else (a[i] > epsilon, a[i] < cost[i] - epsilon)
        steps += 1


class Rows:
    """The packed unknowns and the passes over them. group: each place's unknown; copies: each unknown's rows."""

    def __init__(self, p: DataFrame):
        self.spark = p.sparkSession
        ship(self.spark)
        self.numbered = with_position(p.select("id", "y", "f"), [F.col("id")], "place")
        three = self.numbered.select("place", "y", "f")
        found = [unpacked(r.data) for r in three.mapInArrow(_digests, PACKED).select("data").collect()]
        place, digest = (np.concatenate(x) for x in zip(*found))
        _, first, which, count = np.unique(digest[np.argsort(place)], axis=0, return_index=True, return_inverse=True, return_counts=True)
        order = np.argsort(first)  # an unknown's number is by its first row
        number, rank = np.full(len(place), -1), np.empty(len(first), int)
        rank[order] = number[first[order]] = np.arange(len(first))
        self.group, self.copies = rank[which.ravel()], count[order].astype(float)
        sent = self.spark.sparkContext.broadcast((number, self.copies))

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield from _blocks(b, *sent.value)

        self.parts = max(min(self.spark.sparkContext.defaultParallelism, -(-len(first) // BLOCK)), -(-len(first) // FILE_ROWS))
        self.files = settle(three.mapInArrow(pack, PACKED).repartition(self.parts), "svm-rows")
        sent.destroy()

    def each(self, value: object, of: Callable[[object, tuple], tuple | None], join: Callable[[list[tuple]], tuple] | None = None) -> list[tuple]:
        """of(value, (number, y, copies, features)) of every block; those of a task are joined, if that is given. The value goes to the executors once and is dropped there."""
        sent = self.spark.sparkContext.broadcast(value)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            all_ = []
            for batch in batches:
                for data in batch.column(0).to_pylist():
                    *rest, x = unpacked(data)
                    if (made := of(sent.value, (*rest, x.astype(np.float64)))) is None:
                        continue
                    if join:
                        all_.append(made)
                    else:
                        yield packed_row(0, 0, made)
            if all_:
                yield packed_row(0, 0, join(all_))

        with setting(self.spark, "spark.sql.files.minPartitionNum", str(self.parts)):  # a task for each file
            found = [unpacked(r.data) for r in self.files.select("data").mapInArrow(run, PACKED).select("data").collect()]
        sent.destroy()
        return found

    def features(self, numbers: np.ndarray) -> np.ndarray:
        """The features of these unknowns, in ascending order."""

        def of(wanted: np.ndarray, block: tuple) -> tuple | None:
            number, _, _, x = block
            at = np.isin(number, wanted)
            return (number[at], x[at]) if at.any() else None

        found = self.each(numbers, of)
        order = np.argsort(np.concatenate([x[0] for x in found]))
        return np.concatenate([x[1] for x in found])[order]

    def add(self, f: np.ndarray, x: np.ndarray, weights: np.ndarray, gamma: float) -> None:
        """Adds the weighted kernels with the rows x to every f."""

        def of(value: tuple, block: tuple) -> tuple:
            return block[0], weighted(block[3], *value, gamma)[0]

        for number, change in self.each((columns_of(x, gamma), weights), of):
            f[number] += change

    def add_all(self, f: np.ndarray, weights: np.ndarray, gamma: float, columns: int) -> None:
        """Adds the weighted kernels with all rows to every f. The kernel of two rows is computed once and counts for both, but for two whose columns go together."""
        some = np.flatnonzero(weights)
        turn = np.full(len(f), len(some))  # when a row's column goes; later than any if it has no weight
        turn[some] = np.arange(len(some)) // columns

        def of(value: tuple, block: tuple) -> tuple | None:
            now, turn, weights, b, w = value
            wanted = turn[block[0]] >= now
            number = block[0][wanted]
            if not len(number):
                return None
            return number, *weighted(block[3][wanted], b, w, gamma, np.where(turn[number] > now, weights[number], 0.0))

        def join(made: list[tuple]) -> tuple:
            number, change, back = zip(*made)
            return np.concatenate(number), np.concatenate(change), sum(back)

        for now, lo in enumerate(range(0, len(some), columns)):
            at = some[lo : lo + columns]
            for number, change, back in self.each((now, turn, weights, columns_of(self.features(at), gamma), weights[at]), of, join):
                f[number] += change
                f[at] += back


def _terms(block: tuple, gamma: float) -> tuple[np.ndarray, np.ndarray]:
    """y x the kernel's constant and linear features and 1 for the threshold, and what they leave of the kernel's diagonal."""
    _, y, _, x = block
    s = np.exp(-gamma * (x * x).sum(1))[:, None]
    z = np.concatenate([s, np.sqrt(2 * gamma) * x * s], axis=1)
    return np.concatenate([z, np.ones((len(x), 1))], axis=1) * y[:, None], np.maximum(1 - (z * z).sum(1), 1e-3)


def first_coefficients(rows: Rows, y: np.ndarray, features: int, gamma: float, cost: float) -> np.ndarray:
    """Coefficients in the box with a signed sum of 0: those of the kernel's constant and linear terms, with the rest on the diagonal.

    That problem has a few unknowns (a weight for each term and the threshold), found by damped Newton steps, a pass for each, which tries several dampings.
    """
    n, m = len(y), features + 2
    keep = np.ones(m)
    keep[-1] = 0.0  # the threshold is free

    def at(w: np.ndarray, terms: np.ndarray, rest: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        u = 1 - terms @ w
        return u, np.clip(u / rest, 0, most)

    def sums(tries: np.ndarray, block: tuple) -> tuple[np.ndarray, ...]:
        terms, rest = _terms(block, gamma)
        most, found = cost * block[2], []
        for w in tries:
            u, a = at(w, terms, rest, most)
            free = (u > 0) & (u < most * rest)
            found.append((float((a * u - rest * a * a / 2).sum()), terms.T @ a, (terms[free] / rest[free, None]).T @ terms[free]))
        return tuple(np.array(x) for x in zip(*found))

    added = lambda made: tuple(sum(x) for x in zip(*made))

    def losses(tries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        value, slope, curve = added(rows.each(tries, sums, added))
        return value + (keep * tries * tries).sum(1) / 2, keep * tries - slope, np.diag(keep) + curve

    w, scale = np.zeros(m), float(rows.copies.sum())
    damping, ((value,), (slope,), (curve,)) = scale, losses(w[None])
    for _ in range(60):
        tries = damping * DAMPINGS
        new = np.array([w - np.linalg.solve(curve + np.diag(np.full(m, x)), slope) for x in tries])
        found = losses(new)
        best = int(found[0].argmin())
        gain = value - found[0][best]
        if gain > 0:
            w, (value, slope, curve), damping = new[best], (x[best] for x in found), tries[best]
            if gain < 1e-6 * abs(value) and damping < scale:
                break
        else:
            damping *= 1e3
            if damping > 1e9 * scale:
                break
    a = np.zeros(n)
    for number, part in rows.each(w, lambda w, block: (block[0], at(w, *_terms(block, gamma), cost * block[2])[1])):
        a[number] = part
    left = float((a * y).sum())
    heavy = np.flatnonzero(y == np.sign(left))
    taken = np.minimum(np.cumsum(a[heavy]), abs(left))
    a[heavy] -= np.diff(taken, prepend=0.0)
    return np.clip(a, 0, cost * rows.copies)


def train(p: DataFrame, gamma: float, cost: float, tolerance: float, epsilon: float, working: int = WORKING, columns: int = COLUMNS) -> tuple[DataFrame, float, int]:
    """(id, y, alpha, f), the threshold and the number of steps, of prepared rows (id, y, f)."""
    rows = Rows(p)
    found = rows.each(None, lambda _, block: (block[0], block[1], block[3].shape[1]))
    n, features = len(rows.copies), max(x[2] for x in found)
    y, a = np.empty(n), np.zeros(n)
    for number, label, _ in found:
        y[number] = label
    f = -y
    bound = cost * rows.copies
    most = bound - epsilon
    if features <= START_FEATURES:
        a = first_coefficients(rows, y, features, gamma, cost)
        rows.add_all(f, a * y, gamma, columns)
        if not a.sum() - (a * y * (f + y)).sum() / 2 > 0:  # no better than none
            a, f = np.zeros(n), -y
    pos, steps = y > 0, 0
    while True:
        up, down = np.where(pos, a < most, a > epsilon), np.where(pos, a > epsilon, a < most)
        high, low = np.where(up, f, np.inf), np.where(down, f, -np.inf)
        b_high, b_low = high.min(), low.max()
        if not b_low > b_high + 2 * tolerance:
            break
        half = min(working // 2, n) - 1
        at = np.concatenate([np.argpartition(high, half)[: half + 1], np.argpartition(-low, half)[: half + 1]])
        at = at[(high[at] < b_low) | (low[at] > b_high)]
        free = np.flatnonzero(up & down)
        free = free[np.argsort(-np.abs(f[free] - (b_high + b_low) / 2), kind="stable")[:working]]
        at = np.union1d(at, free)
        x, new, g = rows.features(at), a[at], f[at]
        steps += pair_steps(kernel(x, x, gamma), y[at], new, g, bound[at], epsilon, max(tolerance, (b_low - b_high) / 10))
        moved = np.flatnonzero(new != a[at])
        rows.add(f, x[moved], (new - a[at])[moved] * y[at[moved]], gamma)
        a[at] = new
    order = np.argsort(rows.group, kind="stable")
    full = np.empty(len(order))  # what the copies before a row take
    full[order] = cost * (np.arange(len(order)) - (np.cumsum(rows.copies) - rows.copies)[rows.group[order]])
    sent = rows.spark.sparkContext.broadcast((np.clip(a[rows.group] - full, 0, cost), f[rows.group]))

    def state(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            place = b.column(2).to_numpy()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(x[place]) for x in sent.value)], ["id", "y", "alpha", "f"])

    kind = T.StructType([T.StructField("id", p.schema["id"].dataType), *(T.StructField(c, T.DoubleType()) for c in ("y", "alpha", "f"))])
    return settle(rows.numbered.select("id", "y", "place").mapInArrow(state, kind), "svm-state"), float(b_low + b_high) / 2, steps
