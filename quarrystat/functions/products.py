"""Arrow kernels for products with the rows of a table, dense or sparse.

A dense batch is an array column; a sparse one is two columns, ``at`` (positions, ascending)
and ``v`` (values), of which only the given cells are touched. A task emits one vector for
each column of the small matrix, whatever its number of rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext

from quarrystat.functions.kernels import list_column, matrix

#: Numbers that a sparse batch may expand to at once.
EXPANDED = 4_000_000
#: Sums of pairs that a task may hold, and pairs of one step.
PAIR_SUMS, PAIR_STEP = 2_000_000, 1 << 18


class Dense:
    """A batch of rows as a matrix, the shift taken off cell by cell."""

    def __init__(self, batch, d, shift):
        x = matrix(batch, "features", d).astype(np.float64, copy=False)
        self.n = len(x)
        self.x = x if shift is None or not self.n else x - shift

    def times(self, right):
        return self.x @ right

    def back(self, y, out):
        out += self.x.T @ y

    def squares(self):
        return float(np.vdot(self.x, self.x))

    def sums(self, out):
        out += self.x.sum(0)


class Sparse:
    """A batch of rows as cells; the shift acts through sums, so that zeros stay out."""

    def __init__(self, batch, d, shift):
        at, v = (batch.column(c) for c in ("at", "v"))
        if at.null_count or v.null_count:
            raise ValueError("features: null rows")
        self.n, self.shift = len(at), shift
        sizes = np.diff(at.offsets.to_numpy())
        if (sizes != np.diff(v.offsets.to_numpy())).any():
            raise ValueError("features: positions and values differ in number")
        self.row = np.repeat(np.arange(self.n), sizes)
        self.at = at.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        self.v = v.flatten().to_numpy(zero_copy_only=False)
        if len(self.at) and (self.at.min() < 0 or self.at.max() >= d):
            raise ValueError(f"features: a position is outside 0..{d - 1}")
        self.by_column = np.argsort(self.at, kind="stable")

    def _summed(self, keys, parts, out):
        """Adds ``parts(cells)`` to ``out`` by key; the keys of the cells ascend."""
        step = max(1, EXPANDED // out.shape[1])
        for a in range(0, len(keys), step):
            k = keys[a:a + step]
            first = np.flatnonzero(np.diff(k, prepend=k[0] - 1))
            out[k[first]] += np.add.reduceat(parts(slice(a, a + step)), first)

    def times(self, right):
        out = np.zeros((self.n, right.shape[1]))
        self._summed(self.row, lambda c: right[self.at[c]] * self.v[c, None], out)
        return out if self.shift is None else out - self.shift @ right

    def back(self, y, out):
        order = self.by_column
        self._summed(self.at[order], lambda c: y[self.row[order[c]]] * self.v[order[c], None], out)
        if self.shift is not None:
            out -= np.outer(self.shift, y.sum(0))

    def squares(self):
        total = float(self.v @ self.v)
        if self.shift is not None:
            total += self.n * float(self.shift @ self.shift) - 2.0 * float(self.v @ self.shift[self.at])
        return total

    def sums(self, out):
        out += np.bincount(self.at, self.v, len(out))
        if self.shift is not None:
            out -= self.n * self.shift


def _emit(v: np.ndarray, fan: int):
    part = TaskContext.get().partitionId() % fan
    for at in range(0, len(v), max(1, EXPANDED // v.shape[1])):
        some = v[at:at + max(1, EXPANDED // v.shape[1])]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(some), part, np.int32)), pa.array(np.arange(at, at + len(some), dtype=np.int32)),
             list_column(some)], names=["part", "c", "v"])


def gram_times_kernel(d: int, right: np.ndarray, shift=None, sparse: bool = False, fan: int = 1, target: str | None = None):
    """``(part, c, v)``: partial sums of column c of X' (X right), then the sum of squares of
    X and the row count. X are the rows less ``shift``.

    With ``target`` the last column of ``X right`` is replaced by what it leaves of that
    column: X' (target - X right[:, -1]); the sum of squares is then that of the rest.
    """
    rows = Sparse if sparse else Dense

    def run(batches):
        acc, squares, n = np.zeros(right.shape), 0.0, 0
        for batch in batches:
            x = rows(batch, d, shift)
            if not x.n:
                continue
            y = x.times(right)
            if target is None:
                squares += x.squares()
            else:
                goal = batch.column(target)
                if goal.null_count:
                    raise ValueError(f"nulls in {target}")
                y[:, -1] = goal.to_numpy() - y[:, -1]
                squares += float(y[:, -1] @ y[:, -1])
            x.back(y, acc)
            n += x.n
        if n:
            tail = np.tile([squares, float(n)], (right.shape[1], 1))
            yield from _emit(np.hstack([acc.T, tail]), fan)
    return run


def column_sum_kernel(d: int, shift=None, sparse: bool = False, fan: int = 1):
    """``(part, c, v)`` with c = 0: partial column sums, then the row count."""
    rows = Sparse if sparse else Dense

    def run(batches):
        acc, n = np.zeros(d), 0
        for batch in batches:
            x = rows(batch, d, shift)
            if x.n:
                x.sums(acc)
                n += x.n
        if n:
            yield from _emit(np.append(acc, float(n))[None, :], fan)
    return run


def sparse_product_kernel(keep: list[str], right: np.ndarray, out: str, shift=None):
    """Sparse rows (less ``shift``) times a small matrix: the columns of ``keep`` plus ``out``."""
    def run(batches):
        for batch in batches:
            x = Sparse(batch, len(right), shift)
            if x.n:
                yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [list_column(x.times(right))], names=[*keep, out])
    return run


def _pair_batch(d, key, value):
    return pa.RecordBatch.from_arrays([pa.array((key // d).astype(np.int32)), pa.array((key % d).astype(np.int32)),
                                       pa.array(value)], names=["i", "j", "value"])


class _PairSums:
    """Sums of products by pair of columns, folded whenever ``most`` are held."""

    def __init__(self, d, most):
        self.d, self.most, self.keys, self.sums, self.held = d, most, [], [], 0

    def add(self, key, value):
        self.keys.append(key)
        self.sums.append(value)
        self.held += len(key)

    def fold(self):
        key, value = np.concatenate(self.keys), np.concatenate(self.sums)
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.diff(key, prepend=-1))
        self.keys, self.sums, self.held = [key[first]], [np.add.reduceat(value[order], first)], len(first)

    def batches(self, everything=False):
        """What must go out now: all at the end, or when folding leaves more than half."""
        if not self.held or not (everything or self.held > self.most):
            return
        self.fold()
        if everything or self.held > self.most // 2:
            key, value = self.keys[0], self.sums[0]
            self.keys, self.sums, self.held = [], [], 0
            yield _pair_batch(self.d, key, value)


class _PairMatrix:
    """Sums of products by pair of columns where every pair has its place; a task holds one."""

    def __init__(self, d):
        self.d, self.sums, self.met = d, np.zeros(d * d), np.zeros(d * d, bool)

    def add(self, key, value):
        np.add.at(self.sums, key, value)
        self.met[key] = True

    def batches(self, everything=False):
        if everything:
            key = np.flatnonzero(self.met)
            for at in range(0, len(key), PAIR_STEP):
                some = key[at:at + PAIR_STEP]
                yield _pair_batch(self.d, some, self.sums[some])


def pair_kernel(d: int, most: int = PAIR_SUMS):
    """``(i, j, value)``: partial sums of x_i x_j, i <= j, over pairs of cells that are there.

    The work is the number of such pairs; equal pairs are added up before they leave the task,
    in a matrix if it has at most ``most`` cells, else in sorted runs of so many. Memory does not
    grow with the rows.
    """
    def run(batches):
        held = _PairMatrix(d) if d * d <= most else _PairSums(d, most)
        step = max(1, min(PAIR_STEP, most // 4))
        for batch in batches:
            x = Sparse(batch, d, None)
            nnz = len(x.at)
            if not nnz:
                continue
            ends = np.cumsum(np.bincount(x.row, minlength=x.n))
            partners = ends[x.row] - np.arange(nnz)                # cells of the row from this one on
            upto = np.cumsum(partners)
            at = 0
            while at < nnz:
                base = upto[at - 1] if at else 0
                to = max(at + 1, int(np.searchsorted(upto, base + step, side="right")))
                left = np.repeat(np.arange(at, to), partners[at:to])
                right = np.arange(len(left)) - np.repeat(upto[at:to] - partners[at:to] - base, partners[at:to]) + left
                held.add(x.at[left] * d + x.at[right], x.v[left] * x.v[right])
                yield from held.batches()
                at = to
        yield from held.batches(everything=True)
    return run
