"""Arrow kernels: one numpy pass over each batch of a partition.

Each builder returns a function for ``mapInArrow``.  State inside a task is
bounded by the number of features, never by the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext

SIGN = np.int64(-(2 ** 63))
# Counts that a task may hold, cells of one numpy step, and bytes of rows held for counting.
COUNT_CELLS, SLICE_CELLS, HELD_BYTES = 8_000_000, 4_000_000, 32 << 20
# Below this share of the norms a distance is taken from differences.
FEW_DIGITS = 1e-3


def matrix(batch, name: str, d: int | None = None) -> np.ndarray:
    """The array column ``name`` as an n x d matrix; refuses ragged rows and,
    where ``d`` is given, rows of another width."""
    col = batch.column(name)
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    n = len(col)
    if pa.types.is_binary(col.type):
        return _packed(col, n, d)
    flat = col.flatten()
    if col.null_count or flat.null_count:
        raise ValueError(f"{name}: nulls are not allowed, use NaN for missing values")
    if n == 0:
        return np.zeros((0, 0))
    sizes = np.diff(col.offsets.to_numpy())
    if (sizes != (sizes[0] if d is None else d)).any():
        raise ValueError(f"{name}: rows differ in width")
    return flat.to_numpy(zero_copy_only=False).reshape(n, int(sizes[0]))


def _packed(col, n: int, d: int | None) -> np.ndarray:
    """Rows of small integers stored as bytes by :func:`pack_kernel`."""
    if n == 0:
        return np.zeros((0, 0), np.int16)
    _, ends, data = col.buffers()
    ends = np.frombuffer(ends, np.int32)[col.offset:col.offset + n + 1]
    size = ends[1] - ends[0] if d is None else 2 * d
    if col.null_count or (np.diff(ends) != size).any():
        raise ValueError("packed rows differ in width")
    return np.frombuffer(data, np.int16)[ends[0] // 2:ends[-1] // 2].reshape(n, size // 2)


def pack_kernel(name: str, keep: list[str]):
    """An array of small integers as bytes: cheap to cache and to hand over."""
    def run(batches):
        for batch in batches:
            x = matrix(batch, name)
            if not len(x):
                continue
            if x.min() < -(1 << 15) or x.max() >= 1 << 15:
                raise ValueError("states must fit 16 bits to be packed")
            raw = np.ascontiguousarray(x, np.int16)
            ends = pa.array(np.arange(len(x) + 1, dtype=np.int32) * (2 * x.shape[1]))
            packed = pa.Array.from_buffers(pa.binary(), len(x),
                                           [None, ends.buffers()[1], pa.py_buffer(raw)])
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [packed],
                                             names=keep + [name])
    return run


def list_column(m: np.ndarray, kind=None) -> pa.Array:
    """An n x d matrix as an Arrow list column."""
    n, d = m.shape
    offsets = pa.array(np.arange(n + 1, dtype=np.int32) * d)
    return pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(m).reshape(-1), type=kind))


def gram_kernel(name: str, d: int, rows: tuple[int, int], shift=None, fan: int = 1):
    """Partial sums of x_i * x_j for i in ``rows`` and every j >= i.

    ``shift`` is subtracted first.  A task emits ``(part, i, v)`` once for each i: v
    holds the products with columns i to d - 1, then the sum of column i and the row
    count.  ``part`` is the task's number modulo ``fan``.
    """
    lo, hi = rows

    def run(batches):
        acc, sums, n = 0.0, 0.0, 0
        for batch in batches:
            x = matrix(batch, name, d).astype(np.float64, copy=False)
            if not len(x):
                continue
            if shift is not None:
                x = x - shift
            acc = acc + x[:, lo:hi].T @ x[:, lo:]
            sums = sums + x[:, lo:hi].sum(0)
            n += len(x)
        if not n:
            return
        part = TaskContext.get().partitionId() % fan
        step = max(1, (1 << 20) // (d - lo + 2))
        for at in range(0, hi - lo, step):
            r = np.arange(at, min(at + step, hi - lo))
            v = np.column_stack([acc[r], sums[r], np.full(len(r), float(n))])
            upper = np.arange(v.shape[1]) >= r[:, None]
            ends = np.concatenate([[0], np.cumsum(upper.sum(1))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(r), part, np.int32)), pa.array((r + lo).astype(np.int32)),
                 pa.ListArray.from_arrays(pa.array(ends), pa.array(v[upper]))], names=["part", "i", "v"])
    return run


def product_kernel(name: str, keep: list[str], right: np.ndarray, out: str, shift=None):
    """Rows times a small matrix: the columns of ``keep`` plus ``out``."""
    def run(batches):
        for batch in batches:
            x = matrix(batch, name, right.shape[0]).astype(np.float64, copy=False)
            if not len(x):
                continue
            if shift is not None:
                x = x - shift
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in keep] + [list_column(x @ right)], names=keep + [out])
    return run


def _rows_with_few_gaps(x: np.ndarray, check, limit: int | None) -> np.ndarray:
    """Rows of x with at most ``limit`` NaNs among the columns ``check``."""
    if limit is None:
        return x
    return x[np.isnan(x[:, check]).sum(1) <= limit]


def profile_kernel(name: str, d: int, check=None, limit: int | None = None):
    """``(j, nans, n, total)`` per column over rows with few enough gaps.

    ``total`` sums the values that are there.  Emitted once per task.
    """
    def run(batches):
        nans = total = None
        n = 0
        for batch in batches:
            x = matrix(batch, name, d)
            if not len(x):
                continue
            x = _rows_with_few_gaps(x, check, limit)
            gone = np.isnan(x)
            k, t = gone.sum(0), np.where(gone, 0.0, x).sum(0)
            nans, total = (k, t) if nans is None else (nans + k, total + t)
            n += len(x)
        if nans is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(d, dtype=np.int32)), pa.array(nans.astype(np.int64)),
                 pa.array(np.full(d, n, np.int64)), pa.array(total)],
                names=["j", "nans", "n", "total"])
    return run


def fill_kernel(name: str, keep: list[str], cols, fill, check=None, limit: int | None = None):
    """Rows with few enough gaps, cut down to ``cols``, NaNs set to ``fill``."""
    def run(batches):
        for batch in batches:
            x = matrix(batch, name)
            if not len(x):
                continue
            good = np.ones(len(x), bool)
            if limit is not None:
                good = np.isnan(x[:, check]).sum(1) <= limit
            y = x[np.ix_(good, cols)]
            y = np.where(np.isnan(y), fill, y)
            rest = batch.select(keep).filter(pa.array(good))
            yield pa.RecordBatch.from_arrays(rest.columns + [list_column(y)], names=keep + [name])
    return run


def sortable(values: np.ndarray) -> np.ndarray:
    """Unsigned keys in the order of the doubles; NaN above everything."""
    v = values.astype(np.float64) + 0.0
    v[np.isnan(v)] = np.nan
    bits = v.view(np.int64)
    return np.where(bits < 0, ~bits, bits | SIGN).view(np.uint64)


def unsortable(keys: np.ndarray) -> np.ndarray:
    """Inverse of :func:`sortable`."""
    k = keys.view(np.int64)
    return np.where(k < 0, k & ~SIGN, ~k).view(np.float64)


def first_bits(d: int, cells: int) -> int:
    """Key bits of a first histogram of d features in ``cells`` cells: 4 to 16."""
    return max(4, min(16, (cells // max(d, 1)).bit_length() - 1))


class _Histogram:
    """Rows by cell, and whether a cell holds one value only."""

    def __init__(self, size: int):
        self.cnt, self.seen, self.mixed = np.zeros(size, np.int64), np.zeros(size, np.uint64), np.zeros(size, bool)

    def add(self, cell, key):
        open_ = np.flatnonzero(~self.mixed[cell])
        if len(open_):
            c, k = cell[open_], key[open_]
            fresh = self.cnt[c] == 0
            self.seen[c[fresh]] = k[fresh]
            self.mixed[c[self.seen[c] != k]] = True
        self.cnt += np.bincount(cell, minlength=len(self.cnt))


def _cell_batch(j, lead, digit, cnt, lo, hi):
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(digit), j, np.int32)), pa.array(lead), pa.array(digit.astype(np.int32)),
         pa.array(cnt), pa.array(lo), pa.array(hi)], names=["j", "prefix", "digit", "cnt", "lo", "hi"])


def digit_kernel(name: str, cols: list[int] | None, prefixes: list[np.ndarray] | None, done: int, bits: int,
                 cells: int):
    """Histogram of the next ``bits`` key bits per feature and prefix.

    ``cols`` names the features that the array holds, ``prefixes`` the sorted distinct leading
    ``done`` bits still of interest for each. In the first round both are None: all features,
    and as many bits as ``cells`` allows; a task then also emits one row with j = -1, its row
    count in ``cnt`` and its width in ``lo`` and ``hi``. Emits ``(j, prefix, digit, cnt, lo, hi)``
    for the cells that occur, once per task; ``lo`` and ``hi`` differ when a cell holds more
    than one value.
    """
    def run(batches):
        held: dict[int, _Histogram] = {}
        rows, d, width = 0, 0, bits
        for batch in batches:
            x = matrix(batch, name, d or None)
            if not len(x):
                continue
            if not d:
                d = x.shape[1]
                width = bits if cols is not None else first_bits(d, cells)
                shift, mask = np.uint64(64 - done - width), np.uint64((1 << width) - 1)
            rows += len(x)
            # feature-major, so that every column is read in one run
            for c, key in enumerate(sortable(np.ascontiguousarray(x.T))):
                slots = 1
                if prefixes is None:
                    cell = (key >> shift).astype(np.int64)
                else:
                    want = prefixes[c]
                    slots = len(want)
                    if not slots:
                        continue
                    lead = key >> np.uint64(64 - done)
                    slot = np.minimum(np.searchsorted(want, lead), slots - 1)
                    hit = np.flatnonzero(want[slot] == lead)
                    key = key[hit]
                    cell = (slot[hit] << width) + ((key >> shift) & mask).astype(np.int64)
                if c not in held:
                    held[c] = _Histogram(slots << width)
                held[c].add(cell, key)
        if rows and cols is None:
            one = np.zeros(1, np.int64)
            yield _cell_batch(-1, one, one, one + rows, one + d, one + d)
        for c, h in held.items():
            at = np.flatnonzero(h.cnt)
            if not len(at):
                continue
            lead = np.zeros(len(at), np.uint64) if prefixes is None else prefixes[c][at >> width]
            # keys as signed numbers; a mixed cell is marked by two unequal ends
            lo = h.seen[at].view(np.int64)
            hi = np.where(h.mixed[at], lo ^ 1, lo)
            yield _cell_batch(c if cols is None else cols[c], lead.view(np.int64), at & ((1 << width) - 1),
                              h.cnt[at], np.minimum(lo, hi), np.maximum(lo, hi))
    return run


def gather_kernel(name: str, cols: list[int], prefixes: list[np.ndarray], done: int):
    """Values whose leading ``done`` bits are wanted: ``(j, prefix, v, cnt)``.

    Ties are folded inside each batch.
    """
    def run(batches):
        for batch in batches:
            x = matrix(batch, name, len(cols))
            for c, j in enumerate(cols) if len(x) else ():
                want = prefixes[c]
                if not len(want):
                    continue
                key = sortable(x[:, c])
                if done:
                    lead = key >> np.uint64(64 - done)
                    slot = np.minimum(np.searchsorted(want, lead), len(want) - 1)
                    key = key[want[slot] == lead]
                vals, cnt = np.unique(key, return_counts=True)
                k = len(vals)
                if k:
                    lead = vals >> np.uint64(64 - done) if done else np.zeros(k, np.uint64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(k, j, np.int32)), pa.array(lead.view(np.int64)),
                         pa.array(unsortable(vals)), pa.array(cnt.astype(np.int64))],
                        names=["j", "prefix", "v", "cnt"])
    return run


def bin_kernel(name: str, keep: list[str], cuts: np.ndarray, out: str, top: int | None = None, kind=np.int16):
    """Number of cuts strictly below each value, as an array of ``kind``."""
    def run(batches):
        for batch in batches:
            x = matrix(batch, name, len(cuts))
            if not len(x):
                continue
            b = np.empty(x.shape, kind)
            for j in range(x.shape[1]):
                b[:, j] = np.searchsorted(cuts[j], x[:, j], side="left")
            if top is not None:
                np.minimum(b, top, out=b)
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in keep] + [list_column(b)], names=keep + [out])
    return run


def row_bin_kernel(keep: list[str], levels: int):
    """Equal-frequency bins inside each row; the last value is the label."""
    def run(batches):
        for batch in batches:
            x = matrix(batch, "features")
            if not len(x):
                continue
            step = x.shape[1] // levels
            if step == 0:
                raise ValueError(f"{levels} levels for {x.shape[1]} values")
            cuts = np.sort(x, axis=1)[:, step - 1:levels * step:step]
            b = np.zeros(x.shape, np.int32)
            for k in range(levels):
                b += cuts[:, k:k + 1] < x
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in keep] + [list_column(b[:, :-1]), pa.array(b[:, -1])],
                names=keep + ["features", "label"])
    return run


class _JointCounts:
    """Dense counts features x reference codes x states, growing by doubling."""

    def __init__(self, d: int, most: int):
        self.d, self.most = d, most
        self.clear()

    def clear(self):
        self.codes: dict[int, int] = {}
        self.acc = np.zeros((self.d, 0, 0), np.int64)

    def fits(self, fresh: int, states: int) -> bool:
        """Makes room for ``fresh`` more codes and ``states`` states if the bound allows it."""
        _, r, k = self.acc.shape
        codes, states = len(self.codes) + fresh, max(states, k)
        if codes > r or states > k:
            r, k2 = (max(codes, 2 * r) if codes > r else r), states
            if self.d * r * k2 > self.most:
                r = codes
            if self.d * r * k2 > self.most:
                return False
            acc = np.zeros((self.d, r, k2), np.int64)
            acc[:, :self.acc.shape[1], :k] = self.acc
            self.acc = acc
        return True

    def cells(self):
        j, r, b = np.nonzero(self.acc)
        codes = np.zeros(self.acc.shape[1], np.int64)
        codes[:len(self.codes)] = list(self.codes)
        return j, codes[r], b, self.acc[j, r, b]


def _count_batch(j, code, b, cnt):
    y = ((code + (1 << 31)) & 0xFFFFFFFF) - (1 << 31)
    return pa.RecordBatch.from_arrays(
        [pa.array(j.astype(np.int32)), pa.array((code - y) >> 32), pa.array(y),
         pa.array(b.astype(np.int32)), pa.array(cnt)], names=["j", "s", "y", "b", "cnt"])


def count_kernel(name: str, d: int, sel: int | None, refs: list[str], most: int = COUNT_CELLS):
    """Joint counts ``(j, s, y, b, cnt)`` of every feature with one reference.

    ``s`` is the bin of feature ``sel`` or the first column of ``refs``; ``y``
    is the next column of ``refs`` or 0.  References are 32-bit integers.  A task
    keeps at most ``most`` counts. Where more would be needed, what it holds is sent
    on and it starts anew; a batch that alone needs more is counted by sorting, feature
    by feature. The counts of a cell then arrive in parts.
    """
    def run(batches):
        held = _JointCounts(d, most)
        for batch in batches:
            b = matrix(batch, name, d)
            if not len(b):
                continue
            if any(batch.column(c).null_count for c in refs):
                raise ValueError(f"nulls in {refs}: give missing labels a state of their own")
            ref = [batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in refs]
            if sel is not None:
                ref.insert(0, b[:, sel].astype(np.int64))
            if not ref:
                ref = [np.zeros(len(b), np.int64)]
            y = ref[1] if len(ref) > 1 else 0
            joint, place = np.unique((ref[0] << 32) + y, return_inverse=True)
            states = int(b.max()) + 1
            by_feature = np.ascontiguousarray(b.T)
            if not held.fits(sum(c not in held.codes for c in joint.tolist()), states):
                if len(held.codes):
                    yield _count_batch(*held.cells())
                held.clear()
                if not held.fits(len(joint), states):
                    for j, col in enumerate(by_feature):
                        cell, cnt = np.unique(place * states + col, return_counts=True)
                        yield _count_batch(np.full(len(cell), j), joint[cell // states], cell % states, cnt.astype(np.int64))
                    held.clear()
                    continue
            for c in joint.tolist():
                held.codes.setdefault(c, len(held.codes))
            _, r, k = held.acc.shape
            # one feature at a time: its counts stay in cache
            start = np.array([held.codes[c] for c in joint.tolist()])[place] * k
            for j, col in enumerate(by_feature):
                held.acc[j] += np.bincount(start + col, minlength=r * k).reshape(r, k)
        if len(held.codes):
            yield _count_batch(*held.cells())
    return run


def pair_count_kernel(name: str, d: int, rows: tuple[int, int], states: int, most: int = COUNT_CELLS):
    """Contingency counts ``(i, j, bi, bj, cnt)`` of the features i of ``rows`` with every j >= i.

    Rows are held feature-major, in as small integers as the states allow, up to a number of
    bytes; then one feature after the other meets all its partners in one count of combined
    states. The work for a pair does not grow with the number of states, and a task holds
    ``most`` counts at most. Only cells that occur are sent on.
    """
    kind = np.uint8 if states <= 256 else np.int16 if states <= 1 << 15 else np.int32
    square = states * states

    def met(x):
        for i in range(*rows):
            step = max(1, min(most // square, SLICE_CELLS // max(x.shape[1], 1)))
            base = x[i].astype(np.int64) * states
            for a in range(i, d, step):
                part = x[a:a + step]
                k, n = part.shape
                code = (base + part) + (np.arange(k, dtype=np.int64) * square)[:, None]
                if k * square <= most:
                    cnt = np.bincount(code.reshape(-1), minlength=k * square)
                    cell = np.flatnonzero(cnt)
                    cnt = cnt[cell]
                else:                                  # one partner whose table is too large: sort
                    cell, cnt = np.unique(code, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(cell), i, np.int32)), pa.array((a + cell // square).astype(np.int32)),
                     pa.array((cell % square // states).astype(np.int32)), pa.array((cell % states).astype(np.int32)),
                     pa.array(cnt.astype(np.int64))], names=["i", "j", "bi", "bj", "cnt"])

    def run(batches):
        held, rows_held = [], 0
        for batch in batches:
            b = matrix(batch, name, d)
            if not len(b):
                continue
            if b.min() < 0 or b.max() >= states:
                raise ValueError(f"a bin is outside 0..{states - 1}")
            held.append(np.ascontiguousarray(b[:, rows[0]:].T, kind))
            rows_held += len(b)
            if rows_held * (d - rows[0]) * kind().itemsize >= HELD_BYTES:
                yield from met(_padded(held, rows[0]))
                held, rows_held = [], 0
        if held:
            yield from met(_padded(held, rows[0]))
    return run


def _padded(parts: list[np.ndarray], first: int) -> np.ndarray:
    """The parts side by side; features before ``first`` are not looked at and stay empty."""
    x = np.concatenate(parts, axis=1)
    return np.vstack([np.zeros((first, x.shape[1]), x.dtype), x]) if first else x


def squared_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of two small blocks, with the digits of summed squared
    differences: by a matrix product about the common mean, and where the result is small
    against the norms (rows close together, or clusters far apart) by the differences."""
    c = np.concatenate([a, b]).mean(axis=0)
    a, b = a - c, b - c
    scale = (a ** 2).sum(1)[:, None] + (b ** 2).sum(1)[None, :]
    value = scale - 2.0 * (a @ b.T)
    i, j = np.nonzero(~(value > FEW_DIGITS * scale))
    step = max(1, SLICE_CELLS // max(a.shape[1], 1))
    for at in range(0, len(i), step):
        r, s = i[at:at + step], j[at:at + step]
        value[r, s] = ((a[r] - b[s]) ** 2).sum(1)
    return value


class _Block:
    """Rows of one block in sub-blocks, by id; for distances near rows stand together, and only
    the rows inside a sub-block go by id. Runs of ids take little room where pairs are written."""

    def __init__(self, ids, x, rows, near):
        order = np.argsort(ids, kind="stable")
        if near and len(x) > rows:
            place = np.argsort(x[order, x.var(axis=0).argmax()], kind="stable")
            order = order[np.concatenate([np.sort(place[at:at + rows]) for at in range(0, len(place), rows)])]
        ids, x = ids[order], x[order]
        cuts = [slice(at, at + rows) for at in range(0, len(ids), rows)]
        self.ids, self.x = [ids[c] for c in cuts], [x[c] for c in cuts]
        self.centre = [x.mean(axis=0) for x in self.x]
        self.radius = [float(np.sqrt(((x - c) ** 2).sum(1).max())) for x, c in zip(self.x, self.centre)]


def row_pair_kernel(kind: str, rows: int, shift=None, most: float | None = None):
    """All row pairs of a cell ``p >= q`` of the grid: inner product or squared distance.

    For ``applyInArrow`` on groups ``(p, q)`` with columns blk, id, features. A group holds two
    blocks, or one when p = q; it is worked off by sub-blocks of ``rows`` rows, a batch of
    results each. Emits r >= s. With ``most`` only distances up to it leave the task, and
    sub-blocks that are farther apart (their centres, less both radii) are never multiplied.
    """
    def one(left, a, right, b, diagonal):
        if most is not None:
            gap = float(np.sqrt(((left.centre[a] - right.centre[b]) ** 2).sum()))
            if gap - left.radius[a] - right.radius[b] > np.sqrt(most) * (1 + 1e-9):
                return None
        xa, xb = left.x[a], right.x[b]
        value = xa @ xb.T if kind == "gram" else squared_distances(xa, xb)
        r, s = (m.reshape(-1) for m in np.meshgrid(left.ids[a], right.ids[b], indexing="ij"))
        value = value.reshape(-1)
        keep = np.ones(len(r), bool)
        if diagonal:                                 # each pair of one sub-block once
            i, j = (m.reshape(-1) for m in np.indices((len(xa), len(xb))))
            keep = i >= j
        if most is not None:
            keep &= value <= most
        r, s, value = r[keep], s[keep], value[keep]
        return pa.RecordBatch.from_arrays(
            [pa.array(np.maximum(r, s).astype(np.int64)), pa.array(np.minimum(r, s).astype(np.int64)),
             pa.array(value)], names=["r", "s", "value"])

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, q = key[0].as_py(), key[1].as_py()
        table = pa.Table.from_batches(list(batches))
        blk, ids = table.column("blk").to_numpy(), table.column("id").to_numpy()
        x = matrix(table, "features").astype(np.float64, copy=False)
        if shift is not None:
            x = x - shift
        sides = [_Block(ids[blk == b], x[blk == b], rows, kind == "distance") for b in sorted({p, q}, reverse=True)]
        left, right = sides[0], sides[-1]
        for a in range(len(left.ids)):
            for b in range(a + 1 if p == q else len(right.ids)):
                out = one(left, a, right, b, p == q and a == b)
                if out is not None and out.num_rows:
                    yield out
    return run


def transpose_kernel():
    """A tile of rows x features turned into one row per feature, ordered by id."""
    def run(key, table):
        chunk, first = key[0].as_py(), key[1].as_py()
        ids = table.column("id").to_numpy()
        order = np.argsort(ids, kind="stable")
        m = matrix(table, "features")[order].T
        d, n = m.shape
        return pa.table({"j": pa.array(np.arange(first, first + d, dtype=np.int32)),
                         "chunk": pa.array(np.full(d, chunk, np.int64)),
                         "ids": list_column(np.tile(ids[order].astype(np.int64), (d, 1))),
                         "values": list_column(m)})
    return run
