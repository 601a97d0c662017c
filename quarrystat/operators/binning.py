"""Exact order statistics per feature and equal-frequency bins."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarrystat.functions import kernels
from quarrystat.operators.common import PARTIAL_BUDGET, union_all, with_width

# Rows of one feature a single task may sort.
SORT_LIMIT = 1_000_000
# Cells worth shuffling instead of another pass: a few, or one in a thousand.
SORT_CELLS = 1_000_000
# Histogram cells of the first pass (seen by the driver), and those a task may hold later.
FIRST_CELLS, HISTOGRAM_CELLS = 1 << 20, 8_000_000
# Wanted ranks that are sent to every task; more meet the cells in a shuffle.
BROADCAST_RANKS = 1_000_000
# Open features up to which they are read alone.
FEW_FEATURES = 256

_CELLS = "j int, prefix bigint, digit int, cnt bigint, lo bigint, hi bigint"


def order_statistics(df: DataFrame, ranks: list[int], features: str = "features",
                     sort_limit: int = SORT_LIMIT) -> np.ndarray:
    """The values of the given 1-based ranks of every feature, a d x L matrix.

    Radix selection on the 64-bit sort keys: every pass counts the next key
    bits inside the ranges still open, so nothing but histograms is shuffled
    and no task holds a whole feature.  The first pass also counts the rows and
    finds the width. A range of at most ``sort_limit`` rows is sorted.  A rank is
    settled as soon as its range holds a single value, so heavy ties cost no
    further pass; later passes read only the features that still have an open range.
    """
    def of(n: int) -> list[int]:
        if not ranks or min(ranks) < 1 or max(ranks) > n:
            raise ValueError(f"ranks must lie in 1..{n}")
        return ranks
    return _select(df, of, features, sort_limit)


def _located(cells: DataFrame, by: str, open_: np.ndarray, lead: np.ndarray, left: np.ndarray,
             *more: str) -> dict[str, np.ndarray]:
    """``(j, k, by, cnt, upto, *more)``: the cells in which the wanted ranks fall."""
    run = (W.partitionBy("j", "prefix").orderBy(by)
           .rowsBetween(W.unboundedPreceding, W.currentRow))
    j, k = np.nonzero(open_)
    want = cells.sparkSession.createDataFrame(pa.table({
        "j": j.astype(np.int32), "prefix": lead[j, k].view(np.int64), "k": k.astype(np.int32), "rank": left[j, k]}))
    want = F.broadcast(want) if len(j) <= BROADCAST_RANKS else want
    found = (cells.withColumn("upto", F.sum("cnt").over(run)).join(want, ["j", "prefix"])
             .filter("upto - cnt < rank and rank <= upto").select("j", "k", by, "cnt", "upto", *more).toArrow())
    return {name: found[name].to_numpy() for name in found.column_names}


def _histogram(src: DataFrame, kernel) -> DataFrame:
    return src.mapInArrow(kernel, _CELLS).groupBy("j", "prefix", "digit").agg(
        F.sum("cnt").alias("cnt"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def _select(df: DataFrame, ranks_of: Callable[[int], list[int]], features: str, sort_limit: int) -> np.ndarray:
    """The value of every wanted rank, d x L; ``ranks_of`` gives the ranks for a row count."""
    tasks = df.sparkSession.sparkContext.defaultParallelism
    # FIRST_CELLS rows at most (or 16 a feature)
    first = _histogram(df.select(features), kernels.digit_kernel(features, None, None, 0, 0, FIRST_CELLS)).toArrow()
    cell = {name: first[name].to_numpy() for name in first.column_names}
    head = np.flatnonzero(cell["j"] < 0)
    if not len(head):
        raise ValueError("the table has no rows")
    n, d = int(cell["cnt"][head[0]]), int(cell["lo"][head[0]])
    if d != cell["hi"][head[0]]:
        raise ValueError(f"{features}: rows differ in width")
    ranks = np.array(ranks_of(n), np.int64)
    value = np.full((d, len(ranks)), np.nan)
    open_ = np.ones(value.shape, bool)
    lead = np.zeros(value.shape, np.uint64)                # key bits known
    left = np.tile(ranks, (d, 1))                          # rank in the range
    size = np.full(value.shape, n)                         # rows in the range
    done = _narrow_ranges(_found_in(cell, d, ranks), kernels.first_bits(d, FIRST_CELLS), 0, value, open_, lead, left, size)
    while open_.any() and done < 64 and (size[open_].max() > sort_limit
                                         or size[open_].sum() > max(SORT_CELLS, n * d // 1000)):
        src, cols, prefixes = _open_columns(df, features, open_, lead)
        bits = _next_bits(size[open_], sum(map(len, prefixes)), tasks, max(SORT_CELLS, n * d // 1000), 64 - done)
        cells = union_all([
            _histogram(src, kernels.digit_kernel(features, cols, part, done, bits, HISTOGRAM_CELLS))
            for part in _bounded(prefixes, HISTOGRAM_CELLS >> bits)])
        found = _located(cells, "digit", open_, lead, left, "lo", "hi")
        done = _narrow_ranges(found, bits, done, value, open_, lead, left, size)
    if open_.any():
        src, cols, prefixes = _open_columns(df, features, open_, lead)
        cells = src.mapInArrow(kernels.gather_kernel(features, cols, prefixes, done),
                               "j int, prefix bigint, v double, cnt bigint")
        found = _located(cells, "v", open_, lead, left)
        value[found["j"], found["k"]] = found["v"]
    return value


def _found_in(cell: dict[str, np.ndarray], d: int, ranks: np.ndarray) -> dict[str, np.ndarray]:
    """The cells of the first histogram in which the ranks of every feature fall."""
    order = np.lexsort((cell["digit"], cell["j"]))
    order = order[cell["j"][order] >= 0]
    cell = {name: v[order] for name, v in cell.items()}
    ends = np.searchsorted(cell["j"], np.arange(d + 1))
    upto, at = np.empty(len(order), np.int64), []
    for j in range(d):
        part = slice(ends[j], ends[j + 1])
        upto[part] = np.cumsum(cell["cnt"][part])
        at.append(ends[j] + np.searchsorted(upto[part], ranks))
    at = np.concatenate(at) if at else np.zeros(0, np.int64)
    return {**{name: v[at] for name, v in cell.items()}, "upto": upto[at], "k": np.tile(np.arange(len(ranks)), d)}


def _narrow_ranges(found: dict[str, np.ndarray], bits: int, done: int, value, open_, lead, left, size) -> int:
    """Every open range becomes the cell found in it; cells of one value are settled."""
    c = found
    at = c["j"], c["k"]
    single = c["lo"] == c["hi"]
    value[c["j"][single], c["k"][single]] = kernels.unsortable(c["lo"][single].astype(np.int64).view(np.uint64))
    open_[at] = ~single
    lead[at] = (lead[at] << np.uint64(bits)) | c["digit"].astype(np.uint64)
    left[at] -= c["upto"] - c["cnt"]
    size[at] = c["cnt"]
    return done + bits


def _open_columns(df: DataFrame, features: str, open_: np.ndarray, lead: np.ndarray):
    """The features with an open range: a table of these alone if they are few, their
    positions, and the prefixes wanted of each."""
    d = len(open_)
    cols = np.flatnonzero(open_.any(1)).tolist()
    if len(cols) == d or len(cols) > FEW_FEATURES:
        src, cols = df.select(features), list(range(d))
    else:
        src = df.select(F.array(*[F.get(F.col(features), F.lit(j)) for j in cols]).alias(features))
    return src, cols, [np.unique(lead[j][open_[j]]) for j in cols]


def _bounded(prefixes: list[np.ndarray], slots: int) -> list[list[np.ndarray]]:
    """The prefixes dealt to scans of at most ``slots`` each (one scan but for very many)."""
    none = np.zeros(0, np.uint64)
    parts, used = [[none] * len(prefixes)], 0
    for c, p in enumerate(prefixes):
        while len(p):
            take = p[:max(1, slots - used)]
            parts[-1][c] = take
            p, used = p[len(take):], used + len(take)
            if used >= slots and (len(p) or any(len(q) for q in prefixes[c + 1:])):
                parts.append([none] * len(prefixes))
                used = 0
    return parts


def _next_bits(sizes: np.ndarray, slots: int, tasks: int, limit: int, most: int) -> int:
    """Bits for the next pass: enough to leave ``limit`` rows in the ranges together, as far as
    the cells fit a task and the cells of all tasks the shuffle."""
    needed = math.ceil(math.log2(max(2.0, float(sizes.max()) * len(sizes) / limit))) + 2
    room = min(HISTOGRAM_CELLS // max(slots, 1), PARTIAL_BUDGET // max(slots * tasks, 1))
    return min(most, max(4, min(16, needed, max(1, room).bit_length() - 1)))


def equal_frequency_cuts(df: DataFrame, levels: int, features: str = "features",
                         sort_limit: int = SORT_LIMIT) -> np.ndarray:
    """Cut values ``sorted[k * (n div levels)]`` for k = 1..levels, d x levels."""
    def ranks(n: int) -> list[int]:
        if levels > n:
            raise ValueError(f"{levels} levels for {n} rows")
        return [k * (n // levels) for k in range(1, levels + 1)]
    return _select(df, ranks, features, sort_limit)


def equal_frequency_bins(df: DataFrame, levels: int, features: str = "features",
                         out: str = "bins", clamp: bool = False, cuts: np.ndarray | None = None,
                         sort_limit: int = SORT_LIMIT) -> DataFrame:
    """``bins[j]`` = number of cuts of feature j strictly below the value, small integers
    (beyond 32,767 cuts plain ones).

    Rows above the last cut (levels not dividing n) get bin ``levels``;
    ``clamp`` folds them into the last regular bin.
    """
    if cuts is None:
        cuts = equal_frequency_cuts(df, levels, features, sort_limit)
    wide = max((len(c) for c in cuts), default=0) >= 1 << 15
    keep = [c for c in df.columns if c != features]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(keep).schema)
    schema = (schema + ", " if schema else "") + f"`{out}` array<{'int' if wide else 'smallint'}>"
    binned = df.mapInArrow(kernels.bin_kernel(features, keep, cuts, out, levels - 1 if clamp else None,
                                              np.int32 if wide else np.int16), schema)
    return with_width(binned, out, len(cuts))


def bins_long(df: DataFrame, *keep: str, bins: str = "bins") -> DataFrame:
    """Binned cells ``(*keep, j, b)``."""
    return df.select(*(keep or ("id",)), F.posexplode(bins).alias("j", "b"))
