"""Sums over the rows of a table, dense or sparse, that leave it as small matrices.

``features`` is an array column (dense) or an ML vector column (dense or sparse vectors, read
cell by cell). The driver holds matrices of d rows and as many columns as were asked for.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrystat.functions import products as kernels
from quarrystat.operators.common import MAX_MATRIX_CELLS

# Buckets of tasks whose partial sums meet first, and bytes of partial sums of all tasks together.
FAN, SHUFFLE_BYTES = 32, 64 << 30


def is_vector(df: DataFrame, features: str = "features") -> bool:
    """Whether the features are ML vectors (and may be sparse)."""
    return isinstance(df.schema[features].dataType, VectorUDT)


def vector_width(features: str = "features") -> Column:
    x = F.unwrap_udt(features)
    return F.coalesce(x["size"], F.size(x["values"]))


def cell_columns(features: str = "features") -> list[Column]:
    """``at`` and ``v`` of an ML vector: positions and values of the cells it holds."""
    x = F.unwrap_udt(features)
    every = F.transform(x["values"], lambda _, j: j)
    return [F.coalesce(x["indices"], every).alias("at"), x["values"].alias("v")]


def merged(df: DataFrame, sums: int) -> DataFrame:
    """``df`` with splits merged (no shuffle) as far as tasks that each send ``sums`` numbers
    would pass ``SHUFFLE_BYTES`` together, but to no fewer tasks than there are cores."""
    most = max(df.sparkSession.sparkContext.defaultParallelism, SHUFFLE_BYTES // (8 * max(sums, 1)))
    return df.coalesce(most) if most < 1_000_000 else df


def one_vector_each(rows: DataFrame) -> DataFrame:
    """``(c, v)`` from ``(part, c, v)``: vectors are summed in the JVM in two levels, first by c
    and a bucket of the task number, so that no reducer gets the vectors of all tasks."""
    rows = rows.select("part", "c", array_to_vector("v").alias("v"))
    for keys in (("c", "part"), ("c",)):
        rows = rows.groupBy(*keys).agg(Summarizer.sum(F.col("v")).alias("v"))
    return rows.select("c", vector_to_array("v").alias("v"))


class RowProducts:
    """Products with the Gram matrix of a table's rows less ``shift``, one scan each.

    ``n`` rows and the sum of squares ``total`` (the trace of the Gram matrix) are known after
    the first product.
    """

    def __init__(self, df: DataFrame, d: int, shift=None, target: str | None = None):
        self.d, self.shift, self.target = d, shift, target
        self.sparse = is_vector(df)
        more = [F.col(target).cast("double").alias("target_")] if target else []
        self.rows = df.select(*(cell_columns() if self.sparse else ["features"]), *more)
        self.n = self.total = None

    def _vectors(self, kernel, columns: int) -> np.ndarray:
        out = merged(self.rows, columns * self.d).mapInArrow(kernel, "part int, c int, v array<double>")
        got = one_vector_each(out).toArrow()
        if not got.num_rows:
            raise ValueError("the table has no rows")
        m = np.empty((columns, len(got["v"][0])))
        for c, v in zip(got["c"].to_pylist(), got["v"]):
            m[c] = v.values.to_numpy()
        return m

    def times(self, right: np.ndarray) -> np.ndarray:
        """X' (X right). A wide ``right`` is sent in panels of bounded size, a scan each; with a
        target it is taken whole (it has two columns)."""
        step = right.shape[1] if self.target else max(1, MAX_MATRIX_CELLS // self.d)
        parts = []
        for at in range(0, right.shape[1], step):
            panel = np.ascontiguousarray(right[:, at:at + step])
            m = self._vectors(kernels.gram_times_kernel(self.d, panel, self.shift, self.sparse, FAN,
                                                        "target_" if self.target else None), panel.shape[1])
            self.total, self.n = float(m[0, -2]), int(round(m[0, -1]))
            parts.append(m[:, :-2].T)
        return np.hstack(parts)

    def square(self) -> np.ndarray:
        """X'X whole, on the driver. Sparse rows (without a shift) give it by the pairs of cells
        they hold, so that the work does not grow with d for each cell."""
        if not self.sparse or self.shift is not None or self.target:
            return self.times(np.eye(self.d))
        got = pair_products(self.rows, self.d).toArrow()          # d (d + 1) / 2 entries at most
        if not got.num_rows and self.rows.isEmpty():
            raise ValueError("the table has no rows")
        i, j, v = (got[c].to_numpy() for c in ("i", "j", "value"))
        out = np.zeros((self.d, self.d))
        out[i, j] = v
        out[j, i] = v
        self.total = float(np.trace(out))
        return out

    def means(self) -> np.ndarray:
        """Column means of the rows (less the shift)."""
        m = self._vectors(kernels.column_sum_kernel(self.d, self.shift, self.sparse, FAN), 1)[0]
        self.n = int(round(m[-1]))
        return m[:-1] / m[-1]


def pair_products(cells: DataFrame, d: int) -> DataFrame:
    """``(i, j, value)``, i <= j: sums of products over pairs of cells that rows hold together.

    ``cells`` has ``at`` and ``v``. The work grows with the pairs, not with d * d; a task adds
    equal pairs up before the shuffle. Pairs that never meet have no row.
    """
    return (cells.select("at", "v").mapInArrow(kernels.pair_kernel(d), "i int, j int, value double")
            .groupBy("i", "j").agg(F.sum("value").alias("value")))
