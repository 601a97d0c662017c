"""Gram, covariance and cosine matrices of the columns; matrix products.

All results are entry tables ``(i, j, value)``.  One pass over the table makes
one partial d x d sum per task; only those are shuffled, a vector for each matrix row.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrystat.functions import arrays as A
from quarrystat.functions import kernels
from quarrystat.functions.draws import cell_unit, row_number
from quarrystat.functions.products import sparse_product_kernel
from quarrystat.operators.common import (MAX_MATRIX_CELLS, by_feature, require_local, union_all,
                                         width)
from quarrystat.operators.products import (FAN, RowProducts, cell_columns, is_vector, merged, one_vector_each,
                                           pair_products)
from quarrystat.operators.reshape import mirror, to_long
from quarrystat.operators.stats import col_l2, mean_vector

# Matrix cells a task may hold in one scan.
TASK_CELLS = 8_000_000
BROADCAST_ENTRIES = 2_000_000


def _gram_rows(df: DataFrame, d: int, features: str, shift, band: int) -> DataFrame:
    """``(i, v)``: matrix row i from its diagonal on, then the sum of column i and the
    row count.

    A task sends one vector for each matrix row. They are summed in the JVM in two
    levels, first by matrix row and a bucket of the task number, so that however many
    tasks there are, no reducer gets the vectors of all of them.
    """
    src = merged(df.select(features), d * (d + 1) // 2)
    parts = [src.mapInArrow(
        kernels.gram_kernel(features, d, (a, min(a + band, d)), shift, FAN),
        "part int, i int, v array<double>") for a in range(0, d, band)]
    return one_vector_each(union_all(parts).withColumnRenamed("i", "c")).withColumnRenamed("c", "i")


def gram(df: DataFrame, features: str = "features", shift=None, count: bool = False,
         tile: int | None = None) -> DataFrame:
    """Upper triangle of X'X: one pass over the table, vectors of partial sums shuffled.

    ``shift`` is subtracted from every row.  With ``count`` the entries also hold the
    number of rows ``n``.  The matrix is made in bands of ``tile`` rows, a scan each; by
    default as many rows as a task may hold, all of them up to some 2,800 columns.
    """
    d = width(df, features)
    rows = _gram_rows(df, d, features, shift, tile or max(1, TASK_CELLS // (d + 2)))
    n = [F.round(F.get("v", F.size("v") - 1)).cast("bigint").alias("n")] if count else []
    out = rows.select("i", *n, F.posexplode(F.slice("v", F.lit(1), F.size("v") - 2)).alias("k", "value"))
    return out.select("i", (F.col("i") + F.col("k")).alias("j"), "value", *(["n"] if count else []))


def gramian(df: DataFrame, full: bool = False) -> DataFrame:
    """X'X as entries, upper triangle or full."""
    g = gram(df)
    return mirror(g) if full else g


def second_moment(df: DataFrame) -> DataFrame:
    """Sum of x_i * x_j over N - 1 without centring, full matrix."""
    g = gram(df, count=True)
    return mirror(g.select("i", "j", (F.col("value") / (F.col("n") - 1)).alias("value")))


def covariance(df: DataFrame, ddof: int = 1, triangle: str = "full") -> DataFrame:
    """Covariance of the columns over N - ddof: a pass for the means, one for the products
    of what is left (whose own means are rounding errors)."""
    g = gram(df, shift=mean_vector(df), count=True)
    value = F.col("value") / (F.col("n") - ddof)
    out = g.select("i", "j", value.alias("value"))
    return mirror(out) if triangle == "full" else out


def _with_draw(df: DataFrame, seed: int) -> DataFrame:
    """A 32-bit number of each row's id in ``_r``: the row's part of its cells' draws."""
    return df.withColumn("_r", row_number(seed))


def _cells(df: DataFrame) -> DataFrame:
    """Rows with ``_c``, an array of the cells ``(j, v)`` that a row holds: all of a dense row,
    the given ones of a sparse row."""
    if is_vector(df):
        at, v = cell_columns()
        cells = F.zip_with(at, v, lambda j, x: F.struct(j.alias("j"), x.alias("v")))
    else:
        cells = F.transform("features", lambda x, j: F.struct(j.alias("j"), x.cast("double").alias("v")))
    return df.select("*", cells.alias("_c"))


def _drawn(cells: DataFrame, p: np.ndarray, scale: np.ndarray) -> DataFrame:
    """``(at, v)``: each cell of column j with probability p[j], divided by scale[j]. Cells that
    are not drawn leave the row here, so that later work follows what is kept."""
    probs, scales = A.literal_array(p), A.literal_array(scale)
    kept = F.filter("_c", lambda c: cell_unit(F.col("_r"), c["j"]) < F.get(probs, c["j"])) if (p < 1).any() else F.col("_c")
    return (cells.select(kept.alias("_k"))
            .select(F.transform("_k", lambda c: c["j"]).alias("at"),
                    F.transform("_k", lambda c: c["v"] / F.get(scales, c["j"])).alias("v")))


def _products(kept: DataFrame, p: np.ndarray, d: int, sparse: bool) -> DataFrame:
    """Sums of products of the kept cells, i <= j: by pairs that meet, or as a dense product
    where the rows are dense and nothing is sampled away."""
    if sparse or (p < 1).any():
        return pair_products(kept, d)
    return gram(kept.select(F.col("v").alias("features")))


def _column_norms(df: DataFrame, d: int) -> np.ndarray:
    """L2 norms of the columns; 1 for a column of zeros."""
    rows = _cells(df).select(F.explode("_c").alias("c")) if is_vector(df) else None
    norms, = by_feature(col_l2(df, d) if rows is None else rows.groupBy(F.col("c.j").alias("j")).agg(
        F.sqrt(F.sum(F.col("c.v") * F.col("c.v"))).alias("l2")), d, "l2")
    return np.where(np.nan_to_num(norms) == 0, 1.0, norms)


def covariance_sampled(df: DataFrame, seed: int = 0, gamma: float | None = None) -> DataFrame:
    """Population covariance from sampled cells, upper triangle.

    A cell of column i enters with probability p_i = sqrt(gamma) / norm and is weighted so that
    the expectation is the covariance.  Without gamma every cell enters, however large the norms
    of a long table: that is exact, as it is where every p_i reaches 1. Dense rows are centred
    before the draw. Of sparse rows only the cells they hold are drawn, and the product of the
    exact means is taken off the sums afterwards; pairs of columns that never meet have no row
    (their value is minus that product). Work follows the pairs of cells kept together.
    """
    d, sparse = width(df), is_vector(df)
    p = np.ones(d) if gamma is None else np.minimum(1.0, math.sqrt(gamma) / _column_norms(df, d))
    rows = RowProducts(df, d)
    mean = rows.means()
    if not sparse:
        df = df.select("id", A.subtract(F.col("features"), A.literal_array(mean)).alias("features"))
    g = _products(_drawn(_cells(_with_draw(df, seed)), p, p), p, d, sparse)
    # a squared cell was drawn once but weighted twice
    once = F.when(F.col("i") == F.col("j"), F.get(A.literal_array(p), F.col("i"))).otherwise(1.0)
    value = F.col("value") * once / F.lit(float(rows.n))
    if sparse:
        m = A.literal_array(mean)
        value = value - F.get(m, F.col("i")) * F.get(m, F.col("j"))
    return g.select("i", "j", value.alias("value"))


def cosine(df: DataFrame, threshold: float = 0.0, seed: int = 0) -> DataFrame:
    """Cosine similarity of column pairs i < j.

    Exact for thresholds below 1e-6; otherwise cells are sampled so that pairs
    above the threshold are estimated well. Of sparse rows only pairs that meet have a row.
    """
    if threshold < 0:
        raise ValueError("threshold must not be negative")
    d = width(df)
    if threshold >= 1e-6:
        return cosine_sampled(df, 10 * math.log(d) / threshold, seed)
    norms = _column_norms(df, d)
    if is_vector(df):
        every = np.ones(d)
        return pair_products(_drawn(_cells(df), every, norms), d).filter("i < j")
    norms = A.literal_array(norms)
    return (gram(df).filter("i < j").select("i", "j", (
        F.col("value") / (F.get(norms, F.col("i")) * F.get(norms, F.col("j")))).alias("value")))


def cosine_sampled(df: DataFrame, gamma: float, seed: int = 0, norms=None) -> DataFrame:
    """Cosine similarity by dimension-independent sampling (DIMSUM), rows dense or sparse.

    A cell of column j stays with probability sqrt(gamma) / norm_j; pairs of cells that stay in
    one row are multiplied in its task and added up by pair before the shuffle, so the work
    falls with gamma. Pairs of columns that never meet have no row.
    """
    if gamma <= 1:
        raise ValueError("gamma must be above 1")
    d = width(df)
    norms = _column_norms(df, d) if norms is None else np.asarray(norms, float).copy()
    if len(norms) != d:
        raise ValueError("one norm per column is needed")
    norms[norms == 0] = 1.0
    root = math.sqrt(gamma)
    p, q = np.minimum(1.0, root / norms), np.minimum(root, norms)
    rows = _with_draw(df, seed) if (p < 1).any() else df
    return _products(_drawn(_cells(rows), p, q), p, d, is_vector(df)).filter("i < j")


def gram_times(df: DataFrame, v) -> DataFrame:
    """(X'X) v as ``(j, value)`` without forming X'X."""
    weight = A.dot(F.col("features"), A.literal_array(v))
    return (df.select(weight.alias("_a"), F.posexplode("features").alias("j", "v"))
            .groupBy("j").agg(F.sum(F.col("_a") * F.col("v")).alias("value")))


def gram_times_matrix(df: DataFrame, v: np.ndarray) -> np.ndarray:
    """(X'X) V for a small d x k matrix, on the driver; rows may be sparse."""
    return RowProducts(df, len(v)).times(np.asarray(v, float))


def multiply_local(df: DataFrame, right: np.ndarray, out: str = "features", shift=None,
                   keep=("id",)) -> DataFrame:
    """Rows (dense or sparse) times a small matrix; keeps the ids, no shuffle."""
    right = np.asarray(right, float)
    if right.size > MAX_MATRIX_CELLS:
        raise ValueError("the right-hand matrix is too large to ship; use multiply_entries")
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema)
    schema = f"{types}, `{out}` array<double>"
    if is_vector(df):
        kernel = sparse_product_kernel(list(keep), right, out, None if shift is None else np.asarray(shift, float))
        return df.select(*keep, *cell_columns()).mapInArrow(kernel, schema)
    return df.select(*keep, "features").mapInArrow(kernels.product_kernel("features", list(keep), right, out, shift), schema)


def multiply_entries(a: DataFrame, b: DataFrame, salt: int = 16,
                     broadcast_limit: int = BROADCAST_ENTRIES) -> DataFrame:
    """Product of two entry tables: sum over k of a(i, k) * b(k, j).

    A right side of at most ``broadcast_limit`` entries is sent to every task.
    A larger one is joined on a salted inner index, so one hot index is
    spread over ``salt`` tasks.
    """
    left = a.select("i", F.col("j").alias("k"), F.col("value").alias("_a"))
    right = b.select(F.col("i").alias("k"), "j", F.col("value").alias("_b"))
    if b.limit(broadcast_limit + 1).count() <= broadcast_limit:
        pairs = left.join(F.broadcast(right), "k")
    else:
        pairs = (left.withColumn("_s", F.pmod(F.xxhash64("i"), F.lit(salt)))
                 .join(right.withColumn("_s", F.explode(F.array(*[F.lit(s).cast("bigint")
                                                                  for s in range(salt)]))),
                       ["k", "_s"]))
    return pairs.groupBy("i", "j").agg(F.sum(F.col("_a") * F.col("_b")).alias("value"))


def as_entries(df: DataFrame) -> DataFrame:
    """A wide table as entries with the id as row index."""
    return to_long(df).select(F.col("id").alias("i"), "j", F.col("v").alias("value"))


def local_matrix(entries: DataFrame, d: int, symmetric: bool = True) -> np.ndarray:
    """A small d x d entry table as a numpy matrix on the driver."""
    require_local(d)
    pdf = entries.select("i", "j", "value").toPandas()
    out = np.zeros((d, d))
    out[pdf["i"], pdf["j"]] = pdf["value"]
    if symmetric:
        out[pdf["j"], pdf["i"]] = pdf["value"]
    return out


def local_moments(df: DataFrame, features: str = "features", shift=None):
    """Row count, column sums and X'X (each after the shift), in one pass."""
    d = width(df, features)
    require_local(d)
    rows = _gram_rows(df, d, features, shift, max(1, TASK_CELLS // (d + 2))).toArrow()
    out, sums, n = np.zeros((d, d)), np.zeros(d), 0
    for i, v in zip(rows["i"].to_pylist(), rows["v"]):
        v = v.values.to_numpy()
        out[i, i:] = out[i:, i] = v[:-2]
        sums[i], n = v[-2], round(v[-1])
    return n, sums, out


def local_covariance(df: DataFrame, ddof: int = 1):
    """Row count, column means and covariance on the driver (d is bounded)."""
    c = mean_vector(df)
    n, s, g = local_moments(df, shift=c)
    return n, c + s / n, (g - np.outer(s, s) / n) / (n - ddof)


def entry_table(spark, m: np.ndarray) -> DataFrame:
    """A small dense matrix as an entry table."""
    i, j = np.indices(m.shape)
    return spark.createDataFrame(pa.table({
        "i": i.reshape(-1).astype(np.int32), "j": j.reshape(-1).astype(np.int32),
        "value": np.ascontiguousarray(m, float).reshape(-1)}))
