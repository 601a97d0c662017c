"""Distributed test tables.  A cell depends on (seed, row, column) alone, so a
lost task makes the same rows again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystat.functions import arrays as A
from quarrystat.functions.draws import cell_gauss, cell_unit, row_number

# Streams of a seed: two for a normal number, one for a plain one, two for noise, one for gaps.
_FIRST, _SECOND, _PLAIN, _NOISE, _NOISE_TOO, _GAPS = range(6)
_STREAMS = 8


def _row(seed: int, stream: int):
    return row_number(seed * _STREAMS + stream)


def linear_labels(df: DataFrame, weights, intercept: float = 0.0, noise: float = 0.0,
                  seed: int = 0, binary: bool = False) -> DataFrame:
    """label = x.w + intercept + noise * N(0, 1); ``binary`` keeps the sign."""
    y = A.dot(F.col("features"), A.literal_array(weights)) + F.lit(float(intercept))
    if noise:
        y = y + F.lit(float(noise)) * cell_gauss(_row(seed, _NOISE), _row(seed, _NOISE_TOO), F.lit(0))
    if binary:
        y = F.when(y >= 0, 1.0).otherwise(-1.0)
    return df.withColumn("label", y)


def gaussian_features(ids: DataFrame, d: int, seed: int = 0, support: list[int] | None = None) -> DataFrame:
    """``(id, features)``: d features of N(0, 1) for each id; outside ``support`` they are U(0, 100)."""
    rows = ids.select("id", *[_row(seed, s).alias(f"_r{s}") for s in (_FIRST, _SECOND, _PLAIN)])

    def cell(j):
        normal = cell_gauss(F.col(f"_r{_FIRST}"), F.col(f"_r{_SECOND}"), j)
        if support is None:
            return normal
        plain = 100.0 * cell_unit(F.col(f"_r{_PLAIN}"), j)
        return F.when(F.array_contains(A.literal_array(support, "int"), j), normal).otherwise(plain)
    return rows.select("id", F.transform(F.sequence(F.lit(0), F.lit(d - 1)), cell).alias(
        "features", metadata={"width": d}))


def gaussian_rows(spark: SparkSession, n: int, d: int, seed: int = 0, partitions: int | None = None,
                  support: list[int] | None = None) -> DataFrame:
    """n rows of :func:`gaussian_features`."""
    return gaussian_features(spark.range(0, n, numPartitions=partitions), d, seed, support)


def regression_table(spark: SparkSession, n: int, d: int, weights, noise: float = 0.0,
                     intercept: float = 0.0, seed: int = 0, partitions: int | None = None,
                     support: list[int] | None = None, binary: bool = False) -> DataFrame:
    """Gaussian features with a linear (or sign) label: ``(id, features, label)``."""
    return linear_labels(gaussian_rows(spark, n, d, seed, partitions, support), weights,
                         intercept, noise, seed, binary)


def inject_nan(df: DataFrame, share: float, always: list[int] = (3,), seed: int = 0) -> DataFrame:
    """NaN in the columns ``always`` and in a random share of the other cells."""
    nan = F.lit(float("nan"))
    gone = A.literal_array(list(always), "int")
    rows = df.withColumn("_g", _row(seed, _GAPS))
    return rows.withColumn("features", F.transform("features", lambda x, j: F.when(
        F.array_contains(gone, j) | (cell_unit(F.col("_g"), j) < share), nan).otherwise(x))).drop("_g")
