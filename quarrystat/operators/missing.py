"""Missing values: counting, dropping, imputing.  NaN marks a missing cell."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrystat.functions import arrays as A
from quarrystat.functions import kernels
from quarrystat.operators.common import by_feature, whole, width, with_width
from quarrystat.operators.stats import _per_feature


def nan_counts(df: DataFrame) -> DataFrame:
    """NaNs and rows per column: ``(j, nans, n)``."""
    return _per_feature(df, F.sum(F.isnan("v").cast("bigint")).alias("nans"),
                        F.count("*").alias("n"))


def nan_row_counts(df: DataFrame) -> DataFrame:
    return df.select("id", A.nan_count(whole(df, width(df, empty=0))).alias("nans"))


def _profile(df: DataFrame, d: int, check=None, limit: int | None = None):
    """NaNs, rows and mean of every column in one pass.

    With ``check`` and ``limit`` only rows with at most ``limit`` NaNs among
    those columns count.
    """
    parts = df.select("features").mapInArrow(
        kernels.profile_kernel("features", d, check, limit),
        "j int, nans bigint, n bigint, total double")
    found = parts.groupBy("j").agg(*[F.sum(c).alias(c) for c in ("nans", "n", "total")])
    nans, n, total = by_feature(found, d, "nans", "n", "total")
    with np.errstate(invalid="ignore"):
        return nans, n, total / (n - nans)


def _filled(df: DataFrame, cols, mean, check=None, limit: int | None = None) -> DataFrame:
    """Rows that pass, cut down to ``cols``, gaps set to the means."""
    keep = [c for c in df.columns if c != "features"]
    types = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(keep).schema]
    filled = df.select(*keep, "features").mapInArrow(
        kernels.fill_kernel("features", keep, np.asarray(cols, int), np.asarray(mean), check, limit),
        ", ".join(types + ["features array<double>"]))
    return with_width(filled, "features", len(cols))


def _keep(df: DataFrame, keep) -> DataFrame:
    return with_width(df.withColumn("features", A.pick("features", keep)), "features", len(keep))


def drop_columns(df: DataFrame, max_nan: int, inclusive: bool = True):
    """Columns with at most ``max_nan`` NaNs (fewer, if not inclusive).

    Returns the table and the dropped 0-based positions.
    """
    nans, _, _ = _profile(df, width(df))
    good = nans <= max_nan if inclusive else nans < max_nan
    return _keep(df, np.flatnonzero(good)), [int(j) for j in np.flatnonzero(~good)]


def drop_rows(df: DataFrame, max_nan: int, inclusive: bool = True):
    """Rows with at most ``max_nan`` NaNs, and the ids of the dropped ones.

    Null and ragged rows are errors: each row lands in one of the two outputs.
    """
    k = A.nan_count(whole(df, width(df, empty=0)))
    good = k <= max_nan if inclusive else k < max_nan
    return df.filter(good), df.filter(~good).select("id")


def impute_mean(df: DataFrame) -> DataFrame:
    """NaNs replaced by the mean of the other values of the column."""
    d = width(df)
    _, _, mean = _profile(df, d)
    return _filled(df, range(d), mean)


def _half_full(df: DataFrame):
    """Columns with values in more than half of the rows, and their means."""
    nans, n, mean = _profile(df, width(df))
    keep = np.flatnonzero(n - nans > n / 2.0)
    return keep, mean[keep]


def column_check(df: DataFrame) -> DataFrame:
    """Columns filled in more than half of the rows, gaps set to the mean."""
    return _filled(df, *_half_full(df))


def column_row_check(df: DataFrame) -> DataFrame:
    """:func:`column_check`, then only rows with fewer NaNs than a quarter of
    the kept columns.  The means are those before rows are dropped."""
    keep, mean = _half_full(df)
    return _filled(df, keep, mean, keep, len(keep) // 4 - 1)


def filter_long(df: DataFrame, group_a: DataFrame, group_b: DataFrame) -> DataFrame:
    """Cleaned cells ``(id, label, j, v)``.

    Columns with at most rows/2 NaNs, rows with at most kept/4; gaps come from a
    join with the column means; the label is 1 for ids in ``group_a``, 2 for
    ids in ``group_b``, else -1.
    """
    nans, n, mean = _profile(df, width(df))
    keep = np.flatnonzero(nans <= n // 2)
    picked = A.pick(F.col("features"), keep)
    rows = df.filter(A.nan_count(picked) <= len(keep) // 4)
    spark = df.sparkSession
    # one row per kept feature
    means = spark.createDataFrame([(int(j), float(mean[j])) for j in keep], "j int, mean double")
    member = (group_a.select("id").distinct().withColumn("label", F.lit(1))
              .unionByName(group_b.select("id").distinct().withColumn("label", F.lit(2)))
              .groupBy("id").agg(F.min("label").alias("label")))
    # whole rows meet their group; cells are made afterwards
    marked = rows.select("id", "features").join(member, "id", "left").select(
        "id", F.coalesce("label", F.lit(-1)).alias("label"), "features")
    return (marked.select("id", "label", F.posexplode("features").alias("j", "v"))
            .join(F.broadcast(means), "j")
            .select("id", "label", "j",
                    F.when(F.isnan("v"), F.col("mean")).otherwise(F.col("v")).alias("v")))


def clean_table(df: DataFrame, col_share: float = 0.5, row_share: float = 0.25,
                col_share_after: float = 0.25):
    """Drop sparse columns, then sparse rows, then sparse columns again; impute.

    Thresholds come from the size of the original table.  Two passes read the
    table before the result: one to choose the columns, one over the kept rows
    for the second choice and the means.
    """
    d = width(df)
    nans, n, _ = _profile(df, d)
    rows = int(n[0])
    first = np.flatnonzero(nans <= int(rows * col_share))
    limit = int(d * row_share)
    nans, _, mean = _profile(df, d, first, limit)
    last = np.array([j for j in first if nans[j] <= int(rows * col_share_after)], int)
    return _filled(df, last, mean[last], first, limit), [int(j) for j in last]
