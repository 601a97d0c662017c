"""Helpers shared by the operators."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Bounds on what may sit on the driver or travel inside a task.
MAX_LOCAL_WIDTH = 4096
MAX_MATRIX_CELLS = MAX_LOCAL_WIDTH ** 2
# Partial results shuffled by one job, over all tasks together.
PARTIAL_BUDGET = 2_000_000_000


def with_width(df: DataFrame, features: str, d: int) -> DataFrame:
    """``df`` with the number of features noted on the column: :func:`width` then asks no job."""
    return df.withColumn(features, F.col(features).alias(features, metadata={"width": d}))


def width(df: DataFrame, features: str = "features", empty: int | None = None) -> int:
    """Number of features: as noted on the column, or from the first row. A table without rows
    is an error unless ``empty`` is given.

    The kernels refuse ragged rows; :func:`check_width` tests a whole table.
    """
    field = df.select(features).schema[0]
    if "width" in field.metadata:
        return int(field.metadata["width"])
    kind = field.dataType.typeName()
    x = F.unwrap_udt(features) if kind == "vectorudt" else None
    size = (F.coalesce(x["size"], F.size(x["values"])) if x is not None
            else F.octet_length(features) / 2 if kind == "binary" else F.size(features))
    row = df.select(size).first()
    if row is None:
        if empty is None:
            raise ValueError("the table has no rows")
        return empty
    if row[0] is None or row[0] < 0:
        raise ValueError(f"{features}: null array in the first row")
    return int(row[0])


def whole(df: DataFrame, d: int, features: str = "features") -> Column:
    """The array column; a null array or one of another width than ``d`` is an error where it
    is read, so that no row drops out unseen."""
    c = F.col(features)
    return F.when(F.coalesce(F.size(c) == d, F.lit(False)), c).otherwise(
        F.raise_error(F.lit(f"{features}: null array or width other than {d}")))


def check_width(df: DataFrame, features: str = "features") -> int:
    """Width after a full pass over the table; raises on ragged rows."""
    lo, hi = df.select(F.min(F.size(features)), F.max(F.size(features))).first()
    if lo is None or lo != hi:
        raise ValueError(f"rows have between {lo} and {hi} features")
    return int(lo)


def by_feature(df: DataFrame, d: int, *cols: str, key: str = "j") -> list[np.ndarray]:
    """Columns of a per-feature table as driver vectors of length d."""
    rows = df.select(key, *cols).collect()
    out = [np.full(d, np.nan) for _ in cols]
    for r in rows:
        for k, c in enumerate(cols):
            out[k][r[key]] = np.nan if r[c] is None else r[c]
    return out


def union_all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def log2(c):
    return F.log(c) / F.lit(math.log(2.0))


def require_local(d: int) -> None:
    if d > MAX_LOCAL_WIDTH:
        raise ValueError(f"{d} features: a d x d matrix is kept local only up to {MAX_LOCAL_WIDTH}")
