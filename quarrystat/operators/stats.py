"""Column statistics, normalisation, contingency tables and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrystat.functions import arrays as A
from quarrystat.functions import kernels
from quarrystat.operators.common import by_feature, whole, width
from quarrystat.operators.reshape import to_long, with_label

MAX_STATES = 10_000


def _per_feature(df: DataFrame, *aggs: Column, d: int | None = None) -> DataFrame:
    """Aggregates per feature: cells are combined inside each task, so the
    shuffle carries one row per feature and task. Null and ragged rows are errors."""
    d = width(df, empty=0) if d is None else d
    return df.select(F.posexplode(whole(df, d)).alias("j", "v")).groupBy("j").agg(*aggs)


def mean_ignoring_nan(v: Column) -> Column:
    """NaN where nothing is left to average."""
    return F.coalesce(F.avg(F.when(~F.isnan(v), v)), F.lit(float("nan")))


def col_means(df: DataFrame, d: int | None = None) -> DataFrame:
    return _per_feature(df, F.avg("v").alias("mean"), d=d)


def col_means_ignoring_nan(df: DataFrame) -> DataFrame:
    return _per_feature(df, mean_ignoring_nan(F.col("v")).alias("mean"))


def col_l2(df: DataFrame, d: int | None = None) -> DataFrame:
    return _per_feature(df, F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("l2"), d=d)


def col_summary(df: DataFrame) -> DataFrame:
    v = F.col("v")
    return _per_feature(df, F.count("*").alias("n"), F.min(v).alias("lo"), F.max(v).alias("hi"),
                        F.avg(v).alias("mean"), F.sqrt(F.sum(v * v)).alias("l2"))


def mean_vector(df: DataFrame):
    """Column means as a driver vector of length d."""
    d = width(df)
    return by_feature(col_means(df, d), d, "mean")[0]


def mean_shift(df: DataFrame) -> DataFrame:
    """Rows minus the column means."""
    return df.withColumn("features", A.subtract(F.col("features"), A.literal_array(mean_vector(df))))


def unit_norm(df: DataFrame, label: str | None = None) -> DataFrame:
    """Every column divided by its largest magnitude; zero columns stay zero.

    With ``label`` "last" or "first" the label is put into the row afterwards.
    """
    d = width(df)
    top, = by_feature(_per_feature(df, F.max(F.abs("v")).alias("top"), d=d), d, "top")
    top[top == 0] = 1.0
    out = df.withColumn("features", F.zip_with("features", A.literal_array(top),
                                               lambda x, t: x / t))
    return with_label(out, label) if label else out


def unit_norm_long(df: DataFrame) -> DataFrame:
    """Feature-major form of :func:`unit_norm`: ``(j, id, v)``."""
    return to_long(unit_norm(df)).select("j", "id", "v")


def row_bins(df: DataFrame, levels: int) -> DataFrame:
    """Equal-frequency bins inside each sample, the label taken as one more value.

    Returns the rows with binned features and binned label.
    """
    rest = [c for c in df.columns if c not in ("features", "label")]
    types = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(rest).schema]
    schema = ", ".join(types + ["features array<int>", "label int"])
    return with_label(df.select(*rest, "features", "label")).drop("label").mapInArrow(
        kernels.row_bin_kernel(rest, levels), schema)


def crosstab_counts(df: DataFrame, a: str, b: str) -> DataFrame:
    """Long contingency table ``(a, b, n)`` with nulls shown as 'null'."""
    return (df.groupBy(*[F.coalesce(F.col(c).cast("string"), F.lit("null")).alias(c) for c in (a, b)])
            .agg(F.count("*").alias("n")))


def crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    """Contingency table with one column per value of ``b`` and 0 in empty cells."""
    counts = crosstab_counts(df, a, b)
    heads = [r[0] for r in counts.select(b).distinct().limit(MAX_STATES).collect()]
    if len(heads) >= MAX_STATES:
        raise ValueError(f"{b} has {MAX_STATES} or more distinct values")
    wide = counts.groupBy(a).pivot(b, sorted(heads)).agg(F.sum("n")).na.fill(0)
    return wide.toDF(*[c.replace("`", "") for c in wide.columns])


def label_states(df: DataFrame, col: str, limit: int = MAX_STATES) -> list:
    """Sorted distinct labels; refuses columns with more than ``limit`` of them."""
    got = [r[0] for r in df.select(col).distinct().limit(limit + 1).collect()]
    if len(got) > limit:
        raise ValueError(f"{col} has more than {limit} distinct values")
    return sorted(v for v in got if v is not None)


def index_labels(df: DataFrame, col: str, out: str = "label", limit: int = MAX_STATES) -> DataFrame:
    """Labels recoded to 0, 1, ... in sorted order."""
    states = F.array(*[F.lit(s) for s in label_states(df, col, limit)])
    return df.withColumn(out, (F.array_position(states, F.col(col)) - 1).cast("int"))


def positive_label(c: Column) -> Column:
    """1 where the label is 1.0, else 0."""
    return F.when(c == 1.0, 1).otherwise(0)


def error_rate(df: DataFrame, prediction: str = "prediction", label: str = "label") -> DataFrame:
    wrong = (F.col(prediction) != F.col(label)).cast("double")
    return df.agg(F.avg(wrong).alias("error_rate"), (1 - F.avg(wrong)).alias("accuracy"))
