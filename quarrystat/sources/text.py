"""CSV and LibSVM tables without a key column, and their sinks."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarrystat.operators.products import is_vector


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(line, value)``: 0-based contiguous line numbers in file order.

    A line's place inside its file split is known where it is read; only the
    line counts of the splits are added up.
    """
    raw = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("_f"),
        F.col("_metadata.file_block_start").alias("_b"),
        F.monotonically_increasing_id().alias("_m"))
    splits = raw.groupBy("_f", "_b").agg(F.min("_m").alias("_first"), F.count("*").alias("_n"))
    before = W.orderBy("_f", "_b").rowsBetween(W.unboundedPreceding, -1)
    offsets = splits.select("_f", "_b", (F.coalesce(F.sum("_n").over(before), F.lit(0))
                                         - F.col("_first")).alias("_shift"))
    return raw.join(offsets, ["_f", "_b"]).select((F.col("_m") + F.col("_shift")).alias("line"),
                                                  "value")


def _numbers(value):
    return F.transform(F.split(value, ","), lambda x: F.trim(x).cast("double"))


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """Comma-separated numbers, one row per line: ``(id, features)``."""
    return numbered_lines(spark, path).select(F.col("line").alias("id"),
                                              _numbers(F.col("value")).alias("features"))


def read_pair(spark: SparkSession, feature_path: str, label_path: str) -> DataFrame:
    """A feature file and a label file paired line by line."""
    labels = numbered_lines(spark, label_path).select(
        F.col("line").alias("id"), F.trim("value").cast("double").alias("label"))
    return read_matrix(spark, feature_path).join(labels, "id").select("id", "label", "features")


def write_matrix(df: DataFrame, path: str, col: str = "features") -> None:
    """One comma-separated line per row, in id order."""
    (df.orderBy("id").select(F.array_join(F.col(col).cast("array<string>"), ",").alias("value"))
     .write.text(path))


def write_labels(df: DataFrame, path: str) -> None:
    df.orderBy("id").select(F.col("label").cast("string").alias("value")).write.text(path)


def read_libsvm(spark: SparkSession, path: str, features: int | None = None, dense: bool = False,
                ids: bool = False) -> DataFrame:
    """LibSVM rows as ``(label, features)``, ML vectors that hold the cells of the file;
    ``dense`` makes arrays of them. bz2 and gzip are read as they are. ``ids`` numbers the rows
    by split and line: the same for the same files, not contiguous."""
    reader = spark.read.format("libsvm")
    if features:
        reader = reader.option("numFeatures", str(features))
    x = vector_to_array("features").alias("features") if dense else "features"
    return reader.load(path).select(*([F.monotonically_increasing_id().alias("id")] if ids else []), "label", x)


def write_libsvm(df: DataFrame, path: str) -> None:
    """Rows with array or vector features; of sparse vectors only the cells they hold."""
    x = F.col("features") if is_vector(df) else array_to_vector("features").alias("features")
    df.select(F.col("label").cast("double").alias("label"), x).write.format("libsvm").save(path)


def write_entries(entries: DataFrame, path: str, fmt: str = "parquet") -> None:
    """An entry table as parquet or csv."""
    entries.write.format(fmt).save(path)


def stringify(df: DataFrame) -> DataFrame:
    """Every column as text: nulls become 'null', backticks leave the names."""
    return df.select(*[F.coalesce(F.col(f"`{c.replace('`', '``')}`").cast("string"), F.lit("null"))
                       .alias(c.replace("`", "")) for c in df.columns])


def from_rows(spark: SparkSession, rows, label: bool = True) -> DataFrame:
    """Rows held in memory as a table; ids follow the order given."""
    if label:
        data = [(i, float(y), [float(v) for v in x]) for i, (y, x) in enumerate(rows)]
        return spark.createDataFrame(data, "id bigint, label double, features array<double>")
    data = [(i, [float(v) for v in x]) for i, x in enumerate(rows)]
    return spark.createDataFrame(data, "id bigint, features array<double>")
