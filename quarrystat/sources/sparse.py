"""Sparse rows: ML vectors made from cells, and cells counted from texts.

A sparse row is an ML vector in ``features``. Nothing here makes a row as wide as the table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from quarrystat.operators.products import cell_columns

#: Bytes of texts whose words are counted in one task.
TEXT_BYTES = 8 << 20


def _vector_kernel(keep: list[str], d: int):
    def run(batches):
        for b in batches:
            n = b.num_rows
            at = b.column("at")
            if len(at.flatten()) and not 0 <= min(at.flatten().to_numpy()) <= max(at.flatten().to_numpy()) < d:
                raise ValueError(f"a position is outside 0..{d - 1}")
            x = pa.StructArray.from_arrays(
                [pa.array(np.zeros(n, np.int8)), pa.array(np.full(n, d, np.int32)), at, b.column("v")],
                names=["type", "size", "indices", "values"])
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), x], names=[*keep, "features"])
    return run


def to_vectors(cells: DataFrame, d: int) -> DataFrame:
    """Rows with ``at`` (ascending positions) and ``v`` as ML vectors of width d; other columns stay."""
    keep = [c for c in cells.columns if c not in ("at", "v")]
    schema = StructType([*cells.select(*keep).schema.fields, StructField("features", VectorUDT(), metadata={"width": d})])
    src = cells.select(*keep, F.col("at").cast("array<int>").alias("at"), F.col("v").cast("array<double>").alias("v"))
    return src.mapInArrow(_vector_kernel(keep, d), schema)


def from_entries(entries: DataFrame, d: int) -> DataFrame:
    """An entry table ``(i, j, value)`` as sparse rows ``(id, features)``; entries of one place
    are added up before a row is put together."""
    cells = entries.groupBy("i", "j").agg(F.sum("value").alias("v"))
    rows = cells.groupBy(F.col("i").alias("id")).agg(F.array_sort(F.collect_list(F.struct("j", "v"))).alias("c"))
    return to_vectors(rows.select("id", F.col("c.j").alias("at"), F.col("c.v").alias("v")), d)


def to_entries(df: DataFrame, key: str = "id") -> DataFrame:
    """The cells that sparse rows hold: ``(key, j, v)``."""
    at, v = cell_columns()
    return df.select(key, F.explode(F.arrays_zip(at, v)).alias("c")).select(key, F.col("c.at").alias("j"), "c.v")


def to_dense(df: DataFrame) -> DataFrame:
    """Vectors as arrays, every zero written out."""
    return df.withColumn("features", vector_to_array("features"))


def word_entries(docs: DataFrame, buckets: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(i, j, value)``: how often document i holds words (runs of A-Z, a-z) of bucket j, the
    bucket being a hash of the word that SQL can repeat. Null ids and texts have no entries.

    Whole texts go to as many partitions as keep ``TEXT_BYTES`` each, by id, so that the cells a
    task counts do not grow with the table; a document's cells stay together for later steps.
    """
    words = F.explode(F.regexp_extract_all(F.col(text), F.lit("[A-Za-z]+"), F.lit(0)))
    j = F.conv(F.substring(F.md5("w"), 1, 8), 16, 10).cast("long") % buckets
    docs = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("i"), text)
    size = docs.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0
    parts = max(docs.sparkSession.sparkContext.defaultParallelism, -(-size // TEXT_BYTES))
    return (docs.repartition(parts, "i").select("i", words.alias("w"))
            .groupBy("i", j.cast("int").alias("j")).agg(F.count("*").cast("double").alias("value")))
