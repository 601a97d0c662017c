"""Bounded training samples of labelled documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def about(rows: DataFrame, n: int, salt: int, key: str = "doc_id") -> DataFrame:
    """About ``n`` of the rows, chosen by a hash of the key; all of them if there are fewer."""
    total = max(1, rows.count())
    share = min(1.0, n / total)
    return rows.where(_hash(F.col(key), salt) < int(share * (1 << 30))) if share < 1 else rows


def _hash(key: Column, salt: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(salt), key), F.lit(1 << 30))


def with_text(ids: DataFrame, docs: DataFrame) -> DataFrame:
    """``ids`` (a bounded sample with a ``doc_id``) with the documents' texts and their hash
    ``h``. The sample is broadcast, so no text moves."""
    rows = docs.select(F.col("doc_id").alias("id_"), F.col("text").cast("string").alias("text"))
    return rows.join(F.broadcast(ids), F.col("id_") == F.col("doc_id")).drop("id_").withColumn("h", F.xxhash64("text"))


def one_for_each_id(rows: DataFrame) -> DataFrame:
    """Of rows with the same ``doc_id`` the one with the smallest ``h``: an id that many rows
    share does not make a sample larger. Combined before the shuffle; ``rows`` carry features."""
    kept = [c for c in rows.columns if c not in ("doc_id", "h")]
    return rows.groupBy("doc_id").agg(F.min_by(F.struct(*kept), "h").alias("r")).select("r.*")
