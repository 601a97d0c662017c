"""Row identity, long form, transposes, blocks and partition-wise row work."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarrystat.functions import arrays as A
from quarrystat.functions import kernels
from quarrystat.session import scratch_path

ORDINAL_BUCKET = 1_000_000
# Samples and cells of a tile of a transpose.
TILE_ROWS, TILE_CELLS = 16_384, 4_000_000


def wide_table(df: DataFrame, id_col, features, label=None, extra=()) -> DataFrame:
    """Any table as ``(id, [label], features)``; nulls become NaN.

    ``features`` is an array column or a list of numeric columns.
    """
    d = len(features) if isinstance(features, (list, tuple)) else None
    if d:
        nan = F.lit(float("nan"))
        cells = [F.col(c) if isinstance(c, str) else c for c in features]
        features = F.array(*[F.coalesce(c.cast("double"), nan) for c in cells])
    else:
        features = A.clean_double(F.col(features) if isinstance(features, str) else features)
    cols = [(F.col(id_col) if isinstance(id_col, str) else id_col).cast("bigint").alias("id")]
    if label is not None:
        cols.append((F.col(label) if isinstance(label, str) else label).alias("label"))
    features = features.alias("features", metadata={"width": d}) if d else features.alias("features")
    return df.select(*cols, features, *extra)


def with_label(df: DataFrame, where: str = "last") -> DataFrame:
    """Label put behind (``last``) or before (``first``) the features."""
    one = F.array(F.col("label").cast("double"))
    both = F.concat("features", one) if where == "last" else F.concat(one, "features")
    return df.withColumn("features", both)


def to_long(df: DataFrame, *keep: str, features: str = "features", value: str = "v") -> DataFrame:
    """One row per cell: ``(*keep, j, v)``.  Narrow, no shuffle."""
    return df.select(*(keep or ("id",)), F.posexplode(features).alias("j", value))


def transpose_entries(df: DataFrame) -> DataFrame:
    """Entry table of the transposed matrix: feature is the row, id the column."""
    return to_long(df).select(F.col("j").alias("i"), F.col("id").alias("j"),
                              F.col("v").alias("value"))


def transpose_tiles(df: DataFrame, rows: int = TILE_ROWS, cells: int = TILE_CELLS) -> DataFrame:
    """``(j, chunk, ids, values)``: feature j of the samples of a chunk, in id order.

    A tile holds ``rows`` samples of as many features as make ``cells`` cells, so that the
    width of the table never makes one larger. Rows are cut by feature tile before the
    shuffle, each cell travels once, and a tile leaves its task in order.
    """
    blocked = with_blocks(df.select("id", "features"), rows)
    step = max(1, cells // rows)
    starts = F.sequence(F.lit(0), F.greatest(F.size("features") - 1, F.lit(0)), F.lit(step))
    parts = blocked.select("blk", "id", "features", F.explode(starts).alias("first")).select(
        "blk", "first", "id", F.slice("features", F.col("first") + 1, F.lit(step)).alias("features"))
    return parts.groupBy("blk", "first").applyInArrow(
        kernels.transpose_kernel(), "j int, chunk bigint, ids array<bigint>, values array<double>")


def transpose_sorted(df: DataFrame, rows: int = TILE_ROWS, cells: int = TILE_CELLS) -> DataFrame:
    """Transposed cells ``(j, pos, id, v)`` in feature order, sample order inside each feature;
    ``pos`` counts the samples of a feature. The sort moves whole runs of a tile, not cells."""
    runs = transpose_tiles(df, rows, cells).orderBy("j", "chunk")
    cell = F.posexplode(F.arrays_zip("ids", "values")).alias("k", "c")
    return runs.select("j", "chunk", cell).select(
        "j", (F.col("chunk") * rows + F.col("k")).alias("pos"), F.col("c.ids").alias("id"), F.col("c.values").alias("v"))


def transpose_chunks(df: DataFrame, chunk_rows: int = TILE_ROWS, cells: int = TILE_CELLS) -> DataFrame:
    """Feature-major arrays ``(j, chunk, values)`` of at most ``chunk_rows`` samples, from
    bounded tiles; no array ever grows with the table. With ``chunk_rows`` >= rows each
    feature is one array."""
    return transpose_tiles(df, chunk_rows, cells).select("j", "chunk", "values")


def mirror(entries: DataFrame) -> DataFrame:
    """Full symmetric entry table from one triangle, without reading it twice."""
    rest = [F.col(c) for c in entries.columns if c not in ("i", "j")]
    here = F.struct("i", "j", *rest)
    there = F.struct(F.col("j").alias("i"), F.col("i").alias("j"), *rest)
    both = F.when(F.col("i") == F.col("j"), F.array(here)).otherwise(F.array(here, there))
    return entries.select(F.inline(both))


def append_columns(a: DataFrame, b: DataFrame) -> DataFrame:
    """Columns of ``b`` behind those of ``a``, matched on id. Both tables must have the same
    ids, each once: null and repeated ids are an error before the join, unmatched ones in it."""
    _unique(a.select("id"), "id")
    _unique(b.select("id"), "id")
    left = a.select(F.col("id").alias("_id"), F.struct(*a.columns).alias("_a"))
    right = b.select(F.col("id").alias("_other"), F.col("features").alias("_more"))
    both = left.join(right, F.col("_id") == F.col("_other"), "full_outer")
    whole = F.when(F.col("_id").isNotNull() & F.col("_other").isNotNull(), F.concat("_a.features", "_more")).otherwise(
        F.raise_error(F.concat(F.lit("id without a partner: "), F.coalesce("_id", "_other").cast("string"))))
    return both.select(*[(whole if c == "features" else F.col(f"_a.{c}")).alias(c) for c in a.columns])


def _unique(keys: DataFrame, key: str) -> int:
    """The number of keys; null or repeated ones are an error."""
    n, distinct = keys.agg(F.count("*"), F.count_distinct(key)).first()
    if n != distinct:
        raise ValueError(f"{key}: {n} rows but {distinct} distinct keys; a key must be unique and not null")
    return n


def feature_column(df: DataFrame, j: int, features: str = "features") -> DataFrame:
    """One feature as ``(id, v)``."""
    return df.select("id", F.get(F.col(features), F.lit(j)).alias("v"))


def with_ordinal(df: DataFrame, key: str = "id", name: str = "ordinal",
                 bucket_rows: int = ORDINAL_BUCKET) -> DataFrame:
    """Contiguous 0-based position in the order of a unique numeric key.

    Only the keys are numbered, range by range of about ``bucket_rows``, so no
    task sorts the whole table and no wide row takes part; the positions then
    meet the rows by key.  Null or repeated keys are an error.
    """
    keys = df.select(key)
    n = _unique(keys, key)
    numbered = _number_keys(keys, key, name, n, bucket_rows)
    if df.columns == [key]:
        return numbered
    # one bucket at most: a checked size
    return df.join(F.broadcast(numbered) if n <= min(bucket_rows, ORDINAL_BUCKET) else numbered, key)


def _number_keys(keys: DataFrame, key: str, name: str, n: int, bucket_rows: int) -> DataFrame:
    pieces = math.ceil(n / bucket_rows)
    if pieces <= 1:
        return keys.withColumn(name, F.row_number().over(W.orderBy(key)).cast("bigint") - 1)
    # range-partitioned, sorted and written once: the place in its file's partition is then fixed
    path = scratch_path(keys.sparkSession, "ordered-keys")
    (keys.repartitionByRange(pieces, key).sortWithinPartitions(key)
     .withColumn("_m", F.monotonically_increasing_id()).write.parquet(path))
    ordered = keys.sparkSession.read.parquet(path).select(
        key, F.expr("shiftright(_m, 33)").alias("_b"), F.expr("_m & ((1L << 33) - 1)").alias("_k"))
    sizes = ordered.groupBy("_b").agg(F.count("*").alias("_n"))
    before = W.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    # one row per range of about bucket_rows keys
    offsets = sizes.select("_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    return (ordered.join(F.broadcast(offsets), "_b")
            .select(key, (F.col("_off") + F.col("_k")).alias(name)))


def with_blocks(df: DataFrame, rows_per_block: int, key: str = "id") -> DataFrame:
    """Contiguous blocks of rows: ``blk = ordinal div rows_per_block``."""
    return (with_ordinal(df, key)
            .withColumn("blk", F.floor(F.col("ordinal") / rows_per_block).cast("bigint")))


def block_partition(df: DataFrame, rows_per_block: int, partitions: int | None = None) -> DataFrame:
    """Rows laid out so that a block sits inside one partition, in key order."""
    b = with_blocks(df, rows_per_block)
    b = b.repartition(partitions, "blk") if partitions else b.repartition("blk")
    return b.sortWithinPartitions("blk", "ordinal")


def consecutive_pairs(df: DataFrame, value: str, rows_per_block: int, key: str = "id") -> DataFrame:
    """``(blk, prev, cur)`` of neighbouring rows inside each contiguous block."""
    w = W.partitionBy("blk").orderBy("ordinal")
    return (with_blocks(df, rows_per_block, key)
            .select("blk", F.lag(value).over(w).alias("prev"), F.col(value).alias("cur"),
                    F.row_number().over(w).alias("_rn"))
            .filter("_rn > 1").drop("_rn"))


def sort_in_partitions(df: DataFrame, by: list[str], *order: str, parts: int | None = None) -> DataFrame:
    """Rows dealt out by ``by`` and sorted in each partition by ``by``, then ``order``;
    ``parts`` partitions, by default as many as the session shuffles into."""
    dealt = df.repartition(parts, *by) if parts else df.repartition(*by)
    return dealt.sortWithinPartitions(*by, *order)


def tag_partition(df: DataFrame) -> DataFrame:
    return df.withColumn("part", F.spark_partition_id())


def hash_unit(*cols, seed: int = 0) -> Column:
    """Uniform [0, 1) number that depends only on the key and the seed.

    Unlike ``rand`` it gives the same row the same number in every layout and
    on every retry.
    """
    text = F.concat_ws(":", *[F.col(c).cast("string") if isinstance(c, str) else c.cast("string")
                              for c in cols], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(float(2 ** 32))


def replicate(df: DataFrame, below: int = 10, key: str = "id", seed: int = 0) -> DataFrame:
    """Every row 0 to ``below - 1`` times, drawn per row."""
    times = F.floor(hash_unit(key, seed=seed) * below).cast("int")
    return (df.withColumn("_n", times).filter("_n > 0")
            .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_n")))).drop("_n"))


def split(df: DataFrame, share: float = 0.8, key: str = "id", seed: int = 0):
    """Train and test rows by a hash of the key."""
    u = hash_unit(key, seed=seed)
    return df.filter(u < share), df.filter(u >= share)
