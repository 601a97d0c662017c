"""What the text operators share: words, row keys, saved intermediates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystat.session import scratch_path

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Stands for a null id: it sorts after every other.
LAST_ID = (1 << 63) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: later steps start from
    files that outlive an executor, and nothing is computed twice."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def row_id(c: str | Column = "doc_id") -> Column:
    """The id, nulls last of all."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(c.cast("long"), F.lit(LAST_ID))


def packed(docs: DataFrame) -> Column:
    """The whole row in one column, so that no name can clash with ours."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns])


def unpacked(df: DataFrame, columns: list[str], row: str = "row_", **new: Column) -> DataFrame:
    """The row again; ``new`` replaces fields of the same name."""
    return df.select(*[new[c].alias(c) if c in new else F.col(f"{row}.`{c}`").alias(c) for c in columns])


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z, nothing else."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def held_out(c: Column, parts: int, part: int) -> Column:
    """Rows whose crc32 of the id as text leaves the given remainder (null id: never)."""
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % parts == part, F.lit(False))


def row_digest(docs: DataFrame) -> Column:
    """A digest of the whole row that tells nulls in different columns apart."""
    return F.xxhash64(*[x for c in docs.columns for x in (F.col(f"`{c}`").isNull(), F.col(f"`{c}`"))])


def one_row_of_each(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """One row of each group; ``marks`` has ``(d, r, g)`` of every row: id, row digest and
    group. The smallest id and then the smallest digest stays; of equal rows one."""
    keep = marks.groupBy("g").agg(F.min(F.struct("d", "r")).alias("k")).select("k.d", "k.r").distinct()
    times = marks.groupBy("d", "r").count().select("d", "r", (F.col("count") > 1).alias("several"))
    keep = saved(keep.join(times, ["d", "r"]), "kept-rows")
    kept = docs.select(packed(docs).alias("row_"), row_id().alias("d"), row_digest(docs).alias("r")).join(keep, ["d", "r"])
    first = kept.where("several").groupBy("d", "r").agg(F.first("row_").alias("row_"))
    return unpacked(kept.where("not several").select("row_").unionByName(first.select("row_")), docs.columns)


def crowded(total: int) -> int:
    """A key with more rows than this is hot: 1/1024 of all rows, but 1,024 at least and 65,536
    at most. A task can take a key below it; the keys above it are at most 1,024 or one in
    65,536 rows, so a list of their hashes can be broadcast."""
    return max(1024, min(total // 1024, 65_536))


def matched(rows: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` joined with ``other``, which has one small row for each key (rows without a
    partner keep nulls). The partners of hot keys are broadcast, so that no task gets all rows
    of one key. ``rows`` is read three times, it should be a saved table."""
    hot = rows.groupBy(*keys).count().where(F.col("count") > crowded(rows.count())).select(*keys)
    hot = saved(hot.join(other, keys, "left").withColumn("hot_", F.lit(True)), "hot-partners")
    marked = rows.join(F.broadcast(hot), keys, "left")
    near = marked.where(F.col("hot_").isNotNull()).drop("hot_")
    return near.unionByName(marked.where(F.col("hot_").isNull()).select(*rows.columns).join(other, keys, "left"))
