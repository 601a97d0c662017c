"""Exact dedup by deterministic block naming.

Each text is cut into blocks of equal size. The blocks are sorted and named by integers,
equal blocks alike and others never; then adjacent pairs of names are named in the same
way, until each document has one name. Two texts are equal if and only if they reach the
same name at the same level: contents are compared, never hashes of them.

A text of n blocks takes ``ceil(log2 n)`` levels, and only documents with more than one
name left go on. Names come from a sort inside small buckets (a key's bucket is a hash of
it, which equal keys share), so no sort is global and the buckets grow in number with the
rows. A key of very many rows is found by counts (combined before the shuffle) and named
once, apart from its rows; these get the name by a join that deals them out.

Defined cases: null text counts as empty, and all empty texts are equal; a null id is
below every other, so such a row stays only where its whole group has no id; of rows with
the same id and the same text one stays; rows with the same id and other texts are judged
by text; very long texts are cut in two steps, in time proportional to their length; an
empty table gives an empty result; other columns are never looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrystat.llm.common import crowded, matched, packed, saved, unpacked

#: Bytes of a block, and blocks of a piece: long texts are cut into pieces first.
BLOCK, PIECE = 4096, 256
#: Rows of a bucket of names, on average.
BUCKET_ROWS = 1024
#: Stands for a missing id: below every other.
NO_ID = -(1 << 63)
#: Copies of one row written by one task.
CHUNK = 65_536


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text.cast("string"), F.lit("")).cast("binary"), 256))


def _identity(docs: DataFrame) -> list[Column]:
    """``(d, s)``: id and digest. The digest tells rows of one id apart and is reported; it
    never decides that texts are equal."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("d"), _digest(F.col("text")).alias("s")]


def _cut(x: Column, size: int) -> Column:
    """A binary value in parts of ``size`` bytes; an empty one is one empty part."""
    last = F.greatest(F.octet_length(x) - 1, F.lit(0))
    return F.transform(F.sequence(F.lit(0), F.floor(last / size).cast("int")),
                       lambda i: F.substring(x, i * size + 1, F.lit(size)))


def text_blocks(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """``(d, s, n, pos, block)``: block ``pos`` of the ``n`` of a document."""
    size = block * PIECE
    raw = docs.select(*_identity(docs), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("x"))
    n = F.greatest(F.ceil(F.octet_length("x") / block), F.lit(1)).cast("int").alias("n")
    pieces = raw.select("d", "s", n, F.posexplode(_cut(F.col("x"), size)).alias("piece", "x"))
    parts = pieces.select("d", "s", "n", "piece", F.posexplode(_cut(F.col("x"), block)).alias("k", "block"))
    return parts.select("d", "s", "n", (F.col("piece") * PIECE + F.col("k")).alias("pos"), "block")


def _ranked(rows: DataFrame, keys: list[str], n: int, rest: list[str]) -> DataFrame:
    """``rest`` and ``name``, the rank of the key among those of its bucket; ``n`` rows."""
    buckets = n // BUCKET_ROWS + 1
    rank = F.dense_rank().over(Window.partitionBy("bucket").orderBy(*keys)).cast("long")
    return (rows.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)))
            .select(*rest, (rank * buckets + F.col("bucket")).alias("name")))


def named(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with ``name long`` in place of ``keys``: equal keys share a name, others
    never do. ``rows`` is read several times; it should be a saved table or a scan."""
    h = F.xxhash64(*keys)
    counts = saved(rows.groupBy(h.alias("h")).agg(F.count("*").alias("rows")), "name-counts")
    total = counts.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    limit, rest = crowded(total), [c for c in rows.columns if c not in keys]
    crowds = counts.where(F.col("rows") > limit).select("h", F.expr(f"cast(rows div {limit} as int)").alias("salts"))
    hashed = rows.withColumn("h", h).join(F.broadcast(crowds), "h", "left")
    out = _ranked(hashed.where(F.col("salts").isNull()), keys, total, rest)
    if crowds.isEmpty():
        return out
    hot = hashed.where(F.col("salts").isNotNull())
    few = saved(hot.groupBy(*keys).agg(F.max("salts").alias("salts")), "hot-keys")
    names = saved(_ranked(few, keys, few.count(), [*keys, "salts"]), "hot-names")
    # each row goes to one of as many places as its key has; negative names are those of hot keys
    names = names.select(*keys, (-F.col("name")).alias("name"), F.explode(F.sequence(F.lit(0), "salts")).alias("salt"))
    # (rows equal throughout differ in their task)
    dealt = hot.withColumn("salt", F.pmod(F.xxhash64(*rest, F.spark_partition_id()), F.col("salts") + 1).cast("int"))
    return out.unionByName(dealt.join(names, [*keys, "salt"]).select(*rest, "name"))


def identities(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """``(d, s, copies, level, name)``: equal texts, and only these, share level and name.
    Rows equal in id and text are one row with a count."""
    level = 0
    names = named(text_blocks(docs, block), ["block"])
    names = saved(names.groupBy("d", "s", "n", "pos", "name").agg(F.count("*").alias("copies")), "names")
    done = [names.where("n = 1").select("d", "s", "copies", F.lit(level).alias("level"), "name")]
    while (names.agg(F.max("n")).first()[0] or 1) > 1:
        level += 1
        half = F.expr("pos div 2").cast("int")
        at = [F.max(F.when(F.col("pos") % 2 == k, F.col("name"))).alias(c) for k, c in enumerate(("left", "right"))]
        pairs = (names.where("n > 1").groupBy("d", "s", F.expr("cast((n + 1) div 2 as int)").alias("n"), half.alias("pos"))
                 .agg(F.max("copies").alias("copies"), *at))
        # 0 names nothing: it stands for the missing second half
        pairs = saved(pairs.withColumn("right", F.coalesce("right", F.lit(0).cast("long"))), "pairs")
        names = saved(named(pairs, ["left", "right"]), "names")
        done.append(names.where("n = 1").select("d", "s", "copies", F.lit(level).alias("level"), "name"))
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def _groups(docs: DataFrame, block: int) -> DataFrame:
    """``(d, s, copies, keep, group_size)`` of every id and text."""
    ids = saved(identities(docs, block), "identities")
    groups = ids.groupBy("level", "name").agg(F.max("d").alias("keep"), F.sum("copies").alias("group_size"))
    return matched(ids, groups, ["level", "name"]).drop("level", "name")


def exact_copies(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """``(doc_id, keep_id, group_size, kept, text_sha256)``, a row for every row of ``docs``."""
    def long(c):
        return F.when(F.col(c) != NO_ID, F.col(c))
    rows = saved(_groups(docs, block), "groups").select(
        long("d").alias("doc_id"), long("keep").alias("keep_id"), "group_size",
        (F.col("d") == F.col("keep")).alias("stays"), F.lower(F.hex("s")).alias("text_sha256"), "copies")
    few = rows.where(F.col("copies") <= CHUNK).select("*", F.lit(0).cast("long").alias("chunk"))
    # copies of one row by the million are dealt out before they are written
    many = (rows.where(F.col("copies") > CHUNK)
            .select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(copies - 1) div {CHUNK}"))).alias("chunk"))
            .repartition(F.col("doc_id"), F.col("chunk")))
    left = F.least(F.col("copies") - F.col("chunk") * CHUNK, F.lit(CHUNK)).cast("int")
    copy = F.explode(F.sequence(F.lit(1), left)).alias("copy")
    return few.unionByName(many).select("*", copy).select(
        "doc_id", "keep_id", "group_size", (F.col("stays") & (F.col("chunk") == 0) & (F.col("copy") == 1)).alias("kept"),
        "text_sha256")


def without_copies(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """The rows that stay, whole: of equal texts the one with the largest id."""
    groups = saved(_groups(docs, block), "groups")
    keep = groups.where("d = keep").select("d", "s", "copies")
    limit = crowded(groups.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0])
    crowds = keep.where(F.col("copies") > limit).select("d", "s", F.lit(True).alias("crowd"))
    rows = docs.select(packed(docs).alias("row_"), *_identity(docs)).join(F.broadcast(crowds), ["d", "s"], "left")
    cold = rows.where(F.col("crowd").isNull()).join(keep, ["d", "s"])
    several = rows.where("crowd").select("d", "s", "row_").unionByName(cold.where("copies > 1").select("d", "s", "row_"))
    first = several.groupBy("d", "s").agg(F.first("row_").alias("row_")).select("row_")
    return unpacked(cold.where("copies = 1").select("row_").unionByName(first), docs.columns)


EXACT_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
  doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
