"""Line dedup: repeated lines stay only in the first document that holds them.

Every line of at least ten characters becomes a 128-bit hash with its document
and position. The hashes are range-partitioned and sorted by document and
position; a running first value per hash tells the owner. Decisions come back as
one bitmap per document, never as text.

Skew: a hash so frequent that it would fill a partition is found on a sample of
documents (a hint about speed only). Its owner is then a minimum that every task
combines before the shuffle, and its lines never move.

Defined cases: null text is one empty line; documents with a null id sort last
and count as one document; rows with the same id are one document; rows that are
equal throughout get the same bitmap; other columns are never looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrystat.llm.common import BLANKS, ascii_lower, packed, row_id, saved, unpacked

#: Documents in the sample that looks for hot lines: one of so many.
HINT_EVERY = 64


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _line_hashes(docs: DataFrame, min_chars: int) -> DataFrame:
    """``(h1, h2, d, t, pos)`` of each line whose key is long enough."""
    d = docs.select(row_id().alias("d"), F.xxhash64("text").alias("t"),
                    F.posexplode(lines_of(F.col("text"))).alias("pos", "line"))
    key = F.col("key")
    return (d.withColumn("key", F.btrim("line", F.lit(BLANKS))).where(F.length(key) >= min_chars)
            .withColumn("key", ascii_lower(key))
            .select(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2"), "d", "t", "pos"))


def _hot(hashes: DataFrame) -> DataFrame:
    """Hashes with more than a quarter of a partition's share of all lines; at
    most four for each shuffle partition, and so small enough to broadcast."""
    parts = int(hashes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sample = hashes.where(F.pmod(F.xxhash64(F.lit(7), "d"), F.lit(HINT_EVERY)) == 0)
    least = max(32, sample.count() / (4 * parts))
    return sample.groupBy("h1", "h2").count().where(F.col("count") >= least).select("h1", "h2")


def keep_bitmaps(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """``(d, t, keep array<long>)`` of the documents that lose a line: bit ``i % 64``
    of word ``i / 64`` is 1 if line i stays. Words after the last loss are left off."""
    hashes = saved(_line_hashes(docs, min_chars), "lines")
    hot = saved(hashes.join(F.broadcast(_hot(hashes)), ["h1", "h2"])
                .groupBy("h1", "h2").agg(F.min("d").alias("owner")), "hot-lines")
    marked = hashes.join(F.broadcast(hot), ["h1", "h2"], "left")
    cold = (marked.where(F.col("owner").isNull()).drop("owner")
            .repartitionByRange("h1", "h2").sortWithinPartitions("h1", "h2", "d", "pos")
            .withColumn("owner", F.first("d").over(Window.partitionBy("h1", "h2").orderBy("d", "pos"))))
    lost = marked.where("owner < d").unionByName(cold.where("owner < d"))
    words = (lost.groupBy("d", "t", F.expr("pos div 64").cast("int").alias("word"))
             .agg(F.expr("bit_or(shiftleft(1L, pos % 64))").alias("bits")))
    return (words.groupBy("d", "t").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("m"))
            .select("d", "t", F.expr("transform(sequence(0, array_max(map_keys(m))),"
                                     " w -> ~coalesce(m[w], 0L))").alias("keep")))


def _marked(docs: DataFrame, min_chars: int) -> DataFrame:
    """Each row with its lines and the lines that stay."""
    rows = docs.select(packed(docs).alias("row_"), row_id().alias("d"), F.xxhash64("text").alias("t"))
    stays = "filter(lines_, (x, i) -> coalesce(getbit(get(keep, cast(i div 64 as int)), i % 64), 1) = 1)"
    return (rows.join(keep_bitmaps(docs, min_chars), ["d", "t"], "left")
            .withColumn("lines_", lines_of(F.col("row_.text")))
            .withColumn("kept_", F.when(F.col("keep").isNull(), F.col("lines_")).otherwise(F.expr(stays))))


def line_digests(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """``(doc_id, n_lines, n_dropped, kept_sha256)`` of every document."""
    n = F.size("lines_").cast("long")
    return _marked(docs, min_chars).select(
        F.col("row_.doc_id").alias("doc_id"), n.alias("n_lines"),
        (n - F.size("kept_")).cast("long").alias("n_dropped"),
        F.sha2(F.array_join("kept_", "\n").cast("binary"), 256).alias("kept_sha256"))


def without_repeated_lines(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """The documents with only the lines that stay; untouched texts as they were.

    A document that loses every line keeps an empty text. ``n_chars``, where there
    is one, follows the new text.
    """
    m = _marked(docs, min_chars)
    text = F.when(F.size("kept_") == F.size("lines_"), F.col("row_.text")).otherwise(F.array_join("kept_", "\n"))
    new = {"text": text}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        new["n_chars"] = F.when(F.size("kept_") == F.size("lines_"), F.col("row_.n_chars")).otherwise(
            F.length(F.array_join("kept_", "\n")).cast(kind))
    return unpacked(m, docs.columns, **new)


LINE_DEDUP_SQL = """
WITH l AS (SELECT doc_id, unnest(s) AS line, generate_subscripts(s, 1) AS pos
           FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents)),
k AS (SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
o AS (SELECT key, min(doc_id) AS own FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1),
m AS (SELECT k.*, coalesce(o.own < k.doc_id, false) AS lost FROM k LEFT JOIN o USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE lost) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT lost), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
