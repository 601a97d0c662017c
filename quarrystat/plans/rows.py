"""Row-wise and partition-wise operators."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarrystat.functions import arrays as A
from quarrystat.operators import reshape
from quarrystat.plans.registry import embeddings, query, table

SEED = 11


def _events(spark, sf):
    return table(spark, sf, "events").withColumnRenamed("event_id", "id")


@query("row_ordinal", "SELECT event_id AS id, row_number() OVER (ORDER BY event_id) - 1 AS ordinal FROM events")
def row_ordinal(spark, sf):
    return reshape.with_ordinal(_events(spark, sf).select("id"), bucket_rows=1500)


@query("consecutive_pairs", """WITH o AS (SELECT value, row_number() OVER (ORDER BY event_id) - 1 AS o FROM events),
p AS (SELECT o, (o // 1000)::BIGINT AS blk, lag(value) OVER (PARTITION BY o // 1000 ORDER BY o) AS prev, value AS cur FROM o)
SELECT blk, prev, cur FROM p WHERE o % 1000 <> 0""")
def consecutive_pairs(spark, sf):
    return reshape.consecutive_pairs(_events(spark, sf).select("id", "value"), "value", 1000)


@query("partition_tags", "SELECT user_id, 1::BIGINT AS tags, count(*) AS n FROM events GROUP BY user_id")
def partition_tags(spark, sf):
    """Rows dealt out by a key carry one tag for each key, and every row carries one."""
    t = reshape.tag_partition(_events(spark, sf).select("user_id").repartition("user_id"))
    return (t.groupBy("user_id", "part").agg(F.count("*").alias("k"))
            .groupBy("user_id").agg(F.count("part").alias("tags"), F.sum("k").alias("n")))


_HASH = f"('0x' || substr(md5(event_id::VARCHAR || ':{SEED}'), 1, 8))::BIGINT / 4294967296.0"


@query("replicate", f"""WITH t AS (SELECT event_id AS id, floor({_HASH} * 10)::INTEGER AS n FROM events)
SELECT id, unnest(generate_series(1, n))::INTEGER AS copy FROM t WHERE n > 0""")
def replicate(spark, sf):
    return reshape.replicate(_events(spark, sf).select("id"), 10, seed=SEED)


@query("hash_split", f"SELECT event_id AS id, CASE WHEN {_HASH} < 0.8 THEN 'train' ELSE 'test' END AS part FROM events")
def hash_split(spark, sf):
    train, test = reshape.split(_events(spark, sf).select("id"), 0.8, seed=SEED)
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))


@query("union_blocks", """SELECT l_linestatus AS part, count(*) AS n, round(avg(l_tax), 6) AS tax FROM lineitem GROUP BY 1
UNION ALL SELECT 'all', count(*), round(avg(l_tax), 6) FROM lineitem""")
def union_blocks(spark, sf):
    t = table(spark, sf, "lineitem").select("l_linestatus", "l_tax")
    both = t.withColumnRenamed("l_linestatus", "part").unionByName(
        t.select(F.lit("all").alias("part"), "l_tax"))
    return both.groupBy("part").agg(F.count("*").alias("n"), A.neat(F.avg("l_tax")).alias("tax"))


@query("top_rows", """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice FROM lineitem
ORDER BY l_extendedprice DESC, l_orderkey, l_partkey, l_suppkey, l_linenumber LIMIT 25""")
def top_rows(spark, sf):
    return (table(spark, sf, "lineitem")
            .select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice")
            .orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
            .limit(25))


@query("sort_in_partitions", """SELECT vec_id AS id, label,
  row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS place FROM embeddings""")
def sort_in_partitions(spark, sf):
    """The place of each row behind the first of its label, as the partition has them."""
    t = reshape.sort_in_partitions(embeddings(spark, sf).select("id", "label"), ["label"], "id")
    t = t.withColumn("at", F.monotonically_increasing_id())
    first = F.min("at").over(Window.partitionBy("label"))
    return t.select("id", "label", (F.col("at") - first).alias("place"))
