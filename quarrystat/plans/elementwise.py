"""Array functions and projections."""

from pyspark.sql import functions as F

from quarrystat.functions import arrays as A
from quarrystat.operators import stats
from quarrystat.operators.reshape import append_columns, feature_column, to_long, with_label
from quarrystat.plans.registry import E, embeddings, gappy, lineitem, query, r6, table

_f = "features"


@query("array_arith", f"WITH {E} SELECT id, j, {r6('v + 2 * v')} AS plus, {r6('v - 2 * v')} AS minus, "
       f"{r6('v * 2 * v')} AS times, {r6('v / (2 * v)')} AS ratio, {r6('v + 1.5')} AS plus_s, "
       f"{r6('v * 3')} AS times_s, {r6('v / 4')} AS ratio_s FROM e")
def array_arith(spark, sf):
    df = embeddings(spark, sf).withColumn("b", A.multiply_scalar(_f, 2.0))
    b = F.col("b")
    parts = {"plus": A.add(_f, b), "minus": A.subtract(_f, b), "times": A.multiply(_f, b),
             "ratio": A.divide(_f, b), "plus_s": A.add_scalar(_f, 1.5),
             "times_s": A.multiply_scalar(_f, 3.0), "ratio_s": A.divide_scalar(_f, 4.0)}
    names = list(parts)
    cells = df.select("id", *[c.alias(n) for n, c in parts.items()]).select(
        "id", F.posexplode(F.arrays_zip(*names)).alias("j", "c"))
    return cells.select("id", "j", *[A.neat(F.col(f"c.{n}")).alias(n) for n in names])


@query("array_int_ops", """SELECT sum(l_linenumber + l_suppkey % 10)::BIGINT AS sum0,
  sum(l_quantity::INTEGER + l_partkey % 7)::BIGINT AS sum1,
  sum((l_linenumber + l_suppkey % 10) // 3)::BIGINT AS div0,
  sum((l_quantity::INTEGER + l_partkey % 7) // 3)::BIGINT AS div1 FROM lineitem""")
def array_int_ops(spark, sf):
    t = table(spark, sf, "lineitem")
    a = F.array(F.col("l_linenumber"), F.col("l_quantity").cast("int"))
    b = F.array((F.col("l_suppkey") % 10).cast("int"), (F.col("l_partkey") % 7).cast("int"))
    s = t.select(A.add(a, b).alias("s")).withColumn("d", A.divide_int(F.col("s"), 3))
    return s.agg(*[F.sum(F.get(c, F.lit(i)).cast("bigint")).alias(n)
                   for n, c, i in (("sum0", "s", 0), ("sum1", "s", 1),
                                   ("div0", "d", 0), ("div1", "d", 1))])


@query("nested_array_ops", """SELECT l_returnflag,
  round(avg(l_quantity + l_tax), 6) AS s00, round(avg(l_discount + l_quantity), 6) AS s01,
  round(avg(l_tax + l_tax), 6) AS s10, round(avg(l_quantity + l_tax), 6) AS s11,
  round(avg((l_quantity + l_tax) / 4), 6) AS d00, round(avg((l_discount + l_quantity) / 4), 6) AS d01,
  round(avg((l_tax + l_tax) / 4), 6) AS d10, round(avg((l_quantity + l_tax) / 4), 6) AS d11
  FROM lineitem GROUP BY 1""")
def nested_array_ops(spark, sf):
    t = table(spark, sf, "lineitem")
    a = F.array(F.array("l_quantity", "l_discount"), F.array("l_tax", "l_quantity"))
    b = F.array(F.array("l_tax", "l_quantity"), F.array("l_tax", "l_tax"))
    s = t.select("l_returnflag", A.nested_add(a, b).alias("s")).withColumn(
        "d", A.nested_divide(F.col("s"), 4.0))
    return s.groupBy("l_returnflag").agg(
        *[A.neat(F.avg(F.col(c)[k][i])).alias(f"{c}{k}{i}") for c in ("s", "d") for k in (0, 1) for i in (0, 1)])


@query("pair_array_ops", """SELECT l_linestatus, round(avg((l_quantity + l_tax) / 3), 6) AS mean0,
  round(avg((l_quantity + l_tax) / 2), 6) AS half_total, round(avg(3 / 2.0), 6) AS half_n
  FROM lineitem GROUP BY 1""")
def pair_array_ops(spark, sf):
    t = table(spark, sf, "lineitem")

    def pair(c, n):
        return F.array(F.struct(F.col(c).alias("total"), F.lit(n).alias("n")))
    s = t.select("l_linestatus", A.pair_add(pair("l_quantity", 1), pair("l_tax", 2)).alias("s"))
    s = s.withColumn("m", A.pair_ratio(F.col("s"))).withColumn("h", A.pair_divide(F.col("s"), 2))
    return s.groupBy("l_linestatus").agg(
        A.neat(F.avg(F.col("m")[0])).alias("mean0"),
        A.neat(F.avg(F.col("h")[0]["total"])).alias("half_total"),
        A.neat(F.avg(F.col("h")[0]["n"])).alias("half_n"))


@query("float_cast", f"WITH {E} SELECT j, {r6('sum((v / 3)::FLOAT::DOUBLE)')} AS total FROM e GROUP BY j")
def float_cast(spark, sf):
    df = embeddings(spark, sf).withColumn("features", A.to_float(A.divide_scalar(_f, 3.0)))
    return to_long(df).groupBy("j").agg(A.neat(F.sum(F.col("v").cast("double"))).alias("total"))


@query("label_recode", """SELECT l_returnflag, (dense_rank() OVER (ORDER BY l_returnflag) - 1)::INTEGER AS label,
  CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END AS is_one, n
  FROM (SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY 1)""")
def label_recode(spark, sf):
    t = stats.index_labels(table(spark, sf, "lineitem").select("l_returnflag"), "l_returnflag")
    return (t.withColumn("is_one", stats.positive_label(F.col("label").cast("double")))
            .groupBy("l_returnflag", "label", "is_one").agg(F.count("*").alias("n")))


@query("take_columns", f"WITH {E} SELECT id, j, v FROM e WHERE j < 5")
def take_columns(spark, sf):
    return to_long(embeddings(spark, sf).withColumn("features", A.take_first(_f, 5)))


@query("pick_columns", f"""WITH {E} SELECT id, CASE j WHEN 60 THEN 0 WHEN 2 THEN 1 ELSE 2 END AS j, v
  FROM e WHERE j IN (60, 2, 17)""")
def pick_columns(spark, sf):
    return to_long(embeddings(spark, sf).withColumn("features", A.pick(_f, [60, 2, 17])))


@query("append_columns", f"""WITH {E} SELECT id, j, v FROM e UNION ALL SELECT id, j + 64, v / 2 FROM e""")
def append_cols(spark, sf):
    df = embeddings(spark, sf)
    return to_long(append_columns(df, df.withColumn("features", A.divide_scalar(_f, 2.0))))


@query("label_last", f"""WITH {E} SELECT id, j, v FROM e
  UNION ALL SELECT vec_id, 64, label::DOUBLE FROM embeddings""")
def label_last(spark, sf):
    return to_long(with_label(embeddings(spark, sf), "last"))


@query("label_first", f"""WITH {E} SELECT id, j + 1 AS j, v FROM e
  UNION ALL SELECT vec_id, 0, label::DOUBLE FROM embeddings""")
def label_first(spark, sf):
    return to_long(with_label(embeddings(spark, sf), "first"))


@query("dot_product", f"""WITH {E} SELECT id, {r6('sum(v * (j + 1))')} AS weighted,
  {r6('sum(v * v)')} AS squared FROM e GROUP BY id""")
def dot_product(spark, sf):
    w = A.literal_array(range(1, 65))
    return embeddings(spark, sf).select("id", A.neat(A.dot(_f, w)).alias("weighted"),
                                        A.neat(A.dot(_f, _f)).alias("squared"))


@query("feature_lookup", f"WITH {E} SELECT id, v FROM e WHERE j = 24")
def feature_lookup(spark, sf):
    return feature_column(embeddings(spark, sf), 24)


@query("list_product", """SELECT pos, round(avg(x), 6) AS x, round(avg(y), 6) AS y, count(*) AS n FROM (
  SELECT unnest([0, 1, 2, 3])::INTEGER AS pos,
    unnest([l_quantity, l_quantity, l_linenumber, l_linenumber]) AS x,
    unnest([l_discount, l_tax, l_discount, l_tax]) AS y FROM lineitem) GROUP BY pos""")
def list_product(spark, sf):
    a = F.array(F.col("l_quantity"), F.col("l_linenumber").cast("double"))
    pairs = table(spark, sf, "lineitem").select(
        F.posexplode(A.list_product(a, F.array("l_discount", "l_tax"))).alias("pos", "p"))
    return pairs.groupBy("pos").agg(A.neat(F.avg("p.x")).alias("x"), A.neat(F.avg("p.y")).alias("y"),
                                    F.count("*").alias("n"))
