"""Column statistics, normalisation, bins, contingency tables, transposes."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarrystat.functions import arrays as A
from quarrystat.operators import binning, mutual_info, reshape, stats, supervised
from quarrystat.plans.registry import (E, L, bins_cte, embeddings, gappy, lineitem, query, r6,
                                       table)


def _v():
    return A.neat(F.col("v")).alias("v")




@query("col_means", f"WITH {L} SELECT j, {r6('avg(v)')} AS mean FROM e GROUP BY j")
def col_means(spark, sf):
    return stats.col_means(lineitem(spark, sf)).select("j", A.neat(F.col("mean")).alias("mean"))


@query("mean_shift", f"""WITH {E}, mu AS (SELECT j, avg(v) AS mean FROM e GROUP BY j)
SELECT id, j, {r6('v - mean')} AS v FROM e JOIN mu USING (j)""")
def mean_shift(spark, sf):
    return reshape.to_long(stats.mean_shift(embeddings(spark, sf))).select("id", "j", _v())


@query("col_l2", f"WITH {E} SELECT j, {r6('sqrt(sum(v * v))')} AS l2 FROM e GROUP BY j")
def col_l2(spark, sf):
    return stats.col_l2(embeddings(spark, sf)).select("j", A.neat(F.col("l2")).alias("l2"))


@query("col_summary", f"""WITH {E} SELECT j, count(*) AS n, {r6('min(v)')} AS lo, {r6('max(v)')} AS hi,
  {r6('avg(v)')} AS mean, {r6('sqrt(sum(v * v))')} AS l2 FROM e GROUP BY j""")
def col_summary(spark, sf):
    s = stats.col_summary(embeddings(spark, sf))
    return s.select("j", "n", *[A.neat(F.col(c)).alias(c) for c in ("lo", "hi", "mean", "l2")])


_UNIT = f"""WITH {E}, t AS (SELECT j, max(abs(v)) AS top FROM e GROUP BY j),
u AS (SELECT id, j, {r6('CASE WHEN top = 0 THEN 0 ELSE v / top END')} AS v FROM e JOIN t USING (j))"""


@query("unit_norm", f"""{_UNIT} SELECT id, j, v FROM u
  UNION ALL SELECT vec_id, 64, label::DOUBLE FROM embeddings""")
def unit_norm(spark, sf):
    return reshape.to_long(stats.unit_norm(embeddings(spark, sf), label="last")).select("id", "j", _v())


@query("unit_norm_long", f"{_UNIT} SELECT j, id, v FROM u")
def unit_norm_long(spark, sf):
    return stats.unit_norm_long(embeddings(spark, sf)).select("j", "id", _v())


@query("equal_freq_bins", f"WITH {E}, {bins_cte(5)} SELECT id, j, b FROM b")
def equal_freq_bins(spark, sf):
    out = binning.bins_long(binning.equal_frequency_bins(embeddings(spark, sf), 5))
    return out.select("id", "j", F.col("b").cast("int").alias("b"))


@query("equal_freq_bins_lineitem", f"""WITH {L}, {bins_cte(7)}
SELECT j, b, count(*) AS n FROM b GROUP BY j, b""")
def equal_freq_bins_lineitem(spark, sf):
    out = binning.equal_frequency_bins(lineitem(spark, sf).select("features"), 7)
    return (out.select(F.posexplode("bins").alias("j", "b"))
            .groupBy("j", F.col("b").cast("int").alias("b")).agg(F.count("*").alias("n")))


@query("bin_cuts_by_digits", f"""WITH {L}, {bins_cte(6)}
SELECT j, (i - 1)::INTEGER AS k, {r6('cs[i]')} AS cut FROM cuts, unnest(generate_series(1, 6)) AS t(i)""")
def bin_cuts_by_digits(spark, sf):
    """The scalable selection, used here below its usual size."""
    cuts = binning.equal_frequency_cuts(lineitem(spark, sf), 6, sort_limit=500)
    rows = [(j, k, float(v)) for j, row in enumerate(cuts) for k, v in enumerate(row)]
    return spark.createDataFrame(rows, "j int, k int, cut double").select(
        "j", "k", A.neat(F.col("cut")).alias("cut"))


@query("row_bins", f"""WITH {E}, a AS (SELECT id, j, v FROM e
  UNION ALL SELECT vec_id, 64, label::DOUBLE FROM embeddings),
c AS (SELECT id, list(v ORDER BY v) AS cs FROM (
  SELECT id, v, row_number() OVER (PARTITION BY id ORDER BY v) AS rn FROM a)
  WHERE rn % 13 = 0 GROUP BY id),
b AS (SELECT id, j, len(list_filter(cs, lambda x: x < v))::INTEGER AS b FROM a JOIN c USING (id))
SELECT id, b.j, b.b, l.b AS label FROM b JOIN b l USING (id) WHERE b.j < 64 AND l.j = 64""")
def row_bins(spark, sf):
    out = stats.row_bins(embeddings(spark, sf), 5)
    return out.select("id", F.posexplode("features").alias("j", "b"), "label")


@query("crosstab_counts", """SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY 1, 2""")
def crosstab_counts(spark, sf):
    return stats.crosstab_counts(table(spark, sf, "lineitem"), "l_returnflag", "l_linestatus")


@query("crosstab", """SELECT l_returnflag, count(*) FILTER (l_linestatus = 'F') AS "F",
  count(*) FILTER (l_linestatus = 'O') AS "O" FROM lineitem GROUP BY 1""")
def crosstab(spark, sf):
    return stats.crosstab(table(spark, sf, "lineitem"), "l_returnflag", "l_linestatus")


@query("entropy", f"""WITH {E}, {bins_cte(5)}, c AS (SELECT j, b, count(*)::DOUBLE AS c FROM b GROUP BY j, b)
SELECT j, {r6('-sum(c / n * log2(c / n))')} AS h FROM (SELECT *, sum(c) OVER (PARTITION BY j) AS n FROM c) GROUP BY j""")
def entropy(spark, sf):
    h = mutual_info.entropy(binning.equal_frequency_bins(embeddings(spark, sf), 5))
    return h.select("j", A.neat(F.col("h")).alias("h"))


@query("error_rate", """SELECT round(avg(CASE WHEN p <> quality THEN 1.0 ELSE 0 END), 6) AS error_rate,
  round(1 - avg(CASE WHEN p <> quality THEN 1.0 ELSE 0 END), 6) AS accuracy
  FROM (SELECT quality, CASE WHEN n_chars > 1000 THEN 1 ELSE 0 END AS p
    FROM labels JOIN documents USING (doc_id))""")
def error_rate(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "n_chars")
    t = table(spark, sf, "labels").join(d, "doc_id").select(
        F.col("quality").alias("label"), F.when(F.col("n_chars") > 1000, 1).otherwise(0).alias("prediction"))
    return stats.error_rate(t).select(*[A.neat(F.col(c)).alias(c) for c in ("error_rate", "accuracy")])


@query("auc_score", """WITH t AS (SELECT quality, n_chars FROM labels JOIN documents USING (doc_id)),
r AS (SELECT quality, avg(rn) OVER (PARTITION BY n_chars) AS rk FROM (
  SELECT *, row_number() OVER (ORDER BY n_chars) AS rn FROM t))
SELECT round((sum(rk) FILTER (quality = 1) - p * (p + 1) / 2) / (p * q), 6) AS auc
FROM r, (SELECT count(*) FILTER (quality = 1) AS p, count(*) FILTER (quality = 0) AS q FROM t) GROUP BY p, q""")
def auc_score(spark, sf):
    t = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id")
    return spark.createDataFrame([(round(supervised.auc(t, "n_chars", "quality"), 6),)], "auc double")


@query("transpose_long", f"""WITH {E}, p AS (SELECT *, row_number() OVER (PARTITION BY j ORDER BY id) - 1 AS pos FROM e)
SELECT j, pos, id, v, pos % 100 AS seen FROM p""")
def transpose_long(spark, sf):
    """With the place of a cell in its tile's run, as the rows come out."""
    t = reshape.transpose_sorted(embeddings(spark, sf), rows=100, cells=1700).withColumn("_m", F.monotonically_increasing_id())
    run = Window.partitionBy("j", F.expr("pos div 100")).orderBy("_m")
    return t.select("j", "pos", "id", "v", (F.row_number().over(run) - 1).cast("bigint").alias("seen"))


@query("transpose_entries", f"WITH {E} SELECT j AS i, id AS j, v AS value FROM e")
def transpose_entries(spark, sf):
    return reshape.transpose_entries(embeddings(spark, sf))


@query("transpose_chunks", f"""WITH {E}, r AS (SELECT vec_id AS id, row_number() OVER (ORDER BY vec_id) - 1 AS o FROM embeddings)
SELECT j, (o // 128)::BIGINT AS chunk, (o % 128)::INTEGER AS pos, v FROM e JOIN r USING (id)""")
def transpose_chunks(spark, sf):
    t = reshape.transpose_chunks(embeddings(spark, sf), 128)
    return t.select("j", "chunk", F.posexplode("values").alias("pos", "v"))


@query("feature_ranking", f"""WITH {E}, s AS (SELECT j, sqrt(sum(v * v)) AS l2 FROM e GROUP BY j)
SELECT (row_number() OVER (ORDER BY round(l2, 10) DESC, j) - 1)::INTEGER AS pos, j, {r6('l2')} AS score FROM s""")
def feature_ranking(spark, sf):
    from quarrystat.operators.selection import ranking
    return (ranking(stats.col_l2(embeddings(spark, sf)), "l2")
            .select("pos", "j", A.neat(F.col("score")).alias("score")))
