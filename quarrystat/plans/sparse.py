"""Sparse rows: LibSVM files, sampled products and logistic regression without dense rows."""

from pyspark.ml.feature import Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import functions as F

from quarrystat.functions import arrays as A
from quarrystat.functions.draws import WORD, draw_sql, row_sql
from quarrystat.operators import decomposition, gram
from quarrystat.operators import supervised as M
from quarrystat.plans.registry import query, r6, table
from quarrystat.session import scratch_path
from quarrystat.sources import sparse, text

#: Columns of the hashed words, of the hashed parts, and the strength of the penalty.
WORDS, PARTS, REG = 47_000, 997, 1.0
_BUCKET = f"(('0x' || substr(md5(w), 1, 8))::BIGINT % {WORDS})::INTEGER"
_WORDS = f"""c AS (SELECT doc_id AS i, {_BUCKET} AS j, count(*)::DOUBLE AS v
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z]+')) AS w FROM documents) GROUP BY ALL)"""


def _labelled_words(spark, sf):
    """Labelled documents as sparse rows of hashed words, out of a LibSVM file."""
    rows = sparse.from_entries(sparse.word_entries(table(spark, sf, "documents"), WORDS), WORDS)
    labels = table(spark, sf, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("label"))
    path = scratch_path(spark, "words")
    text.write_libsvm(rows.join(labels, "id"), path)
    return text.read_libsvm(spark, path, WORDS)


@query("libsvm_sparse", f"""WITH {_WORDS} SELECT quality::DOUBLE AS label, j, count(*) AS n, sum(v) AS total
FROM c JOIN labels ON doc_id = i GROUP BY ALL""")
def libsvm_sparse(spark, sf):
    """47,000 columns, only the cells of the file."""
    cells = sparse.to_entries(_labelled_words(spark, sf), "label")
    return cells.groupBy("label", "j").agg(F.count("*").alias("n"), F.sum("v").alias("total"))


@query("logreg_sparse", f"""WITH {_WORDS}, y AS (SELECT doc_id, quality FROM labels WHERE doc_id IN (SELECT i FROM c)),
x AS (SELECT i, j, v / sqrt(sum(v * v) OVER (PARTITION BY i)) AS v FROM c)
SELECT j % 64 AS part, round(sum(v * quality) / (SELECT count(*) FROM y), 5) + 0.0 AS moment FROM x JOIN y ON doc_id = i GROUP BY 1
UNION ALL SELECT -1, round(avg(quality), 5) FROM y""")
def logreg_sparse(spark, sf):
    """Rows of length 1. At the optimum the fitted probabilities and the penalty's pull together
    have the labels' moments with every column (here by column modulo 64; part -1: intercept)."""
    t = Normalizer(inputCol="raw", outputCol="features").transform(
        _labelled_words(spark, sf).withColumnRenamed("features", "raw")).select("label", "features").persist()
    try:
        model = M.logistic(t, reg=REG, max_iter=200, tol=1e-9)
        var = t.agg(Summarizer.variance(F.col("features"))).first()[0]     # the penalty is on scaled columns
        p = M.predict(model, t).select(vector_to_array("probability")[1].alias("p"), "features")
        n = t.count()
        sums = sparse.to_entries(p, "p").groupBy("j").agg((F.sum(F.col("p") * F.col("v")) / n).alias("m"))
        pull = [(j, float(w * v * REG)) for j, (w, v) in enumerate(zip(model.coefficients, var)) if w]
        pull = spark.createDataFrame(pull, "j int, w double")
        parts = sums.join(pull, "j", "left").groupBy((F.col("j") % 64).alias("part")).agg(
            F.sum(F.col("m") + F.coalesce("w", F.lit(0.0))).alias("moment"))
        out = parts.unionByName(p.agg(F.lit(-1).alias("part"), F.avg("p").alias("moment"))).collect()   # 65 rows
    finally:
        t.unpersist()
    return spark.createDataFrame([(r["part"], r["moment"]) for r in out], "part int, moment double").select(
        "part", A.neat(F.col("moment"), 5).alias("moment"))


def _baskets(spark, sf):
    """Orders as sparse rows: the quantity bought of each hashed part."""
    t = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("i"), (F.col("l_partkey") % PARTS).cast("int").alias("j"),
                                            F.col("l_quantity").alias("value"))
    return sparse.from_entries(t, PARTS)


_BASKETS = f"""e AS MATERIALIZED (SELECT l_orderkey AS id, (l_partkey % {PARTS})::INTEGER AS j, sum(l_quantity)::DOUBLE AS v
  FROM lineitem GROUP BY ALL), c AS (SELECT j, sqrt(sum(v * v)) AS norm, sum(v) AS total FROM e GROUP BY j)"""
_DRAWS = f"""r AS (SELECT DISTINCT id, {row_sql('id', 7)} AS r FROM e),
u AS (SELECT id, j, v, {draw_sql('r', 'j')} / {WORD}.0::DOUBLE AS u FROM e JOIN r USING (id))"""


def _value(df):
    return df.select("i", "j", A.neat(F.col("value")).alias("value"))


@query("cosine_sparse", f"""WITH {_BASKETS}, k AS (SELECT id, j, v / norm AS v FROM e JOIN c USING (j))
SELECT a.j AS i, b.j AS j, {r6('sum(a.v * b.v)')} AS value FROM k a JOIN k b ON a.id = b.id AND a.j < b.j GROUP BY ALL""")
def cosine_sparse(spark, sf):
    """Parts bought together."""
    return _value(gram.cosine(_baskets(spark, sf)))


@query("cosine_dimsum_sparse", f"""WITH {_BASKETS}, {_DRAWS},
k AS MATERIALIZED (SELECT id, j, v / least(100.0, norm) AS v FROM u JOIN c USING (j) WHERE u < 100 / norm)
SELECT a.j AS i, b.j AS j, {r6('sum(a.v * b.v)')} AS value FROM k a JOIN k b ON a.id = b.id AND a.j < b.j GROUP BY ALL""")
def cosine_dimsum_sparse(spark, sf):
    """gamma small enough to sample columns of these norms."""
    return _value(gram.cosine_sampled(_baskets(spark, sf), gamma=10_000.0, seed=7))


@query("cov_sparse", f"""WITH {_BASKETS}, n AS (SELECT count(DISTINCT id)::DOUBLE AS n FROM e)
SELECT a.j AS i, b.j AS j, {r6('sum(a.v * b.v) / max(n) - max(ca.total) * max(cb.total) / max(n) / max(n)')} AS value
FROM e a JOIN e b ON a.id = b.id AND a.j <= b.j JOIN c ca ON ca.j = a.j JOIN c cb ON cb.j = b.j, n GROUP BY ALL""")
def cov_sparse(spark, sf):
    """Without gamma every cell is kept, so this is exact however many orders there are."""
    return _value(gram.covariance_sampled(_baskets(spark, sf)))


@query("svd_sparse", f"""WITH {_BASKETS} SELECT count(*) AS cells, round(sum(v * v), 2) AS energy FROM e""")
def svd_sparse(spark, sf):
    """All singular values of the sparse rows hold their energy; cells are counted beside."""
    rows = _baskets(spark, sf).persist()
    try:
        lam, _ = decomposition.top_eigen(rows, PARTS)
        n = sparse.to_entries(rows).count()
    finally:
        rows.unpersist()
    return spark.createDataFrame([(n, float(lam.sum()))], "cells long, energy double").select(
        "cells", A.neat(F.col("energy"), 2).alias("energy"))
