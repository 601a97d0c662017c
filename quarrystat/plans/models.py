"""Least squares, classifiers, forests and the text model."""

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from quarrystat.functions import arrays as A
from quarrystat.operators import stats
from quarrystat.operators import supervised as M
from quarrystat.operators.reshape import split
from quarrystat.plans.registry import E, embeddings, query, table
from quarrystat.sources import synthetic


@query("ols_weights", """WITH a AS (SELECT l_quantity / 50 AS x, l_discount AS y, l_tax AS z,
  l_extendedprice / 100000 AS t FROM lineitem),
g AS (SELECT sum(x*x) AS a, sum(x*y) AS b, sum(x*z) AS c, sum(y*y) AS d, sum(y*z) AS e, sum(z*z) AS f,
  sum(x*t) AS p, sum(y*t) AS q, sum(z*t) AS r FROM a),
h AS (SELECT *, a*(d*f - e*e) - b*(b*f - c*e) + c*(b*e - c*d) AS det FROM g)
SELECT 0 AS j, round((p*(d*f - e*e) + q*(c*e - b*f) + r*(b*e - c*d)) / det, 6) AS w FROM h
UNION ALL SELECT 1, round((p*(c*e - b*f) + q*(a*f - c*c) + r*(b*c - a*e)) / det, 6) FROM h
UNION ALL SELECT 2, round((p*(b*e - c*d) + q*(b*c - a*e) + r*(a*d - b*b)) / det, 6) FROM h""")
def ols_weights(spark, sf):
    t = table(spark, sf, "lineitem").select(
        (F.col("l_extendedprice") / 100000).alias("label"),
        F.array(F.col("l_quantity") / 50, F.col("l_discount"), F.col("l_tax")).alias("features"))
    w = M.least_squares(t)
    return spark.createDataFrame([(j, float(x)) for j, x in enumerate(w)], "j int, w double").select(
        "j", A.neat(F.col("w")).alias("w"))


_TRUE = [((j * 7) % 11 - 5) / 5.0 for j in range(64)]


@query("ols_recovers", """SELECT j::INTEGER AS j, round(((j * 7) % 11 - 5) / 5.0, 6)::DOUBLE AS w
FROM generate_series(0, 63) t(j)""")
def ols_recovers(spark, sf):
    """Labels made from known weights give the weights back."""
    w = M.least_squares(synthetic.linear_labels(embeddings(spark, sf), _TRUE))
    return spark.createDataFrame([(j, float(x)) for j, x in enumerate(w)], "j int, w double").select(
        "j", A.neat(F.col("w")).alias("w"))


def _binary(spark, sf):
    """Odd labels against even ones."""
    return embeddings(spark, sf).withColumn("label", F.col("label") % 2)


@query("logreg_error")
def logreg_error(spark, sf):
    df = _binary(spark, sf).persist()
    try:
        out = stats.error_rate(M.predict(M.logistic(df), df)).first()
    finally:
        df.unpersist()
    return spark.createDataFrame([(out[0], out[1])], "error_rate double, accuracy double")


@query("logreg_moments", """WITH t AS (SELECT (l_extendedprice > 40000)::INTEGER AS y,
  [1, l_quantity / 50, l_discount * 10, l_tax * 10] AS x FROM lineitem)
SELECT (k - 1)::INTEGER AS j, round(avg(y * x[k]), 4) AS moment FROM t, generate_series(1, 4) g(k) GROUP BY k""")
def logreg_moments(spark, sf):
    """At the optimum the fitted probabilities have the labels' moments with every feature
    (j = 0: the intercept)."""
    t = table(spark, sf, "lineitem").select(
        (F.col("l_extendedprice") > 40000).cast("int").alias("label"),
        F.array(F.col("l_quantity") / 50, F.col("l_discount") * 10, F.col("l_tax") * 10).alias("features")).persist()
    try:
        p = vector_to_array("probability")[1]
        x = F.concat(F.array(F.lit(1.0)), vector_to_array("features"))
        out = M.predict(M.logistic(t, tol=1e-12), t).select(p.alias("p"), F.posexplode(x).alias("j", "x")).groupBy("j").agg(
            F.avg(F.col("p") * F.col("x")).alias("m")).collect()           # a row for each feature
    finally:
        t.unpersist()
    return spark.createDataFrame([(r["j"], r["m"]) for r in out], "j int, m double").select(
        "j", A.neat(F.col("m"), 4).alias("moment"))


@query("logreg_auc_sweep")
def logreg_auc_sweep(spark, sf):
    return M.logistic_sweep(_binary(spark, sf))


def _quantity(spark, sf):
    """Labels by the quantity, and one feature in whole numbers: the quantity, moved by the tax."""
    t = table(spark, sf, "lineitem")
    line = (F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 1_000_000 + F.col("l_partkey") * 100 + F.col("l_suppkey")
    x = F.col("l_quantity") + F.round(F.col("l_tax") * 100) * 3
    return t.select(line.alias("id"), (F.col("l_quantity") > 25).cast("int").alias("label"), F.array(x).alias("features"))


_QUANTITY = """t AS (SELECT ((l_orderkey * 8 + l_linenumber) * 1000000 + l_partkey * 100 + l_suppkey) AS id,
  (l_quantity > 25)::INTEGER AS y, l_quantity + round(l_tax * 100) * 3 AS x FROM lineitem)"""
_TEST = "('0x' || substr(md5(id::VARCHAR || ':0'), 1, 8))::BIGINT / 4294967296.0 >= 0.8"


@query("logreg_sweep_monotone", f"""WITH {_QUANTITY}, h AS (SELECT y, x FROM t WHERE {_TEST}),
k AS (SELECT y, avg(rn) OVER (PARTITION BY x) AS rk FROM (SELECT *, row_number() OVER (ORDER BY x) AS rn FROM h)),
a AS (SELECT (sum(rk) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * sum(1 - y)) AS auc FROM k)
SELECT unnest([0.01, 0.1, 1.0, 10.0, 100.0])::DOUBLE AS reg, round(auc, 5) AS auc FROM a""")
def logreg_sweep_monotone(spark, sf):
    """With one feature every penalty ranks the held-out rows as the feature does."""
    return M.logistic_sweep(_quantity(spark, sf)).select("reg", A.neat(F.col("auc"), 5).alias("auc"))


@query("svm_held_out", f"""WITH {_QUANTITY} SELECT y AS label, y::DOUBLE AS prediction, count(*) AS n FROM t WHERE {_TEST} GROUP BY ALL""")
def svm_held_out(spark, sf):
    """Classes a wide gap apart: every held-out row is told right."""
    t = _quantity(spark, sf)
    gap = F.array(F.get("features", F.lit(0)) + F.when(F.col("label") == 1, 50.0).otherwise(-50.0))
    train, test = split(t.withColumn("features", gap))
    train = train.persist()
    try:
        model = M.linear_svm(train, max_iter=20)
    finally:
        train.unpersist()
    return M.predict(model, test).groupBy(F.col("label").cast("int").alias("label"), "prediction").agg(F.count("*").alias("n"))


@query("svm_accuracy")
def svm_accuracy(spark, sf):
    df = synthetic.linear_labels(embeddings(spark, sf), _TRUE, noise=0.01, binary=True)
    df = df.withColumn("label", F.when(F.col("label") > 0, 1.0).otherwise(0.0)).persist()
    try:
        out = stats.error_rate(M.predict(M.linear_svm(df), df)).first()
    finally:
        df.unpersist()
    return spark.createDataFrame([(out[0], out[1])], "error_rate double, accuracy double")


@query("forest_fit")
def forest_fit(spark, sf):
    df = embeddings(spark, sf)
    return M.predict(M.forest(df), df).select("id", "label", A.neat(F.col("prediction")).alias("prediction"))


@query("forest_stump", """WITH t AS (SELECT l_linenumber + 0.5 * l_tax AS y,
  [l_linenumber::DOUBLE, l_discount, l_tax] AS x FROM lineitem),
c AS (SELECT k, x[k] AS v, count(*) AS n, sum(y) AS s FROM t, generate_series(1, 3) g(k) GROUP BY ALL),
r AS (SELECT k, v, sum(n) OVER w AS n, sum(s) OVER w AS s, sum(n) OVER (PARTITION BY k) AS tn, sum(s) OVER (PARTITION BY k) AS ts
  FROM c WINDOW w AS (PARTITION BY k ORDER BY v)),
best AS (SELECT * FROM r WHERE n < tn ORDER BY s * s / n + (ts - s) * (ts - s) / (tn - n) DESC, k, v LIMIT 1)
SELECT round(s / n, 4) AS prediction, n::BIGINT AS n FROM best
UNION ALL SELECT round((ts - s) / (tn - n), 4), (tn - n)::BIGINT FROM best""")
def forest_stump(spark, sf):
    """A forest of one tree with one split: the split of least variance over all rows."""
    t = table(spark, sf, "lineitem").select(
        (F.col("l_linenumber") + 0.5 * F.col("l_tax")).alias("label"),
        F.array(F.col("l_linenumber").cast("double"), "l_discount", "l_tax").alias("features")).persist()
    try:
        model = M.forest(t, trees=1, depth=1, bootstrap=False, features="all")
    finally:
        t.unpersist()
    return (M.predict(model, t).groupBy("prediction").agg(F.count("*").alias("n"))
            .select(A.neat(F.col("prediction"), 4).alias("prediction"), "n"))


def _texts(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "text").join(
        table(spark, sf, "labels").select("doc_id", F.col("quality").cast("double").alias("label")), "doc_id")


@query("tokenize", r"""SELECT doc_id, len(list_filter(w, lambda x: x <> ''))::BIGINT AS words,
  len(list_distinct(list_filter(w, lambda x: x <> '')))::BIGINT AS distinct_words
  FROM (SELECT doc_id, regexp_split_to_array(lower(text), '\s') AS w FROM documents)""")
def tokenize(spark, sf):
    t = M.tokens(table(spark, sf, "documents").select("doc_id", "text"))
    w = F.filter("words", lambda x: x != "")
    return t.select("doc_id", F.size(w).cast("bigint").alias("words"),
                    F.size(F.array_distinct(w)).cast("bigint").alias("distinct_words"))


@query("hashing_tf", r"""SELECT doc_id, len(regexp_split_to_array(rtrim(lower(text), E' \t\n\r\f'), '\s'))::DOUBLE AS total
  FROM documents""")
def hashing_tf(spark, sf):
    """Hashing moves no counts: they add up to the tokens of the text."""
    t = M.term_frequencies(table(spark, sf, "documents").select("doc_id", "text"), 1000)
    return t.select("doc_id", A.total(vector_to_array("features")).alias("total"))


@query("cv_text", """SELECT doc_id, text, quality::DOUBLE AS label, 2 AS classes, 1.0 AS total
FROM documents JOIN labels USING (doc_id) WHERE ('0x' || substr(md5(doc_id::VARCHAR || ':0'), 1, 8))::BIGINT / 4294967296.0 >= 0.8""")
def cv_text(spark, sf):
    """Chosen and fitted on four fifths of the labelled documents, shown on the others."""
    train, test = split(_texts(spark, sf), key="doc_id")
    train = train.persist()
    try:
        model = M.text_model(train)
    finally:
        train.unpersist()
    p = vector_to_array("probability")
    return model.transform(test).select("doc_id", "text", "label", F.size(p).alias("classes"), A.neat(A.total(p)).alias("total"))


_PLANTED = "CASE WHEN v > 0 THEN 1.0 ELSE 0.0 END"


@query("forest_importance_planted", f"""WITH {E}, y AS (SELECT id, {_PLANTED} AS y FROM e WHERE j = 17),
r AS (SELECT j, corr(v, y) ** 2 AS r FROM e JOIN y USING (id) GROUP BY j)
SELECT 63 AS pos, j FROM r ORDER BY r DESC, j LIMIT 1""")
def forest_importance_planted(spark, sf):
    """A label made of one feature: it comes last, as the most important one."""
    x = F.get("features", F.lit(17))
    df = embeddings(spark, sf).withColumn("label", F.when(x > 0, 1.0).otherwise(0.0))
    return M.forest_importance(df).where("pos = 63").select("pos", "j")
