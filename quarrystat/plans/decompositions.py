"""SVD, PCA, QR, eigenpairs and incremental PCA."""

import numpy as np
from pyspark.sql import functions as F

from quarrystat.functions import arrays as A
from quarrystat.operators import decomposition as D
from quarrystat.operators import gram
from quarrystat.operators.reshape import to_long
from quarrystat.plans.registry import (COV, E, GRAM, L, embeddings, leading_cte, lineitem, query,
                                       r6, table)
from quarrystat.session import scratch_path
from quarrystat.streaming.ipca import StreamingPca

TOP = 2


def _vectors(spark, values, vec):
    rows = [(c, j, float(vec[j, c]), float(values[c])) for c in range(vec.shape[1])
            for j in range(vec.shape[0])]
    return spark.createDataFrame(rows, "comp int, j int, v double, weight double").select(
        "comp", "j", A.neat(F.col("v"), 5).alias("v"), A.neat(F.col("weight")).alias("weight"))


def _lead_sql(weight, with_clause, source="g"):
    return f"WITH {with_clause},\n{leading_cte(source, TOP)}\nSELECT comp, j, {r6('v', 5)} AS v, {r6(weight)} AS weight FROM lead"


_COV_N1 = COV.replace("g AS MATERIALIZED", "gg AS MATERIALIZED") + \
    ", g AS MATERIALIZED (SELECT i, j, css / (n - 1) AS value FROM gg)"
_COV_N = COV.replace("g AS MATERIALIZED", "gg AS MATERIALIZED") + \
    ", g AS MATERIALIZED (SELECT i, j, css / n AS value FROM gg)"


@query("svd_leading", _lead_sql("sqrt(lam)", GRAM))
def svd_leading(spark, sf):
    m = D.svd(embeddings(spark, sf), TOP)
    return _vectors(spark, m.s, m.v)


@query("svd_distributed", _lead_sql("sqrt(lam)", GRAM))
def svd_distributed(spark, sf):
    df = embeddings(spark, sf).select("id", "features").persist()
    try:
        m = D.svd(df, TOP, mode="distributed")
    finally:
        df.unpersist()
    return _vectors(spark, m.s, m.v)


@query("top_eigen", _lead_sql("lam", GRAM))
def top_eigen(spark, sf):
    df = embeddings(spark, sf).select("features").persist()
    try:
        lam, vec = D.top_eigen(df, TOP)
    finally:
        df.unpersist()
    return _vectors(spark, lam, vec)


@query("svd_left", f"""WITH {GRAM},
{leading_cte('g', TOP)}
SELECT id, comp AS j, {r6('sum(e.v * lead.v) / sqrt(max(lam))', 5)} AS v FROM e JOIN lead USING (j) GROUP BY id, comp""")
def svd_left(spark, sf):
    m = D.svd(embeddings(spark, sf), TOP, compute_u=True)
    return to_long(m.u, features="u").select("id", "j", A.neat(F.col("v"), 5).alias("v"))


@query("svd_energy", f"""WITH {E} SELECT {r6('sum(v * v)')} AS energy FROM e""")
def svd_energy(spark, sf):
    m = D.svd(embeddings(spark, sf), 64)
    return spark.createDataFrame([(float((m.s ** 2).sum()),)], "energy double").select(
        A.neat(F.col("energy")).alias("energy"))


@query("cov_svd", _lead_sql("lam", _COV_N))
def cov_svd(spark, sf):
    m = D.covariance_svd(embeddings(spark, sf), TOP)
    return _vectors(spark, m.s, m.v)


@query("pca_leading", _lead_sql("lam / (SELECT sum(value) FROM g WHERE i = j)", _COV_N1))
def pca_leading(spark, sf):
    m = D.pca(embeddings(spark, sf), TOP)
    return _vectors(spark, m.ratio, m.pc)


@query("pca_total_variance", f"""WITH {E}, s AS (SELECT j, var_samp(v) AS s FROM e GROUP BY j)
SELECT {r6('sum(s)')} AS total, 1.0::DOUBLE AS ratio FROM s""")
def pca_total_variance(spark, sf):
    m = D.pca(embeddings(spark, sf), 64)
    return spark.createDataFrame([(float(m.variance.sum()), float(m.ratio.sum()))],
                                 "total double, ratio double").select(
        *[A.neat(F.col(c)).alias(c) for c in ("total", "ratio")])


def _scores_sql(shift):
    return f"""WITH {_COV_N1},
{leading_cte('g', TOP)}
SELECT id, comp AS j, {r6('sum((e.v' + shift + ') * lead.v)', 5)} AS v
FROM e JOIN mu USING (j) JOIN lead USING (j) GROUP BY id, comp"""


def _scores(spark, sf, centred):
    df = embeddings(spark, sf)
    out = D.pca_project(df, D.pca(df, TOP), centred)
    return to_long(out, features="scores").select("id", "j", A.neat(F.col("v"), 5).alias("v"))


@query("pca_projection", _scores_sql(""))
def pca_projection(spark, sf):
    return _scores(spark, sf, False)


@query("pca_scores_centred", _scores_sql(" - mean"))
def pca_scores_centred(spark, sf):
    return _scores(spark, sf, True)


@query("qr_gram_check", f"WITH {GRAM} SELECT i, j, {r6('value')} AS value FROM g WHERE i <= j")
def qr_gram_check(spark, sf):
    _, r = D.tall_skinny_qr(embeddings(spark, sf), compute_q=False)
    return (gram.entry_table(spark, r.T @ r).filter("i <= j")
            .select("i", "j", A.neat(F.col("value")).alias("value")))


@query("qr_r_lineitem", """WITH a AS (SELECT l_quantity / 50 AS x, l_extendedprice / 100000 AS y, l_discount AS z FROM lineitem),
g AS (SELECT sum(x*x) AS xx, sum(x*y) AS xy, sum(x*z) AS xz, sum(y*y) AS yy, sum(y*z) AS yz, sum(z*z) AS zz FROM a),
r AS (SELECT *, sqrt(xx) AS r00, xy / sqrt(xx) AS r01, xz / sqrt(xx) AS r02 FROM g),
q AS (SELECT *, sqrt(yy - r01 * r01) AS r11, (yz - r01 * r02) / sqrt(yy - r01 * r01) AS r12 FROM r)
SELECT round(r00, 5) AS r00, round(r01, 5) AS r01, round(r02, 5) AS r02, round(r11, 5) AS r11,
  round(r12, 5) AS r12, round(sqrt(zz - r02 * r02 - r12 * r12), 5) AS r22 FROM q""")
def qr_r_lineitem(spark, sf):
    t = table(spark, sf, "lineitem").select(F.array(
        F.col("l_quantity") / 50, F.col("l_extendedprice") / 100000, F.col("l_discount")).alias("features"))
    _, r = D.tall_skinny_qr(t, compute_q=False)
    names = [f"r{i}{j}" for i in range(3) for j in range(i, 3)]
    row = tuple(float(r[int(n[1]), int(n[2])]) for n in names)
    return spark.createDataFrame([row], ", ".join(f"{n} double" for n in names)).select(
        *[A.neat(F.col(n), 5).alias(n) for n in names])


@query("qr_orthonormal", """SELECT i::INTEGER AS i, j::INTEGER AS j, CASE WHEN i = j THEN 1.0 ELSE 0.0 END::DOUBLE AS value
FROM generate_series(0, 63) t(i), generate_series(0, 63) u(j) WHERE i <= j""")
def qr_orthonormal(spark, sf):
    """Q'Q of the whole table is the identity."""
    q, _ = D.tall_skinny_qr(embeddings(spark, sf))
    g = gram.gramian(q.withColumnRenamed("q", "features"))
    return g.select("i", "j", A.neat(F.col("value")).alias("value"))


def _ipca_blocks(spark, sf, blocks, k=None):
    df = embeddings(spark, sf)
    state = None
    for b in range(blocks):
        state = D.ipca_fit(df.filter(F.col("id") % blocks == b), state, k=k)
    return state


def _state_rows(spark, state):
    energy = float((state.d ** 2).sum())
    rows = [(j, float(m), energy, float(state.n)) for j, m in enumerate(state.mu)]
    return spark.createDataFrame(rows, "j int, mean double, energy double, n double").select(
        "j", A.neat(F.col("mean")).alias("mean"), A.neat(F.col("energy"), 4).alias("energy"), "n")


_IPCA = f"""WITH {E}, mu AS (SELECT j, avg(v) AS mean, sum(v * v) - count(*) * avg(v) ** 2 AS ss,
  count(*)::DOUBLE AS n FROM e GROUP BY j)
SELECT j, {r6('mean')} AS mean, round((SELECT sum(ss) FROM mu), 4) AS energy, n FROM mu"""


@query("ipca_first", _IPCA)
def ipca_first(spark, sf):
    """The whole table as the first block."""
    return _state_rows(spark, D.ipca_fit(embeddings(spark, sf)))


@query("ipca_energy", _IPCA)
def ipca_energy(spark, sf):
    """Three updates keep mean, count and total variation of all rows."""
    return _state_rows(spark, _ipca_blocks(spark, sf, 3))


@query("ipca_leading", _lead_sql("sqrt(lam)", COV.replace("g AS MATERIALIZED", "gg AS MATERIALIZED")
                                 + ", g AS MATERIALIZED (SELECT i, j, css AS value FROM gg)"))
def ipca_leading(spark, sf):
    """Kept whole, the updated components are those of all rows together."""
    state = _ipca_blocks(spark, sf, 3)
    return _vectors(spark, state.d[:TOP], state.u[:, :TOP])


@query("ipca_stream", _IPCA)
def ipca_stream(spark, sf):
    """The same state, fed by a file stream."""
    base = scratch_path(spark, "ipca")
    schema = table(spark, sf, "embeddings").schema
    rows = (spark.readStream.schema(schema).parquet(f"{sf}/embeddings*.parquet")
            .select(F.col("embedding").cast("array<double>").alias("features")))
    return _state_rows(spark, StreamingPca(f"{base}/state").run(rows, f"{base}/checkpoint"))
